"""Splitting oversized texts at natural boundaries, in parallel within a text.

A long text is worked on in ranges. A range begins at the first safe place at or after its nominal start: a place where the tokenizer
always cuts, as the characters on both sides are of different classes. Both neighbours find the same place, however far it is, so the
tokens of the ranges are those of the text. Workers list the boundaries of their ranges with token
numbers; prefix sums of the ranges' token counts turn these into places on the token axis of the text, and
a pass over the stitched boundary table, in order and with a window of one piece, chooses the cuts. Pieces are emitted by offset.

Texts of a table cell come as characters; texts that fit one range are finished where they are scanned. Files come as
byte ranges: no worker reads more of a file than its range and what lies between it and the next safe places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.blocks import cut
from ..sources.files import ByteFile
from .tokens import default_path, token_starts

#: Characters of a range of a cell, bytes of a range of a file, and how much is read at a time in search of a safe place.
RANGE = 65_536
FILE_RANGE = 1 << 20
STEP = 4_096
#: The longest token of the vocabularies has so many characters at most.
TOKEN_CHARS = 128
#: Of word ends, and of places inside words, the last in each so many characters of a cell (bytes of a file) is listed.
BLOCK = 128
#: How many of a piece's last tokens are searched first.
REACH = 192
#: Characters seen before a place to tell what ends there.
SEEN = 16
#: Places where the pre-tokenizer cuts whatever follows: before a space, or where letters, digits and others meet (no apostrophe, which may begin a suffix).
_SAFE = regex.compile(
    r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)
_PARAGRAPH = regex.compile(r"\n[ \t\r]*\n[ \t\r]*$")
_SENTENCE = regex.compile(r"""[.!?…。！？][)"'»”’」]*\s*$""")


def safe_place(text: str, at: int) -> int:
    """The first safe place of ``text`` at or after ``at``; its length if there is none."""
    if at <= 0:
        return 0
    m = _SAFE.search(text, at) if at < len(text) else None
    return m.start() if m else len(text)


def safe_before(text: str, at: int) -> int:
    """A safe place of ``text`` before ``at``, not far from it if there is one; else 0."""
    back = STEP
    while at - back > 0:
        found = _SAFE.search(text, at - back, at + 1)
        if found and found.start() < at:
            return found.start()
        back *= 4
    return 0


def boundary(text: str, at: int) -> int:
    """How natural it is to end a piece before character ``at``: 4 paragraph, 3 sentence, 2 line, 1 word, 0 none."""
    before, after = text[max(0, at - SEEN) : at], text[at : at + 1]
    if not before or not after:
        return 4
    if not after.isspace() and _PARAGRAPH.search(before):
        return 4
    if _SENTENCE.search(before) and (after.isspace() or before[-1].isspace() or before[-1] in "。！？」"):
        return 3
    if before[-1] == "\n":
        return 2
    return int(after.isspace() or before[-1].isspace())


def list_boundaries(text: str, head: int, lo: int, hi: int, overlap: int, path: str) -> tuple[int, np.ndarray]:
    """(tokens of text[lo:hi], rows (token, char, kind, back_token, back_char)) for places from ``lo`` up to ``hi``.

    Tokens are counted from ``lo``; those before it, from ``head``, are negative. head, lo and hi are safe places; some
    characters outside are seen. back is the last token boundary at a character's start at least ``overlap`` tokens earlier.
    """
    before = head + token_starts(text[head:lo], path) if head < lo else np.zeros(0, np.int64)
    own = lo + token_starts(text[lo:hi], path)
    starts, first = np.concatenate([before, own]), len(before)
    if not len(own):
        return 0, np.zeros((0, 5), np.int64)
    # A token inside a character shares the start of the one before it.
    clean = np.append(True, starts[1:] != starts[:-1])
    last_clean = np.maximum.accumulate(np.where(clean, np.arange(len(starts)), 0))
    places = first + np.flatnonzero(clean[first:])
    kinds = np.array([boundary(text, int(c)) for c in starts[places]])
    if lo == 0 and len(kinds):
        kinds[0] = 0
    back = last_clean[np.maximum(places - overlap, 0)]
    return len(own), np.stack([places - first, starts[places], kinds, back - first, starts[back]], 1)


def thin(rows: np.ndarray) -> np.ndarray:
    """Rows (token, at, kind, ...) in order: all of kind 2 and more, and of the others the last of each kind in every block of the text.

    Thinning parts and then the whole is the same as thinning the whole.
    """
    if not len(rows):
        return rows
    block, keep = rows[:, 1] // BLOCK, rows[:, 2] >= 2
    for kind in (0, 1):
        own = np.flatnonzero(rows[:, 2] == kind)
        if len(own):
            keep[own[np.append(block[own][1:] != block[own][:-1], True)]] = True
    return rows[keep]


class Cutter:
    """Chooses the cuts of one text from its boundary table, given in order; holds the boundaries of one piece.

    A cut is the best boundary of a piece's last tokens if that is a sentence's or paragraph's end; else the last such end further back; else the last
    line end, word end or token.
    """

    def __init__(self, total: int, limit: int, margin: int) -> None:
        self.total, self.most, self.done = total, limit - margin, total <= limit
        self.begin, self.held = (0, 0), np.zeros((0, 5), np.int64)
        #: (start token, start, end token, end) of pieces; the last has end -1.
        self.pieces: list[tuple[int, int, int, int]] = []

    def add(self, rows: np.ndarray) -> None:
        if not self.done:
            self.held = thin(np.concatenate([self.held, rows]))
            while not self.done and self._whole():
                self._cut()

    def _whole(self) -> bool:
        """Whether every block with a boundary within reach has been seen to its end."""
        within = self.held[self.held[:, 0] <= self.begin[0] + self.most]
        return len(within) < len(self.held) and self.held[-1, 1] // BLOCK > (within[-1, 1] // BLOCK if len(within) else -1)

    def end(self) -> list[tuple[int, int, int, int]]:
        while not self.done:
            self._cut()
        if self.total > 0:
            self.pieces.append((*self.begin, self.total, -1))
        return self.pieces

    def _cut(self) -> None:
        top = self.begin[0] + self.most
        if self.total <= top:
            self.done = True
            return
        here = self.held[(self.held[:, 0] <= top) & (self.held[:, 0] > self.begin[0] + self.most // 4)]
        late = here[(here[:, 0] > top - REACH) & (here[:, 2] >= 3)]
        if len(late):
            best = late[np.lexsort((late[:, 0], late[:, 2]))[-1]]
        else:
            best = here[np.lexsort((here[:, 0], np.minimum(here[:, 2], 3)))[-1]]
        self.pieces.append((*self.begin, int(best[0]), int(best[1])))
        self.begin = int(best[3]), int(best[4])
        self.held = self.held[self.held[:, 0] > best[0]]


def _check(limit: int, overlap: int, margin: int) -> None:
    if overlap < 0 or limit < max(256, 8 * (overlap + margin)):
        raise ValueError("limit must be at least 256 and eight times overlap and margin together")


_NAMES = ["id", "range_no", "tokens", "token", "at", "kind", "back_token", "back_at"]
_BOUNDARIES = "id {0}, range_no long, tokens long, token array<long>, at array<long>, kind array<long>, back_token array<long>, back_at array<long>"


def _boundary_batch(ids: list, numbers: list, found: list[tuple[int, np.ndarray]], id_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array([r[:, c] for _, r in found], pa.list_(pa.int64())) for c in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(numbers, pa.int64()), pa.array([n for n, _ in found], pa.int64()), *columns], _NAMES)


def stitch(ranges: DataFrame, limit: int, margin: int) -> DataFrame:
    """(id, piece_no, start, end, tokens) from the boundaries of ranges: prefix sums, then one pass per text over its table.

    end is -1 for the end of the text. A text within the limit gives nothing.
    """
    id_type = ranges.schema["id"].dataType.simpleString()
    counted = cut(ranges)
    whole = Window.partitionBy("id")
    sums = counted.select("id", "range_no", "tokens").withColumn("before", F.sum("tokens").over(whole.orderBy("range_no")) - F.col("tokens")).withColumn("total", F.sum("tokens").over(whole))
    long = sums.filter(F.col("total") > limit).drop("tokens")
    placed = counted.join(long, ["id", "range_no"]).repartition("id").sortWithinPartitions("id", "range_no")

    def choose(batches):
        cutter, at, out = None, None, []

        def ended():
            return [(at, k, s, e, z - a) for k, (a, s, z, e) in enumerate(cutter.end())] if cutter else []

        for b in batches:
            c = {k: b.column(k).to_pylist() for k in ("id", "before", "total")}
            for i, (key, before, total) in enumerate(zip(*c.values())):
                if cutter is None or key != at:
                    out += ended()
                    cutter, at = Cutter(total, limit, margin), key
                rows = np.stack([b.column(k)[i].values.to_numpy() for k in ("token", "at", "kind", "back_token", "back_at")], 1)
                cutter.add(rows + np.array([before, 0, 0, before, 0]))
            if out:
                yield _piece_batch(out)
                out = []
        out += ended()
        if out:
            yield _piece_batch(out)

    def _piece_batch(rows):
        kinds = [b_type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["id", "piece_no", "start", "end", "tokens"])

    b_type = pa.int64() if id_type == "bigint" else pa.string()
    return placed.mapInArrow(choose, f"id {id_type}, piece_no long, start long, end long, tokens long")


def split_oversized(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, path: str | None = None, margin: int = 8,
    range_chars: int | None = None,
) -> DataFrame:
    """(doc_id, piece_no, start, end, tokens, text) of every text of more than ``limit`` tokens.

    Pieces have at most ``limit`` tokens, cover the text without gaps, and end before character ``end`` at
    a natural boundary (see ``Cutter``): paragraph, sentence, line, word, else between characters.
    A piece begins ``overlap`` tokens before the end of the one before it (up to 3 more where a token
    boundary lies inside a character). tokens counts the tokens of the whole text that lie in the piece;
    counted by itself a piece may differ by a few where it begins inside a word, for which ``margin``
    tokens are kept free. Ids must be unique; rows with null ids, and texts null, empty or within the limit, give
    nothing. Pieces do not depend on ``range_chars``.

    Texts of at most ``range_chars`` are split in their scan task and never exchanged. Longer ones are cut into ranges, which go to all tasks.
    """
    _check(limit, overlap, margin)
    where, size = path or default_path(), range_chars or RANGE
    # Every token holds at least one byte: texts of at most limit bytes are passed over unread.
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & (F.octet_length("text") > limit))
    out = "id long, piece_no long, start long, end long, tokens long, text string"

    def whole(batches):
        for b in batches:
            rows = []
            for key, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                n, places = list_boundaries(t, 0, 0, len(t), overlap, where)
                if n > limit:
                    cutter = Cutter(n, limit, margin)
                    cutter.add(places)
                    for k, (a, s, z, e) in enumerate(cutter.end()):
                        e = len(t) if e < 0 else e
                        rows.append((key, k, s, e, z - a, t[s:e]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["id", "piece_no", "start", "end", "tokens", "text"])

    small = named.filter(F.length("text") <= size).mapInArrow(whole, out)
    large = named.filter(F.length("text") > size)
    names = ["id", "range_no", "at", "head", "lo", "hi", "part"]
    left = (overlap + 4) * TOKEN_CHARS

    def deal(batches):
        for b in batches:
            for key, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ends = [safe_place(t, at) for at in range(0, len(t), size)] + [len(t)]
                for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
                    if lo < hi:
                        head = safe_before(t, max(0, lo - left)) if lo else 0
                        at = max(0, head - SEEN)
                        row = (key, k, at, head - at, lo - at, hi - at, t[at : hi + 1])
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    def describe(batches):
        for b in batches:
            c = {k: b.column(k).to_pylist() for k in names}
            found = []
            for at, head, lo, hi, part in zip(c["at"], c["head"], c["lo"], c["hi"], c["part"]):
                n, rows = list_boundaries(part, head, lo, hi, overlap, where)
                found.append((n, thin(rows + np.array([0, at, 0, 0, at]))))
            yield _boundary_batch(c["id"], c["range_no"], found, pa.int64())

    dealt = large.mapInArrow(deal, "id long, range_no long, at long, head long, lo long, hi long, part string")
    pieces = stitch(dealt.repartition("id", "range_no").mapInArrow(describe, _BOUNDARIES.format("long")), limit, margin)
    listed = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "tokens"))).alias("pieces"))

    def emit(batches):
        for b in batches:
            for key, t, listed_ in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), b.column("pieces").to_pylist()):
                for lo in range(0, len(listed_), 256):
                    rows = [(key, p["piece_no"], p["start"], len(t) if p["end"] < 0 else p["end"], p["tokens"]) for p in listed_[lo : lo + 256]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*rows)), pa.array([t[r[2] : r[3]] for r in rows])], ["id", "piece_no", "start", "end", "tokens", "text"])

    cuts = large.join(listed, "id").mapInArrow(emit, out)
    return small.unionByName(cuts).withColumnRenamed("id", "doc_id")


class FileText(ByteFile):
    """Byte ranges of one UTF-8 file, read as text."""

    def character(self, at: int) -> int:
        """The first character's start at or after byte ``at``."""
        if not 0 < at < self.size:
            return min(max(at, 0), self.size)
        for i, x in enumerate(self.file.read_at(4, at)):
            if x & 0xC0 != 0x80:
                return at + i
        return min(at + 4, self.size)

    def text(self, lo: int, hi: int) -> str:
        return self.file.read_at(hi - lo, lo).decode("utf-8", "replace")

    def safe_place(self, at: int) -> int:
        """The first safe place at or after byte ``at``."""
        if at <= 0:
            return 0
        at, step = self.character(at), STEP
        # The character before is seen as well, whose class decides.
        lo = at - 1
        while lo > 0 and self.file.read_at(1, lo)[0] & 0xC0 == 0x80:
            lo -= 1
        while at < self.size:
            hi = self.character(min(self.size, at + step))
            t = self.text(lo, hi)
            place = safe_place(t, 1)
            if place < len(t):
                return lo + len(t[:place].encode())
            if hi == self.size:
                break
            step *= 4
        return self.size

    def safe_before(self, at: int) -> int:
        back = STEP
        while at - back > 0:
            place = self.safe_place(at - back)
            if place < at:
                return place
            back *= 4
        return 0


def split_files(
    spark: SparkSession, files: str | list[str], limit: int = 1024, overlap: int = 64, path: str | None = None, margin: int = 8, range_bytes: int = FILE_RANGE
) -> DataFrame:
    """(path, piece_no, start, end, tokens, text) of UTF-8 text files of more than ``limit`` tokens; start and end are bytes.

    Cuts are chosen as in ``split_oversized``. Files are planned from their lengths alone, in ranges of
    ``range_bytes`` that go to all tasks; a task reads its range, its pieces, and no file whole. Files must be valid UTF-8; empty ones and those within the limit give nothing.
    """
    _check(limit, overlap, margin)
    where = path or default_path()
    left = (overlap + 4) * TOKEN_CHARS
    lengths = spark.read.format("binaryFile").load(files).select(F.col("path").alias("id"), "length").filter(F.col("length") > limit)
    plan = lengths.select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / range_bytes))).alias("range_no"))
    tasks = max(spark.sparkContext.defaultParallelism, 1)

    def describe(batches):
        for b in batches:
            for key, k in zip(b.column("id").to_pylist(), b.column("range_no").to_pylist()):
                with FileText(key) as f:
                    lo, hi = f.safe_place(k * range_bytes), f.safe_place(min(f.size, (k + 1) * range_bytes))
                    if lo >= hi:
                        continue
                    head = f.safe_before(max(0, lo - left)) if lo else 0
                    at = f.character(max(0, head - 4 * SEEN))
                    end = f.character(min(f.size, hi + 1))
                    raw = f.file.read_at(end - at, at)
                    t = raw.decode("utf-8", "replace")
                    chars = [len(raw[: x - at].decode("utf-8", "replace")) for x in (head, lo, hi)]
                    n, rows = list_boundaries(t, *chars, overlap, where)
                    # Characters to bytes: where each character begins.
                    begins = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw)) + at
                    rows[:, 1], rows[:, 4] = begins[rows[:, 1]], begins[rows[:, 4]]
                yield _boundary_batch([key], [k], [(n, thin(rows))], pa.string())

    pieces = stitch(plan.repartition(tasks * 4, "id", "range_no").mapInArrow(describe, _BOUNDARIES.format("string")), limit, margin)

    def emit(batches):
        for b in batches:
            rows = b.to_pylist()
            for lo in range(0, len(rows), 256):
                out = []
                for x in rows[lo : lo + 256]:
                    with FileText(x["id"]) as f:
                        end = f.size if x["end"] < 0 else x["end"]
                        out.append((x["id"], x["piece_no"], x["start"], end, x["tokens"], f.text(x["start"], end)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["path", "piece_no", "start", "end", "tokens", "text"])

    spread = cut(pieces).repartition(tasks * 4, "id", F.floor(F.col("piece_no") / 64))
    return spread.mapInArrow(emit, "path string, piece_no long, start long, end long, tokens long, text string")
