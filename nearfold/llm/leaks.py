"""Evaluation texts leaking into training text.

A passage of an item is ``window`` consecutive words. Every place of every document is embedded by the CGK random walk, which turns edit
distance into Hamming distance: a pointer walks along the words,
and at each step the word under it is written out and a random bit of (step, word) says whether the
pointer moves on. Bit-sampling LSH hashes some positions of the embedding; places of documents and passages
that agree in a hash are candidates, and an exact word-level edit distance decides.

Two windows that are equal have equal embeddings and meet in any repetition: without edits there is one, over the whole window. With edits, each
repetition has a fresh walk and fresh positions, and as many are made as the target recall asks for. Two tracks are the
same up to the first edit, so positions are drawn from a walk over half of the window, from its first word on in even repetitions and from its last word
back in odd ones: an edit in one half leaves the other's track as it is. A candidate place is compared with the passage as the begin
(or end) of spans of up to ``max_edits`` words less or more: a dropped word shortens a passage, an added one lengthens it.

Documents are never shuffled and are read once. Up to a bound, the items' hashes are broadcast. Beyond it hashes of both sides meet by
an equi-join: a broadcast filter of a fixed number of bits, set by the items' hashes, keeps the places of documents that can match, and only these are
exchanged, with their words, for the edit check.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut
from .words import Hasher, word_blocks, words

#: Items of up to so many characters are broadcast.
BROADCAST_CHARS = 16_000_000
#: Bits of the filter, as a power of two, and how many a hash sets.
FILTER_BITS = 28
FILTER_MARKS = 2
BLOCK_WORDS = 300_000
#: An odd 64-bit constant (golden ratio) for multiplicative hashing.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repetitions(max_edits: int, target_recall: float) -> int:
    """LSH repetitions for a target recall: all edits lie in the half that a repetition does not walk with a chance of about 2 ** -max_edits.

    Even, so that both directions come alike. Measured recall is in the tests.
    """
    if not max_edits:
        return 1
    return 2 * math.ceil(math.log(1 - target_recall) / math.log(1 - 0.5**max_edits) / 2)


def embed_hashes(hashes: np.ndarray, starts: np.ndarray, window: int, repetition: int, sampled: int, steps: int) -> np.ndarray:
    """The bit-sampling hash of the CGK embedding of hashes[s : s + window] for each s of ``starts``.

    ``sampled`` of the embedding's first ``steps`` positions, drawn from the repetition's number alone, go into the hash; the walk past the
    window's end writes a pad symbol.
    """
    rng = np.random.default_rng(7919 * (repetition + 1))
    positions = set(rng.choice(steps, min(sampled, steps), replace=False).tolist())
    odd = rng.integers(1, 2**63, steps, dtype=np.uint64) | np.uint64(1)
    last, at, ends = max(positions), starts.copy(), starts + window
    out = np.full(len(starts), np.uint64(repetition + 1))
    padded = np.append(hashes, np.uint64(0))
    for step in range(last + 1):
        symbol = padded[np.minimum(at, len(hashes))]
        if step >= window:
            symbol[at >= ends] = 0
        if step in positions:
            out = (out ^ symbol) * MULTIPLIER
            out ^= out >> np.uint64(32)
        if step < last:
            at += ((symbol * odd[step]) >> np.uint64(63)).astype(np.int64)
    return out


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Word-level Levenshtein distance, or most + 1 if it is larger."""
    if a == b:
        return 0
    if not most or abs(len(a) - len(b)) > most:
        return most + 1
    # Equal ends don't change the distance; one edit leaves at most one word between them.
    lo, x, y = 0, len(a), len(b)
    while lo < x and lo < y and a[lo] == b[lo]:
        lo += 1
    while x > lo and y > lo and a[x - 1] == b[y - 1]:
        x, y = x - 1, y - 1
    if most == 1:
        return min(max(x, y) - lo, 2)
    a, b = a[lo:x], b[lo:y]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


class ItemIndex:
    """All windows of a slice of items: sorted hashes per repetition, with the item and place of each."""

    def __init__(self, items: list[tuple[int, str]], window: int, reps: int, sampled: int, steps: int) -> None:
        hasher = Hasher()
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.window, self.sampled, self.steps = window, sampled, steps
        own = [np.arange(max(0, len(w) - window + 1)) for w in self.words]
        self.item = np.concatenate([np.full(len(o), k) for k, o in enumerate(own)]) if own else np.zeros(0, int)
        self.place = np.concatenate(own) if own else np.zeros(0, int)
        self.tables = []
        hashed = [hasher(w) for w in self.words]
        for r in range(reps):
            h = []
            for x, o in zip(hashed, own):
                if len(o):
                    h.append(embed_hashes(x[::-1], len(x) - o - window, window, r, sampled, steps) if r % 2 else embed_hashes(x, o, window, r, sampled, steps))
            h = np.concatenate(h) if h else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            self.tables.append((h[order], order))


def find_in(
    index: ItemIndex, docs: list[list[str]], max_edits: int, hasher: Hasher, begun: list[int] | None = None
) -> list[tuple[int, int, int, int]]:
    """(document number, item number, places of the document where a passage of the item begins, fewest edits).

    Only the first ``begun`` words of a document count as places.
    """
    window = index.window
    sizes = np.array([len(w) for w in docs], np.int64)
    begins = np.cumsum(sizes) - sizes
    # A span of n words within max_edits edits of a passage has at most max_edits words less or more.
    lengths = list(range(max(1, window - max_edits), window + max_edits + 1))
    many = np.maximum(sizes - lengths[0] + 1, 0)
    if not many.sum():
        return []
    hashes = np.concatenate([hasher(w) for w in docs])
    owner = np.repeat(np.arange(len(docs)), many)
    first = begins[owner]
    starts = first + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    ends = starts + lengths[0]
    limits = sizes if begun is None else np.minimum(sizes, begun)
    checked: set[tuple[int, int, int, int]] = set()
    found: dict[tuple[int, int], list] = {}
    for r, (sorted_hashes, order) in enumerate(index.tables):
        if not len(order):
            break
        back = r % 2
        walked = (hashes[::-1], len(hashes) - ends) if back else (hashes, starts)
        h = embed_hashes(*walked, window, r, index.sampled, index.steps)
        lo = np.searchsorted(sorted_hashes, h, "left")
        hit = np.flatnonzero(sorted_hashes[np.minimum(lo, len(order) - 1)] == h)
        hi = np.searchsorted(sorted_hashes, h[hit], "right")
        for s, top in zip(hit.tolist(), hi.tolist()):
            doc = int(owner[s])
            for w in order[lo[s] : top].tolist():
                k, p = int(index.item[w]), int(index.place[w])
                passage = index.words[k][p : p + window]
                for n in lengths:
                    begin = int((ends[s] - n if back else starts[s]) - first[s])
                    if begin < 0 or begin >= limits[doc] or begin + n > sizes[doc] or (doc, begin, n, w) in checked:
                        continue
                    checked.add((doc, begin, n, w))
                    e = edit_distance(docs[doc][begin : begin + n], passage, max_edits)
                    if e <= max_edits:
                        f = found.setdefault((doc, k), [set(), e])
                        f[0].add(begin)
                        f[1] = min(f[1], e)
    return [(d, k, len(v[0]), v[1]) for (d, k), v in found.items()]


def leaked(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 12, max_edits: int = 0, sampled: int | None = None, target_recall: float = 0.95, broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """(doc_id, item_id, windows, edits): documents that hold a passage of ``window`` words of an item.

    windows counts the places of the document where a span begins that matches a passage within ``max_edits`` word
    edits (changed, added or dropped words), edits is the fewest. With no edits the result is exact; with some, pairs may be missed at a rate
    of about 1 - target_recall per single matching window, and none is wrong. Null or blank texts, items
    shorter than the window, and texts shorter than it by more than max_edits words match nothing. Rows with repeated ids are all searched; a pair comes once.
    Texts are taken whole. Empty tables give no rows.
    """
    spark = docs.sparkSession
    if window < 1 or max_edits < 0:
        raise ValueError("window must be positive and max_edits not negative")
    if sampled is None:
        sampled = 2 * window if not max_edits else max(2, window // 3)
    reps, steps = repetitions(max_edits, target_recall), window if max_edits else 2 * window
    named = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null").distinct()
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).filter("doc_id is not null and text is not null")
    if size > broadcast_chars:
        return _leaked_by_join(texts, named, window, max_edits, sampled, reps, steps)
    index = ItemIndex([(r.item_id, r.text) for r in named.orderBy("item_id", "text").toLocalIterator()], window, reps, sampled, steps)
    shared = spark.sparkContext.broadcast(index.__dict__)

    def search(batches):
        known = ItemIndex.__new__(ItemIndex)
        known.__dict__.update(shared.value)
        hasher, ids = Hasher(), known.ids
        for held_ids, _, held, begun, _ in _document_blocks(batches, window, max_edits):
            got = [(held_ids[d], ids[k], n, e) for d, k, n, e in find_in(known, held, max_edits, hasher, begun)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got)], ["doc_id", "item_id", "windows", "edits"])

    found = texts.mapInArrow(search, "doc_id long, item_id long, windows long, edits long")
    return found.groupBy("doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.min("edits").alias("edits"))


def _document_blocks(batches, window: int, max_edits: int):
    """(ids, rows, words, begun, offsets) of texts, about ``BLOCK_WORDS`` words at a time.

    A very long text comes in blocks that share all words but one of the longest span; places among
    the shared words belong to the later block, so each is seen once and with all its spans. begun counts a block's own places, offsets
    the words of the text before it; rows number the texts where the batches do.
    """
    held: tuple[list, ...] = ([], [], [], [], [])
    total, shared_words = 0, window + max_edits - 1
    for b in batches:
        rows = b.column("row").to_pylist() if "row" in b.schema.names else [0] * b.num_rows
        for doc, row, text in zip(b.column("doc_id").to_pylist(), rows, b.column("text").to_pylist()):
            blocks = iter([words(text)] if len(text) <= BLOCK_WORDS else word_blocks(text, BLOCK_WORDS, shared_words))
            own, offset = next(blocks, None), 0
            while own is not None:
                later = next(blocks, None)
                places = len(own) if later is None else len(own) - shared_words
                if len(own) >= window - max_edits:
                    for column, x in zip(held, (doc, row, own, places, offset)):
                        column.append(x)
                    total += len(own)
                if total >= BLOCK_WORDS:
                    yield held
                    held, total = ([], [], [], [], []), 0
                own, offset = later, offset + places
    if held[0]:
        yield held


def _marks(hashes: np.ndarray) -> list[np.ndarray]:
    """The filter's bits of each hash."""
    return [((hashes * (MULTIPLIER + np.uint64(2 * m))) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for m in range(FILTER_MARKS)]


def _leaked_by_join(texts: DataFrame, named: DataFrame, window: int, max_edits: int, sampled: int, reps: int, steps: int) -> DataFrame:
    """The same for items of any size. A hash that very many places share is split by the engine's handling of skewed joins."""
    lengths = list(range(max(1, window - max_edits), window + max_edits + 1))

    def walk(found: list[str], hashes: np.ndarray, places: np.ndarray, width: int, r: int) -> np.ndarray:
        return embed_hashes(hashes[::-1], len(hashes) - places - width, window, r, sampled, steps) if r % 2 else embed_hashes(hashes, places, window, r, sampled, steps)

    def item_hashes(batches):
        hasher = Hasher()
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                w = words(text)
                places = np.arange(max(0, len(w) - window + 1))
                if len(places):
                    h = hasher(w)
                    spans = pa.array([" ".join(w[p : p + window]) for p in places.tolist()])
                    for r in range(reps):
                        yield pa.RecordBatch.from_arrays([pa.array(walk(w, h, places, window, r).view(np.int64)), pa.array(np.full(len(places), item)), spans], ["hash", "item_id", "passage"])

    items = cut(named.mapInArrow(item_hashes, "hash long, item_id long, passage string").distinct())

    def bits(batches):
        for b in batches:
            at = np.unique(np.concatenate(_marks(b.column("hash").to_numpy().view(np.uint64)))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).view(pa.int64())], ["word", "bits"])

    # At most 2 ** (FILTER_BITS - 6) rows of 16 bytes, whatever the items.
    set_ = items.select("hash").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def place_hashes(batches):
        hasher, filter_ = Hasher(), shared.value
        for ids, rows, docs, begun, offsets in _document_blocks(batches, window, max_edits):
            for doc, row, w, own, offset in zip(ids, rows, docs, begun, offsets):
                places, h = np.arange(len(w) - lengths[0] + 1), hasher(w)
                for r in range(reps):
                    x = walk(w, h, places, lengths[0], r)
                    hit = np.ones(len(x), bool)
                    for at in _marks(x):
                        hit &= (filter_[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                    hit = np.flatnonzero(hit)
                    if len(hit):
                        # The words of the longest span, from its begin or, of walks from the end, up to its end.
                        cuts = [(max(0, p + lengths[0] - lengths[-1]), p + lengths[0]) if r % 2 else (p, p + lengths[-1]) for p in hit.tolist()]
                        columns = [pa.array(x[hit].view(np.int64))] + [pa.array([v] * len(hit), pa.int64()) for v in (doc, row, offset, own, r % 2)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([a for a, _ in cuts]), pa.array([" ".join(w[a:z]) for a, z in cuts])], ["hash", "doc_id", "row", "offset", "own", "back", "begin", "span"])

    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    places = numbered.mapInArrow(place_hashes, "hash long, doc_id long, row long, offset long, own long, back long, begin long, span string")

    def verify(batches):
        for b in batches:
            out = []
            for x in b.to_pylist():
                span, passage = x["span"].split(" "), x["passage"].split(" ")
                for n in lengths:
                    at = len(span) - n if x["back"] else 0
                    if 0 <= at and n <= len(span) and x["begin"] + at < x["own"]:
                        e = edit_distance(span[at : at + n], passage, max_edits)
                        if e <= max_edits:
                            out.append((x["doc_id"], x["item_id"], x["row"], x["offset"] + x["begin"] + at, e))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["doc_id", "item_id", "row", "place", "edits"])

    met = places.join(items, "hash").mapInArrow(verify, "doc_id long, item_id long, row long, place long, edits long")
    return met.groupBy("doc_id", "item_id", "row", "place").agg(F.min("edits").alias("edits")).groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.min("edits").alias("edits"))
