"""Binary vector files as a Spark data source: ``spark.read.format("vecfile")``.

Kinds (option ``kind``), all little-endian:
  bin          count and dimension (two 32-bit integers), then the rows; option ``offset`` skips bytes before them
  fvecs, bvecs, ivecs   each row preceded by its dimension (32-bit); elements of 4, 1 and 4 bytes
  truth        queries and k, then their neighbour ids (32-bit), then, if the file is long enough, distances
  range_truth  queries and total, a count per query, then the ids
  graph        size (64-bit), largest degree and start (32-bit), hidden nodes (64-bit), then degree and ids per node
  permutation  count (64-bit), then the physical id of each logical id (32-bit)

Option ``element`` is float, int8, uint8, uint32 or int32 for bin; ids are row numbers. Fixed-stride kinds are read in
row ranges, one task each (option ``rows_per_task``), and comparisons of the id with constants narrow the ranges. Reading
past the end, or a file of the wrong length, is an error. bin, fvecs, bvecs, ivecs, graph and permutation can be written: rows in the
order of partitions. Paths may be URIs of any file system that Arrow knows.

A single file is what other programs read; its parts are joined on commit, by one process. With the option ``folder`` (bin, fvecs, bvecs
and ivecs) each task's part is a file of its kind by itself, and the commit only writes their row counts beside them: nothing passes through the driver, and
reading a folder gives the rows of its parts in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import files

#: The list of a folder's parts.
MANIFEST = "_parts.json"
ELEMENTS = {"float": "<f4", "int8": "i1", "uint8": "u1", "uint32": "<u4", "int32": "<i4"}
COLUMN = {"float": "float", "int8": "tinyint", "uint8": "smallint", "uint32": "bigint", "int32": "int"}
_ARROW = {"float": pa.float32(), "int8": pa.int8(), "uint8": pa.int16(), "uint32": pa.int64(), "int32": pa.int32()}
_ROWED = {"fvecs": "float", "bvecs": "uint8", "ivecs": "int32"}
_SCHEMAS = {
    "truth": "query_id long, rank int, id long, distance double",
    "range_truth": "query_id long, id long",
    "graph": "id long, nbrs array<long>, entry boolean",
    "permutation": "logical_id long, physical_id long",
}


def header(path: str, offset: int = 0) -> tuple[int, int]:
    """Count and dimension of a bin file, or of a folder of them."""
    if files.is_folder(path):
        parts = manifest(path)
        return sum(n for _, n in parts["parts"]), parts["dim"]
    with files.ByteFile(path) as f:
        if f.size < offset + 8 or (got := f.array("<i4", 2, offset)).min() < 0:
            raise ValueError(f"{path}: no header")
    return int(got[0]), int(got[1])


def manifest(path: str) -> dict:
    """parts (file name, rows) in order, dim and kind of a folder."""
    with files.ByteFile(f"{path}/{MANIFEST}") as f:
        return json.loads(f.file.read_at(f.size, 0))


class Rows(InputPartition):
    """Rows begin .. end of a file, whose first row has the number ``first``."""

    def __init__(self, begin: int, end: int, path: str, first: int = 0) -> None:
        self.begin, self.end, self.path, self.first = begin, end, path, first


class VecFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecfile"

    @property
    def kind(self) -> str:
        return self.options.get("kind", "bin")

    @property
    def element(self) -> str:
        e = _ROWED.get(self.kind) or self.options.get("element", "float")
        if e not in ELEMENTS:
            raise ValueError(f"unknown element {e!r}")
        return e

    def schema(self) -> str:
        if self.kind in _SCHEMAS:
            return _SCHEMAS[self.kind]
        if self.kind != "bin" and self.kind not in _ROWED:
            raise ValueError(f"unknown kind {self.kind!r}")
        return f"id long, vec array<{COLUMN[self.element]}>"

    def reader(self, schema) -> DataSourceReader:
        return VecReader(self.options.get("path"), self.kind, self.element, int(self.options.get("offset", 0)), int(self.options.get("rows_per_task", 100_000)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if self.kind not in ("bin", "graph", "permutation", *_ROWED):
            raise ValueError(f"{self.kind} files cannot be written")
        folder = self.options.get("folder", "false").lower() == "true"
        if folder and self.kind in ("graph", "permutation"):
            raise ValueError(f"{self.kind} files cannot be folders")
        return VecWriter(self.options.get("path"), self.kind, self.element, overwrite, folder)


class VecReader(DataSourceReader):
    def __init__(self, path: str, kind: str, element: str, offset: int, rows_per_task: int) -> None:
        self.path, self.kind, self.element, self.offset, self.step = path, kind, element, offset, rows_per_task
        self.low, self.high = 0, None
        item = np.dtype(ELEMENTS[element]).itemsize
        #: (path, rows) of the files to read.
        self.files: list[tuple[str, int]] = []
        if files.is_folder(path):
            parts = manifest(path)
            if parts["kind"] != kind:
                raise ValueError(f"{path}: a folder of {parts['kind']} files")
            self.dim, self.files = parts["dim"], [(f"{path}/{name}", n) for name, n in parts["parts"]]
            return
        with files.ByteFile(path) as f:
            size, n = f.size, 1
            if kind in _ROWED:
                self.dim = int(f.array("<i4", 1, 0)[0]) if size else 0
                n, rest = divmod(size, 4 + self.dim * item)
                if rest:
                    raise ValueError(f"{path}: {rest} bytes left over")
            elif kind == "permutation":
                n = int(f.array("<u8", 1, 0)[0])
                if size != 8 + 4 * n:
                    raise ValueError(f"{path}: wrong length")
            elif kind != "graph":
                n, self.dim = header(path, offset)
                with_ids = 8 + 4 * n * self.dim
                if kind == "bin" and size < offset + 8 + n * self.dim * item:
                    raise ValueError(f"{path}: too short for {n} rows of {self.dim}")
                if kind == "truth" and size not in (with_ids, with_ids + 4 * n * self.dim):
                    raise ValueError(f"{path}: wrong length")
                self.far = kind == "truth" and size > with_ids
                # Where each range's ids begin; the counts are read once, here.
                self.before = np.append(0, np.cumsum(f.array("<i4", n, 8), dtype=np.int64))[:: max(1, rows_per_task)] if kind == "range_truth" else None
        self.n, self.files = n, [(path, n)]

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if self.kind in ("bin", *_ROWED) and getattr(f, "attribute", None) == ("id",) and isinstance(getattr(f, "value", None), int):
                v = f.value
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = v + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                    continue
            yield f

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for path, n in self.files:
            low, high = max(self.low - first, 0), n if self.high is None else min(n, self.high - first)
            out += [Rows(a, min(a + self.step, high), path, first) for a in range(low - low % self.step if self.kind == "range_truth" else low, high, self.step)]
            first += n
        return out or [Rows(0, 0, self.path)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        a, b = part.begin, part.end
        if a >= b:
            return
        with files.ByteFile(part.path) as f:
            if self.kind == "bin":
                item = np.dtype(ELEMENTS[self.element])
                yield self._vectors(part.first + a, f.array(item, (b - a) * self.dim, self.offset + 8 + a * self.dim * item.itemsize))
            elif self.kind in _ROWED:
                item = np.dtype(ELEMENTS[self.element])
                stride = 4 + self.dim * item.itemsize
                raw = f.array("u1", (b - a) * stride, a * stride).reshape(b - a, stride)
                if (raw[:, :4].copy().view("<i4") != self.dim).any():
                    raise ValueError(f"{self.path}: rows of different dimensions")
                yield self._vectors(part.first + a, raw[:, 4:].copy().view(item).ravel())
            elif self.kind == "truth":
                ids = f.array("<u4", (b - a) * self.dim, 8 + 4 * a * self.dim).astype(np.int64)
                far = pa.nulls(len(ids), pa.float64())
                if self.far:
                    far = pa.array(f.array("<f4", len(ids), 8 + 4 * self.n * self.dim + 4 * a * self.dim).astype(np.float64))
                q, r = np.repeat(np.arange(a, b), self.dim), np.tile(np.arange(1, self.dim + 1, dtype=np.int32), b - a)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(ids), far], ["query_id", "rank", "id", "distance"])
            elif self.kind == "range_truth":
                own = f.array("<i4", b - a, 8 + 4 * a).astype(np.int64)
                ids = f.array("<u4", int(own.sum()), 8 + 4 * self.n + 4 * int(self.before[a // self.step])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(a, b), own)), pa.array(ids)], ["query_id", "id"])
            elif self.kind == "permutation":
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(f.array("<u4", b - a, 8 + 4 * a).astype(np.int64))], ["logical_id", "physical_id"])
            else:
                yield from self._graph(f)

    def _vectors(self, first: int, flat: np.ndarray) -> pa.RecordBatch:
        n = len(flat) // self.dim if self.dim else 0
        values = pa.array(flat).cast(_ARROW[self.element])
        vec = pa.ListArray.from_arrays(np.arange(0, n * self.dim + 1, max(1, self.dim), dtype=np.int32), values)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), vec], ["id", "vec"])

    def _graph(self, f: files.ByteFile) -> Iterator[pa.RecordBatch]:
        """Records of varying length, which say nothing of where others begin: read by one task, in blocks."""
        size, start = int(f.array("<u8", 1, 0)[0]), int(f.array("<u4", 2, 8)[1])
        if size > f.size:
            raise ValueError(f"{self.path}: ends early")
        node, at, left = 0, 24, np.zeros(0, "<u4")
        while at < size:
            count = min(1 << 20, (size - at) // 4)
            flat = np.append(left, f.array("<u4", count, at))
            at += 4 * count
            i, ends = 0, [0]
            while i < len(flat) and i + 1 + int(flat[i]) <= len(flat):
                i += 1 + int(flat[i])
                ends.append(i)
            heads, left = np.array(ends[:-1], np.int64), flat[i:]
            if len(heads):
                nbrs = np.delete(flat[:i], heads).astype(np.int64)
                ids, offsets = np.arange(node, node + len(heads)), np.array(ends) - np.arange(len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(nbrs)), pa.array(ids == start)], ["id", "nbrs", "entry"])
                node += len(heads)
        if len(left):
            raise ValueError(f"{self.path}: ends early")


class Part(WriterCommitMessage):
    """A task's part: rows, and their dimension (of graphs the largest degree, and the entry's place in the part)."""

    def __init__(self, number: int, path: str, rows: int, dim: int, entry: int = -1) -> None:
        self.number, self.path, self.rows, self.dim, self.entry = number, path, rows, dim, entry


class VecWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, element: str, overwrite: bool, folder: bool) -> None:
        if files.exists(path) and not overwrite:
            raise ValueError(f"{path} exists")
        self.path, self.kind, self.element, self.folder = path, kind, element, folder
        if folder:
            files.remove(path)
            files.make_folder(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        """One part per task; the attempt's number keeps a repeated task from mixing with the first."""
        c = TaskContext.get()
        name = f"part-{c.partitionId():05d}-{c.taskAttemptId()}"
        done = Part(c.partitionId(), f"{self.path}/{name}" if self.folder else f"{self.path}.{name}", 0, 0)
        rows = []
        with files.write(done.path) as f:
            if self.folder and self.kind == "bin":
                # A part is a bin file by itself, whose header needs the number of rows first.
                rows = [x for b in batches if (x := self._bytes(b, done))]
                f.write(np.array([done.rows, done.dim], "<i4").tobytes())
                for x in rows:
                    f.write(x)
            else:
                for b in batches:
                    f.write(self._bytes(b, done))
        return done

    def _bytes(self, b: pa.RecordBatch, done: Part) -> bytes:
        if not b.num_rows:
            return b""
        if self.kind == "permutation":
            done.rows += b.num_rows
            return b.column("physical_id").to_numpy().astype("<u4").tobytes()
        if self.kind == "graph":
            col = b.column("nbrs")
            degree = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            heads = np.cumsum(degree) - degree
            entry = np.flatnonzero(b.column("entry").to_numpy(zero_copy_only=False))
            if len(entry) and done.entry < 0:
                done.entry = done.rows + int(entry[0])
            done.rows, done.dim = done.rows + b.num_rows, max(done.dim, int(degree.max()))
            return np.insert(col.flatten().to_numpy(zero_copy_only=False), heads, degree).astype("<u4").tobytes()
        v = b.column("vec")
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        done.dim = done.dim or int(lengths[0])
        if v.null_count or (lengths != done.dim).any():
            raise ValueError("vectors must be non-null and of one length")
        done.rows += len(lengths)
        m = v.flatten().to_numpy(zero_copy_only=False).astype(ELEMENTS[self.element]).reshape(-1, done.dim)
        if self.kind != "bin":
            m = np.concatenate([np.full((len(m), 1), done.dim, "<i4").view(np.uint8).reshape(len(m), 4), np.ascontiguousarray(m).view(np.uint8).reshape(len(m), -1)], 1)
        return m.tobytes()

    def commit(self, parts: list[Part]) -> None:
        parts = sorted((p for p in parts if p), key=lambda p: p.number)
        dims, n = {p.dim for p in parts if p.rows}, sum(p.rows for p in parts)
        if self.kind not in ("graph", "permutation") and len(dims) > 1:
            self.abort(parts)
            raise ValueError("vectors of different lengths")
        if self.folder:
            held = {"kind": self.kind, "dim": max(dims, default=0), "parts": [(p.path.rsplit("/", 1)[1], p.rows) for p in parts]}
            with files.write(f"{self.path}/{MANIFEST}") as f:
                f.write(json.dumps(held).encode())
            return
        head = b""
        if self.kind == "bin":
            head = np.array([n, max(dims, default=0)], "<i4").tobytes()
        elif self.kind == "permutation":
            head = np.array([n], "<u8").tobytes()
        elif self.kind == "graph":
            firsts = np.cumsum([0, *[p.rows for p in parts]])
            entry = next((int(a) + p.entry for a, p in zip(firsts, parts) if p.entry >= 0), 0)
            sizes = 0
            for p in parts:
                with files.ByteFile(p.path) as f:
                    sizes += f.size
            head = np.array([24 + sizes], "<u8").tobytes() + np.array([max(dims, default=0), entry], "<u4").tobytes() + np.array([0], "<u8").tobytes()
        with files.write(f"{self.path}.new") as f:
            f.write(head)
            for p in parts:
                with files.ByteFile(p.path) as g:
                    for at in range(0, g.size, 1 << 24):
                        f.write(g.file.read_at(1 << 24, at))
        files.move(f"{self.path}.new", self.path)
        self.abort(parts)

    def abort(self, parts: list[Part]) -> None:
        for p in parts:
            if p:
                files.remove(p.path)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VecFile)


def read_vectors(spark: SparkSession, path: str, kind: str = "bin", element: str = "float", **options) -> DataFrame:
    register(spark)
    return spark.read.format("vecfile").options(kind=kind, element=element, **options).load(path)


def read_rows(spark: SparkSession, path: str, offset: int, count: int, element: str = "float") -> DataFrame:
    """Rows offset .. offset + count of a bin file; an error if that is past its end."""
    from pyspark.sql import functions as F

    n, _ = header(path)
    if offset < 0 or count < 0 or offset + count > n:
        raise ValueError(f"rows {offset} to {offset + count} of {n}")
    return read_vectors(spark, path, "bin", element).filter((F.col("id") >= offset) & (F.col("id") < offset + count))


#: Rows of a task that writes.
WRITE_ROWS = 200_000


def _tasks(rows: DataFrame, partitions: int | None) -> int:
    return partitions or max(1, -(-rows.count() // WRITE_ROWS))


def save_vectors(rows: DataFrame, path: str, kind: str = "bin", element: str = "float", partitions: int | None = None, folder: bool = False) -> None:
    """Write (id, vec) in id order; row numbers of the file are the places in that order. Partitions by the number of rows if not given."""
    register(rows.sparkSession)
    ordered = rows.select("id", "vec").repartitionByRange(_tasks(rows, partitions), "id").sortWithinPartitions("id")
    ordered.write.format("vecfile").options(kind=kind, element=element, folder=str(folder).lower()).mode("overwrite").save(path)


def save_graph(graph: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write (id, nbrs, entry) of one graph whose ids are 0 .. n - 1 (see ``dynamic.compact``) as a graph file. Other ids are an error."""
    from pyspark.sql import functions as F

    register(graph.sparkSession)
    n, distinct, low, high = graph.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
    if n and (distinct, low, high) != (n, 0, n - 1):
        raise ValueError("a graph file needs the ids 0 .. n - 1, each once")
    ordered = graph.select("id", "nbrs", F.coalesce("entry", F.lit(False)).alias("entry")).repartitionByRange(_tasks(graph, partitions), "id").sortWithinPartitions("id")
    ordered.write.format("vecfile").options(kind="graph").mode("overwrite").save(path)


def save_permutation(layout: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write (logical_id, physical_id), a bijection on 0 .. n - 1, as a permutation file. Other ids are an error."""
    from pyspark.sql import functions as F

    register(layout.sparkSession)
    n, a, b, c, d = layout.agg(F.count("*"), F.countDistinct("logical_id"), F.countDistinct("physical_id"), F.max("logical_id"), F.max("physical_id")).first()
    if n and (a, b, c, d) != (n, n, n - 1, n - 1):
        raise ValueError("a permutation file needs the ids 0 .. n - 1, each once")
    ordered = layout.select("logical_id", "physical_id").repartitionByRange(_tasks(layout, partitions), "logical_id").sortWithinPartitions("logical_id")
    ordered.write.format("vecfile").options(kind="permutation").mode("overwrite").save(path)


def read_permutation(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(logical_id, physical_id) of a permutation file; where there is none, the identity on 0 .. n - 1."""
    if files.exists(path):
        return read_vectors(spark, path, "permutation")
    if n is None:
        raise ValueError(f"{path}: no such file")
    return spark.range(n).selectExpr("id as logical_id", "id as physical_id")


def save_truth(truth: DataFrame, path: str) -> None:
    """Write (query_id, rank, id, distance) as a truth file, queries in order; every query must have the same ranks.

    Ids and distances are two streams of the file: each is written like a vector file and the second follows the first.
    """
    from pyspark.sql import functions as F

    per = truth.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("x"))
    shape = per.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if shape.n and shape.a != shape.b:
        raise ValueError("queries have different numbers of neighbours")
    ids, far = f"{path}.ids", f"{path}.distances"
    save_vectors(per.select(F.col("query_id").alias("id"), F.transform("x", lambda x: x["id"]).alias("vec")), ids, "bin", "uint32")
    save_vectors(per.select(F.col("query_id").alias("id"), F.transform("x", lambda x: x["distance"]).alias("vec")), far)
    with files.write(f"{path}.new") as f:
        for name, skip in ((ids, 0), (far, 8)):
            with files.ByteFile(name) as g:
                for at in range(skip, g.size, 1 << 24):
                    f.write(g.file.read_at(1 << 24, at))
            files.remove(name)
    files.move(f"{path}.new", path)


def convert(spark: SparkSession, source: str, target: str, from_kind: str, to_kind: str, from_element: str = "float", to_element: str = "float") -> None:
    """One vector format to another: fvecs, bvecs, ivecs and bin, with the element type cast."""
    save_vectors(read_vectors(spark, source, from_kind, from_element), target, to_kind, to_element)
