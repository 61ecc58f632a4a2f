"""Exact search: k-nearest and range joins of a stated query set against a whole table, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrow import batch, matrix
from ..functions.distance import metric as metric_of, norm_squared

#: Queries per block, and the most blocks that are broadcast together.
BLOCK_ROWS = 2048
BROADCAST_BLOCKS = 16
#: Base rows compared with a block at once: bounds the distance matrix to 16 MB.
STEP = 1024


def select_vectors(rows: DataFrame, row_id: str, vec: str, prefix: str = "") -> DataFrame:
    """(id, vec) of a table, whatever else it holds; rows with a null id or vector are left out."""
    out = rows.select(F.col(row_id).cast("long").alias(prefix + "id"), F.col(vec).cast("array<double>").alias(prefix + "vec"))
    return out.filter(F.col(prefix + "id").isNotNull() & F.col(prefix + "vec").isNotNull())


class Nearest:
    """The k nearest base rows so far of each of a block of queries, by (distance, id)."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int, name: str, skip_self: bool) -> None:
        self.ids, self.vecs, self.k, self.metric, self.skip_self = ids, vecs, k, metric_of(name), skip_self
        self.rows = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.int64)
        self.value = np.zeros(0)
        self.edge = np.full(len(ids), np.inf)

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        for lo in range(0, len(ids), STEP):
            self._add(ids[lo : lo + STEP], vecs[lo : lo + STEP])

    def _add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        s = self.metric.sign
        grid = s * self.metric.grid(self.vecs, vecs)
        slack = 1e-9 * (1.0 + np.abs(grid).max(1))
        if self.skip_self:
            grid[self.ids[:, None] == ids[None]] = np.inf
        if len(ids) > self.k:
            own = np.partition(grid, self.k - 1, 1)[:, self.k - 1]
            limit = np.minimum(own, self.edge) + slack
        else:
            limit = self.edge + slack
        r, c = np.nonzero((grid <= limit[:, None]) & (grid < np.inf))
        value = s * self.metric.pairs(self.vecs[r], vecs[c])
        rows, found, values = np.append(self.rows, r), np.append(self.found, ids[c]), np.append(self.value, value)
        order = np.lexsort((found, values, rows))
        rows, found, values = rows[order], found[order], values[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows]
        keep = rank < self.k
        self.rows, self.found, self.value = rows[keep], found[keep], values[keep]
        last = rank == self.k - 1
        self.edge[rows[last]] = values[last]

    def result(self) -> pa.RecordBatch:
        return batch(query_id=self.ids[self.rows], id=self.found, distance=self.metric.sign * self.value)


_FOUND = "query_id long, id long, distance double"


def knn_join(
    queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", query_id: str = "id", query_vec: str = "vec", base_id: str = "id",
    base_vec: str = "vec", skip_self: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, id, distance): the k base rows nearest to each query, by (distance, id), ranks from 1.

    Metrics: l2 (squared), ip (inner product, largest first), cosine (1 - cosine), fast_l2 (rank only). Rows with null ids or vectors
    are left out; vectors of other lengths or with NaN are an error. Ids should be unique: repeated base rows
    are ranked each. Fewer base rows give fewer ranks; empty tables give no rows.

    The base is scanned once, where it lies. Up to ``BROADCAST_BLOCKS`` blocks of ``block_rows`` queries are broadcast (32,768 queries
    of 64 dimensions are 16 MB); a task compares them block by block and keeps k rows per query, so that what is shuffled is
    k rows per query and task, whatever the rows of a task. More queries meet the base in a shuffled grid of blocks.
    """
    if k < 1:
        raise ValueError("k must be positive")
    metric_of(metric)
    spark = base.sparkSession
    q, b = select_vectors(queries, query_id, query_vec), select_vectors(base, base_id, base_vec)
    n = q.count()
    blocks = max(1, math.ceil(n / block_rows))
    if blocks <= BROADCAST_BLOCKS:
        t = q.orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((t.column("id").to_numpy(), matrix(t.column("vec"))))

        def scan(batches):
            ids, vecs = shared.value
            near = [Nearest(ids[i : i + block_rows], vecs[i : i + block_rows], k, metric, skip_self) for i in range(0, len(ids), block_rows)]
            for x in batches:
                if x.num_rows:
                    own, held = x.column("id").to_numpy(), matrix(x.column("vec"))
                    for block in near:
                        block.add(own, held)
            for block in near:
                yield block.result()

        found = b.mapInArrow(scan, _FOUND)
    else:
        found = _grid(q, b, k, metric, skip_self, blocks, block_rows)
    order = F.col("distance").desc() if metric_of(metric).sign < 0 else F.col("distance").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _grid(q: DataFrame, b: DataFrame, k: int, metric: str, skip_self: bool, blocks: int, block_rows: int) -> DataFrame:
    def cell(qs, bs):
        near = Nearest(qs.column("id").to_numpy(), matrix(qs.column("vec")), k, metric, skip_self)
        if qs.num_rows and bs.num_rows:
            near.add(bs.column("id").to_numpy(), matrix(bs.column("vec")))
        return pa.Table.from_batches([near.result()])

    return _cells(q, b, blocks, block_rows, cell)


def _cells(q: DataFrame, b: DataFrame, blocks: int, block_rows: int, cell) -> DataFrame:
    """Blocks of queries against blocks of the base, a cell per pair; a cell holds one block of each."""
    side = max(1, math.ceil(b.count() / (8 * block_rows)))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = q.select("id", "vec", own.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("j"))
    other = F.pmod(F.xxhash64("id"), F.lit(side)).cast("int")
    right = b.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), other.alias("j"))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, _FOUND)


def _within(ids, vecs, base_ids, base_vecs, m, radius: float, skip_self: bool):
    """Batches of the pairs within a radius, screened by the fast grid and decided by exact values."""
    for lo in range(0, len(base_ids), STEP):
        bi, bv = base_ids[lo : lo + STEP], base_vecs[lo : lo + STEP]
        grid = m.sign * m.grid(vecs, bv)
        r, c = np.nonzero(grid <= m.sign * radius + 1e-9 * (1 + np.abs(grid).max()))
        d = m.pairs(vecs[r], bv[c])
        keep = m.sign * d <= m.sign * radius
        if skip_self:
            keep &= ids[r] != bi[c]
        yield batch(query_id=ids[r[keep]], id=bi[c[keep]], distance=d[keep])


def range_join(
    queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2", query_id: str = "id", query_vec: str = "vec", base_id: str = "id",
    base_vec: str = "vec", skip_self: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, id, distance): base rows within ``radius`` of each query (inner product: at least ``radius``).

    Blocks and bad vectors are treated as in ``knn_join``.
    """
    spark, m = base.sparkSession, metric_of(metric)
    q, b = select_vectors(queries, query_id, query_vec), select_vectors(base, base_id, base_vec)
    blocks = max(1, math.ceil(q.count() / block_rows))
    if blocks > BROADCAST_BLOCKS:

        def cell(qs, bs):
            got = [batch(query_id=np.zeros(0, np.int64), id=np.zeros(0, np.int64), distance=np.zeros(0))]
            if qs.num_rows and bs.num_rows:
                got += _within(qs.column("id").to_numpy(), matrix(qs.column("vec")), bs.column("id").to_numpy(), matrix(bs.column("vec")), m, radius, skip_self)
            return pa.Table.from_batches(got)

        return _cells(q, b, blocks, block_rows, cell)
    t = q.orderBy("id").toArrow()
    shared = spark.sparkContext.broadcast((t.column("id").to_numpy(), matrix(t.column("vec"))))

    def scan(batches):
        ids, vecs = shared.value
        for x in batches:
            if x.num_rows:
                own, held = x.column("id").to_numpy(), matrix(x.column("vec"))
                for i in range(0, len(ids), block_rows):
                    yield from _within(ids[i : i + block_rows], vecs[i : i + block_rows], own, held, m, radius, skip_self)

    return b.mapInArrow(scan, _FOUND)


def knn_graph(base: DataFrame, k: int, metric: str = "l2", row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(query_id, rank, id, distance): every row's k nearest other rows, exact. Quadratic: for ground truth and small sets."""
    return knn_join(base, base, k, metric, row_id, vec, row_id, vec, skip_self=True)


def fast_l2_rank(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id): ranking by norm2 - 2 x.q, which is no distance, so none is returned."""
    return knn_join(queries, base, k, "fast_l2", skip_self=True).select("query_id", "rank", "id")


def mean_vector(rows: DataFrame, vec: str = "vec", most: int = 512) -> DataFrame:
    """(mean): one row with the column-wise mean of all vectors, none for an empty table.

    Up to ``most`` dimensions the means are one aggregate of as many columns, so that tasks send a row each; beyond that
    elements are exploded and grouped by position.
    """
    v = rows.select(F.col(vec).alias("v")).filter("v is not null")
    one = v.select(F.size("v").alias("n")).first()
    if one is not None and one.n <= most:
        return v.agg(*[F.avg(F.col("v")[i].cast("double")).alias(f"m{i}") for i in range(one.n)]).select(F.array(*[f"m{i}" for i in range(one.n)]).alias("mean"))
    each = v.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mean")).filter("size(mean) > 0")


def centroid(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """(pos, mean): the column-wise mean of all vectors, positions from 0."""
    return mean_vector(rows, vec).select(F.posexplode("mean").alias("pos", "mean"))


def medoid(rows: DataFrame, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(id, distance): the row nearest to the mean, the smallest id on ties. One row, none for an empty table."""
    from ..functions.distance import l2_squared

    v = select_vectors(rows, row_id, vec)
    mean = mean_vector(v).withColumnRenamed("mean", "_c")
    d = v.join(F.broadcast(mean)).select("id", l2_squared("vec", "_c").alias("distance"))  # one row
    return d.groupBy().agg(F.min(F.struct("distance", "id")).alias("m")).filter("m is not null").select("m.id", "m.distance")


def norms(rows: DataFrame, row_id: str = "id", vec: str = "vec") -> DataFrame:
    v = select_vectors(rows, row_id, vec)
    return v.select("id", norm_squared("vec").alias("norm2"), F.sqrt(norm_squared("vec")).alias("norm"))


def merge_results(results: list[DataFrame], k: int) -> DataFrame:
    """(query_id, rank, id, distance, partition): one ranking of the results of several indexes, partition = its place in the list."""
    all_ = None
    for i, r in enumerate(results):
        one = r.select("query_id", "id", "distance").withColumn("partition", F.lit(i))
        all_ = one if all_ is None else all_.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id", "partition"))
    return all_.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance", "partition")
