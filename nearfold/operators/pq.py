"""Product quantisation: codebooks, codes, asymmetric distances, re-ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrow import batch, matrix, vectors
from ..functions.distance import METRICS
from .cluster import lloyd_local, plus_plus, training_rows
from .exact import BROADCAST_BLOCKS, select_vectors


def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Starts of ``chunks`` contiguous chunks and ``dim``; sizes differ by at most one, larger ones first."""
    if not 1 <= chunks <= dim:
        raise ValueError("chunks must be between 1 and the dimension")
    small, extra = divmod(dim, chunks)
    return [i * small + min(i, extra) for i in range(chunks + 1)]


def chunk_count(budget_bytes: float, n: int | Column, dim: int, most: int = 256) -> int | Column:
    """Chunks (bytes per row) that a RAM budget allows for n rows, a number or a column: floor(budget / n), between 1 and min(dim, most)."""
    if isinstance(n, Column):
        return F.greatest(F.lit(1), F.least(F.floor(F.lit(float(budget_bytes)) / F.greatest(n, F.lit(1))), F.lit(min(dim, most)))).cast("long")
    return int(max(1, min(budget_bytes // max(n, 1), dim, most)))


def search_budget(bytes_: float) -> float:
    """Bytes left for codes: a quarter of a GiB is kept back if more than one GiB remains without it."""
    reserve = 0.25 * 2**30
    return bytes_ - reserve if bytes_ - reserve > 2**30 else bytes_


@dataclass(frozen=True)
class Codebook:
    """centers[c] is (codes, chunk size); the vector is centred and rotated before it is cut into chunks."""

    offsets: list[int]
    centers: list[np.ndarray]
    centroid: np.ndarray
    rotation: np.ndarray | None = field(default=None)

    def turn(self, x: np.ndarray) -> np.ndarray:
        x = x - self.centroid
        return x if self.rotation is None else x @ self.rotation

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, chunks) numbers of the nearest centres, the smallest on ties."""
        t = self.turn(x)
        return np.stack([METRICS["l2"].grid(t[:, a:b], c).argmin(1) for a, b, c in zip(self.offsets, self.offsets[1:], self.centers)], 1).astype(np.int16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        y = np.concatenate([c[codes[:, j]] for j, c in enumerate(self.centers)], 1)
        return (y if self.rotation is None else y @ self.rotation.T) + self.centroid

    def tables(self, queries: np.ndarray, metric: str = "l2") -> list[np.ndarray]:
        """Per chunk (queries, codes): squared L2 to each centre, or minus the inner product."""
        if metric == "ip":
            t = queries if self.rotation is None else queries @ self.rotation
            return [-(t[:, a:b] @ c.T) for a, b, c in zip(self.offsets, self.offsets[1:], self.centers)]
        t = self.turn(queries)
        return [np.maximum(METRICS["l2"].grid(t[:, a:b], c), 0) for a, b, c in zip(self.offsets, self.offsets[1:], self.centers)]

    def distances(self, tables: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """(queries, rows): table entries summed over the chunks."""
        out = np.zeros((len(tables[0]), len(codes)))
        for j, t in enumerate(tables):
            out += t[:, codes[:, j]]
        return out


def train(
    rows: DataFrame, chunks: int, codes: int = 256, centre: bool = True, rounds: int = 12, seed: int = 1, train_rows: int = 256_000,
    row_id: str = "id", vec: str = "vec",
) -> Codebook:
    """A codebook from at most ``train_rows`` rows; chunks are trained in parallel tasks. At most 256 codes."""
    x = training_rows(rows, train_rows, row_id, vec)
    if not len(x) or not 1 <= codes <= 256:
        raise ValueError("need rows to train on and 1 to 256 codes")
    offsets = chunk_offsets(x.shape[1], chunks)
    mean = x.mean(0) if centre else np.zeros(x.shape[1])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(x - mean)

    def one(batches):
        for b in batches:
            for j in b.column("id").to_pylist():
                own = shared.value[:, offsets[j] : offsets[j + 1]]
                c, _, _ = lloyd_local(own, plus_plus(own, codes, seed + j), rounds)
                yield batch(chunk=np.array([j]), center=vectors(c.reshape(1, -1)))

    got = spark.range(0, chunks, 1, chunks).mapInArrow(one, "chunk long, center array<double>").orderBy("chunk").collect()
    return Codebook(offsets, [np.array(r.center).reshape(codes, -1) for r in got], mean)


def train_rotated(
    rows: DataFrame, chunks: int, codes: int = 256, centre: bool = False, rounds: int = 20, inner: int = 8, seed: int = 1, train_rows: int = 50_000,
    row_id: str = "id", vec: str = "vec",
) -> Codebook:
    """Optimised codebook: alternate per-chunk k-means in the rotated space with the rotation that best
    maps the rows onto their decoded forms (orthogonal Procrustes, by SVD). On the bounded sample."""
    x = training_rows(rows, train_rows, row_id, vec)
    dim = x.shape[1]
    mean = x.mean(0) if centre else np.zeros(dim)
    x = x - mean
    offsets = chunk_offsets(dim, chunks)
    rotation, centers = np.eye(dim), None
    for r in range(rounds):
        t = x @ rotation
        parts, decoded = [], []
        for j in range(chunks):
            own = t[:, offsets[j] : offsets[j + 1]]
            c, near, _ = lloyd_local(own, plus_plus(own, codes, seed + j) if centers is None else centers[j], inner)
            parts.append(c)
            decoded.append(c[near])
        centers = parts
        if r < rounds - 1:
            u, _, vt = np.linalg.svd(x.T @ np.concatenate(decoded, 1))
            rotation = u @ vt
    return Codebook(offsets, centers, mean, rotation)


def encode(rows: DataFrame, book: Codebook, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(id, codes): one small integer per chunk. Rows with null ids or vectors are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(book.__dict__)

    def run(batches):
        b_ = Codebook(**shared.value)
        for b in batches:
            if b.num_rows:
                yield batch(id=b.column("id"), codes=vectors(b_.encode(matrix(b.column("vec")))))

    return select_vectors(rows, row_id, vec).mapInArrow(run, "id long, codes array<smallint>")


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """(id, vec): the vectors that codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(book.__dict__)

    def run(batches):
        b_ = Codebook(**shared.value)
        for b in batches:
            if b.num_rows:
                yield batch(id=b.column("id"), vec=vectors(b_.decode(matrix(b.column("codes")).astype(np.int64))))

    return codes.select("id", "codes").mapInArrow(run, "id long, vec array<double>")


class NearestCodes:
    """The k rows nearest by table look-up so far of each of a block of queries, by (distance, id)."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, book: Codebook, k: int, metric: str, skip_self: bool, ties: bool) -> None:
        self.ids, self.book, self.k, self.skip_self, self.ties = ids, book, k, skip_self, ties
        self.tables = book.tables(vecs, metric)
        self.rows, self.found, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, own: np.ndarray, codes: np.ndarray) -> None:
        for lo in range(0, len(own), 2048):
            d = self.book.distances(self.tables, codes[lo : lo + 2048])
            if self.skip_self:
                d[self.ids[:, None] == own[None, lo : lo + 2048]] = np.inf
            kk = min(self.k, d.shape[1])
            r, j = np.nonzero((d <= np.partition(d, kk - 1, 1)[:, kk - 1 : kk]) & (d < np.inf))
            rows, found, value = np.append(self.rows, r), np.append(self.found, own[lo + j]), np.append(self.value, d[r, j])
            o = np.lexsort((found, value, rows))
            rows, found, value = rows[o], found[o], value[o]
            rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows]
            keep = rank < self.k
            if self.ties:
                edge = np.full(len(self.ids), np.inf)
                edge[rows[rank == self.k - 1]] = value[rank == self.k - 1]
                keep = value <= edge[rows]
            self.rows, self.found, self.value = rows[keep], found[keep], value[keep]

    def result(self):
        return batch(query_id=self.ids[self.rows], id=self.found, distance=self.value)


def adc_scan(queries: DataFrame, codes: DataFrame, book: Codebook, k: int, metric: str = "l2", skip_self: bool = False, block_rows: int = 1024, ties: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the k rows nearest by table look-up over all codes, by (distance, id).

    Up to ``BROADCAST_BLOCKS`` blocks of ``block_rows`` queries (id, vec) are broadcast and the codes are scanned once, where they lie; a
    task keeps k rows per query. More queries meet the codes in a shuffled grid of blocks. ip gives minus
    the inner product. With ``ties`` all rows at the k-th distance come too (rows of equal codes tie), and ranks are shared.
    """
    spark = codes.sparkSession
    q, c = select_vectors(queries, "id", "vec"), codes.select("id", "codes")
    n, found_ = q.count(), "query_id long, id long, distance double"
    blocks = max(1, -(-n // block_rows))
    if blocks <= BROADCAST_BLOCKS:
        t = q.orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((book.__dict__, t.column("id").to_numpy(), matrix(t.column("vec"))))

        def scan(batches):
            held, ids, vecs = shared.value
            near = [NearestCodes(ids[i : i + block_rows], vecs[i : i + block_rows], Codebook(**held), k, metric, skip_self, ties) for i in range(0, len(ids), block_rows)]
            for b in batches:
                if b.num_rows:
                    own, coded = b.column("id").to_numpy(), matrix(b.column("codes")).astype(np.int64)
                    for block in near:
                        block.add(own, coded)
            for block in near:
                yield block.result()

        found = c.mapInArrow(scan, found_)
    else:
        model = spark.sparkContext.broadcast(book.__dict__)
        sides = max(1, -(-c.count() // (64 * block_rows)))

        def cell(qs, cs):
            near = NearestCodes(qs.column("id").to_numpy(), matrix(qs.column("vec")), Codebook(**model.value), k, metric, skip_self, ties)
            if qs.num_rows and cs.num_rows:
                near.add(cs.column("id").to_numpy(), matrix(cs.column("codes")).astype(np.int64))
            return pa.Table.from_batches([near.result()])

        hashed = F.xxhash64("id")
        left = q.select("id", "vec", F.pmod(hashed, F.lit(blocks)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("j"))
        right = c.select("id", "codes", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.pmod(hashed, F.lit(sides)).cast("int").alias("j"))
        found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, found_)
    order = Window.partitionBy("query_id")
    rank = F.rank().over(order.orderBy("distance")) if ties else F.row_number().over(order.orderBy("distance", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def rerank(candidates: DataFrame, queries: DataFrame, rows: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance): candidates (query_id, id) ordered by their full vectors, the k best."""
    m = METRICS[metric]
    q = select_vectors(queries, "id", "vec").select(F.col("id").alias("query_id"), F.col("vec").alias("_q"))
    b = select_vectors(rows, "id", "vec").select("id", F.col("vec").alias("_b"))
    d = candidates.select("query_id", "id").distinct().join(q, "query_id").join(b, "id").select("query_id", "id", m.column("_q", "_b").alias("distance"))
    order = F.col("distance").desc() if m.sign < 0 else F.col("distance").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
