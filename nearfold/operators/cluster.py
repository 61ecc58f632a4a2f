"""K-means partitioning driven by data or by sampled queries, and shard assignment."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrow import batch, matrix
from ..functions.distance import METRICS
from .blocks import cut
from .exact import select_vectors

#: Rows that train centroids at most; they are held on the driver.
TRAIN_ROWS = 200_000


def nearest_centers(rows: DataFrame, centers: np.ndarray, n: int = 1, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(id, rank, center, distance): the ``n`` nearest centres of each row by (squared L2, number), centres broadcast.

    Rows with null ids or vectors are left out. Fewer centres give fewer ranks.
    """
    if n < 1 or not len(centers):
        raise ValueError("need centres and a positive n")
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centers, np.float64))

    def assign(batches):
        c = shared.value
        k = min(n, len(c))
        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column("id").to_numpy(), matrix(b.column("vec"))
            for lo in range(0, len(ids), 4096):
                x = v[lo : lo + 4096]
                grid = METRICS["l2"].grid(x, c)
                edge = np.partition(grid, k - 1, 1)[:, k - 1]
                r, j = np.nonzero(grid <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None])
                d = ((x[r] - c[j]) ** 2).sum(1)
                o = np.lexsort((j, d, r))
                r, j, d = r[o], j[o], d[o]
                rank = np.arange(len(r)) - np.searchsorted(r, np.arange(len(x)))[r]
                keep = rank < k
                yield batch(id=ids[lo + r[keep]], rank=(rank[keep] + 1).astype(np.int32), center=j[keep].astype(np.int32), distance=d[keep])

    return select_vectors(rows, row_id, vec).mapInArrow(assign, "id long, rank int, center int, distance double")


def shard_members(rows: DataFrame, centers: np.ndarray, replicas: int = 2, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(shard, id): every row in the shards of its ``replicas`` nearest centres."""
    return nearest_centers(rows, centers, replicas, row_id, vec).select(F.col("center").alias("shard"), "id")


def shard_data(rows: DataFrame, members: DataFrame, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(shard, id, vec): the rows of each shard, an equi-join on the id."""
    return members.join(select_vectors(rows, row_id, vec), "id").select("shard", "id", "vec")


def shard_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("shard").agg(F.count("*").alias("n"))


def replication_factor(members: DataFrame) -> DataFrame:
    """(shards, rows, replication): replication = memberships per distinct id."""
    return members.agg(
        F.countDistinct("shard").alias("shards"), F.count("*").alias("rows"), (F.count("*") / F.countDistinct("id")).alias("replication")
    )


def lloyd_step(rows: DataFrame, centers: np.ndarray, row_id: str = "id", vec: str = "vec", empty: str = "keep") -> tuple[np.ndarray, float]:
    """One Lloyd iteration over all rows: (new centres, sum of squared distances to the old ones).

    Tasks reduce their rows to a sum per centre, so what comes to the driver is one row per centre. An empty
    centre keeps its place, or becomes the zero vector with ``empty='zero'``.
    """
    c = np.asarray(centers, np.float64)
    dim = c.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(c)

    def reduce(batches):
        k = shared.value
        total, n, cost = np.zeros_like(k), np.zeros(len(k), np.int64), np.zeros(len(k))
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec"))
            near = METRICS["l2"].grid(x, k).argmin(1)
            np.add.at(total, near, x)
            np.add.at(n, near, 1)
            np.add.at(cost, near, ((x - k[near]) ** 2).sum(1))
        used = np.flatnonzero(n)
        if len(used):
            yield batch(center=used.astype(np.int64), n=n[used], cost=cost[used], **{f"s{i}": total[used, i] for i in range(dim)})

    names = [f"s{i}" for i in range(dim)]
    schema = "center long, n long, cost double, " + ", ".join(f"{s} double" for s in names)
    got = select_vectors(rows, row_id, vec).mapInArrow(reduce, schema).groupBy("center").agg(F.sum("n"), F.sum("cost"), *[F.sum(s) for s in names]).orderBy("center").collect()
    new = np.zeros_like(c) if empty == "zero" else c.copy()
    for r in got:
        new[r[0]] = np.array(r[3:], np.float64) / r[1]
    return new, float(sum(r[2] for r in got))


def training_rows(rows: DataFrame, most: int = TRAIN_ROWS, row_id: str = "id", vec: str = "vec") -> np.ndarray:
    """At most ``most`` vectors for fitting, those with the smallest id hashes, in that order.

    A threshold on the hash comes first, so that tasks send about 1.5 * most rows in all, not most rows each.
    """
    v, draw = select_vectors(rows, row_id, vec), F.pmod(F.xxhash64("id"), F.lit(1 << 53))
    few = v.filter(draw < int(min(1.0, (1.5 * most + 100) / max(v.count(), 1)) * (1 << 53)))
    column = few.orderBy(draw, "id").limit(most).select("vec").toArrow().column("vec")
    if not len(column):
        return matrix(column)
    # Chunk by chunk: the vectors are held twice, not three times.
    out, at = np.empty((len(column), len(column[0]))), 0
    for chunk in column.chunks:
        if len(chunk):
            x = matrix(chunk)
            if x.shape[1] != out.shape[1]:
                raise ValueError("vectors of a table must be non-null and of one length")
            out[at : at + len(x)] = x
            at += len(x)
    return out


#: Elements of a block of distances that the driver computes at once: 32 MB, and some such temporaries.
GRID_ELEMENTS = 4_000_000


def _blocks(n: int, width: int):
    """Slices of n rows whose blocks of ``width`` columns have at most ``GRID_ELEMENTS`` elements."""
    step = max(1, GRID_ELEMENTS // max(width, 1))
    return (slice(lo, min(n, lo + step)) for lo in range(0, n, step))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from the row y."""
    out = np.empty(len(x))
    for b in _blocks(len(x), x.shape[1]):
        out[b] = ((x[b] - y) ** 2).sum(1)
    return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, float]:
    """The nearest centre of each row and the sum of squared distances to them, a block of rows at a time."""
    near, apart = np.empty(len(x), np.int64), np.empty(len(x))
    for b in _blocks(len(x), max(centers.shape)):
        near[b] = METRICS["l2"].grid(x[b], centers).argmin(1)
        apart[b] = ((x[b] - centers[near[b]]) ** 2).sum(1)
    return near, float(apart.sum())


def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ seeding; repeats rows if there are fewer distinct ones."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    d = _apart(x, x[chosen[0]])
    while len(chosen) < k:
        total = d.sum()
        nxt = int(rng.integers(len(x))) if total <= 0 else int(np.searchsorted(np.cumsum(d), rng.random() * total, "right"))
        nxt = min(nxt, len(x) - 1)
        chosen.append(nxt)
        d = np.minimum(d, _apart(x, x[nxt]))
    return x[chosen].copy()


def lloyd_local(x: np.ndarray, centers: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Lloyd on a bounded matrix until a relative gain below 1e-5: (centres, assignment, residual). Beyond x it needs blocks of bounded size."""
    before = math.inf
    for i in range(rounds):
        near, residual = _nearest(x, centers)
        n = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        if residual < np.finfo(np.float32).eps or i and (before - residual) / before < 1e-5:
            break
        before = residual
    return centers, *_nearest(x, centers)


def kmeans(rows: DataFrame, k: int, rounds: int = 10, seed: int = 1, train_rows: int = TRAIN_ROWS, row_id: str = "id", vec: str = "vec") -> np.ndarray:
    """Centres: k-means++ on a bounded sample, then Lloyd over all rows until the relative gain is below 1e-5."""
    sample = training_rows(rows, train_rows, row_id, vec)
    if not len(sample):
        raise ValueError("no rows to train on")
    centers, before = plus_plus(sample, k, seed), math.inf
    held = cut(select_vectors(rows, row_id, vec))
    for i in range(rounds):
        centers, residual = lloyd_step(held, centers)
        if residual < np.finfo(np.float32).eps or i and (before - residual) / before < 1e-5:
            break
        before = residual
    return centers


def kmeans_residual(rows: DataFrame, centers: np.ndarray, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(residual): sum of squared distances to the nearest centre."""
    return nearest_centers(rows, centers, 1, row_id, vec).agg(F.sum("distance").alias("residual"))


def ram_estimate(n: int | Column, dim: int, degree: int, element_bytes: int = 4) -> float | Column:
    """Bytes of an index over n rows, a number or a column: 1.1 * (vectors padded to 8 dimensions + 1.3 * degree neighbours + lock and list header)."""
    padded = -(-dim // 8) * 8
    return 1.1 * (n * padded * element_bytes + n * degree * 4 * 1.3 + n * 8 + n * 24)


def partition_for_budget(
    rows: DataFrame, dim: int, degree: int, budget_bytes: float, train_on: DataFrame | None = None, replicas: int = 2, rounds: int = 10, seed: int = 1,
    train_rows: int = TRAIN_ROWS, most: int | None = None, row_id: str = "id", vec: str = "vec",
) -> np.ndarray:
    """Centres such that the largest shard's index fits the budget: 3 shards or the fewest that could fit, then 2 more each time, from 64 on a quarter more.

    ``train_on`` (id, vec) are the rows that train the centres, for instance sampled queries; by default the base
    itself. Shard sizes are counted over all base rows. Raises if ``most`` shards, by default as many as there are training rows, do not suffice.
    """
    base = cut(select_vectors(rows, row_id, vec))
    source = base if train_on is None else train_on
    sample = training_rows(source, train_rows)
    if not len(sample):
        raise ValueError("no rows to train on")
    most = len(sample) if most is None else most
    # On average a shard holds replicas * rows / shards: fewer shards than that cannot fit.
    fewest = replicas * ram_estimate(base.count(), dim, degree) / max(budget_bytes, 1)
    k = max(3, 2 * (math.ceil(min(fewest, most)) // 2) + 1)
    while k <= max(most, 3):
        centers, _, _ = lloyd_local(sample, plus_plus(sample, k, seed), rounds)
        largest = shard_sizes(shard_members(base, centers, replicas)).agg(F.max("n")).first()[0] or 0
        if ram_estimate(largest, dim, degree) <= budget_bytes:
            return centers
        k += 2 if k < 64 else 2 * (k // 8)
    raise ValueError(f"the budget needs more than {most} shards")


def residuals(rows: DataFrame, centers: np.ndarray, sign: int = -1, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(id, center, vec): vector minus (sign -1) or plus (sign 1) its nearest centre."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(centers, np.float64))

    def run(batches):
        from ..functions.arrow import vectors

        c = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"))
                near = METRICS["l2"].grid(x, c).argmin(1)
                yield batch(id=b.column("id"), center=near.astype(np.int32), vec=vectors(x + sign * c[near]))

    return select_vectors(rows, row_id, vec).mapInArrow(run, "id long, center int, vec array<double>")


def shard_pruned_knn(queries: DataFrame, rows: DataFrame, centers: np.ndarray, k: int, probes: int = 2, replicas: int = 1) -> DataFrame:
    """(query_id, rank, id, distance): exact search in each query's ``probes`` nearest shards only.

    Shards meet queries by an equi-join on the shard; a query's rows of one shard are compared in one place
    by the block kernel, and only the k best leave it. (id, vec) tables.
    """
    from .exact import Nearest

    asked = nearest_centers(queries, centers, probes).select("id", F.col("center").alias("shard")).join(select_vectors(queries, "id", "vec"), "id")
    members = shard_members(rows, centers, replicas)
    held = shard_data(rows, members)
    # A shard is dealt into blocks of bounded size, and its queries go to each of them.
    sizes = members.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 50_000)).cast("int").alias("_n"))
    left = asked.join(sizes, "shard").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("shard", "_b", "id", "vec")
    right = held.join(sizes, "shard").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).select("shard", "_b", "id", "vec")

    def search(qs, bs):
        import pyarrow as pa

        if not qs.num_rows or not bs.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        near = Nearest(qs.column("id").to_numpy(), matrix(qs.column("vec")), k, "l2", True)
        near.add(bs.column("id").to_numpy(), matrix(bs.column("vec")))
        return pa.Table.from_batches([near.result()])

    found = left.groupBy("shard", "_b").cogroup(right.groupBy("shard", "_b")).applyInArrow(search, "query_id long, id long, distance double")
    unique = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return unique.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
