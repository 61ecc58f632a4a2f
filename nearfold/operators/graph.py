"""Proximity-graph indexes: built per shard, searched per shard or merged.

A graph is (shard, id, nbrs, entry), entry true for the shard's start. A shard is one task's work, so its size
must be bounded by the partitioning (``shard_rows``).
"""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrow import matrix
from .blocks import cut
from .exact import medoid, select_vectors
from .kernels import BuildParams, build_graph, distances, greedy_search, padded_seeds, robust_prune

SHARD_ROWS = 50_000
#: Queries of one shard that one task answers; those of a popular shard come in several blocks, each with a copy of the shard.
QUERY_BLOCK = 4096
GRAPH = "shard int, id long, nbrs array<long>, entry boolean"


def _by_id(t: pa.Table) -> pa.Table:
    return t.sort_by("id").combine_chunks()


def ragged(arrays: list[np.ndarray]) -> pa.Array:
    """Lists of integers as an Arrow column."""
    lengths = np.array([len(a) for a in arrays], np.int64)
    flat = np.concatenate(arrays) if len(arrays) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths)).astype(np.int32), pa.array(flat.astype(np.int64)))


def local_graph(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(ids, vectors, neighbours as rows, entry rows) of a shard's table sorted by id; edges to absent ids drop out."""
    ids, vecs = t.column("id").to_numpy(), matrix(t.column("vec"))
    col = t.column("nbrs").combine_chunks()
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    at = np.searchsorted(ids, flat)
    ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == flat) if len(flat) else np.zeros(0, bool)
    nbrs = [at[a:b][ok[a:b]] for a, b in zip(ends[:-1], ends[1:])]
    return ids, vecs, nbrs, np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False))


def meet(queries: DataFrame, held: DataFrame, look, schema: str, block: int = QUERY_BLOCK) -> DataFrame:
    """Queries (shard, id, vec) and the rows of their shards (shard, ...) in one task per shard and block of queries.

    Shards without queries are not moved. The number of shards bounds what is broadcast, 16 bytes each.
    """
    sizes = cut(queries.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("_n")))
    near = held.join(F.broadcast(sizes), "shard").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    asked = queries.join(F.broadcast(sizes), "shard").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).drop("_n")
    return asked.groupBy("shard", "_b").cogroup(near.groupBy("shard", "_b")).applyInArrow(look, schema)


def start_points(dim: int, norm: float = 1.0, count: int = 1, seed: int = 1) -> np.ndarray:
    """(count, dim) random vectors of length ``norm``, to start searches from."""
    x = np.random.default_rng(seed).standard_normal((count, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * norm


def frozen_rows(spark, starts: np.ndarray) -> DataFrame:
    """(id, vec): start points as rows of the reserved ids -1, -2, ..., which searches pass through and never return."""
    return spark.createDataFrame([(-1 - i, [float(y) for y in x]) for i, x in enumerate(starts)], "id long, vec array<double>")


def check_shards(members: DataFrame, shard_rows: int) -> None:
    """Raise if a shard holds more rows than one task may."""
    top = members.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    if top > shard_rows:
        raise ValueError(f"a shard has {top} rows; partition into more shards, so that each has at most {shard_rows}")


def build_sharded(
    rows: DataFrame, members: DataFrame, params: BuildParams = BuildParams(), shard_rows: int = SHARD_ROWS, starts: np.ndarray | None = None, book=None
) -> DataFrame:
    """(shard, id, nbrs, entry): a graph per shard of ``members`` (shard, id) over ``rows`` (id, vec).

    Rows enter in id order, so the result is the same in every run. Members without a row drop out. Degrees are at
    most ``params.degree``. Raises if a shard has more than ``shard_rows`` members. ``starts`` are vectors that
    are frozen into every shard under the ids of ``frozen_rows`` and are its entries instead of the medoid. With ``book``, a codebook, distances
    while building are those between the vectors that codes stand for.
    """
    check_shards(members, shard_rows)
    kept, model = asdict(params), book.__dict__ if book else None

    def build(key, t):
        t = _by_id(t)
        ids, vecs = t.column("id").to_numpy(), matrix(t.column("vec"))
        if model:
            b = type(book)(**model)
            vecs = b.decode(b.encode(vecs).astype(np.int64))
        if starts is not None:
            ids, vecs = np.append(-1 - np.arange(len(starts)), ids), np.concatenate([starts, vecs])
        nbrs, start = build_graph(vecs, BuildParams(**kept), None if starts is None else 0)
        entry = ids < 0
        entry[start] = True
        return pa.table({"shard": np.full(len(ids), t.column("shard")[0].as_py(), np.int32), "id": ids, "nbrs": ragged([ids[x] for x in nbrs]), "entry": entry})

    data = members.select(F.col("shard").cast("int"), "id").distinct().join(select_vectors(rows, "id", "vec"), "id").select("shard", "id", "vec")
    return data.groupBy("shard").applyInArrow(build, GRAPH)


def build_bulk(rows: DataFrame, members: DataFrame, params: BuildParams = BuildParams(), pool: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The same by blocks instead of insertions: each row's pool is its exact ``pool`` nearest rows of the shard, pruned, then
    joined with the rows that chose it and pruned again. Faster per row, and without an order of insertion."""
    check_shards(members, shard_rows)
    kept = asdict(params)

    def build(key, t):
        p = BuildParams(**kept)
        t = _by_id(t)
        ids, vecs = t.column("id").to_numpy(), matrix(t.column("vec"))
        n, norms = len(ids), (vecs * vecs).sum(1)
        rng = np.random.default_rng(1)
        own = []
        for lo in range(0, n, 512):
            grid = norms[lo : lo + 512, None] + norms[None] - 2 * vecs[lo : lo + 512] @ vecs.T
            near = np.argsort(grid, 1, kind="stable")[:, : pool + 1]
            for i, x in enumerate(near):
                # A few far rows keep the graph connected.
                c = np.append(x, rng.integers(0, n, 8))
                own.append(robust_prune(vecs, lo + i, c, distances(vecs, c, vecs[lo + i]), p))
        back: list[list[int]] = [[] for _ in range(n)]
        for i, x in enumerate(own):
            for y in x.tolist():
                back[y].append(i)
        nbrs = []
        for i in range(n):
            c = np.unique(np.append(own[i], np.array(back[i], np.int64)))
            nbrs.append(c if len(c) <= p.degree else robust_prune(vecs, i, c, distances(vecs, c, vecs[i]), p))
        entry = np.zeros(n, bool)
        entry[int(distances(vecs, np.arange(n), vecs.mean(0)).argmin())] = True
        return pa.table({"shard": t.column("shard"), "id": ids, "nbrs": ragged([ids[x] for x in nbrs]), "entry": entry})

    data = members.select(F.col("shard").cast("int"), "id").distinct().join(select_vectors(rows, "id", "vec"), "id").select("shard", "id", "vec")
    return data.groupBy("shard").applyInArrow(build, GRAPH)


def merge_shards(graph: DataFrame, degree: int, seed: int = 1) -> DataFrame:
    """(id, nbrs): the neighbours of an id from all shards, each once; above ``degree`` a hash of seed, id and neighbour picks.

    nbrs is in ascending order. Null and self edges drop out; ids without neighbours have an empty list.
    """
    edges = graph.select("id", F.explode("nbrs").alias("to")).filter("to is not null and to <> id").distinct()
    pick = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "to"), "to"))
    kept = edges.withColumn("_r", pick).filter(F.col("_r") <= degree).groupBy("id").agg(F.array_sort(F.collect_list("to")).alias("nbrs"))
    return graph.select("id").distinct().join(kept, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs"))


def merged_graph(graph: DataFrame, rows: DataFrame, degree: int, shard_rows: int = SHARD_ROWS, seed: int = 1) -> DataFrame:
    """(shard, id, nbrs, entry): the graphs of all shards merged into one that can be searched, entered at the medoid of all rows.

    Searches take it as one shard, so it may have at most ``shard_rows`` rows; larger sets stay sharded and merge results.
    """
    one = merge_shards(graph, degree, seed).withColumn("shard", F.lit(0))
    check_shards(one, shard_rows)
    center = medoid(rows).select("id", F.lit(True).alias("entry"))
    return one.join(F.broadcast(center), "id", "left").select("shard", "id", "nbrs", F.coalesce("entry", F.lit(False)).alias("entry"))


def search(
    queries: DataFrame, graph: DataFrame, rows: DataFrame, k: int, list_size: int = 100, routes: DataFrame | None = None, hidden: DataFrame | None = None,
    skip_self: bool = False, metric: str = "l2", seed: int = 1,
) -> DataFrame:
    """(query_id, rank, id, distance, hops, comparisons): approximate k nearest by greedy search in shards.

    ``routes`` (query_id, shard) says where each query looks; without it, in every shard. ``hidden`` (id) are expanded
    but not returned. hops and comparisons are sums over the shards that a query looked into. k must not exceed
    ``list_size``. A shard's graph meets its queries in blocks of ``QUERY_BLOCK``. Frozen start points (ids below 0) never come out. With ``metric`` fast_l2 distances are norm - 2 x.q, and
    a search begins at the neighbours of the entry nodes, padded with random nodes to ``list_size`` by ``seed``.
    """
    if not 0 < k <= list_size:
        raise ValueError("need 0 < k <= list_size")
    if metric not in ("l2", "fast_l2"):
        raise ValueError("metric must be l2 or fast_l2")
    q = select_vectors(queries, "id", "vec")
    if routes is None:
        shards = [r.shard for r in graph.select("shard").distinct().orderBy("shard").limit(10_001).collect()]
        if len(shards) > 10_000:
            raise ValueError("give routes to search in more than 10,000 shards")
        to = q.withColumn("shard", F.explode(F.array(*[F.lit(x).cast("int") for x in shards]) if shards else F.array().cast("array<int>")))
    else:
        to = q.join(routes.select(F.col("query_id").alias("id"), F.col("shard").cast("int")), "id")
    held = graph.join(select_vectors(rows, "id", "vec"), "id").select("shard", "id", "vec", "nbrs", "entry")
    held = held.withColumn("hid", F.lit(False)) if hidden is None else held.join(hidden.select("id", F.lit(True).alias("hid")).distinct(), "id", "left").fillna(False, ["hid"])
    schema = "query_id long, id long, distance double, hops long, comparisons long"
    empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "hops": pa.array([], pa.int64()), "comparisons": pa.array([], pa.int64())})

    def first(x: int, nodes: np.ndarray) -> list[int]:
        return [x, *[0] * (len(nodes) - 1)][: len(nodes)]

    def look(qs, t):
        if not qs.num_rows or not t.num_rows:
            return empty
        t = _by_id(t)
        ids, vecs, nbrs, starts = local_graph(t)
        norms = None
        if metric == "fast_l2":
            norms, starts = (vecs * vecs).sum(1), padded_seeds(nbrs, starts, list_size, seed)
        hide = t.column("hid").to_numpy(zero_copy_only=False) | (ids < 0)
        out = [[], [], [], [], []]
        for qid, v in zip(qs.column("id").to_pylist(), matrix(qs.column("vec"))):
            best, expanded, _, count = greedy_search(vecs, nbrs, starts, v, list_size, norms)
            show = ~hide[best.nodes]
            if skip_self:
                show &= ids[best.nodes] != qid
            nodes = best.nodes[show][:k]
            for c, x in zip(out, ([qid] * len(nodes), ids[nodes], best.dist[show][:k], first(len(expanded), nodes), first(count, nodes))):
                c.extend(x)
        return pa.table(dict(zip(("query_id", "id", "distance", "hops", "comparisons"), (pa.array(c, ty.type) for c, ty in zip(out, empty.columns)))))

    found = meet(to.select("shard", "id", "vec"), held, look, schema)
    # The first row of each query and shard carries what the search there cost; the others carry 0.
    unique = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"), F.sum("hops").alias("_h"), F.sum("comparisons").alias("_c"))
    w = Window.partitionBy("query_id")
    return (
        unique.withColumn("rank", F.row_number().over(w.orderBy("distance", "id"))).withColumn("hops", F.sum("_h").over(w)).withColumn("comparisons", F.sum("_c").over(w))
        .filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance", "hops", "comparisons")
    )
