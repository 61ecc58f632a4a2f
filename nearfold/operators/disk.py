"""Page-aware search with cost accounting, range search by growing lists, and the beam-width tuner."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .exact import select_vectors
from .graph import _by_id, local_graph, meet
from .kernels import beam_search, distances
from .pq import Codebook
from ..functions.arrow import matrix

RESULT = "query_id long, id long, distance double, place int, pages long, comparisons long, hops long, cache_hits long, us long"


def _search(
    queries: DataFrame, graph: DataFrame, rows: DataFrame, layout: DataFrame, book: Codebook | None, k: int, list_size: int, beam: int,
    reuse_pages: bool, cache: DataFrame | None, hidden: DataFrame | None, page_limit: int | None, skip_self: bool, radius: float | None,
    codes: DataFrame | None, routes: DataFrame | None = None,
) -> DataFrame:
    held = (
        graph.join(select_vectors(rows, "id", "vec"), "id").join(layout.select(F.col("logical_id").alias("id"), "page_no"), "id")
        .select("shard", "id", "vec", "nbrs", "entry", "page_no")
    )
    stored = book is not None and codes is not None
    if stored:
        held = held.join(codes.select("id", "codes"), "id")
    for name, marks in (("cached", cache), ("hid", hidden)):
        held = held.withColumn(name, F.lit(False)) if marks is None else held.join(marks.select("id", F.lit(True).alias(name)).distinct(), "id", "left").fillna(False, [name])
    q = select_vectors(queries, "id", "vec")
    if routes is None:
        shards = [r.shard for r in graph.select("shard").distinct().orderBy("shard").limit(10_001).collect()]
        if len(shards) > 10_000:
            raise ValueError("give routes to search in more than 10,000 shards")
        q = q.withColumn("shard", F.explode(F.array(*[F.lit(x).cast("int") for x in shards]) if shards else F.array().cast("array<int>")))
    else:
        q = q.join(routes.select(F.col("query_id").alias("id"), F.col("shard").cast("int")), "id")
    model = queries.sparkSession.sparkContext.broadcast(book.__dict__ if book else None)
    names = [x.split()[0] for x in RESULT.split(", ")]

    def look(qs, t):
        out: list[list] = [[] for _ in names]
        if qs.num_rows and t.num_rows:
            t = _by_id(t)
            ids, vecs, nbrs, starts = local_graph(t)
            page, cached, hide = (t.column(c).to_numpy(zero_copy_only=False) for c in ("page_no", "cached", "hid"))
            b = Codebook(**model.value) if model.value else None
            coded = (matrix(t.column("codes")).astype(np.int64) if stored else b.encode(vecs).astype(np.int64)) if b else None
            chunk = np.arange(coded.shape[1]) if b else None
            widest = max(len(c) for c in b.centers) if b else 0
            for qid, v in zip(qs.column("id").to_pylist(), matrix(qs.column("vec"))):
                begin = time.perf_counter()
                if b:
                    # A table of the query's distances to all centres; rows are looked up when they are met.
                    table = np.stack([np.pad(x[0], (0, widest - x.shape[1])) for x in b.tables(v[None])])
                    guide = lambda rows, table=table: table[chunk, coded[rows]].sum(1)
                else:
                    guide = lambda rows, v=v: distances(vecs, rows, v)
                size = list_size
                while True:
                    width = beam if radius is None else min(100, max(beam, size // 5))
                    nodes, dist, s = beam_search(vecs, nbrs, guide, starts, v, size, width, page, cached, reuse_pages, page_limit)
                    show = ~hide[nodes] & (ids[nodes] >= 0)
                    if skip_self:
                        show &= ids[nodes] != qid
                    nodes, dist = nodes[show], dist[show]
                    if radius is None:
                        nodes, dist = nodes[:k], dist[:k]
                        break
                    hits = int((dist <= radius).sum())
                    if 2 * hits < size:
                        nodes, dist = nodes[:hits], dist[:hits]
                        break
                    if size >= k:
                        # Too many lie within for a walk: the shard is read as a whole, which is exact.
                        every = distances(vecs, np.arange(len(vecs)), v)
                        nodes = np.flatnonzero((every <= radius) & ~hide & (ids >= 0) & (ids != qid if skip_self else True))
                        nodes = nodes[np.lexsort((nodes, every[nodes]))]
                        dist = every[nodes]
                        s.pages, s.comparisons = len(np.unique(page[~cached])), s.comparisons + len(vecs)
                        break
                    size *= 2
                us = int(1e6 * (time.perf_counter() - begin))
                for i, (x, d) in enumerate(zip(ids[nodes].tolist(), dist.tolist())):
                    cost = (s.pages, s.comparisons, s.hops, s.cache_hits, us) if not i else (0, 0, 0, 0, 0)
                    for c, y in zip(out, (qid, x, d, i, *cost)):
                        c.append(y)
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), *[pa.int64()] * 5]
        return pa.table({n: pa.array(c, ty) for n, c, ty in zip(names, out, types)})

    found = meet(q.select("shard", "id", "vec"), held, look, RESULT)
    costs = names[4:]
    unique = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"), *[F.sum(c).alias(c) for c in costs])
    w = Window.partitionBy("query_id")
    ranked = unique.withColumn("rank", F.row_number().over(w.orderBy("distance", "id"))).withColumns({c: F.sum(c).over(w) for c in costs})
    return ranked.select("query_id", "rank", "id", "distance", *costs)


def page_search(
    queries: DataFrame, graph: DataFrame, rows: DataFrame, layout: DataFrame, k: int = 10, list_size: int = 50, beam: int = 2, book: Codebook | None = None,
    reuse_pages: bool = False, cache: DataFrame | None = None, hidden: DataFrame | None = None, page_limit: int | None = None, skip_self: bool = False,
    codes: DataFrame | None = None, timed: bool = False, routes: DataFrame | None = None,
) -> DataFrame:
    """(query_id, rank, id, distance, pages, comparisons, hops, cache_hits): k nearest by beam search over pages.

    With ``timed`` also us, the microseconds that the query's walks took in their tasks. ``codes`` (id, codes) are the rows' codes of ``book``; without them
    each task encodes its shard. ``routes`` (query_id, shard) says where each query looks; without it, in every shard.

    Codes of ``book`` guide the search, without it full distances do; results are ordered by full distance. ``layout``
    maps ids to pages. ``cache`` (id) are free of reads, ``hidden`` (id) are not returned. With ``reuse_pages`` all nodes of
    a page that the query has read are free as well: the results are the same, and no more pages are read. Fewer
    results come back when fewer nodes were expanded, for instance under ``page_limit``. Costs are per query.
    """
    if not 0 < k <= list_size or beam < 1:
        raise ValueError("need 0 < k <= list_size and a positive beam")
    found = _search(queries, graph, rows, layout, book, k, list_size, beam, reuse_pages, cache, hidden, page_limit, skip_self, None, codes, routes)
    return (found if timed else found.drop("us")).filter(F.col("rank") <= k)


def range_search(
    queries: DataFrame, graph: DataFrame, rows: DataFrame, layout: DataFrame, radius: float, min_list: int = 100, max_list: int = 10_000, min_beam: int = 2,
    book: Codebook | None = None, skip_self: bool = False, codes: DataFrame | None = None,
) -> DataFrame:
    """Approximate rows within ``radius``: the list doubles while half of it or more lies within, up to ``max_list``.

    Where half of a list of ``max_list`` or more still lies within, the query compares all rows of that shard instead, exactly: no
    number of rows is too large to come out.
    """
    return _search(queries, graph, rows, layout, book, max_list, min_list, min_beam, True, None, None, None, skip_self, radius, codes).drop("us")


def batch_stats(found: DataFrame) -> DataFrame:
    """(queries, mean_us, p999_us, mean_pages, mean_comparisons, mean_hops, mean_cache_hits) of a search with ``timed``; one row.

    The percentile is exact for up to 10,000 values and within a ten-thousandth of the ranks beyond.
    """
    one = found.filter("rank = 1")
    means = [F.avg(c).alias(f"mean_{c}") for c in ("pages", "comparisons", "hops", "cache_hits")]
    return one.agg(F.count("*").alias("queries"), F.avg("us").alias("mean_us"), F.percentile_approx("us", 0.999, 10_000).alias("p999_us"), *means)


def tune_beam(run, start: int = 1, most: int = 64, tail_ms: float = 15.0) -> int:
    """The beam width with the best throughput: grows by a tenth, rounded up, while queries per second rise and the
    99.9th percentile stays below ``tail_ms`` plus twice the mean.

    ``run(beam)`` makes a search and returns the latencies of its queries in seconds.
    """
    best, beam, rate = start, start, 0.0
    while beam <= most:
        t = time.perf_counter()
        lat = sorted(run(beam))
        now = len(lat) / max(time.perf_counter() - t, 1e-9)
        mean, tail = sum(lat) / len(lat), lat[min(len(lat) - 1, int(0.999 * len(lat)))]
        if now <= rate or tail * 1000 >= tail_ms + 2 * mean * 1000:
            break
        best, rate = beam, now
        beam = math.ceil(beam * 1.1) if math.ceil(beam * 1.1) > beam else beam + 1
    return best
