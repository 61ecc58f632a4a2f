"""Page layouts from what queries visit together.

A path table is (path_id, pos, id): the nodes that a search visited, in order. Rows with nulls in these columns do
not count, and repeated rows count once. A layout is (logical_id, physical_id, page_no, slot), a bijection onto 0..n-1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PAGE_BYTES = 4096
#: Nodes on a co-visit path are tied to the next three, with weight 1 / (1 + gap).
REACH = 3
#: Up to so many rows are ordered and cut in one task.
ONE_TASK = 50_000


def nodes_per_page(degree: int, dim: int, element_bytes: int = 4, page_bytes: int = PAGE_BYTES) -> int:
    """Records (degree, neighbours, vector) that fit a page; at least 1, larger records take pages of their own."""
    return max(1, page_bytes // ((degree + 1) * 4 + dim * element_bytes))


def paths_of(logs: DataFrame, path: str, pos: str, node: str) -> DataFrame:
    """(path_id, pos, id) of a log: rows with nulls left out, each place and node once."""
    p = logs.select(F.col(path).alias("path_id"), F.col(pos).alias("pos"), F.col(node).alias("id"))
    return p.filter("path_id is not null and pos is not null and id is not null").distinct()


def covisit_weights(paths: DataFrame, reach: int = REACH) -> DataFrame:
    """(a, b, weight), a < b: sum over paths of 1 / (1 + gap) for nodes at most ``reach`` places apart.

    Each row looks at its places ahead by an equi-join on (path, place), so a long path stays linear and can be
    split over tasks.
    """
    ahead = paths.select("path_id", "id", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + reach)).alias("pos"), F.col("pos").alias("_from"))
    other = paths.select("path_id", "pos", F.col("id").alias("_other"))
    met = ahead.join(other, ["path_id", "pos"]).filter(F.col("id") != F.col("_other"))
    w = 1.0 / (1.0 + F.col("pos") - F.col("_from"))
    return met.groupBy(F.least("id", "_other").alias("a"), F.greatest("id", "_other").alias("b")).agg(F.sum(w).alias("weight"))


def covisit_strength(weights: DataFrame) -> DataFrame:
    """(id, strength): the sum of a node's weights."""
    both = weights.select(F.explode(F.array("a", "b")).alias("id"), "weight")
    return both.groupBy("id").agg(F.sum("weight").alias("strength"))


def visit_counts(paths: DataFrame) -> DataFrame:
    """(id, visits): the paths that visit a node."""
    return paths.select("path_id", "id").distinct().groupBy("id").agg(F.count("*").alias("visits"))


def hot_nodes(paths: DataFrame, n: int) -> DataFrame:
    """(id, visits): the n most visited nodes, ties to the smaller id. Above ``ONE_TASK`` rows they are numbered over all tasks."""
    return first_rows(visit_counts(paths).withColumn("_v", -F.col("visits")), ["_v", "id"], n).select("id", "visits")


def path_stats(paths: DataFrame) -> DataFrame:
    """(paths, avg_length, max_length, nodes)."""
    per = paths.groupBy("path_id").agg(F.count("*").alias("n"))
    nodes = paths.agg(F.countDistinct("id").alias("nodes"))
    return per.agg(F.count("*").alias("paths"), F.avg("n").alias("avg_length"), F.max("n").alias("max_length")).join(F.broadcast(nodes))  # one row each


#: Rows of a range when rows are numbered.
NUMBER_ROWS = 1_000_000


def number_globally(rows: DataFrame, order: list, name: str, buckets: int | None = None) -> DataFrame:
    """Adds ``name`` = 0, 1, ... in the order of ``order`` columns, without sorting all rows in one task.

    Rows are range-partitioned, by their number if ``buckets`` is not given, counted per partition, and numbered inside it from the sum of those before. The
    partitioned rows are written to the checkpoint folder first, so that counts and numbers see the same partitions.
    """
    from .blocks import cut

    if buckets is None:
        buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // NUMBER_ROWS))
    # The number that Spark gives a row holds its partition above bit 33 and its place in the partition below.
    parts = cut(rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    part, place = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    sums = parts.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # ``buckets`` rows
    offsets = sums.select("_p", before.alias("_before"))
    numbered = parts.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return numbered.withColumn(name, (F.col("_before") + place).cast("long")).drop("_p", "_i", "_before")


def first_rows(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``: by one task for few, by global numbers for many."""
    return rows.orderBy(*order).limit(n) if n <= ONE_TASK else number_globally(rows, order, "_place").filter(F.col("_place") < n).drop("_place")


def paged(order: DataFrame, per_page: int) -> DataFrame:
    """(logical_id, physical_id, page_no, slot) from (logical_id, physical_id); page 0 is the header."""
    return order.select("logical_id", "physical_id", (F.floor(F.col("physical_id") / per_page) + 1).alias("page_no"), (F.col("physical_id") % per_page).cast("int").alias("slot"))


def identity_layout(ids: DataFrame, per_page: int) -> DataFrame:
    """Nodes in id order."""
    return paged(number_globally(ids.select(F.col("id").alias("logical_id")).distinct(), ["logical_id"], "physical_id"), per_page)


def first_seen_layout(paths: DataFrame, ids: DataFrame, per_page: int) -> DataFrame:
    """Nodes in order of first appearance over the paths by (path_id, pos), then the others by id."""
    first = paths.groupBy("id").agg(F.min(F.struct("path_id", "pos")).alias("_f"))
    every = ids.select("id").distinct().join(first, "id", "left")
    keyed = every.select(F.col("id").alias("logical_id"), F.col("_f").isNull().alias("_n"), F.col("_f.path_id").alias("_a"), F.col("_f.pos").alias("_b"))
    return paged(number_globally(keyed, ["_n", "_a", "_b", "logical_id"], "physical_id").select("logical_id", "physical_id"), per_page)


def covisit_layout(weights: DataFrame, members: DataFrame, per_page: int, shard_rows: int = 1_000_000) -> DataFrame:
    """Nodes shard by shard, each in breadth-first order over its co-visit edges, strongest seeds and edges first.

    ``weights`` are (shard, a, b, weight), ``members`` (shard, id) with each id in one shard. The walk is sequential, so
    a shard is one task's work; raises above ``shard_rows`` members. Nodes that no path visits follow by id.
    """
    top = members.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    if top > shard_rows:
        raise ValueError(f"a shard has {top} rows; at most {shard_rows} can be ordered in one task")

    def order(edges, ids):
        own = np.unique(ids.column("id").to_numpy())
        a, b, w = (edges.column(c).to_numpy() for c in ("a", "b", "weight"))
        src, dst, wt = np.append(a, b), np.append(b, a), np.append(w, w)
        ok = np.isin(src, own) & np.isin(dst, own)
        src, dst, wt = np.searchsorted(own, src[ok]), np.searchsorted(own, dst[ok]), wt[ok]
        strength = np.bincount(src, wt, minlength=len(own))
        by = np.lexsort((dst, -np.round(wt, 9), src))
        dst, starts = dst[by], np.searchsorted(src[by], np.arange(len(own) + 1))
        done, out = np.zeros(len(own), bool), []
        for seed in np.lexsort((own, -np.round(strength, 9))):
            if done[seed]:
                continue
            done[seed] = True
            queue = [int(seed)]
            for node in queue:
                new = dst[starts[node] : starts[node + 1]]
                for x in new[~done[new]].tolist():
                    done[x] = True
                    queue.append(x)
            out += queue
        n = len(own)
        shard = ids.column("shard").to_pylist()[:1] * n
        return pa.table({"shard": pa.array(shard, pa.int32()), "logical_id": own[np.array(out, np.int64)], "place": np.arange(n)})

    s = F.col("shard").cast("int").alias("shard")
    placed = (
        weights.select(s, F.col("a").cast("long"), F.col("b").cast("long"), "weight").groupBy("shard")
        .cogroup(members.select(s, F.col("id").cast("long")).groupBy("shard")).applyInArrow(order, "shard int, logical_id long, place long")
    )
    return paged(number_globally(placed, ["shard", "place"], "physical_id").select("logical_id", "physical_id"), per_page)


def unique_pages(paths: DataFrame, layout: DataFrame) -> DataFrame:
    """(path_id, nodes, pages): the distinct pages that each path touches."""
    at = paths.join(layout.select(F.col("logical_id").alias("id"), "page_no"), "id")
    return at.groupBy("path_id").agg(F.countDistinct("id").alias("nodes"), F.countDistinct("page_no").alias("pages"))


def cache_by_levels(graph: DataFrame, start: DataFrame, share: float = 0.1, most: int | None = None) -> DataFrame:
    """(id): nodes nearest to the start by edges, level by level then by id, at most ``share`` of all nodes."""
    from .evaluate import bfs_levels

    n = graph.select("id").distinct().count()
    cap = int(min(n * share, most if most is not None else n))
    return first_rows(bfs_levels(graph, start), ["level", "id"], cap).select("id")


def write_pages(graph: DataFrame, rows: DataFrame, layout: DataFrame, path: str, partitions: int = 8) -> None:
    """The disk layout as Parquet, range-partitioned by page and sorted: (page_no, slot, id, vec, nbrs)."""
    laid = layout.select(F.col("logical_id").alias("id"), "page_no", "slot").join(rows.select("id", "vec"), "id").join(graph.select("id", "nbrs"), "id", "left")
    laid.repartitionByRange(partitions, "page_no").sortWithinPartitions("page_no", "slot").select("page_no", "slot", "id", "vec", "nbrs").write.mode("errorifexists").parquet(path)
