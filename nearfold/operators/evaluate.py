"""Recall, percentiles and index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def floor_percentiles(rows: DataFrame, value: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., p, value): v[floor(p * n)] of the n values in order, p = 1 the largest; nulls and NaN do not count.

    Values are reduced to counts, and counts to sums per range of values (64 ranges per doubling), over which the offsets
    run. A running sum is only taken inside the ranges that hold a wanted rank, so no task sorts a whole group.
    """
    keys = by or []
    v = F.col("value")
    counts = rows.select(*keys, F.col(value).alias("value")).filter(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, "value").agg(F.count("*").alias("_c"))
    d = v.cast("double")
    counts = counts.withColumn("_band", F.floor(F.signum(d) * F.log2(1 + F.abs(d)) * 64))
    bands = counts.groupBy(*keys, "_band").agg(F.sum("_c").alias("_in"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # bands, not rows
    first = F.coalesce(F.sum("_in").over(whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_in").over(whole)
    wanted = (
        bands.withColumn("_first", first).withColumn("_n", total).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in points])))
        .withColumn("_rank", F.least(F.floor(F.col("p") * F.col("_n")), F.col("_n") - 1)).filter("_rank >= _first and _rank < _first + _in")
    )
    ranks = wanted.groupBy(*keys, "_band").agg(F.first("_first").alias("_first"), F.collect_list(F.struct("p", "_rank")).alias("_ranks"))
    same = " and ".join(f"c.`{k}` <=> r.`{k}`" for k in [*keys, "_band"])
    held = counts.alias("c").join(ranks.alias("r"), F.expr(same)).select("c.*", "r._first", "r._ranks")
    upto = F.col("_first") + F.sum("_c").over(Window.partitionBy(*keys, "_band").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = held.withColumn("_upto", upto).withColumn("_w", F.explode("_ranks"))
    return found.filter("_w._rank < _upto and _w._rank >= _upto - _c").select(*keys, F.col("_w.p").alias("p"), "value")


def truth_with_ties(truth: DataFrame, k: int) -> DataFrame:
    """The first k of each query, and whatever follows at the distance of the k-th."""
    at = Window.partitionBy("query_id")
    edge = F.max(F.when(F.col("rank") <= k, F.col("distance"))).over(at)
    return truth.withColumn("_edge", edge).filter((F.col("rank") <= k) | (F.col("distance") == F.col("_edge"))).drop("_edge")


def recall_per_query(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): per cent of the first k results that are in the tie-extended truth; 0 if none is."""
    wanted = truth_with_ties(truth, k).select("query_id", "id").distinct()
    got = result.filter(F.col("rank") <= k).select("query_id", "id").distinct()
    hits = got.join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("_h"))
    return wanted.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("_h", F.lit(0)) * 100.0 / k).alias("recall"))


def recall_at(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(k, recall): the average over the queries of the truth."""
    return recall_per_query(result, truth, k).agg(F.avg("recall").alias("recall")).select(F.lit(k).alias("k"), "recall")


def recall_all_positions(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(k, recall) for every k from 1, one aggregation for all of them."""
    marks = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k")
    t = truth.select("query_id", "id", "rank", "distance", marks)
    edge = F.max(F.when(F.col("rank") <= F.col("k"), F.col("distance"))).over(Window.partitionBy("query_id", "k"))
    wanted = t.withColumn("_e", edge).filter((F.col("rank") <= F.col("k")) | (F.col("distance") == F.col("_e"))).select("query_id", "k", "id").distinct()
    got = result.filter(F.col("rank") <= k).select("query_id", "id", F.explode(F.sequence(F.col("rank"), F.lit(k))).alias("k"))
    hits = wanted.join(got, ["query_id", "k", "id"]).groupBy("k").agg(F.count("*").alias("_h"))
    n = truth.select("query_id").distinct().agg(F.count("*").alias("_n"))
    ks = wanted.select("k").distinct().join(hits, "k", "left")
    return ks.join(F.broadcast(n)).select("k", (F.coalesce("_h", F.lit(0)) * 100.0 / (F.col("k") * F.col("_n"))).alias("recall"))


def active_recall(result: DataFrame, truth: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """Recall when only ids of ``live`` count: the truth is followed until k live entries are found."""
    kept = truth.join(live.select("id").distinct(), "id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return recall_at(result, kept.withColumn("rank", rank), k)


def range_recall(result: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, recall): hits over truth size in per cent, 100 where the truth is empty."""
    size = truth.groupBy("query_id").agg(F.count("*").alias("_n"))
    hits = truth.join(result.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("_h"))
    q = queries.select("query_id").distinct().join(size, "query_id", "left").join(hits, "query_id", "left")
    return q.select("query_id", F.when(F.col("_n") > 0, F.coalesce("_h", F.lit(0)) * 100.0 / F.col("_n")).otherwise(100.0).alias("recall"))


def range_ratio(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(returned, hits, wanted, returned_ratio, hit_ratio): ratios of sums over all queries."""
    hits = truth.join(result.select("query_id", "id").distinct(), ["query_id", "id"]).agg(F.count("*").alias("hits"))
    sizes = result.agg(F.count("*").alias("returned")).join(F.broadcast(truth.agg(F.count("*").alias("wanted")))).join(F.broadcast(hits))
    w: Column = F.col("wanted")
    return sizes.select("returned", "hits", "wanted", (F.col("returned") / w).alias("returned_ratio"), (F.col("hits") / w).alias("hit_ratio"))


def remap_truth(truth: DataFrame, tags: DataFrame) -> DataFrame:
    """(query_id, rank, id, distance) with ids replaced by their tags (id, tag); tag 0 is hidden and drops out, ranks close up."""
    kept = truth.join(tags.select("id", "tag").filter("tag is not null and tag <> 0"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "tag"))
    return kept.select("query_id", rank.alias("rank"), F.col("tag").alias("id"), "distance")


def degree_stats(graph: DataFrame) -> DataFrame:
    """(max_degree, avg_degree, min_degree, below_two) of a graph (id, nbrs)."""
    d = F.size("nbrs")
    return graph.agg(F.max(d).alias("max_degree"), F.avg(d).alias("avg_degree"), F.min(d).alias("min_degree"), F.count_if(d < 2).alias("below_two"))


def reverse_edges(graph: DataFrame) -> DataFrame:
    """(id, in_degree) over the nodes that are some node's neighbour."""
    return graph.select(F.explode("nbrs").alias("id")).groupBy("id").agg(F.count("*").alias("in_degree"))


def bfs_levels(graph: DataFrame, start: DataFrame, most: int = 32) -> DataFrame:
    """(id, level): nodes by the number of edges from ``start`` (id), at most ``most`` levels; unreached nodes are absent.

    One join per level; levels are written to the checkpoint folder.
    """
    from .blocks import cut

    edges = cut(graph.select("id", F.explode("nbrs").alias("to")))
    seen = cut(start.select("id", F.lit(0).alias("level")).distinct())
    for level in range(1, most + 1):
        new = seen.filter(F.col("level") == level - 1).join(edges, "id").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti")
        grown = cut(seen.unionByName(new.withColumn("level", F.lit(level))))
        if grown.filter(F.col("level") == level).isEmpty():
            return grown
        seen = grown
    return seen


def simulate_aggregate_recall(spark: SparkSession, k_total: int, k: int, parts: int, recalls: list[float], rounds: int = 10_000, seed: int = 1) -> DataFrame:
    """(recall): expected recall of the ``k_total`` nearest when each of ``parts`` random partitions returns k results.

    The true neighbours fall into partitions uniformly; of n in one, min(n, k) can be found, at the rate recalls[min(n, k) - 1].
    """
    import numpy as np
    import pyarrow as pa

    if len(recalls) < k or min(k_total, k, parts, rounds) < 1:
        raise ValueError("need positive numbers and a recall for each rank up to k")
    rate = np.append(0.0, np.asarray(recalls[:k]))

    def run(batches):
        for b in batches:
            for block in b.column("id").to_pylist():
                n = min(1000, rounds - 1000 * block)
                held = np.minimum(np.random.default_rng([seed, block]).multinomial(k_total, [1 / parts] * parts, n), k)
                yield pa.RecordBatch.from_arrays([pa.array([float((rate[held] * held).sum() / k_total)]), pa.array([n])], ["s", "n"])

    blocks = -(-rounds // 1000)
    got = spark.range(0, blocks, 1, min(blocks, 8)).mapInArrow(run, "s double, n long")
    return got.agg((F.sum("s") / F.sum("n")).alias("recall"))
