"""Percentiles of very large numeric columns by cumulative frequencies.

The summary is a table of (group, metric, value, count). Counts of separate days or loads are combined
by adding them, so the summary is mergeable; with all value bits kept it is exact, and with
``value_bits`` the values carry a relative error of at most 2 ** -(value_bits - 1).

The running sum is never taken over a whole group in one task. The summary is sorted by range: by group and value, with bounds
sampled from the data, so that every partition holds about as many values, however large a group is and however its
values lie. Sums per group and partition give each partition its offset, and only inside a partition is
there a window running sum, and only where a wanted rank lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.blocks import cut

#: Group values per range.
RANGE_ROWS = 1_000_000


def value_counts(
    rows: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    once_by: str | None = None,
    value_bits: int | None = None,
    minimum: float | None = None,
) -> DataFrame:
    """The mergeable summary: (keys, metric, value, n).

    Null and NaN values, and those below ``minimum``, are left out. Rows that repeat ``once_by``
    count once (copies carry the same content; if they did not, the smallest values would count);
    rows where it is null all count. Null keys form a group of their own. ``value_bits`` rounds down
    to so many significant bits. An empty table gives no rows.
    """
    if {"metric", "value", "n", "p"} & set(keys):
        raise ValueError("keys must not be named metric, value, n or p")
    named = rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(metrics)],
        *([F.col(once_by).alias("_once")] if once_by else []),
    )
    if once_by:
        # One row per id with a map-side combine. Keys are part of the grouping: copies agree on them.
        held = [F.min(f"_m{i}").alias(f"_m{i}") for i in range(len(metrics))]
        by = [f"_k{i}" for i in range(len(keys))]
        unique = named.filter(F.col("_once").isNotNull()).groupBy("_once", *by).agg(*held).drop("_once")
        named = unique.unionByName(named.filter(F.col("_once").isNull()).drop("_once"))
    long = named.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_m{i}").alias("value")) for i, m in enumerate(metrics)])).alias("_e"),
    ).select(*keys, "_e.metric", "_e.value")
    v = F.col("value")
    good = v.isNotNull() & ~F.isnan(v)
    if minimum is not None:
        good = good & (v >= minimum)
    long = long.filter(good)
    if value_bits is not None:
        step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))) - (value_bits - 1))
        long = long.withColumn("value", F.when(v == 0, 0.0).otherwise(F.floor(v / step) * step))
    return long.groupBy(*keys, "metric", "value").agg(F.count("*").alias("n"))


def merge_counts(parts: Sequence[DataFrame]) -> DataFrame:
    """Combine summaries of disjoint loads; their columns must be the same."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    by = [c for c in whole.columns if c != "n"]
    return whole.groupBy(*by).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, points: Sequence[float], range_rows: int = RANGE_ROWS) -> DataFrame:
    """The values at ``points`` of a summary: (keys, metric, n, p, value), value = v[floor(p * n)].

    v are the n values of the group in order, from 0; p = 1 gives the largest. Groups are the
    columns of ``counts`` but for value and n. An empty summary gives no rows. A range has about ``range_rows`` group values.
    """
    keys = [c for c in counts.columns if c not in ("value", "n")]
    held = cut(counts)
    ranges = max(counts.sparkSession.sparkContext.defaultParallelism, math.ceil(held.count() / range_rows))
    # Written once: a partition's number must not change between its uses.
    ranged = cut(held.repartitionByRange(ranges, *keys, "value").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum("n").alias("_in"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))).withColumn("_total", F.sum("_in").over(whole))
    # Only ranges that hold a wanted rank are looked into.
    wanted = offsets.select(*keys, "_range", "_before", "_in", "_total", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p")).withColumn(
        "_rank", F.least(F.floor(F.col("p") * F.col("_total")), F.col("_total") - 1)
    ).filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
    ranks = wanted.groupBy(*keys, "_range").agg(
        F.first("_before").alias("_before"), F.first("_total").alias("_total"), F.collect_list(F.struct("p", "_rank")).alias("_ranks")
    )
    same = ranged.alias("r").join(
        ranks.alias("k"), F.expr(" and ".join(f"r.`{c}` <=> k.`{c}`" for c in [*keys, "_range"]))
    ).select(*[F.col(f"r.{c}") for c in [*keys, "_range", "value", "n"]], "_before", "_total", "_ranks")
    inner = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = same.withColumn("_upto", F.col("_before") + F.sum("n").over(inner))
    return (
        run.select(*keys, "value", "n", "_upto", "_total", F.explode("_ranks").alias("_w"))
        .filter((F.col("_w._rank") < F.col("_upto")) & (F.col("_w._rank") >= F.col("_upto") - F.col("n")))
        .select(*keys, F.col("_total").alias("n"), F.col("_w.p").alias("p"), "value")
    )
