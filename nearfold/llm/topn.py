"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 10, largest: bool = False) -> DataFrame:
    """The ``n`` best items of each group, as (group, item, score, rank), ranks from 1.

    An item's score is its best one in the group; equal scores go to the smaller item. By default the
    smallest score is best; ``largest`` turns this round. Rows with a null group, item or score, or a
    NaN score, do not count. Smaller groups give all their items; an empty table gives no rows. Other
    columns are ignored.

    Both aggregations are cut before the shuffle: repeated items collapse in the map-side aggregate,
    and the rank filter becomes a partial group limit, so a task sends at most ``n`` rows per group
    however hot the group is.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col("_score")
    best = (
        rows.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_score"))
        .filter(F.col("_g").isNotNull() & F.col("_i").isNotNull() & s.isNotNull() & ~F.isnan(s))
        .groupBy("_g", "_i")
        .agg((F.max if largest else F.min)("_score").alias("_score"))
    )
    order = F.col("_score").desc() if largest else F.col("_score").asc()
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(order, F.col("_i").asc()))
    return (
        best.withColumn("_rank", rank)
        .filter(F.col("_rank") <= n)
        .select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_score").alias(score), F.col("_rank").alias("rank"))
    )
