"""The pN_ queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.blocks import cut
from ..operators.sessions import table
from . import bisect, cooccur, leaks, mih, mixing, percentiles, splitting, topn
from .oracle import ORACLE

METRICS = ["total_us", "io_us", "n_ios"]
POINTS = [0.5, 0.9, 0.95, 0.99]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.cooccurrence(table(spark, d, "neighbor"), "shard", "search_id", "id", F.col("expanded"), 5, 3.0)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("shard", "id_a", "id_b")


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).withColumns({"lift": F.round("lift", 6), "pmi": F.round("pmi", 6)})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = mih.knn_all(table(spark, d, "partition_rows"), "id", "cur_row", 64, 5)
    return near.select(F.least("id", "neighbor_id").alias("id_a"), F.greatest("id", "neighbor_id").alias("id_b")).distinct()


def p2_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return mih.knn_all(table(spark, d, "partition_rows"), "id", "cur_row", 64, 5)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    # Weeks begin on Mondays; 1970-01-05 is day 4 of the epoch. No session time zone enters.
    day = F.floor(F.unix_micros("searched_at") / 86_400_000_000)
    stats = table(spark, d, "percentile_stats").withColumn("week_no", F.floor((day - 4) / 7))
    return percentiles.value_counts(stats, ["index_tag", "search_l", "week_no"], METRICS, once_by="stat_id", minimum=0.0)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["index_tag", "search_l", "week_no", "metric"]
    found = percentiles.percentiles(_counts(spark, d), [0.5, 0.95])
    wide = found.groupBy(*keys, "n").agg(F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("mid"), F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("high"))
    return wide.filter((F.col("n") >= 20) & (F.col("high") >= 4 * F.col("mid"))).select(*keys)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.percentiles(_counts(spark, d), POINTS)


def p3_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per index and metric, from the weekly summaries combined."""
    weekly = _counts(spark, d).select("index_tag", "metric", "value", "n")
    return percentiles.percentiles(percentiles.merge_counts([weekly]), POINTS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "neighbor"), "query_id", "id", "distance", 10).select("query_id", "id")


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "neighbor"), "query_id", "id", "distance", 10)


def _held_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that some shard holds."""
    return table(spark, d, "partition_shards").select(F.explode("shard_ids").alias("id")).filter("id is not null").distinct()


def _held_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of partition_rows whose id some shard holds."""
    return table(spark, d, "partition_rows").select("id", "cur_row").join(_held_ids(spark, d), "id", "left_semi")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return bisect.linked_clusters(table(spark, d, "partition_rows"), "id", "cur_row", 64, 0.4, held=_held_ids(spark, d))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return bisect.describe_clusters(bisect.bisecting_clusters(table(spark, d, "partition_rows"), "id", "cur_row", 64, 2.0, held=_held_ids(spark, d)), 3)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), window=12).select("doc_id", "item_id")


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of 16 words with at most one word changed, added or dropped."""
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), window=16, max_edits=1)


def _rated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return sized, cut(mixing.rates(mixing.source_sizes(sized, table(spark, d, "mix_targets")), "closest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_shares(spark, d).filter("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_rated(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, rated = _rated(spark, d)
    return mixing.mix_report(rated, mixing.mix(sized, rated))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pieces(spark, d).filter("piece_no = 0").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "documents"), limit=1024, overlap=64)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
