"""Labels and vectors of results: joins of tags, live sets and rows on the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .exact import select_vectors


def with_tags(found: DataFrame, tags: DataFrame, strict: bool = False) -> DataFrame:
    """``found`` with the column tag of (id, tag); ids without a tag drop out, or with ``strict`` are an error.

    tags must hold an id once. Equi-join on the id; null ids match nothing.
    """
    named = tags.select("id", "tag")
    if not strict:
        return found.join(named, "id")
    both = found.join(named.withColumn("_known", F.lit(True)), "id", "left")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no tag for id "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))).otherwise(F.col("tag"))
    return both.withColumn("tag", known).drop("_known")


def live_results(found: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, tag): the results of ids in ``live`` (id, tag) in order, k at most, ranked anew; ids without a live tag are passed over."""
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = with_tags(found, live).withColumn("rank", F.row_number().over(order).cast("long"))
    return kept.filter(F.col("rank") <= k).select("query_id", "rank", "tag")


def with_vectors(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` with the column vec of ``rows`` (id, vec)."""
    return found.join(select_vectors(rows, "id", "vec"), "id", "left")


def vectors_by_tag(tags: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tag, vec) of each distinct tag of ``wanted`` (tag); vec is null where no row carries it."""
    known = tags.select("id", "tag").join(select_vectors(rows, "id", "vec"), "id").select("tag", "vec")
    return wanted.select("tag").distinct().join(known, "tag", "left")


def truth_within(truth: DataFrame, radius: float) -> DataFrame:
    """The rows of a truth set at a distance of at most ``radius``."""
    return truth.filter(F.col("distance") <= radius)


def truth_sizes(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(queries, least, most): how many rows of a truth set the queries (id) have, those with none included; one row."""
    per = queries.select(F.col("id").alias("query_id")).distinct().join(truth.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").fillna(0, ["n"])
    return per.agg(F.count("*").alias("queries"), F.min("n").alias("least"), F.max("n").alias("most"))
