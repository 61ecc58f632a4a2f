"""What SQL can say of approximate results: how many there are, that distances and order are right, that recall is reached."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.distance import l2_squared
from ..operators import evaluate
from ..operators.exact import select_vectors


def recall_reached(found: DataFrame, truth: DataFrame, k: int, least: float) -> DataFrame:
    """(queries, reached): the queries of the truth, and whether their average recall is at least ``least`` per cent."""
    per = evaluate.recall_per_query(found, truth, k)
    return per.agg(F.count("*").alias("queries"), (F.avg("recall") >= least).alias("reached"))


REACHED = "SELECT count(*) AS queries, true AS reached FROM asked"


def results_right(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, results, exact, ordered): per query the number of results, whether each carries its row's true squared distance, is no
    repetition and not the query itself, and whether ranks are 1, 2, ... by (distance, id)."""
    q = select_vectors(queries, "id", "vec").select(F.col("id").alias("query_id"), F.col("vec").alias("_q"))
    b = select_vectors(rows, "id", "vec").select("id", F.col("vec").alias("_b"))
    true = l2_squared("_q", "_b")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    both = found.join(q, "query_id", "left").join(b, "id", "left").withColumns({"_place": place, "_d": true})
    good = (F.abs(F.col("_d") - F.col("distance")) <= 1e-6 * (1 + F.col("_d"))) & (F.col("id") != F.col("query_id"))
    return both.groupBy("query_id").agg(
        F.count("*").alias("results"),
        ((F.countDistinct("id") == F.count("*")) & F.min(F.coalesce(good, F.lit(False)))).alias("exact"), F.min(F.col("rank") == F.col("_place")).alias("ordered"),
    )


def sql_right(k: int) -> str:
    return f"SELECT id AS query_id, {k} AS results, true AS exact, true AS ordered FROM asked"
