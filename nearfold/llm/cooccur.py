"""Items that appear together: pair counts, lift and pointwise mutual information per scope.

Baskets are kept as rows, never as arrays. Two exact prunings run before pairs are formed. A pair
cannot be counted more often than its rarer item, so items below ``min_count`` drop out; and since
n_ab <= min(n_a, n_b), a lift n_ab * n / (n_a * n_b) >= L needs max(n_a, n_b) <= n / L, so items in more
than n / L baskets drop out too. Hot items go this way.

Hot baskets, whose pairs would be quadratic in a large part of the rows, form no pairs either: up to
``min_count`` - 1 of the largest baskets of a scope are set aside. A pair that reaches ``min_count`` must then
occur in at least one other basket, so the others give all candidates, and the baskets set aside only add their counts
to these, by joins on their items. Further hot baskets are dealt into blocks of items, every pair of which is a cell of its own, so
that no task holds a basket whole. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.blocks import cut
from .blocks import block_pairs

#: Baskets with more present rows than this may be set aside, and are dealt into blocks of so many items if they are not.
HOT_ITEMS = 4096


def cooccurrence(
    rows: DataFrame,
    scope: str,
    basket: str,
    item: str,
    present: Column | None = None,
    min_count: int = 5,
    min_lift: float = 3.0,
    hot_items: int = HOT_ITEMS,
) -> DataFrame:
    """Pairs of items that share at least ``min_count`` baskets of a scope and reach ``min_lift``.

    Returns (scope, id_a, id_b, n_ab, n_a, n_b, n, lift, pmi) with id_a < id_b; pmi is in nats.

    An item is in a basket if any of its rows there has ``present`` true (null counts as false).
    n counts the distinct baskets of the scope over all rows, also those without a present item.
    Rows with a null scope or basket are left out everywhere, null items only as items. Repeated rows
    count once. An empty table gives no rows. Other columns of ``rows`` are ignored, whatever their names.
    """
    if min_count < 1 or min_lift < 0:
        raise ValueError("min_count must be at least 1 and min_lift not negative")
    base = rows.select(
        F.col(scope).alias("_s"),
        F.col(basket).alias("_b"),
        F.col(item).alias("_i"),
        F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("_p"),
    ).filter(F.col("_s").isNotNull() & F.col("_b").isNotNull())

    baskets = base.groupBy("_s", "_b").agg(F.count_if(F.col("_p") & F.col("_i").isNotNull()).alias("_c"))
    scopes = cut(baskets.groupBy("_s").agg(F.count("*").alias("n"), F.max("_c").alias("_most")))
    totals = scopes.select("_s", "n")
    members = base.filter(F.col("_p") & F.col("_i").isNotNull()).select("_s", "_b", "_i").distinct()
    counts = members.groupBy("_s", "_i").agg(F.count("*").alias("n_i")).filter(F.col("n_i") >= min_count)
    usable = counts.join(totals, "_s").filter(F.col("n_i") * F.lit(float(min_lift)) <= F.col("n"))

    kept = members.join(usable.select("_s", "_i"), ["_s", "_i"], "left_semi")
    if not scopes.filter(F.col("_most") > hot_items).isEmpty():
        size = Window.partitionBy("_s").orderBy(F.col("_c").desc(), "_b")
        large = baskets.filter(F.col("_c") > hot_items).withColumn("_r", F.row_number().over(size))
        hot = cut(large.select("_s", "_b", (F.col("_r") < min_count).alias("_aside")))
        pairs = _with_hot(kept, hot, min_count, hot_items)
    else:
        pairs = _pairs(kept).filter(F.col("n_ab") >= min_count)
    a = usable.select("_s", F.col("_i").alias("id_a"), F.col("n_i").alias("n_a"), "n")
    b = usable.select("_s", F.col("_i").alias("id_b"), F.col("n_i").alias("n_b"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
    return (
        pairs.join(a, ["_s", "id_a"])
        .join(b, ["_s", "id_b"])
        .filter(F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
        .select(
            F.col("_s").alias(scope), "id_a", "id_b", "n_ab", "n_a", "n_b", "n",
            lift.alias("lift"), F.log(lift).alias("pmi"),
        )
    )


def _pairs(rows: DataFrame) -> DataFrame:
    """(_s, id_a, id_b, n_ab) of distinct (_s, _b, _i). Both sides are the same plan, so that one exchange serves them."""
    left, right = rows.select("_s", "_b", "_i").alias("l"), rows.select("_s", "_b", "_i").alias("r")
    met = left.join(right, F.expr("l._s = r._s and l._b = r._b and l._i < r._i"))
    named = met.select(F.col("l._s").alias("_s"), F.col("l._i").alias("id_a"), F.col("r._i").alias("id_b"))
    return named.groupBy("_s", "id_a", "id_b").agg(F.count("*").alias("n_ab"))


def _cell_pairs(rows: DataFrame, cap: int) -> DataFrame:
    """(_s, id_a, id_b, n_ab) of distinct (_s, _b, _i) in baskets too large for a task: items meet in cells of two blocks."""
    dealt = block_pairs(rows.withColumn("_g", F.xxhash64("_s", "_b")), "_g", "_i", cap, own=True)
    left, right = dealt.alias("l"), dealt.alias("r")
    same = "l._s = r._s and l._b = r._b and l.block_a = r.block_a and l.block_b = r.block_b and l._i < r._i"
    # Items of one block meet in many cells and count in that of equal blocks.
    met = left.join(right, F.expr(f"{same} and (l.block <> r.block or l.block_a = l.block_b)"))
    named = met.select(F.col("l._s").alias("_s"), F.col("l._i").alias("id_a"), F.col("r._i").alias("id_b"))
    return named.groupBy("_s", "id_a", "id_b").agg(F.count("*").alias("n_ab"))


def _with_hot(kept: DataFrame, hot: DataFrame, min_count: int, cap: int) -> DataFrame:
    """Pairs of at least ``min_count`` baskets when those of ``hot`` (_s, _b, _aside) with _aside, fewer than that per scope, form no pairs."""
    aside, dealt = hot.filter("_aside").select("_s", "_b"), hot.filter("not _aside").select("_s", "_b")
    per = aside.groupBy("_s").agg(F.count("*").alias("_h"))
    enough = F.col("n_ab") + F.coalesce("_h", F.lit(0)) >= min_count
    formed = _pairs(kept.join(hot.select("_s", "_b"), ["_s", "_b"], "left_anti"))
    if not dealt.isEmpty():
        more = _cell_pairs(kept.join(dealt, ["_s", "_b"], "left_semi").select("_s", "_b", "_i"), cap)
        formed = formed.unionByName(more).groupBy("_s", "id_a", "id_b").agg(F.sum("n_ab").alias("n_ab"))
    found = cut(formed.join(per, "_s", "left").filter(enough).drop("_h"))
    held = cut(kept.join(aside, ["_s", "_b"], "left_semi").select("_s", "_b", "_i"))
    with_a = found.join(held.withColumnRenamed("_i", "id_a"), ["_s", "id_a"])
    both = with_a.join(held.withColumnRenamed("_i", "id_b"), ["_s", "_b", "id_b"])
    added = both.groupBy("_s", "id_a", "id_b").agg(F.count("*").alias("_more"))
    total = F.col("n_ab") + F.coalesce("_more", F.lit(0))
    return found.join(added, ["_s", "id_a", "id_b"], "left").select("_s", "id_a", "id_b", total.alias("n_ab")).filter(F.col("n_ab") >= min_count)
