"""Cells of bounded size in which all rows of a group meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut

#: Up to so many oversized groups (12 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def block_pairs(df: DataFrame, key: str, row_id: str, cap: int, own: bool = False) -> DataFrame:
    """Give each row the cells in which it meets every other row of its group, none above 2 * ``cap`` rows or so.

    A group of at most ``cap`` rows is one cell. A larger one is dealt by hash into b = ceil(rows / cap)
    blocks, and every unordered pair of blocks is a cell, so each pair of rows meets at least once and
    no task sees the whole group. Adds ``block_a`` and ``block_b``; (key, block_a, block_b) is the cell. With ``own`` adds
    ``block``, the row's own: rows of two blocks meet in one cell, those of one block in the cell of equal blocks and others.
    """
    big = cut(
        df.groupBy(key)
        .count()
        .filter(F.col("count") > cap)
        .select(key, F.ceil(F.col("count") / cap).cast("int").alias("_blocks"))
    )
    groups = big.count()
    if not groups:
        return df.withColumns({"block_a": F.lit(0), "block_b": F.lit(0)} | ({"block": F.lit(0)} if own else {}))
    if groups <= BROADCAST_GROUPS:
        big = F.broadcast(big)
    dealt = (
        df.join(big, key, "left")
        .withColumn("_n", F.coalesce(F.col("_blocks"), F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64(row_id), F.col("_n")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("block_a", F.least("block", "_other"))
        .withColumn("block_b", F.greatest("block", "_other"))
        .drop("_blocks", "_n", "_other")
    )
    return dealt if own else dealt.drop("block")
