"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import cut
from .tokens import with_tokens

#: Up to so many sources (about 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def source_sizes(sized: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens) for every source of ``targets``, 0 tokens if it has none."""
    sums = sized.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum("_tokens").alias("tokens"))
    wanted = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    return wanted.join(sums, "source", "left").fillna(0, ["docs", "tokens", "target_share", "max_repeats"])


def closest_total(sizes: DataFrame) -> float:
    """The largest total size at which no source with records is short, or that of all sources if it is smaller.

    Every source with records then reaches its target share of the mix, up to the shares of sources without any; a larger total would keep
    short sources below theirs and the others above.
    """
    usable = F.col("max_repeats") * F.col("tokens") / F.col("target_share")
    row = sizes.agg(F.sum("tokens").alias("all"), F.min(F.when((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), usable)).alias("most")).first()
    return float(min(x for x in (row["all"] or 0, row["most"]) if x is not None))


def rates(sizes: DataFrame, total_tokens: float | str | None = None) -> DataFrame:
    """Adds wanted (target_share times the size of all sources), short, and rate (copies per record).

    short is true where the cap keeps a source below ``wanted``. rate = min(max_repeats, target_share * total / tokens), where total is that of all
    sources, ``total_tokens``, or with "closest" the one of ``closest_total``. Sources without records have rate 0.
    """
    total = sizes.agg(F.sum("tokens").alias("total"))
    goal = F.col("total") if total_tokens is None else F.lit(closest_total(sizes) if total_tokens == "closest" else float(total_tokens))
    return (
        sizes.join(F.broadcast(total))  # one row
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("short", F.col("max_repeats") * F.col("tokens") < F.col("wanted"))
        .withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * goal / F.col("tokens"))).otherwise(0.0))
    )


def sized_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """(doc_id, source, _tokens) of every document, in the checkpoint folder, so that texts are tokenized once."""
    return cut(with_tokens(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "text", path).drop("text"))


def mix(sized: DataFrame, rated: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, copy_no): each record floor(rate) times, and once more with probability rate - floor(rate).

    The extra copy is drawn from a hash of seed and id, so the mix is the same in every run and order of rows.
    Records whose source is null or has no target are left out. A null id draws like any value; records of the
    same id draw alike. No record is used more than max_repeats times.
    """
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / float(1 << 53)
    whole = F.floor("rate")
    copies = (whole + F.when(drawn < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    named = cut(rated.select("source", "rate"))
    # A hot source is never one task: the rates, a row per source, go to the records, unless there are very many sources.
    return (
        sized.join(F.broadcast(named) if named.count() <= BROADCAST_SOURCES else named, "source")
        .withColumn("_copies", copies)
        .filter("_copies > 0")
        .select("doc_id", "source", F.col("_tokens").alias("tokens"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy_no"))
    )


def mix_report(rated: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, target_share, tokens, rate, short, used_tokens, actual_share) of the mix that was made."""
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used_tokens"))
    both = rated.join(used, "source", "left").fillna(0, ["used_tokens"])
    total = used.agg(F.sum("used_tokens").alias("_all"))
    return both.join(F.broadcast(total)).select(
        "source", "target_share", "tokens", "rate", "short", "used_tokens", (F.col("used_tokens") / F.col("_all")).alias("actual_share")
    )
