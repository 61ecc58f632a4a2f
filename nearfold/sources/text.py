"""Text sources: vectors and labels a line each, and generated rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.arrow import batch, vectors
from ..functions.vectors import format_tsv, parse_tsv
from ..operators.blocks import cut


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): the lines of a text file, or of a folder's files in order of name, numbered from 0. Splits are counted, not sorted."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select("value", m["file_path"].alias("_f"), m["file_block_start"].alias("_s"), F.monotonically_increasing_id().alias("_i"))
    parts = cut(lines)
    sums = parts.groupBy("_f", "_s").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per split
    place = F.row_number().over(Window.partitionBy("_f", "_s").orderBy("_i")) - 1
    return parts.join(sums.select("_f", "_s", before.alias("_b")), ["_f", "_s"]).select((F.col("_b") + place).cast("long").alias("id"), "value")


def read_tsv(spark: SparkSession, path: str, element: str = "float") -> DataFrame:
    """(id, vec) of a file of white-space separated numbers; blank lines count as lines and give null vectors."""
    t = numbered_lines(spark, path)
    return t.select("id", F.when(F.length(F.trim("value")) > 0, parse_tsv("value", element)).alias("vec"))


def write_tsv(rows: DataFrame, path: str, partitions: int = 8) -> None:
    rows.repartitionByRange(partitions, "id").sortWithinPartitions("id").select(format_tsv("vec")).write.text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, tag): line i labels id i."""
    return numbered_lines(spark, path).select("id", F.col("value").alias("tag"))


def random_vectors(spark: SparkSession, n: int, dim: int, length: float = 1.0, seed: int = 1, element: str = "float", partitions: int = 8) -> DataFrame:
    """(id, vec): Gaussian directions scaled to ``length``. int8 rounds; uint8 rounds and adds 128 (as smallint).

    A row depends on seed and id only, so neither partitions nor retries change it.
    """
    if element not in ("float", "int8", "uint8"):
        raise ValueError("element must be float, int8 or uint8")
    kind = {"float": "float", "int8": "tinyint", "uint8": "smallint"}[element]

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            x = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(dim) for i in ids]) if len(ids) else np.zeros((0, dim))
            x *= length / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
            if element == "float":
                x = x.astype(np.float32)
            else:
                low, high, shift = (-128, 127, 0) if element == "int8" else (0, 255, 128)
                x = np.clip(np.rint(x) + shift, low, high).astype(np.int8 if element == "int8" else np.int16)
            yield batch(id=b.column("id"), vec=vectors(x))

    return spark.range(0, n, 1, partitions).mapInArrow(run, f"id long, vec array<{kind}>")


def sample_rows(rows: DataFrame, share: float, seed: int = 1, row_id: str = "id") -> DataFrame:
    """Each row with probability ``share`` (capped at 1), drawn from a hash of seed and id: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.filter(draw < min(1.0, share))


def warm_up(spark: SparkSession, dim: int, n: int = 100_000, seed: int = 1) -> DataFrame:
    """(id, vec): whole numbers from -128 to 127, for warming up an index without a query sample."""

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            x = np.stack([np.random.default_rng([seed, int(i)]).integers(-128, 128, dim) for i in ids]) if len(ids) else np.zeros((0, dim))
            yield batch(id=b.column("id"), vec=vectors(x.astype(np.float32)))

    return spark.range(0, n, 1, 8).mapInArrow(run, "id long, vec array<float>")
