"""Vector transforms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .distance import _col, norm, norm_squared

#: Smallest float step above 1, used under the root when a whole set is normalised.
EPSILON = 1.1920929e-07


def cast_elements(vec: Column | str, element: str) -> Column:
    """Each element cast to ``element``; float to integer truncates towards zero."""
    return F.transform(_col(vec), lambda x: x.cast(element))


def scale(vec: Column | str, factor: Column | float) -> Column:
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_col(vec), lambda x: x.cast("double") * f)


def normalize(vec: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(vec)
    return F.when(n > 0, F.transform(_col(vec), lambda x: x.cast("double") / n)).otherwise(cast_elements(vec, "double"))


def normalize_eps(vec: Column | str, eps: float = EPSILON) -> Column:
    """Divide by sqrt(norm2 + eps): defined for every vector, a zero vector stays zero."""
    n = F.sqrt(norm_squared(vec) + F.lit(eps))
    return F.transform(_col(vec), lambda x: x.cast("double") / n)


def mips_base(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Base side of the inner-product to L2 reduction: x / M with sqrt(1 - |x|^2 / M^2) appended, M the largest norm.

    M is one aggregate row. An empty table stays empty; if M is 0 the vectors stay zero with 1 appended.
    """
    top = rows.agg(F.max(norm(vec)).alias("_m"))
    m = F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)
    tail = F.sqrt(F.greatest(F.lit(0.0), 1.0 - norm_squared(vec) / (m * m)))
    return rows.join(F.broadcast(top)).withColumn(vec, F.concat(F.transform(F.col(vec), lambda x: x.cast("double") / m), F.array(tail))).drop("_m")


def mips_query(vec: Column | str) -> Column:
    """Query side: unit length with 0 appended."""
    return F.concat(normalize(vec), F.array(F.lit(0.0)))


def quantize_int8(vec: Column | str, bias: float, width: float) -> Column:
    """(x - bias) * 254 / width, truncated and clamped to the byte range."""
    return F.transform(
        _col(vec), lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), ((x.cast("double") - bias) * 254.0 / width).cast("int"))).cast("tinyint")
    )


def dequantize_int8(vec: Column | str, bias: float, factor: float) -> Column:
    """(x - bias) * factor."""
    return F.transform(_col(vec), lambda x: (x.cast("double") - bias) * factor)


def check_vectors(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows as they are; the job fails at the first vector that is null, of another length, or holds null or NaN."""
    v = F.col(vec)
    bad = v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return rows.filter(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit(f"bad vector, want {dim} numbers")).cast("boolean")).otherwise(True))


def parse_tsv(line: Column | str, element: str = "float") -> Column:
    """A line of numbers between white space as a vector."""
    return F.transform(F.split(F.trim(_col(line)), r"\s+"), lambda x: x.cast(element))


def format_tsv(vec: Column | str) -> Column:
    return F.array_join(F.transform(_col(vec), lambda x: x.cast("string")), "\t")


def rotate(rows: DataFrame, rotation, transposed: bool = False, row_id: str = "id", vec: str = "vec") -> DataFrame:
    """(id, vec): every vector times a matrix (or its transpose), a product per Arrow batch. Null ids and vectors are left out."""
    import numpy as np

    from ..operators.exact import select_vectors
    from .arrow import batch, matrix, vectors

    m = np.asarray(rotation, np.float64)
    shared = rows.sparkSession.sparkContext.broadcast(m.T if transposed else m)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield batch(id=b.column("id"), vec=vectors(matrix(b.column("vec")) @ shared.value))

    return select_vectors(rows, row_id, vec).mapInArrow(run, "id long, vec array<double>")
