"""Metrics as Column expressions (inside whole-stage plans) and as NumPy kernels (for Arrow batches).

All accumulate in double precision, in index order for the Column forms. Smaller is closer, except that
the inner product is reported with its own sign.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance; null if a vector is null or their lengths differ (the tail pairs with null)."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm_squared(a: Column | str) -> Column:
    return _sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(norm_squared(a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, clamped to [0, 2]; 1 where a norm is zero."""
    size = norm(a) * norm(b)
    cos = F.when(size > 0, inner_product(a, b) / size).otherwise(0.0)
    return 1.0 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))


def fast_l2(base_norm2: Column | str, base: Column | str, query: Column | str) -> Column:
    """norm2(base) - 2 base . query: ranks like squared L2 but is no distance."""
    return _col(base_norm2) - 2.0 * inner_product(base, query)


def l2_integers(a: Column | str, b: Column | str) -> Column:
    """Squared L2 of integer vectors, exact in 64-bit integers."""
    d = F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))
    return F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x)


@dataclass(frozen=True)
class Metric:
    """column: the Column form; pairs: exact values of row pairs; grid: fast values of all pairs for screening;
    sign: -1 where larger is closer; integers: whether integer vectors are supported."""

    column: Callable[[Column | str, Column | str], Column]
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]
    grid: Callable[[np.ndarray, np.ndarray], np.ndarray]
    sign: int = 1
    integers: bool = True


def _l2_grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2.0 * (a @ b.T)


def _unit(a: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1, keepdims=True))
    return np.divide(a, n, out=np.zeros_like(a), where=n > 0)


def _cosine_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    cos = np.divide((a * b).sum(1), size, out=np.zeros(len(a)), where=size > 0)
    return 1.0 - np.clip(cos, -1.0, 1.0)


METRICS: dict[str, Metric] = {
    "l2": Metric(l2_squared, lambda a, b: ((a - b) ** 2).sum(1), _l2_grid),
    "ip": Metric(inner_product, lambda a, b: (a * b).sum(1), lambda a, b: a @ b.T, -1, False),
    "fast_l2": Metric(
        lambda q, b: fast_l2(norm_squared(b), b, q), lambda a, b: (b * b).sum(1) - 2.0 * (a * b).sum(1), lambda a, b: (b * b).sum(1)[None] - 2.0 * (a @ b.T)
    ),
    "cosine": Metric(cosine_distance, _cosine_pairs, lambda a, b: 1.0 - _unit(a) @ _unit(b).T),
}


def metric(name: str, element: str = "float") -> Metric:
    """The metric of a name; integer vectors have no inner product, as its sign convention is undefined there."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    if element not in ("float", "double") and not METRICS[name].integers:
        raise ValueError(f"{name} is not defined for {element} vectors")
    return METRICS[name]
