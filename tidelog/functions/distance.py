"""Distances between vectors, as expressions that stay in the JVM.

In single precision the expressions fold from the left with a rounding after
each step; in double precision they are for comparison with other engines.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COSINE, EUCLIDEAN_SQUARED, INNER_PRODUCT, InvalidArgument


def _sum(terms: Column, kind: str) -> Column:
    return F.aggregate(terms, F.lit(0).cast(kind), lambda acc, x: (acc + x).cast(kind))


def dot(a: Column, b: Column, kind: str = "float") -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast(kind) * y.cast(kind)).cast(kind)), kind)


def norm(v: Column, kind: str = "float") -> Column:
    return F.sqrt(dot(v, v, kind)).cast(kind)


def normalize(v: Column, kind: str = "float") -> Column:
    """v over its length; null where the length is zero or not finite."""
    n = norm(v, kind)
    good = (n > 0) & (n < F.lit(float("inf")))
    # the length is bound once, outside the lambda over the components
    return F.get(F.transform(F.array(n), lambda length: F.when(good, F.transform(v, lambda x: (x.cast(kind) / length).cast(kind)))), F.lit(0))


def prepare(v: Column, metric: str, kind: str = "float") -> Column:
    """What a metric does to stored and query vectors first."""
    return normalize(v, kind) if metric == COSINE else v.cast(f"array<{kind}>")


def vector_literal(v, kind: str = "float") -> Column:
    return F.array(*[F.lit(float(x)).cast(kind) for x in v])


def prepared_literal(v, metric: str, kind: str = "float") -> Column:
    """prepare() of one query vector, done once and with the same roundings instead of beside every stored vector."""
    number = np.float32 if kind == "float" else np.float64
    x = [number(a) for a in v]
    if metric == COSINE:
        total = number(0)
        with np.errstate(over="ignore"):
            for a in x:
                total = number(total + number(a * a))
        n = number(math.sqrt(float(total)))
        if not 0 < n < math.inf:
            return F.lit(None).cast(f"array<{kind}>")
        x = [number(a / n) for a in x]
    return vector_literal(x, kind)


def prepared_distance(a: Column, b: Column, metric: str, kind: str = "float") -> Column:
    """Distance of prepared vectors; smaller is closer."""
    if metric == COSINE:
        return (F.lit(1).cast(kind) - dot(a, b, kind)).cast(kind)
    if metric == EUCLIDEAN_SQUARED:
        d = F.zip_with(a, b, lambda x, y: (x.cast(kind) - y.cast(kind)).cast(kind))
        return _sum(F.transform(d, lambda x: (x * x).cast(kind)), kind)
    if metric == INNER_PRODUCT:
        return -dot(a, b, kind)
    raise InvalidArgument(f"unknown metric {metric!r}")


def distance(a: Column, b: Column, metric: str, kind: str = "float") -> Column:
    return prepared_distance(prepare(a, metric, kind), prepare(b, metric, kind), metric, kind)


def problem(v: Column, metric: str, dim: int = 0) -> Column:
    """Why a vector is refused; null where it is not."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = F.when(v.isNull() | (F.size(v) == 0), F.lit("empty")).when(~F.coalesce(finite, F.lit(False)), F.lit("non-finite"))
    if dim:
        out = out.when(F.size(v) != dim, F.lit("dimension"))
    if metric == COSINE:
        n = norm(v)
        out = out.when((n == 0) | ~(n < F.lit(float("inf"))), F.lit("zero norm"))
    return out
