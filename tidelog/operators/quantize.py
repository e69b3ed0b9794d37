"""Scalar quantization of vectors to 8 bits a dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import InvalidArgument


def extremes(vectors: DataFrame) -> DataFrame:
    """(dim, min, max) of each dimension: one pass, aggregated before the shuffle."""
    rows = vectors.select(F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("dim").agg(F.min("x").alias("min"), F.max("x").alias("max"))


@dataclass
class ScalarQuantizer:
    """Per-dimension minimum and maximum; a row for each dimension, so small."""

    low: list[float]
    high: list[float]

    @classmethod
    def train(cls, vectors: DataFrame) -> ScalarQuantizer:
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.min(finite).alias("finite")).first()
        if not shape.n:
            raise InvalidArgument("no vectors to train on")
        if shape.a is None or shape.a <= 0:
            raise InvalidArgument("vectors have no dimension")
        if shape.a != shape.b:
            raise InvalidArgument(f"vectors of {shape.a} and of {shape.b} dimensions")
        if not shape.finite:
            raise InvalidArgument("a vector has a component that is not finite")
        rows = sorted(extremes(vectors).collect())
        return cls([r["min"] for r in rows], [r["max"] for r in rows])

    @property
    def dim(self) -> int:
        return len(self.low)

    def _bounds(self, kind: str) -> tuple[Column, Column]:
        array = lambda xs: F.array(*[F.lit(float(x)).cast(kind) for x in xs])
        return array(self.low), array(self.high)

    def quantize(self, v: Column, kind: str = "float") -> Column:
        return quantize(self._checked(v), *self._bounds(kind), kind)

    def dequantize(self, q: Column, kind: str = "float") -> Column:
        return dequantize(self._checked(q), *self._bounds(kind), kind)

    def _checked(self, v: Column) -> Column:
        """v, which fails the query where it has not the model's dimensions; null stays null."""
        text = F.concat(F.lit("a vector has "), F.size(v).cast("string"), F.lit(f" dimensions, the quantizer {self.dim}"))
        return F.when(v.isNull() | (F.size(v) == self.dim), v).otherwise(F.raise_error(text).cast("array<float>"))

    def round_trip(self, v: Column, kind: str = "float") -> Column:
        return self.dequantize(self.quantize(v, kind), kind)


def quantize(v: Column, low: Column, high: Column, kind: str = "float") -> Column:
    """Codes 0 to 255, rounded half away from zero; values outside the range are clamped, a dimension without range is 0, and so is NaN."""

    def one(x: Column, i: Column) -> Column:
        a, b = F.get(low, i), F.get(high, i)
        span = (b - a).cast(kind)
        at = ((((x.cast(kind) - a).cast(kind) / span).cast(kind)) * F.lit(255).cast(kind)).cast(kind)
        return F.when((span == 0) | F.isnan(x), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.round(at)))).cast("smallint")

    return F.transform(v, one)


def dequantize(q: Column, low: Column, high: Column, kind: str = "float") -> Column:
    def one(b: Column, i: Column) -> Column:
        a = F.get(low, i)
        span = (F.get(high, i) - a).cast(kind)
        return F.when(span == 0, a).otherwise((a + ((b.cast(kind) / F.lit(255).cast(kind)).cast(kind) * span).cast(kind)).cast(kind))

    return F.transform(q, one)
