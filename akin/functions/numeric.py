"""Numeric functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores are compared and ranked at this many decimals, so that sums taken in another order tie.
SCORE_DECIMALS = 9


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float and double column; other columns are left alone."""
    return df.select(
        *(
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets given as arrays without duplicates; 0 when either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.coalesce(F.try_divide(shared, F.sqrt(F.size(a) * F.size(b))), F.lit(0.0))


def sparse_dot(ids_a: Column, weights_a: Column, ids_b: Column, weights_b: Column) -> Column:
    """Dot product of two sparse vectors, each an array of distinct ids and one of weights."""
    products = F.transform(
        F.array_sort(F.array_intersect(ids_a, ids_b)),
        lambda i: F.get(weights_a, (F.array_position(ids_a, i) - 1).cast("int"))
        * F.get(weights_b, (F.array_position(ids_b, i) - 1).cast("int")),
    )
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _same(a: Column, b: Column) -> Column:
    return F.coalesce((a == b).cast("double"), F.lit(0.0))


def metadata_cosine(left: dict[str, Column], right: dict[str, Column], mode: str) -> Column:
    """Agreement of platform bucket, type and language bucket.

    `mean` averages three one-hot cosines; `concat` is the cosine of the joined vectors, in which a
    null type has no entry.
    """
    matches = sum(
        (_same(left[k], right[k]) for k in ("platform_bucket", "type", "language_bucket")),
        start=F.lit(0.0),
    )
    if mode == "mean":
        return matches / F.lit(3.0)
    if mode == "concat":
        def entries(side):
            return F.lit(2.0) + side["type"].isNotNull().cast("double")

        return matches / F.sqrt(entries(left) * entries(right))
    raise ValueError(f"unknown metadata mode {mode!r}")


def mixed_score(
    genre: Column, text: Column, metadata: Column, weights, normalise: bool = True
) -> Column:
    """Weighted sum of the three cosines, rounded for ranking."""
    g, t, m = weights.effective(normalise)
    return F.round(
        F.lit(float(g)) * genre + F.lit(float(t)) * text + F.lit(float(m)) * metadata,
        SCORE_DECIMALS,
    )
