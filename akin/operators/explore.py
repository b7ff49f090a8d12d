"""Exploration: value counts, summaries of numbers, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def genre_counts(items: DataFrame, n: int = 20) -> DataFrame:
    """The `n` most frequent genres; ties by name."""
    return (
        items.select(F.explode("genres").alias("genre"))
        .groupBy("genre")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "genre")
        .limit(n)
    )


def value_counts(items: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Non-null values with count and percent, and the number of distinct values.

    The totals come from the grouped counts, which are one row per value.
    """
    counts = items.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_distinct"))
    total = totals.select("total").scalar()
    n_distinct = totals.select("n_distinct").scalar()
    if top is not None:
        counts = counts.orderBy(F.desc("n"), "value").limit(top)
    return counts.select(
        F.lit(column).alias("column_name"),
        "value",
        "n",
        (F.col("n") * 100.0 / total).alias("percent"),
        n_distinct.alias("n_distinct"),
    )


def _number(column: Column) -> Column:
    """A column as double; NaN counts as missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; nulls and NaN are left out."""
    wanted = F.array(*(F.lit(float(p)) for p in probabilities))
    found = df.agg(F.percentile(_number(F.col(column)), wanted)).first()[0]
    return [None] * len(probabilities) if found is None else list(found)


def describe(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max of each named number column.

    All columns in one pass; nulls and NaN are left out.
    """
    narrow = df.select(*(_number(c).alias(name) for name, c in columns.items()))
    quartiles = F.array(*(F.lit(q) for q in (0.25, 0.5, 0.75)))
    one = narrow.agg(
        *(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(name).alias("count"),
                F.avg(name).alias("mean"),
                F.stddev_samp(name).alias("std"),
                F.min(name).alias("min"),
                F.percentile(name, quartiles).alias("q"),
                F.max(name).alias("max"),
            ).alias(name)
            for name in columns
        )
    )
    labels = [F.get("q", i).alias(label) for i, label in enumerate(("q25", "q50", "q75"))]
    return one.select(F.inline(F.array(*columns))).select("column_name", "count", "mean", "std", "min", *labels, "max")


def histogram(df: DataFrame, column: Column, bins: int) -> DataFrame:
    """Counts in equal-width bins from min to max, the last one closed; empty bins included, NaN left out."""
    values = df.select(_number(column).alias("v")).filter(F.col("v").isNotNull())
    edge = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    low = edge.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))).scalar()
    high = edge.select(F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))).scalar()
    width = (high - low) / F.lit(float(bins))
    at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
    counts = values.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (low + width * F.col("bin")).alias("lower"),
        (low + width * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def text_length(column: str) -> Column:
    """Length in characters, 0 for null."""
    return F.coalesce(F.length(column), F.lit(0)).cast("long")


def child_coverage(
    items: DataFrame, children: DataFrame, key: str, parent_key: str, text: str
) -> DataFrame:
    """Items with at least one child text, and the mean number of children.

    Only counts leave the children, never their texts; `items` has one row per key.
    """
    counts = children.groupBy(F.col(parent_key).alias("_parent")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.length(text) > 0).alias("covered")
    )
    per_item = items.select(F.col(key).alias("_key")).join(counts, F.col("_key") == F.col("_parent"), "left")
    return per_item.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count(F.when(F.col("covered"), 1)).alias("n_with_summaries"),
        F.avg(F.coalesce("n", F.lit(0))).alias("mean_season_count"),
    )
