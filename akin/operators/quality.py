"""Data quality checks; each is one pass or one grouped count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akin.functions.numeric import percent
from akin.schemas import METADATA_LENGTHS


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def availability(catalog: DataFrame) -> DataFrame:
    """Items that have each feature: count and percent; 0 percent of an empty catalog."""
    has = {
        "genres": F.size("genres") > 0,
        "summary": F.length("summary_clean") > 0,
        "rating": F.col("rating_avg").isNotNull(),
        "platform": F.col("platform").isNotNull(),
        "type": F.col("type").isNotNull(),
        "language": F.col("language").isNotNull(),
    }
    one = catalog.agg(
        F.count(F.lit(1)).alias("_total"), *(_count_if(c).alias(k) for k, c in has.items())
    )
    rows = F.array(
        *(F.struct(F.lit(k).alias("feature"), F.col(k).alias("available")) for k in has)
    )
    return one.select("_total", F.inline(rows)).select(
        "feature",
        "available",
        F.col("_total").alias("total"),
        percent(F.col("available"), F.col("_total")).alias("percent"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with nulls and how many they have."""
    one = df.agg(*(_count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    rows = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in df.columns)
    )
    return one.select(F.inline(rows)).filter(F.col("n_missing") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def _violations(df: DataFrame, key: str, broken: dict[str, Column]) -> DataFrame:
    """(key, column_name) for every condition that holds; one scan, rows without any drop early."""
    any_broken = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in broken.values()))
    names = F.filter(
        F.array(*(F.when(c, F.lit(name)) for name, c in broken.items())), lambda x: x.isNotNull()
    )
    return df.filter(any_broken).select(
        F.col(key).alias("key"), F.explode(names).alias("column_name")
    )


def null_violations(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with a null in a column that must not be null."""
    return _violations(df, key, {c: F.col(c).isNull() for c in columns})


def length_violations(
    df: DataFrame, key: str, limits: dict[str, int] | None = None
) -> DataFrame:
    """Rows with a text longer than its column allows."""
    limits = METADATA_LENGTHS if limits is None else limits
    return _violations(df, key, {c: F.length(c) > n for c, n in limits.items()})
