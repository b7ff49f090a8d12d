"""Helpers that several operators share: tables, exact prefix sums, membership bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from akin.sources.scratch import written

#: Bits of a membership bitmap; it is the same size for any number of keys.
BITMAP_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running(
    df: DataFrame, group: list[str], order: list[str | Column], value: str, name: str
) -> DataFrame:
    """Add `name`: the sum of `value` over the rows of the group that come before in `order`.

    The rows are range-sorted by group and order, so a hot group spreads over many tasks; sums per
    range are added up by a window over one row per range and group. The result is written to a
    scratch table first: ranges must not change between the two readings.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in group] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = written(
        df.repartitionByRange(partitions(spark), *keys).withColumn("__range", F.spark_partition_id()),
        "ranged",
    )
    sums = ranged.groupBy("__range", *group).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("__range").alias("__r"),
        *(F.col(c).alias(f"__g_{c}") for c in group),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"),
    )
    inside = (
        Window.partitionBy("__range", *group)
        .orderBy(*(keys[len(group):]))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    on = F.col("__range") == F.col("__r")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    summed = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(starts, on, "left").withColumn(name, F.col("__start") + F.col("__inside"))
    return joined.select(*df.columns, name)


def _slot(key: Column, bits: int) -> Column:
    """From 1 on, as the buckets of Spark's bitmap functions start there."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def in_bitmap(
    df: DataFrame, column: str, keys: DataFrame, key: str, name: str, n_bits: int = BITMAP_BITS
) -> DataFrame:
    """`df` with a flag `name`: true for all rows whose `column` is a `key` of `keys`, and a few others.

    The keys become a bitmap of `n_bits` hashed bits, in rows of 4 KB. It is the same size for any
    number of keys, so it can be broadcast; nothing else of `df` moves. Nulls are keys like others.
    """
    slots = keys.select(_slot(F.col(key), n_bits).alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits")
    )
    marked = df.withColumn("__slot", _slot(F.col(column), n_bits))
    joined = marked.join(F.broadcast(bits), F.bitmap_bucket_number("__slot") == F.col("__bucket"), "left")
    at = F.bitmap_bit_position("__slot").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1))
    return joined.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__slot", "__bucket", "__bits")


#: Keys that a bitmap may stand for: at eight bits each it has 64 MB.
MOST_BITMAP_KEYS = 1 << 26


def having(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose `column` is a `key` of `keys`, which is written and holds no key twice.

    Of not too many keys a bitmap of eight bits each is broadcast, so that most other rows go before the
    join; more keys than MOST_BITMAP_KEYS are joined right away.
    """
    n = keys.count()
    if n <= MOST_BITMAP_KEYS:
        bits = max(1 << 15, 1 << (8 * n).bit_length())
        df = in_bitmap(df, column, keys, key, "__here", bits).filter("__here").drop("__here")
    return df.join(keys.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_semi")
