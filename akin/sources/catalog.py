"""Reading and preparing the item catalog and its child tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akin.functions.numeric import nan_to_null
from akin.functions.text import clean_html
from akin.operators.ranks import values_at_ranks
from akin.schemas import CATALOG, RAW_ITEM
from akin.sources.scratch import written


def read_raw(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Raw items as landed, with the fixed schema (nothing is inferred)."""
    return spark.read.schema(RAW_ITEM).format(file_format).load(path)


def scan_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw items from JSON lines, and the rejects (record, reason) that are no items.

    A line that is not JSON, has a value of another type or has no id is rejected whole. Fields that are
    missing are null, unknown ones are ignored. Lines are parsed once, into a scratch table.
    """
    schema = T.StructType([*RAW_ITEM.fields, T.StructField("_record", T.StringType())])
    lines = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record").json(path)
    parsed = written(lines, "json")
    broken = F.col("_record").isNotNull()
    reason = F.when(broken, F.lit("damaged")).otherwise(F.lit("no id"))
    # Records without an id were parsed, so they are spelled out again.
    record = F.coalesce("_record", F.to_json(F.struct(*RAW_ITEM.names)))
    rejects = parsed.filter(broken | F.col("id").isNull()).select(record.alias("record"), reason.alias("reason"))
    return parsed.filter(~broken & F.col("id").isNotNull()).drop("_record"), rejects


def spread(df: DataFrame, key: str) -> DataFrame:
    """Partition a small input by key when its files give fewer tasks than there are cores.

    An input of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


SMALL_LIMIT = 100_000  # rows that one task may keep for an ordered limit


def capped(items: DataFrame, page_size: int = 100, max_items: int | None = None) -> DataFrame:
    """The first items by id, rounded up to whole pages; no cap when `max_items` is 0 or None.

    Ids are unique. A large cap is a filter on the id found at that rank, not an ordered limit.
    """
    if page_size < 1:
        raise ValueError("page_size must be positive")
    if not max_items:
        return items
    cap = math.ceil(max_items / page_size) * page_size
    if cap <= SMALL_LIMIT:
        return items.orderBy("id").limit(cap)
    last = values_at_ranks(items, "id", [cap - 1])[0]
    return items if last is None else items.filter(F.col("id") <= last)


def page(items: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page by id, each row with the size of the catalog and the page bounds."""
    total = items.agg(F.count(F.lit(1))).scalar()
    if offset + limit <= SMALL_LIMIT:
        rows = items.orderBy("id").offset(offset).limit(limit)
    else:
        first, last = values_at_ranks(items, "id", [offset, offset + limit - 1])
        rows = items.filter(F.lit(first is not None))
        if first is not None:
            rows = rows.filter(F.col("id") >= first)
        if last is not None:
            rows = rows.filter(F.col("id") <= last)
        rows = rows.orderBy("id")
    return rows.select(
        "*",
        total.alias("total"),
        F.lit(offset).cast("long").alias("offset"),
        F.lit(limit).cast("long").alias("limit"),
    )


def lookup(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of `table` whose key is in `keys`; unknown keys give nothing."""
    return table.join(keys.select(*on), on, "left_semi")


def prepare(raw: DataFrame) -> DataFrame:
    """Flatten the nested fields, pick the platform, clean the summary, keep ten columns."""
    flat = raw.select(
        "id",
        "name",
        "genres",
        "summary",
        clean_html(F.col("summary")).alias("summary_clean"),
        "type",
        "language",
        "status",
        F.coalesce(F.col("network.name"), F.col("webchannel.name")).alias("platform"),
        F.col("rating.average").alias("rating_avg"),
    )
    return nan_to_null(flat)


def save_catalog(catalog: DataFrame, path: str) -> None:
    catalog.write.mode("overwrite").parquet(path)


def save_catalog_csv(catalog: DataFrame, path: str) -> None:
    """The catalog as CSV with the genres as a JSON array."""
    catalog.withColumn("genres", F.to_json("genres")).write.mode("overwrite").csv(
        path, header=True, escape='"'
    )


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).parquet(path)


def load_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read back what `save_catalog_csv` wrote, the genres as an array again."""
    as_text = ", ".join(
        f"`{f.name}` {'string' if f.name == 'genres' else f.dataType.simpleString()}"
        for f in CATALOG.fields
    )
    return (
        spark.read.schema(as_text)
        .csv(path, header=True, escape='"', multiLine=True)
        .withColumn("genres", F.from_json("genres", "array<string>"))
    )


def to_metadata(catalog: DataFrame, synced_at: Column | None = None) -> DataFrame:
    """The catalog in the shape of the metadata table; an empty clean summary falls back."""
    return nan_to_null(catalog).select(
        F.col("id").alias("item_id"),
        "name",
        "genres",
        F.coalesce(F.nullif(F.col("summary_clean"), F.lit("")), F.col("summary")).alias("summary"),
        F.col("rating_avg").alias("rating"),
        "type",
        "language",
        F.col("platform").alias("network"),
        (F.current_timestamp() if synced_at is None else synced_at).alias("synced_at"),
    )


def _with_children(
    parents: DataFrame, children: DataFrame, key: str, parent_key: str, order: str, value: Column, count_name: str
) -> DataFrame:
    """One row per parent: `_rows`, the children as (o, v) in order, null for none, and their number.

    Null orders come first and equal orders go by value. Children without a parent are left out.
    """
    row = F.struct(F.col(order).alias("o"), value.alias("v"))
    grouped = children.groupBy(F.col(parent_key).alias("_parent")).agg(
        F.array_sort(F.collect_list(row)).alias("_rows"), F.count(F.lit(1)).alias("_count")
    )
    return (
        parents.join(grouped, F.col(key) == F.col("_parent"), "left")
        .withColumn(count_name, F.coalesce("_count", F.lit(0)))
        .drop("_parent", "_count")
    )


def enrich_with_children(
    parents: DataFrame, children: DataFrame, key: str, parent_key: str, order: str, text: str
) -> DataFrame:
    """Parents with the ordered non-empty texts and the number of their children.

    One row per row of `parents`; those without children have an empty list and 0.
    """
    out = _with_children(parents, children, key, parent_key, order, F.col(text), "season_count")
    texts = F.filter("_rows.v", lambda t: F.length(t) > 0)
    return out.withColumn(
        "season_summaries", F.coalesce(texts, F.array().cast("array<string>"))
    ).drop("_rows")


def enriched_items(
    raw: DataFrame, seasons: DataFrame, parent_key: str, order: str, text: str
) -> DataFrame:
    """Raw items flattened and enriched with their season texts."""
    flat = raw.select(
        F.col("id").alias("item_id"),
        "name",
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
        F.col("network.name").alias("network"),
        F.col("webchannel.name").alias("webchannel"),
        F.col("rating.average").alias("rating"),
        "type",
        "language",
        "status",
        "premiered",
        "ended",
    )
    return enrich_with_children(flat, seasons, "item_id", parent_key, order, text)


def nest_children(
    parents: DataFrame, children: DataFrame, key: str, parent_key: str, order: str
) -> DataFrame:
    """Parents with all columns of their children nested in order; one row per row of `parents`."""
    whole = F.struct(*[F.col(c) for c in children.columns])
    out = _with_children(parents, children, key, parent_key, order, whole, "child_count")
    empty = F.filter("_rows.v", lambda _: F.lit(False))
    return out.withColumn("children", F.coalesce("_rows.v", empty, F.array())).drop("_rows")
