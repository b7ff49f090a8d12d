"""Versioned parquet tables: the feature store, the neighbour table and the metadata table.

A write goes to a new version folder and becomes current when Spark has committed it, so a table can
be rebuilt from itself and readers never see half of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akin.operators.features import FeatureSet
from akin.schemas import ITEM_METADATA, ITEM_SIMILARITIES
from akin.sources.items import ItemTable, Written
from akin.sources.scratch import DENSE

SIMILARITIES = "item_similarities"
METADATA = "item_metadata"
_KEEP = {SIMILARITIES: ITEM_SIMILARITIES, METADATA: ITEM_METADATA}


class TableStore:
    """Named tables under one folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self, name: str) -> list[int]:
        """Committed versions of a table, oldest first."""
        return [number for number, done in self._folders(name) if done]

    def _folders(self, name: str) -> list[tuple[int, bool]]:
        """Numbers of all versions begun, and whether Spark has committed them."""
        jvm = self.spark._jvm
        fs, folder = self._at(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            match = re.fullmatch(r"v(\d{8})", status.getPath().getName())
            done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if match:
                found.append((int(match.group(1)), fs.exists(done)))
        return sorted(found)

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:08d}"

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        versions = self.versions(name)
        if not versions:
            raise FileNotFoundError(f"no table {name} under {self.root}")
        schema = schema or _KEEP.get(name)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        table = reader.parquet(self.path(name, versions[-1]))
        # Item tables have one more column, the bucket of the folder.
        return table if schema is None else table.select(*schema.names)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next version and read it back; numbers of failed writes are not used again."""
        number = self.begin(name)
        df.write.option("maxRecordsPerFile", 5_000_000).mode("error").parquet(
            self.path(name, number), compression=DENSE
        )
        return self.read(name, df.schema)


    def begin(self, name: str) -> int:
        """The number of the next version."""
        return max((n for n, _ in self._folders(name)), default=0) + 1

    def commit(self, name: str, number: int) -> None:
        """Make a version current that was written without the mark of success."""
        fs, done = self._at(f"{self.path(name, number)}/_SUCCESS")
        fs.create(done).close()

    def names_in(self, path: str) -> list[str]:
        fs, folder = self._at(path)
        return [status.getPath().getName() for status in fs.listStatus(folder)]

    def remove(self, path: str) -> None:
        fs, folder = self._at(path)
        fs.delete(folder, True)

    def _at(self, path: str):
        """The file system of a path, and the path in its terms."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at


# --- features -----------------------------------------------------------------------------------


def save_features(store: TableStore, features: FeatureSet) -> FeatureSet:
    """Write the packed item features and every vocabulary."""
    return FeatureSet(**{n: store.write(n, df) for n, df in features.tables().items()})


def load_features(store: TableStore) -> FeatureSet:
    """Read all feature tables; any missing one is an error before anything is planned."""
    names = list(FeatureSet.__dataclass_fields__)
    missing = [n for n in names if not store.exists(n)]
    if missing:
        raise FileNotFoundError(f"missing feature tables: {', '.join(missing)}")
    return FeatureSet(**{n: store.read(n) for n in names})


# --- neighbours ---------------------------------------------------------------------------------


def as_similarities(neighbours: DataFrame, computed_at: Column | None = None) -> DataFrame:
    """Neighbours in the shape of the table; component scores are optional."""
    def optional(name: str) -> Column:
        column = F.col(name) if name in neighbours.columns else F.lit(None)
        return column.cast("double").alias(name)

    return neighbours.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.col("similar_item_id").cast("long").alias("similar_item_id"),
        F.col("similarity_score").cast("double").alias("similarity_score"),
        optional("genre_score"),
        optional("text_score"),
        optional("metadata_score"),
        (F.current_timestamp() if computed_at is None else computed_at)
        .cast("timestamp")
        .alias("computed_at"),
    )


def laid_out(similarities: DataFrame) -> DataFrame:
    """Ranges of item ids per file, best neighbour first, so one item's rows sit together."""
    return similarities.repartitionByRange("item_id").sortWithinPartitions(
        "item_id", F.desc("similarity_score"), "similar_item_id"
    )


def similarity_table(store: TableStore, buckets: int = 64) -> ItemTable:
    """The neighbour table: one row per item and neighbour, best neighbour first."""
    order = [F.desc("similarity_score"), F.col("similar_item_id")]
    keys = ["item_id", "similar_item_id"]
    return ItemTable(store, SIMILARITIES, ITEM_SIMILARITIES, keys, order, "computed_at", buckets)


def metadata_table(store: TableStore, buckets: int = 64) -> ItemTable:
    """The metadata table: one row per item."""
    return ItemTable(store, METADATA, ITEM_METADATA, ["item_id"], [], "synced_at", buckets)


def store_similarities(
    store: TableStore,
    neighbours: DataFrame,
    clear_existing: bool = True,
    computed_at: Column | None = None,
) -> DataFrame:
    """Replace the neighbour table, or add to it when `clear_existing` is false; repeated keys are an error."""
    new, table = as_similarities(neighbours, computed_at), similarity_table(store)
    if not clear_existing and store.exists(SIMILARITIES):
        table.append(new)
    else:
        table.write(new)
    return table.read()


def replaced_neighbours(old: DataFrame, new: DataFrame, items: DataFrame) -> DataFrame:
    """`old` with the lists of `items` (column item_id) swapped for theirs in `new`.

    An item without rows in `new` loses its list.
    """
    ids = items.select("item_id")
    return old.join(ids, "item_id", "left_anti").unionByName(new.join(ids, "item_id", "left_semi"))


def deleted(table: DataFrame, items: DataFrame) -> DataFrame:
    """`table` without the rows of `items` (column item_id)."""
    return table.join(items.select("item_id"), "item_id", "left_anti")


def deletion_counts(table: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n_deleted, found) for each item asked to be deleted."""
    asked = items.select("item_id").distinct()
    counts = table.join(asked, "item_id", "left_semi").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, "item_id", "left").select(
        "item_id",
        F.coalesce("n", F.lit(0)).alias("n_deleted"),
        F.col("n").isNotNull().alias("found"),
    )


# --- metadata -----------------------------------------------------------------------------------


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new` rows replace those of the same item; the other rows of `old` stay."""
    return old.join(new.select("item_id"), "item_id", "left_anti").unionByName(new)


def store_metadata(store: TableStore, metadata: DataFrame) -> DataFrame:
    """Replace all metadata; a repeated item is an error."""
    table = metadata_table(store)
    table.write(metadata)
    return table.read()


# --- statistics ---------------------------------------------------------------------------------


def store_stats(similarities: DataFrame) -> DataFrame:
    """Rows, items with neighbours, rows per item (0 when empty) and the latest stamp."""
    total, items = F.count(F.lit(1)), F.countDistinct("item_id")
    return similarities.agg(
        total.alias("total_records"),
        items.alias("unique_items"),
        F.coalesce(F.try_divide(total, items), F.lit(0.0)).alias("avg_similarities_per_item"),
        F.max("computed_at").alias("last_computed"),
    )


def run_stats(similarities: DataFrame, top_n: int, min_similarity: float) -> DataFrame:
    """Statistics of a finished computation, with its parameters."""
    return store_stats(similarities).select(
        "*",
        F.col("unique_items").alias("computed_items"),
        F.lit(top_n).cast("long").alias("top_n_per_item"),
        F.lit(min_similarity).cast("double").alias("min_similarity"),
    )


def written_stats(store: TableStore, found: Written, top_n: int, min_similarity: float) -> DataFrame:
    """`run_stats` out of what the write itself has counted, in one row; nothing is read back."""
    mean = found.rows / found.items if found.items else 0.0
    row = (found.rows, found.items, mean, found.last, found.items, top_n, float(min_similarity))
    schema = (
        "total_records long, unique_items long, avg_similarities_per_item double, last_computed timestamp, "
        "computed_items long, top_n_per_item long, min_similarity double"
    )
    return store.spark.createDataFrame([row], schema)


def system_stats(similarities: DataFrame, metadata: DataFrame, weights) -> DataFrame:
    """Statistics of the store, the number of cached items and the weights, in one row."""
    cached = metadata.agg(F.count(F.lit(1))).scalar()
    return store_stats(similarities).select(
        "*",
        cached.alias("cached_items"),
        F.lit(float(weights.genre)).alias("genre_weight"),
        F.lit(float(weights.text)).alias("text_weight"),
        F.lit(float(weights.metadata)).alias("metadata_weight"),
    )


def neighbour_counts(similarities: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(item_id, n) of the stored items, or of those asked for (column item_id), 0 for one without rows."""
    if items is not None:
        asked = items.select("item_id").distinct()
        counts = neighbour_counts(similarities.join(asked, "item_id", "left_semi"))
        return asked.join(counts, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))
    return similarities.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_sources(similarities: DataFrame) -> DataFrame:
    return similarities.select("item_id").distinct()
