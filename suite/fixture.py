"""The test tables seen as an item catalog, as raw items and as requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akin.config import BuildParams, FeatureParams
from akin.operators.features import FeatureSet, extract
from akin.operators.neighbours import top_neighbours
from akin.sources import catalog as catalog_source
from akin.sources import store as tables
from akin.sources.scratch import DENSE, scratch_path, written

# With four languages in the data, two ranks make the bucket of other languages come up.
PARAMS = FeatureParams(top_languages=2)
STAMP = "2025-01-05 03:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp():
    return F.lit(STAMP).cast("timestamp")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw nested item per document; part gives name, genres, network and rating."""
    documents = catalog_source.spread(table(spark, sf_dir, "documents"), "doc_id")
    parts = table(spark, sf_dir, "part")
    labels = table(spark, sf_dir, "labels")
    size = F.col("p_size")
    has_network = size % 3 != 0
    return (
        documents.join(parts, F.col("p_partkey") == F.col("doc_id"), "left")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("p_name").alias("name"),
            F.when(size % 10 == 0, F.array().cast("array<string>"))
            .otherwise(F.split("p_name", " "))
            .alias("genres"),
            F.col("text").alias("summary"),
            F.when(F.col("toxic") == 1, "TOXIC")
            .when(F.col("quality") == 1, "GOOD")
            .when(F.col("quality") == 0, "POOR")
            .alias("type"),
            F.col("lang").alias("language"),
            F.col("p_type").alias("status"),
            F.when(size % 7 != 0, F.struct(F.col("p_retailprice").alias("average"))).alias("rating"),
            F.when(has_network, F.struct(F.col("p_brand").alias("name"))).alias("network"),
            F.when(~has_network & (size % 2 == 0), F.struct(F.col("source").alias("name"))).alias(
                "webchannel"
            ),
            F.lit(None).cast("string").alias("premiered"),
            F.lit(None).cast("string").alias("ended"),
        )
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_source.prepare(raw_items(spark, sf_dir))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_source.to_metadata(catalog(spark, sf_dir), stamp())


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items: the first turn is the summary."""
    turns = table(spark, sf_dir, "conversations")
    return turns.filter("turn = 0").select(
        F.col("conv_id").alias("item_id"), F.col("text").alias("summary")
    )


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later turns are the child texts."""
    return table(spark, sf_dir, "conversations").filter("turn > 0")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request strings taken from the page addresses: item id, page number, referrer."""
    url = F.col("url")

    def part(pattern: str):
        return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))

    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("request_id"),
        part(r"^https?://[^/]+/[a-z]+/([^/?#]+)").alias("item_id"),
        part(r"[?&]page=([^&#]+)").alias("n"),
        part(r"[?&]ref=([^&#]+)").alias("min_similarity"),
    )


def label_requests(spark: SparkSession, sf_dir: str, n: int, low: float) -> DataFrame:
    """One request for every labelled document."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("request_id"),
        F.col("doc_id").alias("item_id"),
        F.lit(n).cast("long").alias("n"),
        F.lit(low).alias("min_similarity"),
    )


def bought_in_a_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items bought one line after the other in an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("l_partkey").alias("similar_item_id"),
    )
    return (
        lines.join(after, ["l_orderkey", "l_linenumber"])
        .select(F.col("l_partkey").alias("item_id"), "similar_item_id")
        .filter("item_id <> similar_item_id")
        .distinct()
    )


# What the serving queries read: built once per data folder, like the stored tables they stand for.
_built: dict[tuple[str, str], dict[str, object]] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    kept = _built.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def stored_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "catalog", lambda: written(catalog(spark, sf_dir), "catalog", DENSE))


def stored_features(spark: SparkSession, sf_dir: str) -> FeatureSet:
    return _once(spark, sf_dir, "features", lambda: extract(catalog(spark, sf_dir), PARAMS))


def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "metadata", lambda: written(metadata(spark, sf_dir), "metadata", DENSE))


def stored_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour table of the production mix: raw weights, mean of the metadata cosines."""
    build = BuildParams(features=PARAMS)

    def make() -> DataFrame:
        found = top_neighbours(
            stored_features(spark, sf_dir).items,
            (build.weights,),
            build.top_n,
            build.min_similarity,
            build.normalise_weights,
            build.metadata_mode,
        )
        return written(tables.laid_out(tables.as_similarities(found, stamp())), "similarities", DENSE)

    return _once(spark, sf_dir, "similarities", make)


def new_store(spark: SparkSession) -> tables.TableStore:
    return tables.TableStore(spark, scratch_path(spark, "store"))
