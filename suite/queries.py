"""Every registered query: (spark, sf_dir) -> DataFrame, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akin.config import WEIGHT_SCHEMES, BuildParams, Weights
from akin.functions.numeric import mixed_score, nan_to_null
from akin.functions.text import clean_html, clean_texts, combine_text, tokens
from akin.operators import explore, features, neighbours, quality, serve
from akin.operators.pair_stats import PairScores
from akin.plans.build import CATALOG, build, rebuild_with_weights
from akin.sources import catalog as catalogs
from akin.sources import store as tables
from akin.sources.scratch import scratch_path, written
from suite import fixture as fx

TEXT_HEAVY = WEIGHT_SCHEMES[1]
LATER = "2025-02-01 00:00:00"
PATTERNS = ["red widget", "STEEL", "bolt$", "^(old|new) r", "no such name"]


def joined(column: str, separator: str = "|"):
    return F.array_join(column, separator).alias(column.split(".")[-1])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Numbers at six decimals, so that another order of summation gives the same row."""
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


def stamped(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


SCORES = ("similarity_score", "genre_score", "text_score", "metadata_score")


def toxic(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("item_id"))


# --- reading and preparing ----------------------------------------------------------------------


def load_catalog_capped(spark, sf):
    items = catalogs.capped(fx.raw_items(spark, sf), page_size=100, max_items=250)
    return items.select("id", "name", "language", F.length("summary").cast("long").alias("n_chars"))


def _json_lines(spark, sf):
    """The raw items as JSON lines: every ninth is cut short, others lack fields, have more, or have no id."""
    items = fx.raw_items(spark, sf)
    whole = F.to_json(F.struct(*items.columns))
    more = F.concat(F.lit('{"added": [1, {"x": null}], '), F.substring(whole, F.lit(2), F.length(whole)))
    line = (
        F.when(F.col("id") % 9 == 0, F.substring(whole, F.lit(1), F.length(whole) - 4))
        .when(F.col("id") % 9 == 1, F.to_json(F.struct("id", "summary")))
        .when(F.col("id") % 9 == 2, more)
        .when(F.col("id") % 9 == 3, F.to_json(F.struct("name", F.col("id").cast("string").alias("status"))))
        .otherwise(whole)
    )
    path = scratch_path(spark, "lines")
    items.select(line.alias("value")).write.text(path)
    return path


def load_catalog_json(spark, sf):
    good, _ = catalogs.scan_json(spark, _json_lines(spark, sf))
    return good.select("id", "name", "language", F.length("summary").cast("long").alias("n_chars"))


def load_catalog_json_rejects(spark, sf):
    _, rejects = catalogs.scan_json(spark, _json_lines(spark, sf))
    number = F.coalesce(
        F.nullif(F.regexp_extract("record", r'^\{"id":(\d+)', 1), F.lit("")),
        F.regexp_extract("record", r'"status":"(\d+)"', 1),
    )
    return rejects.select(number.cast("long").alias("id"), "reason")


def catalog_page(spark, sf):
    page = catalogs.page(fx.raw_items(spark, sf), offset=60, limit=40)
    return page.select("id", "name", "total", "offset", "limit")


def lookup_by_keys(spark, sf):
    found = catalogs.lookup(fx.metadata(spark, sf), toxic(spark, sf), ["item_id"])
    return found.select("item_id", "name", joined("genres"), "rating", "type", "language", "network")


def lookup_children_by_keys(spark, sf):
    turns = fx.table(spark, sf, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return catalogs.lookup(turns, last, ["conv_id", "turn"])


def prepare_catalog(spark, sf):
    return fx.catalog(spark, sf).withColumn("genres", F.array_join("genres", "|"))


def nan_to_null_query(spark, sf):
    rating = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    return nan_to_null(
        fx.table(spark, sf, "part").select("p_partkey", "p_size", rating.alias("rating"))
    )


def sync_metadata(spark, sf):
    return stamped(fx.metadata(spark, sf).withColumn("genres", F.array_join("genres", "|")), "synced_at")


def find_by_name(spark, sf):
    found = serve.find_by_name(fx.catalog(spark, sf), PATTERNS)
    return found.select("pattern", "id", "name", joined("genres"))


def enrich_with_children(spark, sf):
    rich = catalogs.enriched_items(
        fx.raw_items(spark, sf), fx.children(spark, sf), "conv_id", "turn", "text"
    )
    return rich.select(
        "item_id", "name", "summary", joined("genres"), "network", "webchannel", "rating",
        "type", "language", "status", joined("season_summaries"),
        F.size("season_summaries").cast("long").alias("n_summaries"), "season_count",
    )


def nest_children(spark, sf):
    nested = catalogs.nest_children(
        fx.parents(spark, sf), fx.children(spark, sf), "item_id", "conv_id", "turn"
    )
    lines = F.transform("children", lambda c: F.concat_ws(":", c["turn"], c["role"], c["text"]))
    return nested.select("item_id", "summary", "child_count", F.array_join(lines, "|").alias("children"))


# --- text ---------------------------------------------------------------------------------------


def clean_html_query(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


def _talks(spark, sf):
    return catalogs.enrich_with_children(
        fx.parents(spark, sf), fx.children(spark, sf), "item_id", "conv_id", "turn", "text"
    )


def clean_texts_query(spark, sf):
    texts = clean_texts(F.col("season_summaries"))
    return _talks(spark, sf).select("item_id", F.array_join(texts, "|").alias("texts"))


def combine_text_query(spark, sf):
    both = combine_text(F.col("summary"), F.col("season_summaries"))
    return _talks(spark, sf).select("item_id", both.alias("text"))


def tokenize(spark, sf):
    words = tokens(clean_html(F.col("text")))
    documents = catalogs.spread(fx.table(spark, sf, "documents"), "doc_id")
    return documents.select("doc_id", words.alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), joined("words", " ")
    )


# --- exploration and quality --------------------------------------------------------------------


def genre_counts(spark, sf):
    return explore.genre_counts(fx.catalog(spark, sf))


def value_counts(spark, sf):
    items = written(fx.catalog(spark, sf).select("type", "platform", "language", "status"), "values")
    tops = {"type": None, "platform": 15, "language": 10, "status": None}
    counts = None
    for column, top in tops.items():
        one = explore.value_counts(items, column, top)
        counts = one if counts is None else counts.union(one)
    return rounded(counts, "percent")


def describe_numeric(spark, sf):
    items = fx.catalog(spark, sf).select("rating_avg", "summary")
    found = explore.describe(
        items, {"rating_avg": F.col("rating_avg"), "summary_length": explore.text_length("summary")}
    )
    return rounded(found, "mean", "std", "q25", "q50", "q75")


def histogram(spark, sf):
    items = fx.catalog(spark, sf)
    rating = explore.histogram(items, F.col("rating_avg"), 30)
    length = explore.histogram(
        items.filter(explore.text_length("summary") > 0), explore.text_length("summary"), 50
    )
    both = rating.select(F.lit("rating").alias("measure"), "*").union(
        length.select(F.lit("length").alias("measure"), "*")
    )
    return rounded(both, "lower", "upper")


def child_coverage(spark, sf):
    found = explore.child_coverage(
        fx.catalog(spark, sf), fx.children(spark, sf), "id", "conv_id", "text"
    )
    return rounded(found, "mean_season_count")


def quality_report(spark, sf):
    return rounded(quality.availability(fx.catalog(spark, sf)), "percent")


def missing_values(spark, sf):
    return quality.missing_values(fx.catalog(spark, sf))


def check_unique_keys(spark, sf):
    """Summaries that occur more than once, and doubled keys of the neighbour table (there are none)."""
    # Digests, not whole texts, go through the shuffle.
    digests = fx.catalog(spark, sf).select(F.md5("summary_clean").alias("key"))
    texts = quality.duplicate_keys(digests, ["key"])
    keys = quality.duplicate_keys(fx.stored_similarities(spark, sf), ["item_id", "similar_item_id"])
    return texts.select("key", "n").union(
        keys.select(F.concat_ws("-", "item_id", "similar_item_id"), "n")
    )


def check_not_null(spark, sf):
    return quality.null_violations(
        fx.metadata(spark, sf), "item_id", ["name", "rating", "network", "type", "synced_at"]
    )


def check_lengths(spark, sf):
    return quality.length_violations(
        fx.metadata(spark, sf), "item_id", {"name": 10, "type": 50, "network": 8, "summary": 255}
    )


# --- features -----------------------------------------------------------------------------------


def topn_categories(spark, sf):
    items = fx.catalog(spark, sf)
    top = {"platform": fx.PARAMS.top_platforms, "language": fx.PARAMS.top_languages}
    first, second = (
        features.top_categories(items, c, n).select(
            F.lit(c).alias("column_name"), "value", "n", F.col("rank").cast("long").alias("rank")
        )
        for c, n in top.items()
    )
    return first.union(second)


def genre_vocab(spark, sf):
    return features.genre_vocab(fx.catalog(spark, sf))


def type_vocab(spark, sf):
    return features.type_vocab(fx.catalog(spark, sf))


def _words(spark, sf):
    return written(features.item_words(fx.catalog(spark, sf), fx.PARAMS), "tokens")


def _vocab_rows(vocab):
    return rounded(vocab.withColumn("term_id", F.col("term_id").cast("long")), "idf")


def term_vocab(spark, sf):
    return _vocab_rows(features.term_vocab(_words(spark, sf), fx.PARAMS))


def genre_multihot(spark, sf):
    items = fx.catalog(spark, sf)
    return features.genre_multihot(items, features.genre_vocab(items))


def tfidf(spark, sf):
    words = _words(spark, sf)
    vectors = features.text_vectors(words, features.fit_terms(words, fx.PARAMS))
    postings = features.text_postings(vectors).withColumn("term_id", F.col("term_id").cast("long"))
    return rounded(postings, "weight")


def platform_onehot(spark, sf):
    items, n = fx.catalog(spark, sf), fx.PARAMS.top_platforms
    ranks = features.top_categories(items, "platform", n)
    return features.platform_onehot(items, ranks, n).select(
        "id", F.col("platform_bucket").cast("long").alias("platform_bucket")
    )


def type_onehot(spark, sf):
    items = fx.catalog(spark, sf)
    return features.type_onehot(items, features.type_vocab(items))


def language_onehot(spark, sf):
    items, n = fx.catalog(spark, sf), fx.PARAMS.top_languages
    ranks = features.top_categories(items, "language", n)
    return features.language_onehot(items, ranks, n).select(
        "id", F.col("language_bucket").cast("long").alias("language_bucket")
    )


def feature_summary(spark, sf):
    return rounded(features.feature_summary(fx.stored_features(spark, sf), fx.PARAMS), "sparsity")


def feature_sums(spark, sf):
    return features.feature_sums(fx.stored_features(spark, sf), fx.PARAMS)


def combined_features(spark, sf):
    return rounded(features.combined_features(fx.stored_features(spark, sf), fx.PARAMS), "value")


def top_terms(spark, sf):
    found = fx.stored_features(spark, sf)
    return rounded(features.top_terms(found.items, found.term_vocab, 10), "weight")


def feature_store_roundtrip(spark, sf):
    store = fx.new_store(spark)
    tables.save_features(store, fx.stored_features(spark, sf))
    return rounded(features.feature_summary(tables.load_features(store), fx.PARAMS), "sparsity")


# --- similarity ---------------------------------------------------------------------------------


def _scored(spark, sf, mode="concat", weights=Weights()):
    return serve.score_pairs(
        fx.bought_in_a_row(spark, sf), fx.stored_features(spark, sf).items, weights,
        metadata_mode=mode,
    )


def _one_score(column: str, mode: str = "concat"):
    def query(spark, sf):
        scored = _scored(spark, sf, mode).select("item_id", "similar_item_id", column)
        return rounded(scored, column)

    return query


def hybrid_similarity(spark, sf):
    """Weights 2:3:1 scaled to one, and the raw production weights, side by side."""
    uneven = Weights(2.0, 3.0, 1.0)
    scored = _scored(spark, sf, "mean", uneven).withColumnRenamed("similarity_score", "normalised")
    parts = (F.col("genre_score"), F.col("text_score"), F.col("metadata_score"))
    raw = scored.withColumn("raw", mixed_score(*parts, Weights(), normalise=False))
    return rounded(raw.select("item_id", "similar_item_id", "normalised", "raw"), "normalised", "raw")


def similarity_topn(spark, sf):
    """The flagship: clean, extract, score all pairs, keep the 20 best of every item."""
    found = features.extract(fx.catalog(spark, sf), fx.PARAMS)
    best = neighbours.top_neighbours(found.items, (Weights(),), 20, 0.1, False, "mean")
    return rounded(best.drop("scheme"), *SCORES)


def component_topn(spark, sf):
    items = fx.stored_features(spark, sf).items
    parts = [
        neighbours.component_neighbours(items, c, 5).select(F.lit(c).alias("component"), "*")
        for c in ("genre", "text", "metadata")
    ]
    return rounded(parts[0].union(parts[1]).union(parts[2]), "similarity_score")


def weight_sweep(spark, sf):
    best = neighbours.top_neighbours(
        fx.stored_features(spark, sf).items, WEIGHT_SCHEMES, 5, 0.0, True, "concat"
    )
    return rounded(
        best.select("scheme", "item_id", "similar_item_id", "similarity_score"), "similarity_score"
    )


def similarity_stats(spark, sf):
    found = PairScores(fx.stored_features(spark, sf).items).statistics()
    return rounded(found, "mean", "std", "min", "max", "median")


def score_range(spark, sf):
    return rounded(PairScores(fx.stored_features(spark, sf).items).score_range(), "min", "max")


def pair_histogram(spark, sf):
    return rounded(PairScores(fx.stored_features(spark, sf).items).histogram(50), "lower", "upper")


# --- store --------------------------------------------------------------------------------------


def store_similarities(spark, sf):
    """Written twice, the second time replacing the first, and read back."""
    store = fx.new_store(spark)
    rows = fx.stored_similarities(spark, sf)
    tables.store_similarities(store, rows, computed_at=fx.stamp())
    tables.store_similarities(store, rows, clear_existing=True, computed_at=fx.stamp())
    return stamped(rounded(store.read(tables.SIMILARITIES), *SCORES), "computed_at")


def _text_heavy(spark, sf):
    """The best 10 of every item under other weights, out of all pairs of the stored features."""
    items = fx.stored_features(spark, sf).items
    return neighbours.top_neighbours(items, (TEXT_HEAVY,), 10, 0.2, True, "mean").drop("scheme")


def _text_heavy_of(spark, sf, items):
    """The same lists for some items only."""
    features = fx.stored_features(spark, sf).items
    return neighbours.neighbours_of(features, items, TEXT_HEAVY, 10, 0.2, True, "mean")


def replace_neighbours(spark, sf):
    """The toxic items get the lists of other weights."""
    old = fx.stored_similarities(spark, sf)
    new = _text_heavy_of(spark, sf, toxic(spark, sf)).withColumn("computed_at", fx.stamp())
    return rounded(tables.replaced_neighbours(old, new, toxic(spark, sf)).drop("computed_at"), *SCORES)


def _similarities(spark, sf, rows=None):
    table = tables.similarity_table(fx.new_store(spark))
    table.write(fx.stored_similarities(spark, sf) if rows is None else rows)
    return table


def store_append(spark, sf):
    """The lists of the toxic items are added to those of the others."""
    rows, some = fx.stored_similarities(spark, sf), toxic(spark, sf)
    table = _similarities(spark, sf, tables.deleted(rows, some))
    table.append(rows.join(some, "item_id", "left_semi"))
    return stamped(rounded(table.read(), *SCORES), "computed_at")


def store_replace(spark, sf):
    """The stored lists of the toxic items are swapped for those of other weights."""
    table, some = _similarities(spark, sf), toxic(spark, sf)
    new = tables.as_similarities(_text_heavy_of(spark, sf, some), F.lit(LATER).cast("timestamp"))
    table.replace(new, some)
    return stamped(rounded(table.read(), *SCORES), "computed_at")


def store_delete(spark, sf):
    table = _similarities(spark, sf)
    table.delete(toxic(spark, sf))
    return stamped(rounded(table.read(), *SCORES), "computed_at")


def store_delete_counts(spark, sf):
    return _similarities(spark, sf).delete(toxic(spark, sf))


def _changed(spark, sf):
    """Toxic items renamed and re-stamped, and as new items under other ids."""
    old = catalogs.lookup(fx.metadata(spark, sf), toxic(spark, sf), ["item_id"])
    changed = old.withColumn("name", F.upper("name")).withColumn("synced_at", F.lit(LATER).cast("timestamp"))
    return changed.unionByName(changed.withColumn("item_id", -1 - F.col("item_id")))


def store_upsert(spark, sf):
    table = tables.metadata_table(fx.new_store(spark))
    table.write(fx.metadata(spark, sf))
    table.upsert(_changed(spark, sf))
    return stamped(table.read().select("item_id", "name", joined("genres"), "rating", "synced_at"), "synced_at")


def delete_items(spark, sf):
    return tables.deletion_counts(fx.stored_similarities(spark, sf), toxic(spark, sf))


def kept_after_delete(spark, sf):
    return tables.deleted(fx.metadata(spark, sf), toxic(spark, sf)).select("item_id", "name")


def upsert_metadata(spark, sf):
    """Toxic items come back renamed and re-stamped, and as new items under other ids."""
    old = fx.metadata(spark, sf)
    changed = (
        catalogs.lookup(old, toxic(spark, sf), ["item_id"])
        .withColumn("name", F.upper("name"))
        .withColumn("synced_at", F.lit("2025-02-01 00:00:00").cast("timestamp"))
    )
    added = changed.withColumn("item_id", -1 - F.col("item_id"))
    both = tables.upserted(old, changed.unionByName(added))
    return stamped(both.select("item_id", "name", joined("genres"), "rating", "synced_at"), "synced_at")


def store_stats(spark, sf):
    found = tables.store_stats(fx.stored_similarities(spark, sf))
    return stamped(rounded(found, "avg_similarities_per_item"), "last_computed")


def system_stats(spark, sf):
    found = tables.system_stats(
        fx.stored_similarities(spark, sf), fx.stored_metadata(spark, sf), Weights()
    )
    return stamped(rounded(found, "avg_similarities_per_item"), "last_computed")


def run_stats(spark, sf):
    """The statistics that the write of the neighbour table has observed."""
    store = fx.new_store(spark)
    seen = tables.similarity_table(store).write(fx.stored_similarities(spark, sf))
    found = tables.written_stats(store, seen, 20, 0.1)
    return stamped(rounded(found, "avg_similarities_per_item"), "last_computed")


def neighbour_counts(spark, sf):
    return tables.neighbour_counts(fx.stored_similarities(spark, sf))


def neighbour_counts_asked(spark, sf):
    """Half of the asked ids are not stored."""
    some = toxic(spark, sf)
    asked = some.union(some.select(-1 - F.col("item_id")))
    return tables.neighbour_counts(fx.stored_similarities(spark, sf), asked)


def distinct_sources(spark, sf):
    return tables.distinct_sources(fx.stored_similarities(spark, sf))


def reweight_stored_pairs(spark, sf):
    return rounded(_text_heavy(spark, sf), *SCORES)


def rebuild(spark, sf):
    """A stored table is built anew under other weights and read back."""
    store = fx.new_store(spark)
    store.write(CATALOG, fx.stored_catalog(spark, sf))
    tables.save_features(store, fx.stored_features(spark, sf))
    tables.store_similarities(store, fx.stored_similarities(spark, sf))
    params = BuildParams(weights=TEXT_HEAVY, top_n=10, min_similarity=0.2, normalise_weights=True)
    rebuild_with_weights(store, params, fx.stamp())
    return stamped(rounded(store.read(tables.SIMILARITIES), *SCORES), "computed_at")


def full_build(spark, sf):
    """Fetch, features and populate into a new store; the statistics of the run."""
    found = build(fx.new_store(spark), fx.raw_items(spark, sf), BuildParams(features=fx.PARAMS), stamp=fx.stamp())
    return stamped(rounded(found, "avg_similarities_per_item"), "last_computed")


# --- serving ------------------------------------------------------------------------------------


def validate_requests(spark, sf):
    return serve.validate_requests(fx.requests(spark, sf))


def _served(n: int, low: float):
    def query(spark, sf):
        found = serve.similar_items(
            fx.label_requests(spark, sf, n, low), fx.stored_similarities(spark, sf)
        )
        return rounded(found.drop("computed_at"), *SCORES)

    return query


def recommend_with_metadata(spark, sf):
    """Neighbours without a type are not in this metadata table, so they drop out before the cut."""
    about = fx.stored_metadata(spark, sf).filter("type is not null")
    found = serve.recommend(
        fx.label_requests(spark, sf, 5, 0.0), fx.stored_similarities(spark, sf), about
    )
    return rounded(found.withColumn("genres", F.array_join("genres", "|")), *SCORES)


ANSWER = (
    "item_id long, count long, message string, error string, "
    "recommendations array<struct<item_id: long, name: string, rating: double, network: string>>"
)


def recommend_json(spark, sf):
    """The JSON answers, taken apart again."""
    valid = serve.validate_requests(fx.requests(spark, sf))
    answers = serve.responses(valid, fx.stored_similarities(spark, sf), fx.stored_metadata(spark, sf))
    parsed = answers.withColumn("a", F.from_json("body", ANSWER))
    return parsed.select(
        "request_id",
        "status",
        "a.item_id",
        "a.count",
        "a.message",
        "a.error",
        F.array_join("a.recommendations.item_id", ",").alias("ids"),
        F.array_join("a.recommendations.name", ",").alias("names"),
        F.array_join("a.recommendations.network", ",", "-").alias("networks"),
    )


def verify_sample(spark, sf):
    found = serve.verify_sample(
        fx.stored_catalog(spark, sf), fx.stored_similarities(spark, sf), fx.stored_metadata(spark, sf)
    )
    return rounded(found.withColumn("genres", F.array_join("genres", "|")), "similarity_score")


QUERIES = {
    "load_catalog_capped": load_catalog_capped,
    "load_catalog_json": load_catalog_json,
    "load_catalog_json_rejects": load_catalog_json_rejects,
    "catalog_page": catalog_page,
    "lookup_by_keys": lookup_by_keys,
    "lookup_children_by_keys": lookup_children_by_keys,
    "prepare_catalog": prepare_catalog,
    "nan_to_null": nan_to_null_query,
    "sync_metadata": sync_metadata,
    "find_by_name": find_by_name,
    "enrich_with_children": enrich_with_children,
    "nest_children": nest_children,
    "clean_html": clean_html_query,
    "clean_texts": clean_texts_query,
    "combine_text": combine_text_query,
    "tokenize": tokenize,
    "genre_counts": genre_counts,
    "value_counts": value_counts,
    "describe_numeric": describe_numeric,
    "histogram": histogram,
    "child_coverage": child_coverage,
    "quality_report": quality_report,
    "missing_values": missing_values,
    "check_unique_keys": check_unique_keys,
    "check_not_null": check_not_null,
    "check_lengths": check_lengths,
    "topn_categories": topn_categories,
    "genre_vocab": genre_vocab,
    "type_vocab": type_vocab,
    "term_vocab": term_vocab,
    "genre_multihot": genre_multihot,
    "tfidf": tfidf,
    "platform_onehot": platform_onehot,
    "type_onehot": type_onehot,
    "language_onehot": language_onehot,
    "feature_summary": feature_summary,
    "feature_sums": feature_sums,
    "combined_features": combined_features,
    "top_terms": top_terms,
    "feature_store_roundtrip": feature_store_roundtrip,
    "genre_similarity": _one_score("genre_score"),
    "text_similarity": _one_score("text_score"),
    "metadata_similarity_concat": _one_score("metadata_score"),
    "metadata_similarity_mean": _one_score("metadata_score", "mean"),
    "hybrid_similarity": hybrid_similarity,
    "similarity_topn": similarity_topn,
    "component_topn": component_topn,
    "weight_sweep": weight_sweep,
    "similarity_stats": similarity_stats,
    "score_range": score_range,
    "pair_histogram": pair_histogram,
    "store_similarities": store_similarities,
    "replace_neighbours": replace_neighbours,
    "store_append": store_append,
    "store_replace": store_replace,
    "store_delete": store_delete,
    "store_delete_counts": store_delete_counts,
    "store_upsert": store_upsert,
    "delete_items": delete_items,
    "kept_after_delete": kept_after_delete,
    "upsert_metadata": upsert_metadata,
    "store_stats": store_stats,
    "system_stats": system_stats,
    "run_stats": run_stats,
    "neighbour_counts": neighbour_counts,
    "neighbour_counts_asked": neighbour_counts_asked,
    "distinct_sources": distinct_sources,
    "reweight_stored_pairs": reweight_stored_pairs,
    "rebuild_with_weights": rebuild,
    "full_build": full_build,
    "validate_requests": validate_requests,
    "similar_items": _served(10, 0.0),
    "recommend_threshold": _served(20, 0.5),
    "recommend_with_metadata": recommend_with_metadata,
    "recommend_json": recommend_json,
    "verify_sample": verify_sample,
}
