"""Fitting vocabularies and turning items into features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akin.config import FeatureParams
from akin.functions.membership import bitmap
from akin.functions.text import tokens
from akin.operators import termmath
from akin.sources.scratch import DENSE, discard, written

MAX_BROADCAST = 10_000  # rows of a table that is hinted as small

_COUNTED = "term string, df long, tf long"

GROUPS = ("genre", "text", "platform", "type", "language")


@dataclass(frozen=True)
class FeatureSet:
    """One packed row per item, and the dimension tables that explain the ids in it.

    items: id, genres (distinct, sorted), platform_bucket, type, type_id, language_bucket,
           term_ids, tfs, weights (L2-normalised; the three arrays run in parallel)
    """

    items: DataFrame
    genre_vocab: DataFrame
    term_vocab: DataFrame
    platform_rank: DataFrame
    type_vocab: DataFrame
    language_rank: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


# --- vocabularies -------------------------------------------------------------------------------


def positioned(rows: DataFrame, order: list[str], index: str) -> DataFrame:
    """Add the 0-based position of each row in the given order, without one global sort task.

    `order` must tell all rows apart. Rows are range-partitioned and numbered within their range;
    only the range sizes, one row per partition, are summed up in one place.
    """
    ranged = written(
        rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(index, (F.col("_first") + within - 1).cast("long"))
        .drop("_range", "_first")
    )


def genre_vocab(items: DataFrame) -> DataFrame:
    """Distinct genres with their position in sorted order."""
    genres = items.select(F.explode("genres").alias("genre")).distinct()
    return positioned(genres, ["genre"], "genre_id")


def type_vocab(items: DataFrame) -> DataFrame:
    """Distinct non-null types with their position in sorted order."""
    types = items.filter(F.col("type").isNotNull()).select("type").distinct()
    return positioned(types, ["type"], "type_id")


def top_categories(items: DataFrame, column: str, n: int) -> DataFrame:
    """The `n` most frequent non-null values; ties by value. Ranks start at 0."""
    top = (
        items.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(n)
    )
    order = Window.orderBy(F.desc("n"), "value")  # over the n rows kept
    return top.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


# --- text ---------------------------------------------------------------------------------------


def item_words(items: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """(id, words): the words of the clean summary in order, stop words left out."""
    return items.select("id", _words(params).alias("words"))


def _words(params: FeatureParams) -> Column:
    return tokens(F.coalesce("summary_clean", F.lit("")), params.stop_words)


def _summed(counts: DataFrame) -> DataFrame:
    """df and total tf of each term; tasks have counted many rows at once, the rest is combined before the shuffle."""
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def _word_counts(words: DataFrame) -> DataFrame:
    """(term, df, tf) of the words."""
    return _summed(words.select("words").mapInArrow(termmath.word_counts, _COUNTED))


def _pair_counts(words: DataFrame, frequent: DataFrame) -> DataFrame:
    """(term, df, tf) of word pairs made of frequent words, and a few others; of all when there are too many to filter."""
    bits, count = bitmap(frequent, "term", termmath.slots), termmath.pair_counts
    bits = None if bits is None else np.frombuffer(bits, np.uint8)
    return _summed(words.select("words").mapInArrow(lambda batches: count(batches, bits), _COUNTED))


def term_vocab(words: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """The kept words and word pairs with df, total tf and idf; at most `max_terms` rows.

    A pair occurs no more often than either of its words. So once the single words are counted, only
    pairs of words that are frequent enough themselves can still get in, and only those are counted.
    """
    return _term_vocab(words, params)[0]


def _term_vocab(words: DataFrame, params: FeatureParams) -> tuple[DataFrame, list[DataFrame]]:
    """The vocabulary, and the scratch tables that it is read from."""
    n_items = words.count()
    singles = written(_word_counts(words), "words")
    in_range = (F.col("df") >= params.min_df) & (F.col("df") <= F.lit(params.max_df * n_items))
    best = singles.filter(in_range).orderBy(F.desc("tf"), "term").limit(params.max_terms)
    least = best.agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("tf")).first()
    floor = least.tf if least.n == params.max_terms else 0
    frequent = singles.filter((F.col("df") >= params.min_df) & (F.col("tf") >= floor)).select("term")
    frequent = written(frequent, "frequent")
    kept = (
        best.union(_pair_counts(words, frequent).filter(in_range))
        .orderBy(F.desc("tf"), "term")
        .limit(params.max_terms)
    )
    order = Window.orderBy("term")  # over the max_terms rows kept
    vocab = kept.select(
        "term",
        (F.row_number().over(order) - 1).cast("int").alias("term_id"),
        "df",
        "tf",
        (F.log(F.lit(1.0 + n_items) / (F.col("df") + 1.0)) + 1.0).alias("idf"),
    )
    return vocab, [singles, frequent]


def fit_terms(words: DataFrame, params: FeatureParams = FeatureParams()) -> DataFrame:
    """`term_vocab` written down; no term left is an error."""
    vocab, parts = _term_vocab(words, params)
    vocab = written(vocab, "terms")
    discard(*parts)
    if vocab.isEmpty():
        raise ValueError("empty vocabulary: no term is left after pruning by document frequency")
    return vocab


def with_text(words: DataFrame, vocab: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Each row with its term_ids, tfs and weights (TF-IDF, length one) instead of its words.

    The vocabulary, at most `max_terms` rows, goes to the tasks: terms are filtered, counted and
    weighed in the row they come from, and nothing is shuffled. Rows without a known term have empty
    arrays, or go if `keep_empty` is false.
    """
    known = vocab.select("term", "term_id", "idf").orderBy("term_id").collect()
    terms = termmath.Terms(*([t[c] for t in known] for c in ("term", "term_id", "idf")))
    rest, vectors = [c for c in words.columns if c != "words"], termmath.with_vectors
    schema = T.StructType([words.schema[c] for c in rest])
    for name, kind in (("term_ids", T.IntegerType()), ("tfs", T.LongType()), ("weights", T.DoubleType())):
        schema = schema.add(name, T.ArrayType(kind))
    return words.mapInArrow(lambda batches: vectors(batches, terms, rest, keep_empty), schema)


def text_vectors(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Packed TF-IDF rows (id, term_ids, tfs, weights) of the items that hold a known term."""
    return with_text(words.select("id", "words"), vocab, keep_empty=False)


def text_postings(vectors: DataFrame) -> DataFrame:
    """(id, term_id, weight) from packed rows."""
    return vectors.select("id", F.inline(F.arrays_zip("term_ids", "weights"))).toDF(
        "id", "term_id", "weight"
    )


# --- categories ---------------------------------------------------------------------------------


def genre_multihot(items: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, genre_id) for every distinct genre of an item."""
    return (
        items.select("id", F.explode(F.array_distinct("genres")).alias("genre"))
        .join(vocab, "genre")
        .select("id", "genre_id")
    )


def with_bucket(items: DataFrame, column: str, ranks: DataFrame, n: int, bucket: str) -> DataFrame:
    """Add the rank of the value among the top `n`; anything else, null included, is bucket `n`."""
    top = small(ranks.select(F.col("value").alias(column), F.col("rank").alias(bucket)), n)
    return items.join(top, column, "left").withColumn(bucket, F.coalesce(bucket, F.lit(n)))


def platform_onehot(items: DataFrame, ranks: DataFrame, n: int = 20) -> DataFrame:
    return with_bucket(items, "platform", ranks, n, "platform_bucket").select(
        "id", "platform_bucket"
    )


def language_onehot(items: DataFrame, ranks: DataFrame, n: int = 5) -> DataFrame:
    return with_bucket(items, "language", ranks, n, "language_bucket").select(
        "id", "language_bucket"
    )


def type_onehot(items: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, type_id); a null type has no entry and stays null."""
    return items.join(vocab, "type", "left").select("id", "type_id")


# --- all groups ---------------------------------------------------------------------------------


def extract(items: DataFrame, params: FeatureParams = FeatureParams()) -> FeatureSet:
    """Fit every vocabulary and build one packed feature row per item.

    The items are read once, so they need not be a table. Their words are the one large scratch table; it
    goes when the features are written.
    """
    # The words stay beside the rest of the item, so no join has to bring them together.
    base = items.select("id", "genres", "platform", "type", "language", _words(params).alias("words"))
    read = written(base, "tokens", DENSE)
    terms = fit_terms(read.select("id", "words"), params)
    platforms = written(top_categories(read, "platform", params.top_platforms), "platforms")
    languages = written(top_categories(read, "language", params.top_languages), "languages")
    types, genres = (written(v, "vocab") for v in (type_vocab(read), genre_vocab(read)))

    base = with_text(read, terms)
    base = with_bucket(base, "platform", platforms, params.top_platforms, "platform_bucket")
    base = with_bucket(base, "language", languages, params.top_languages, "language_bucket")
    packed = base.join(types, "type", "left").select(
        "id",
        F.sort_array(F.array_distinct(F.coalesce("genres", _none("string")))).alias("genres"),
        "platform_bucket",
        "type",
        "type_id",
        "language_bucket",
        "term_ids",
        "tfs",
        "weights",
    )
    packed = written(packed, "items")
    discard(read)
    return FeatureSet(packed, genres, terms, platforms, types, languages)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint at a broadcast when the number of rows is known to be small; else leave the choice."""
    return F.broadcast(df) if max_rows <= MAX_BROADCAST else df


def _none(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def combined_features(features: FeatureSet, params: FeatureParams = FeatureParams()) -> DataFrame:
    """All groups side by side as (id, feature_id, value), each group after the one before it."""
    width = group_widths(features, params)
    start, at = {}, 0
    for group in GROUPS:
        start[group] = at
        at += width[group]
    items = features.items

    def one_hot(column: str, group: str) -> DataFrame:
        return items.filter(F.col(column).isNotNull()).select(
            "id", (F.col(column) + start[group]).cast("long").alias("feature_id"),
            F.lit(1.0).alias("value"),
        )

    genre = genre_multihot(items, features.genre_vocab).select(
        "id", (F.col("genre_id") + start["genre"]).alias("feature_id"), F.lit(1.0).alias("value")
    )
    text = text_postings(items).select(
        "id", (F.col("term_id") + start["text"]).cast("long"), F.col("weight")
    )
    return (
        genre.union(text)
        .union(one_hot("platform_bucket", "platform"))
        .union(one_hot("type_id", "type"))
        .union(one_hot("language_bucket", "language"))
    )


def group_widths(features: FeatureSet, params: FeatureParams = FeatureParams()) -> dict[str, int]:
    """Columns of each group; platform and language have one more for all other values."""
    return {
        "genre": features.genre_vocab.count(),
        "text": features.term_vocab.count(),
        "platform": params.top_platforms + 1,
        "type": features.type_vocab.count(),
        "language": params.top_languages + 1,
    }


def feature_summary(features: FeatureSet, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Rows, columns, filled cells and sparsity of each group and of all of them together."""
    width = group_widths(features, params)
    filled = {
        "genre": F.size("genres"),
        "text": F.size("term_ids"),
        "platform": F.lit(1),
        "type": F.col("type").isNotNull().cast("int"),
        "language": F.lit(1),
    }
    one = features.items.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.coalesce(F.sum(filled[g]), F.lit(0)).cast("long").alias(g) for g in GROUPS),
    )
    lines = [(g, width[g], F.col(g)) for g in GROUPS]
    lines.append(("all", sum(width.values()), sum((F.col(g) for g in GROUPS), start=F.lit(0))))
    flat = one.select(
        "n",
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(g).alias("feature_group"),
                        F.lit(w).cast("long").alias("n_columns"),
                        cells.cast("long").alias("n_filled"),
                    )
                    for g, w, cells in lines
                )
            )
        ),
    )
    cells = F.col("n_rows").cast("double") * F.col("n_columns")
    return flat.withColumnRenamed("n", "n_rows").select(
        "feature_group",
        "n_rows",
        "n_columns",
        "n_filled",
        F.coalesce(1.0 - F.try_divide(F.col("n_filled"), cells), F.lit(0.0)).alias("sparsity"),
    )


def feature_sums(features: FeatureSet, params: FeatureParams = FeatureParams()) -> DataFrame:
    """Items per genre, platform, type and language feature (a column sum of each group)."""
    def counted(df: DataFrame, group: str) -> DataFrame:
        return df.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(group).alias("feature_group"), "feature", "n"
        )

    def labelled(column: str, ranks: DataFrame, top: int) -> DataFrame:
        names = small(ranks.select(F.col("rank").alias(column), F.col("value")), top)
        return features.items.select(column).join(names, column, "left").select(
            F.when(F.col(column) == top, F.lit("(other)")).otherwise(F.col("value")).alias("feature")
        )

    items = features.items
    return (
        counted(items.select(F.explode("genres").alias("feature")), "genre")
        .union(counted(labelled("platform_bucket", features.platform_rank, params.top_platforms), "platform"))
        .union(counted(items.filter("type is not null").select(F.col("type").alias("feature")), "type"))
        .union(counted(labelled("language_bucket", features.language_rank, params.top_languages), "language"))
    )


def top_terms(vectors: DataFrame, vocab: DataFrame, n: int = 10) -> DataFrame:
    """The heaviest terms of each item, in the row: an item has at most `max_terms` of them."""
    best = F.slice(
        F.sort_array(
            F.transform(
                F.arrays_zip("term_ids", "weights"),
                lambda x: F.struct(
                    (-F.round(x["weights"], 9)).alias("o"),
                    x["term_ids"].alias("term_id"),
                    x["weights"].alias("weight"),
                ),
            )
        ),
        1,
        n,
    )
    return (
        vectors.select("id", F.posexplode(best).alias("pos", "b"))
        .select("id", (F.col("pos") + 1).cast("long").alias("rank"), "b.term_id", "b.weight")
        .join(vocab.select("term_id", "term"), "term_id")
        .select("id", "rank", "term", "weight")
    )
