import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from akin.config import FeatureParams
from akin.functions import membership
from akin.operators import features as ops


def catalog(spark, rows):
    schema = "id long, genres array<string>, summary_clean string, type string, language string, platform string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(40)] + ["the", "and"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, [1 / (k + 1) for k in range(42)], k=rng.randint(0, 40)))
        rows.append(
            (i, rng.sample(["Drama", "Crime", "Comedy"], rng.randint(0, 3)), text if i else None,
             rng.choice(["A", "B", None]), rng.choice(["en", "fr", "de", None]),
             rng.choice(["Canal", "Canal", "Nova", "Orbit", None]))
        )
    rows.append((60, ["Drama", "Drama"], "w00 w01", "A", "en", "other"))
    return catalog(spark, rows)


def expected_terms(rows, max_terms, min_df, max_df, stop=("the", "and")):
    grams = {}
    for r in rows:
        words = [w for w in re.findall(r"\w\w+", (r.summary_clean or "").lower()) if w not in stop]
        grams[r.id] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df, tf = Counter(), Counter()
    for counts in grams.values():
        df.update(counts.keys())
        tf.update(counts)
    kept = [t for t in df if min_df <= df[t] <= max_df * len(rows)]
    kept = sorted(sorted(kept, key=lambda t: (-tf[t], t))[:max_terms])
    idf = {t: math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in kept}
    vectors = {}
    for i, counts in grams.items():
        raw = {t: counts[t] * idf[t] for t in kept if counts[t]}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        if raw:
            vectors[i] = {t: w / norm for t, w in raw.items()}
    return {t: (df[t], tf[t], idf[t]) for t in kept}, vectors


@pytest.mark.parametrize("most_bits", [membership.MOST_BITS, 0])
@pytest.mark.parametrize(
    "max_terms, min_df, max_df", [(500, 2, 0.8), (30, 2, 0.8), (10, 3, 0.3), (5, 1, 1.0), (45, 2, 0.5)]
)
def test_tfidf_against_plain_python(spark, items, monkeypatch, most_bits, max_terms, min_df, max_df):
    monkeypatch.setattr(membership, "MOST_BITS", most_bits)
    params = FeatureParams(max_terms=max_terms, min_df=min_df, max_df=max_df)
    words = ops.item_words(items, params)
    vocab = ops.fit_terms(words, params)
    terms, vectors = expected_terms(items.collect(), max_terms, min_df, max_df)
    rows = vocab.orderBy("term_id").collect()
    assert [r.term for r in rows] == sorted(terms)
    assert [r.term_id for r in rows] == list(range(len(terms)))
    for r in rows:
        assert (r.df, r.tf) == terms[r.term][:2]
        assert r.idf == pytest.approx(terms[r.term][2])
    names = {r.term_id: r.term for r in rows}
    found = {
        r.id: {names[t]: w for t, w in zip(r.term_ids, r.weights)}
        for r in ops.text_vectors(words, vocab).collect()
    }
    assert found.keys() == vectors.keys()
    for i, vector in vectors.items():
        assert found[i] == pytest.approx(vector)
        assert sum(w * w for w in found[i].values()) == pytest.approx(1.0)


def test_an_empty_vocabulary_is_an_error(spark):
    rows = catalog(spark, [(1, [], "alpha beta", None, None, None), (2, [], "gamma", None, None, None)])
    with pytest.raises(ValueError, match="empty vocabulary"):
        ops.fit_terms(ops.item_words(rows))


def test_more_than_ten_thousand_frequent_words(spark):
    # Every word is in two texts, and so is every pair of neighbours in the first half.
    words = [f"w{i:05d}" for i in range(12_000)]
    texts = [" ".join(words), " ".join(words[:6_000]) + " " + " ".join(reversed(words[6_000:]))]
    rows = catalog(spark, [(i, [], t, None, None, None) for i, t in enumerate(texts)])
    items = ops.item_words(rows)
    vocab = ops.term_vocab(items, FeatureParams(max_terms=30_000, max_df=1.0))
    terms = {r.term for r in vocab.select("term").collect()}
    assert terms == set(words) | {f"{a} {b}" for a, b in zip(words[:6_000], words[1:6_000])}


def test_a_membership_bitmap_has_all_its_keys_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    test = membership.may_hold(keys, "k")
    other = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("k"))
    assert keys.filter(test(F.col("k"))).count() == 20_000
    assert other.filter(test(F.col("k"))).count() < 3_000
    none = membership.may_hold(keys.limit(0), "k")
    assert keys.filter(none(F.col("k"))).count() == 0


def test_vectors_are_made_in_the_row(spark, items, tmp_path):
    words = ops.item_words(items, FeatureParams(max_terms=30))
    words.write.parquet(f"{tmp_path}/w")
    stored = spark.read.parquet(f"{tmp_path}/w")
    vectors = ops.text_vectors(stored, ops.fit_terms(stored, FeatureParams(max_terms=30)))
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_genres_are_multi_hot_without_repeats(spark, items):
    vocab = ops.genre_vocab(items)
    assert [(r.genre, r.genre_id) for r in vocab.orderBy("genre_id").collect()] == [
        ("Comedy", 0), ("Crime", 1), ("Drama", 2)
    ]
    hot = ops.genre_multihot(items, vocab)
    assert hot.filter("id = 60").collect()[0].genre_id == 2 and hot.filter("id = 60").count() == 1
    assert hot.count() == sum(len(set(r.genres)) for r in items.collect())


def test_dense_positions_over_many_ranges(spark):
    values = spark.range(1000).select(F.format_string("%05d", (F.col("id") * 7) % 1000).alias("v"))
    rows = ops.positioned(values, ["v"], "i").collect()
    assert all(int(r.v) == r.i for r in rows) and len(rows) == 1000


def test_a_platform_outside_the_top_is_other(spark):
    rows = [(i, [], "", None, None, p) for i, p in enumerate(["Canal", "Canal", "Nova", "Orbit", None])]
    items = catalog(spark, rows)
    ranks = ops.top_categories(items, "platform", 1)
    found = ops.platform_onehot(items, ranks, 1).orderBy("id").collect()
    assert [r.platform_bucket for r in found] == [0, 0, 1, 1, 1]


def test_ties_at_the_cut_go_by_name(spark):
    items = catalog(spark, [(i, [], "", None, p, None) for i, p in enumerate(["b", "a", "c", "c"])])
    assert [r.value for r in ops.top_categories(items, "language", 2).orderBy("rank").collect()] == ["c", "a"]


def test_a_null_type_has_no_entry(spark, items):
    vocab = ops.type_vocab(items)
    found = {r.id: r.type_id for r in ops.type_onehot(items, vocab).collect()}
    for r in items.collect():
        assert found[r.id] == {"A": 0, "B": 1, None: None}[r.type]


def test_all_groups_together(spark, items):
    params = FeatureParams(max_terms=30, top_platforms=2, top_languages=2)
    found = ops.extract(items, params)
    packed = {r.id: r for r in found.items.collect()}
    assert len(packed) == 61 and packed[0].term_ids == [] and packed[60].genres == ["Drama"]
    # A platform that is really called "other" shares the bucket of all the rest.
    assert packed[60].platform_bucket == 2
    widths = ops.group_widths(found, params)
    assert widths == {"genre": 3, "text": 30, "platform": 3, "type": 2, "language": 3}
    cells = ops.combined_features(found, params)
    summary = {r.feature_group: r for r in ops.feature_summary(found, params).collect()}
    assert summary["all"].n_filled == cells.count() and summary["all"].n_columns == 41
    assert summary["all"].sparsity == pytest.approx(1 - cells.count() / (61 * 41))
    assert cells.agg(F.max("feature_id")).first()[0] < 41
    assert cells.groupBy("id", "feature_id").count().filter("count > 1").count() == 0
    sums = {(r.feature_group, r.feature): r.n for r in ops.feature_sums(found, params).collect()}
    assert sums[("genre", "Drama")] == sum("Drama" in r.genres for r in items.collect())
    assert sum(n for (g, _), n in sums.items() if g == "platform") == 61


def test_top_terms_are_the_heaviest(spark, items):
    found = ops.extract(items, FeatureParams(max_terms=30))
    rows = ops.top_terms(found.items, found.term_vocab, 3).filter("id = 7").orderBy("rank").collect()
    _, vectors = expected_terms(items.collect(), 30, 2, 0.8)
    best = sorted(vectors[7].items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]
    assert [(r.rank, r.term) for r in rows] == [(i + 1, t) for i, (t, _) in enumerate(best)]


def test_the_plan_reads_only_what_it_needs(spark, tmp_path, items):
    items.write.parquet(f"{tmp_path}/c")
    stored = spark.read.parquet(f"{tmp_path}/c")
    plan = ops.top_categories(stored, "platform", 5)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<platform:string>" in plan and "IsNotNull(platform)" in plan
    assert "TakeOrderedAndProject" in plan


def test_terms_are_counted_and_weighed_by_number_not_word_by_word(spark):
    rows = [(1, ["b", "a", "b", "a"]), (2, []), (3, None), (4, ["a", "b"]), (5, ["c"]), (6, ["é", "b", "c"])]
    words = spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    counted = ops._word_counts(words)
    assert {tuple(r) for r in counted.collect()} == {("a", 2, 3), ("b", 3, 4), ("c", 2, 2), ("é", 1, 1)}
    frequent = spark.createDataFrame([("a",), ("b",)], "term string")
    pairs = ops._pair_counts(words, frequent)
    assert {tuple(r) for r in pairs.collect()} >= {("b a", 1, 2), ("a b", 2, 2)}
    vocab = spark.createDataFrame([("a b", 3, 2.0), ("b", 5, 1.0), ("é b", 8, 1.5)], "term string, term_id int, idf double")
    vectors = ops.with_text(words, vocab)
    found = {r.id: (r.term_ids, r.tfs) for r in vectors.collect()}
    assert found == {1: ([3, 5], [1, 2]), 2: ([], []), 3: ([], []), 4: ([3, 5], [1, 1]), 5: ([], []), 6: ([5, 8], [1, 1])}
    weights = {r.id: r.weights for r in vectors.collect()}
    assert weights[1] == pytest.approx([2 / math.sqrt(8), 2 / math.sqrt(8)])
    assert {r.id for r in ops.text_vectors(words, vocab).collect()} == {1, 4, 6}
    # Functions on single words inside arrays are interpreted, call by call.
    for frame in (counted, pairs, vectors):
        assert "lambdafunction" not in frame._jdf.queryExecution().executedPlan().toString()
