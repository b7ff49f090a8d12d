"""What the large steps leave on the disk."""

import os

import pytest
from pyspark.sql import functions as F

from akin.config import FeatureParams, Weights
from akin.operators import features as feature_ops
from akin.operators import serve
from akin.operators.neighbours import top_neighbours
from akin.operators.pair_stats import PairScores
from akin.sources.scratch import scratch_root, written

SCHEMA = (
    "id long, genres array<string>, platform_bucket int, type string, language_bucket int, "
    "term_ids array<int>, tfs array<long>, weights array<double>"
)


def tables(spark):
    """Names of the scratch tables that are there now."""
    folder = f"{scratch_root(spark)}/akin/{spark.sparkContext.applicationId}"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def labels(names):
    return {name.rsplit("-", 1)[0] for name in names}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, ["a", "b"][: i % 3], i % 2, "x", 0, [i % 5], [1], [1.0]) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def test_lists_leave_no_copy_of_the_features_behind(spark, items):
    before = tables(spark)
    found = top_neighbours(items, (Weights(),), 5, 0.1, True, "mean")
    assert labels(tables(spark) - before) == {"lists", "copied"}
    # What is left is enough for the rows, more than once.
    assert found.count() == 300 and found.select("item_id").distinct().count() == 60


def test_statistics_pack_the_features_once_and_remove_them(spark, items):
    before = tables(spark)
    scores = PairScores(items)
    statistics = scores.statistics()
    assert labels(tables(spark) - before) == {"counted", "buckets"}
    assert {r.n_pairs for r in statistics.collect()} == {60 * 59 // 2}
    bins = scores.histogram(4).groupBy("component").agg(F.sum("n").alias("n")).collect()
    assert len(bins) == 4 and {r.n for r in bins} == {60 * 59 // 2}


def test_features_read_the_items_once_and_leave_no_words_behind(spark):
    rows = [(i, ["g"], f"p{i % 3}", None, "en", f"word{i % 4} shared thing number{i % 7}") for i in range(30)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    schema = "id long, genres array<string>, platform string, type string, language string, summary_clean string"
    catalog = written(spark.createDataFrame(rows, schema), "catalog").mapInArrow(seen, schema)
    before = tables(spark)
    found = feature_ops.extract(catalog, FeatureParams(max_terms=20))
    assert read.value == len(rows)
    assert labels(tables(spark) - before).isdisjoint({"tokens", "words", "frequent"})
    assert found.items.count() == 30 and found.term_vocab.count() > 5 and found.genre_vocab.count() == 1
    assert found.platform_rank.count() == 3 and found.type_vocab.count() == 0


def test_features_only_travel_for_pairs_of_two_known_items(spark, items):
    pairs = spark.createDataFrame([(1, 2), (1, 99), (77, 2), (3, None), (5, 1), (None, None)], "item_id long, similar_item_id long")
    scored = serve.score_pairs(pairs, items.unionByName(items.filter("id = 2")))
    assert sorted((r.item_id, r.similar_item_id) for r in scored.collect()) == [(1, 2), (1, 2), (5, 1)]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    # The filter on the partners stands below the joins that bring the features in.
    assert "LeftSemi" in plan and plan.rindex("Join Inner") < plan.index("LeftSemi")
