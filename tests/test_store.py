import datetime

import pytest
from pyspark.sql import functions as F

from akin.config import Weights
from akin.operators import features as feature_ops
from akin.sources import store as tables

def when():
    return F.lit("2025-03-01 10:00:00").cast("timestamp")


@pytest.fixture()
def store(spark, tmp_path):
    return tables.TableStore(spark, str(tmp_path))


@pytest.fixture()
def similar(spark):
    def make(*rows):
        return spark.createDataFrame(
            [tuple(r) for r in rows], "item_id long, similar_item_id long, similarity_score double"
        )

    return make


def pairs(df):
    return sorted((r.item_id, r.similar_item_id) for r in df.collect())


def test_a_write_adds_a_version_and_reads_the_last(store, similar):
    assert not store.exists("t")
    store.write("t", similar((1, 2, 0.5)))
    store.write("t", store.read("t").union(similar((1, 3, 0.4))))
    assert store.versions("t") == [1, 2]
    assert pairs(store.read("t")) == [(1, 2), (1, 3)]


def test_an_unfinished_version_is_not_read(store, similar, tmp_path):
    store.write("t", similar((1, 2, 0.5)))
    (tmp_path / "t" / "v00000002").mkdir()
    (tmp_path / "t" / "notes").mkdir()
    assert store.versions("t") == [1] and pairs(store.read("t")) == [(1, 2)]
    store.write("t", similar((3, 4, 0.5)))
    assert store.versions("t") == [1, 3] and pairs(store.read("t")) == [(3, 4)]


def test_reading_a_missing_table(store):
    with pytest.raises(FileNotFoundError, match="no table t"):
        store.read("t")


def test_store_replaces_or_appends(store, similar):
    tables.store_similarities(store, similar((1, 2, 0.5), (2, 1, 0.5)), computed_at=when())
    assert pairs(store.read(tables.SIMILARITIES)) == [(1, 2), (2, 1)]
    tables.store_similarities(store, similar((3, 1, 0.9)), clear_existing=False, computed_at=when())
    assert pairs(store.read(tables.SIMILARITIES)) == [(1, 2), (2, 1), (3, 1)]
    tables.store_similarities(store, similar((4, 1, 0.2)), computed_at=when())
    rows = store.read(tables.SIMILARITIES).collect()
    assert [(r.item_id, r.genre_score, r.computed_at) for r in rows] == [
        (4, None, datetime.datetime(2025, 3, 1, 10))
    ]


def test_the_stamp_defaults_to_now(similar):
    stamp = tables.as_similarities(similar((1, 2, 0.5))).first().computed_at
    assert abs((datetime.datetime.now() - stamp).total_seconds()) < 86_400 * 2


def test_rows_of_an_item_sit_together_best_first(store, similar):
    rows = [(i, j, ((i * 7 + j * 3) % 10) / 10) for i in range(50) for j in range(50, 60)]
    tables.store_similarities(store, similar(*rows), computed_at=when())
    stored = store.read(tables.SIMILARITIES).withColumn("file", F.input_file_name())
    assert stored.groupBy("item_id").agg(F.countDistinct("file").alias("n")).filter("n > 1").count() == 0
    in_order = [(r.item_id, -r.similarity_score, r.similar_item_id) for r in stored.collect() if r.item_id == 7]
    assert in_order == sorted(in_order)


def test_replace_one_items_neighbours(similar):
    old = similar((1, 2, 0.5), (1, 3, 0.4), (2, 1, 0.5), (3, 1, 0.1))
    new = similar((1, 9, 0.9), (7, 1, 0.9))
    found = tables.replaced_neighbours(old, new, similar((1, 0, 0.0), (3, 0, 0.0)))
    assert pairs(found) == [(1, 9), (2, 1)]


def test_delete_counts_and_leaves_the_rest(similar):
    old = similar((1, 2, 0.5), (1, 3, 0.4), (2, 1, 0.5))
    gone = similar((1, 0, 0.0), (8, 0, 0.0))
    assert pairs(tables.deleted(old, gone)) == [(2, 1)]
    counts = tables.deletion_counts(old, gone).orderBy("item_id").collect()
    assert [tuple(r) for r in counts] == [(1, 2, True), (8, 0, False)]


def test_upsert_updates_and_inserts(spark):
    schema = "item_id long, name string"
    old = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    new = spark.createDataFrame([(2, "B"), (3, "c")], schema)
    assert sorted(tuple(r) for r in tables.upserted(old, new).collect()) == [(1, "a"), (2, "B"), (3, "c")]


def test_stats(similar):
    found = tables.store_stats(tables.as_similarities(similar((1, 2, 0.5), (1, 3, 0.5), (2, 1, 0.5)), when())).first()
    assert tuple(found) == (3, 2, 1.5, datetime.datetime(2025, 3, 1, 10))
    empty = tables.store_stats(tables.as_similarities(similar((1, 2, 0.5)).limit(0), when())).first()
    assert tuple(empty) == (0, 0, 0.0, None)


def test_system_and_run_stats(similar, spark):
    rows = tables.as_similarities(similar((1, 2, 0.5), (2, 1, 0.5)), when())
    about = spark.createDataFrame([(1,), (2,), (3,)], "item_id long")
    system = tables.system_stats(rows, about, Weights()).first()
    assert (system.total_records, system.cached_items, system.text_weight) == (2, 3, 0.5)
    run = tables.run_stats(rows, 20, 0.1).first()
    assert (run.computed_items, run.top_n_per_item, run.min_similarity) == (2, 20, 0.1)


def test_counts_and_sources(similar):
    rows = similar((1, 2, 0.5), (1, 3, 0.5), (2, 1, 0.5))
    assert sorted(tuple(r) for r in tables.neighbour_counts(rows).collect()) == [(1, 2), (2, 1)]
    assert sorted(r.item_id for r in tables.distinct_sources(rows).collect()) == [1, 2]


def test_all_feature_tables_are_needed(spark, store):
    items = spark.createDataFrame(
        [(1, ["a"], "red blue red blue", "x", "en", "p"), (2, [], "red blue", None, None, None),
         (3, ["b"], "green", "x", "en", "p")],
        "id long, genres array<string>, summary_clean string, type string, language string, platform string",
    )
    found = feature_ops.extract(items)
    with pytest.raises(FileNotFoundError, match="missing feature tables: items, genre_vocab"):
        tables.load_features(store)
    tables.save_features(store, found)
    loaded = tables.load_features(store)
    for name, df in found.tables().items():
        assert sorted(loaded.tables()[name].collect(), key=str) == sorted(df.collect(), key=str)
