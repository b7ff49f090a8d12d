"""Item tables: changes by bucket, keys, counts, and files that are left alone."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from akin.sources import store as tables

SCHEMA = "item_id long, similar_item_id long, similarity_score double"


@pytest.fixture()
def store(spark, tmp_path):
    return tables.TableStore(spark, str(tmp_path))


@pytest.fixture()
def rows(spark):
    def make(*found, day=1):
        stamp = F.lit(f"2025-03-{day:02d} 10:00:00").cast("timestamp")
        return tables.as_similarities(spark.createDataFrame(list(found), SCHEMA), stamp)

    return make


@pytest.fixture()
def ids(spark):
    return lambda *found: spark.createDataFrame([(i,) for i in found], "item_id long")


def pairs(df):
    return sorted((r.item_id, r.similar_item_id, r.computed_at.day) for r in df.collect())


def files(store):
    """Path and time of change of every data file of the current version."""
    root = store.path(tables.SIMILARITIES, store.versions(tables.SIMILARITIES)[-1])
    found = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]
    return {f: os.stat(f).st_mtime_ns for f in found}


def bucket_of(path):
    return os.path.basename(os.path.dirname(path))


def full(rows):
    return rows(*[(i, j, 0.5) for i in range(40) for j in (100, 101)])


def test_a_write_says_what_it_wrote(store, rows):
    found = tables.similarity_table(store, buckets=8).write(full(rows))
    assert (found.rows, found.items, found.last) == (80, 40, datetime.datetime(2025, 3, 1, 10))
    stats = tables.written_stats(store, found, 2, 0.1).first()
    again = tables.run_stats(store.read(tables.SIMILARITIES), 2, 0.1).first()
    assert stats == again
    nothing = tables.similarity_table(store).write(rows((1, 2, 0.5)).limit(0))
    assert (nothing.rows, nothing.items, nothing.last) == (0, 0, None)
    assert store.read(tables.SIMILARITIES).count() == 0


def test_replacing_touches_the_buckets_of_its_items_only(store, rows, ids):
    table = tables.similarity_table(store, buckets=8)
    table.write(full(rows))
    before = files(store)
    asked = ids(3, 4, 3, 77)
    counts = table.replace(rows((3, 200, 0.9), (3, 201, 0.8), (3, 202, 0.7), (5, 9, 0.1), day=2), asked)
    assert sorted(tuple(r) for r in counts.collect()) == [(3, 2, 3), (4, 2, 0), (77, 0, 0)]
    got = pairs(table.read())
    assert [p for p in got if p[0] in (3, 4, 5, 77)] == [(3, 200, 2), (3, 201, 2), (3, 202, 2), (5, 100, 1), (5, 101, 1)]
    assert len(got) == 80 - 4 + 3
    touched = {f"bucket_of_8={b}" for b in table._touched(asked)}
    after = files(store)
    assert touched and len(touched) <= 3
    for path, when in before.items():
        if bucket_of(path) not in touched:
            assert after[path] == when
        else:
            assert path not in after


def test_deleting_counts_and_empties_buckets(store, rows, ids):
    table = tables.similarity_table(store, buckets=4)
    table.write(rows((1, 2, 0.5), (1, 3, 0.4), (2, 1, 0.5)))
    gone = table.delete(ids(1, 9))
    assert sorted(tuple(r) for r in gone.collect()) == [(1, 2, True), (9, 0, False)]
    assert pairs(table.read()) == [(2, 1, 1)]
    table.delete(ids(2))
    assert table.read().count() == 0 and not files(store)
    # A table that lost all rows can be filled again.
    table.append(rows((5, 6, 0.5)))
    assert pairs(table.read()) == [(5, 6, 1)]


def test_upserting_metadata_bumps_the_stamp(spark, store):
    def about(day, *found):
        stamp = F.lit(f"2025-03-{day:02d} 00:00:00").cast("timestamp").alias("synced_at")
        base = spark.createDataFrame(list(found), "item_id long, name string")
        none = {"genres": "array<string>", "summary": "string", "rating": "double", "type": "string", "language": "string", "network": "string"}
        return base.select("item_id", "name", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), stamp)

    table = tables.metadata_table(store, buckets=4)
    table.write(about(1, (1, "a"), (2, "b")))
    counts = table.upsert(about(9, (2, "B"), (3, "c")))
    assert sorted(tuple(r) for r in counts.collect()) == [(2, 1, 1), (3, 0, 1)]
    got = sorted((r.item_id, r.name, r.synced_at.day) for r in table.read().collect())
    assert got == [(1, "a", 1), (2, "B", 9), (3, "c", 9)]
    with pytest.raises(ValueError, match="1 rows with double keys"):
        table.upsert(about(9, (5, "x"), (5, "y")))
    assert table.read().count() == 3


def test_appending_copies_nothing_and_refuses_known_keys(store, rows):
    table = tables.similarity_table(store, buckets=4)
    table.write(full(rows))
    before = files(store)
    assert table.append(rows((3, 300, 0.1), (50, 1, 0.2), day=3)).rows == 2
    after = files(store)
    assert all(after[path] == when for path, when in before.items())
    assert (3, 300, 3) in pairs(table.read()) and table.read().count() == 82
    with pytest.raises(ValueError, match="already has the key"):
        table.append(rows((60, 1, 0.2), (3, 100, 0.9)))
    assert table.read().count() == 82


@pytest.mark.parametrize("bad", [[(1, 2, 0.5), (1, 2, 0.4)], [(1, None, 0.5)], [(None, 1, 0.5)]])
def test_bad_keys_fail_and_change_nothing(spark, store, bad):
    table = tables.similarity_table(store, buckets=4)
    when = F.lit("2025-03-01 10:00:00").cast("timestamp")
    good = tables.as_similarities(spark.createDataFrame([(7, 8, 0.5)], SCHEMA), when)
    table.write(good)
    wrong = tables.as_similarities(spark.createDataFrame(bad, SCHEMA), when)
    items = spark.createDataFrame([(1,), (7,)], "item_id long")
    with pytest.raises(ValueError, match="keys"):
        table.write(wrong)
    with pytest.raises(ValueError, match="keys"):
        table.append(wrong)
    if bad[0][0] is not None:
        with pytest.raises(ValueError, match="keys"):
            table.replace(wrong, items)
    assert pairs(table.read()) == [(7, 8, 1)]


def test_reading_some_items_reads_their_buckets(store, rows, ids):
    table = tables.similarity_table(store, buckets=16)
    table.write(full(rows))
    some = table.of_items(ids(3, 99))
    assert pairs(some) == [(3, 100, 1), (3, 101, 1)]
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket_of_16" in plan
