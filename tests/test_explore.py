import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from akin.functions.numeric import nan_to_null
from akin.operators import explore, quality
from akin.operators.ranks import values_at_ranks


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


SAMPLES = {
    "one": [4.0],
    "two": [1.0, 2.0],
    "equal": [7.0] * 50,
    "hot": [3.0] * 300 + [random.Random(1).uniform(-5, 5) for _ in range(200)],
    "wide": [random.Random(2).gauss(0, 1) * 10 ** random.Random(i).randint(-9, 9) for i in range(400)],
    "whole": [random.Random(3).randint(0, 10**9) for _ in range(1)] + list(range(0, 10**9, 1_234_567)),
    "gaps": [None, None, 1, 1e300, -1e300, 2, None],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_exact_quantiles(spark, name):
    values = [v for v in SAMPLES[name] if v is not None]
    wanted = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    found = explore.exact_quantiles(numbers(spark, SAMPLES[name]), "v", wanted)
    assert found == pytest.approx(list(np.quantile(values, wanted)))


def test_ranks_of_long_whole_numbers(spark):
    values = [2**62 + i * i for i in range(300)] + [-(2**60)] * 40
    df = spark.createDataFrame([(v,) for v in values], "v long")
    asked = [0, 39, 40, 41, 200, 339, 340, 10_000]
    assert values_at_ranks(df, "v", asked) == [*(sorted(values)[r] for r in asked[:6]), None, None]


def test_quantiles_of_nothing(spark):
    assert explore.exact_quantiles(numbers(spark, [None]), "v", (0.5,)) == [None]


def test_describe_agrees_with_pandas(spark):
    values = SAMPLES["hot"] + [None] * 9
    found = explore.describe(numbers(spark, values), {"v": F.col("v")}).first()
    expected = pd.Series(values, dtype=float).describe()
    assert list(found)[1:] == pytest.approx(list(expected))


@pytest.mark.parametrize("name", ["one", "equal", "hot", "two"])
def test_histogram_agrees_with_numpy(spark, name):
    found = explore.histogram(numbers(spark, SAMPLES[name] + [None]), F.col("v"), 30).orderBy("bin").collect()
    counts, edges = np.histogram(SAMPLES[name], 30)
    assert [r.n for r in found] == list(counts)
    assert [r.lower for r in found] == pytest.approx(list(edges[:-1]))
    assert [r.upper for r in found] == pytest.approx(list(edges[1:]))


def test_value_and_genre_counts(spark):
    items = spark.createDataFrame(
        [("a", ["x", "y"]), ("b", ["y"]), ("a", []), (None, ["z", "y"])], "c string, genres array<string>"
    )
    found = explore.value_counts(items, "c").orderBy("value").collect()
    assert [(r.value, r.n, r.n_distinct) for r in found] == [("a", 2, 2), ("b", 1, 2)]
    assert found[0].percent == pytest.approx(200 / 3)
    top = explore.value_counts(items, "c", 1).collect()
    assert [(r.value, r.n_distinct) for r in top] == [("a", 2)]
    assert [tuple(r) for r in explore.genre_counts(items, 2).collect()] == [("y", 3), ("x", 1)]


def test_child_coverage(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = [(1, "a"), (1, ""), (1, None), (2, ""), (9, "orphan")]
    found = explore.child_coverage(items, spark.createDataFrame(rows, "pid long, text string"), "id", "pid", "text").first()
    assert (found.n_items, found.n_with_summaries) == (3, 1)
    assert found.mean_season_count == pytest.approx(4 / 3)


def test_nan_becomes_null_only_in_number_columns(spark):
    df = spark.createDataFrame([(float("nan"), "NaN", 1), (2.0, None, 2)], "a double, b string, c long")
    assert [tuple(r) for r in nan_to_null(df).collect()] == [(None, "NaN", 1), (2.0, None, 2)]


CATALOG = "id long, genres array<string>, summary_clean string, rating_avg double, platform string, type string, language string"


def test_availability(spark):
    rows = [(1, ["a"], "x", 1.0, None, "t", "en"), (2, [], "", None, "p", None, "en"), (3, None, None, None, None, None, None)]
    found = {r.feature: (r.available, r.total) for r in quality.availability(spark.createDataFrame(rows, CATALOG)).collect()}
    assert found == {
        "genres": (1, 3), "summary": (1, 3), "rating": (1, 3), "platform": (1, 3), "type": (1, 3), "language": (2, 3)
    }
    empty = quality.availability(spark.createDataFrame([], CATALOG)).collect()
    assert {(r.available, r.total, r.percent) for r in empty} == {(0, 0, 0.0)}


def test_missing_values_lists_only_columns_with_some(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "a long, b string, c string")
    assert {tuple(r) for r in quality.missing_values(df).collect()} == {("b", 2), ("c", 1)}


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 2), (1, 3), (1, 2)], "item_id long, similar_item_id long")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["item_id", "similar_item_id"]).collect()] == [(1, 2, 2)]


def test_broken_rows_are_listed_per_column(spark):
    df = spark.createDataFrame(
        [(1, "n" * 256, "t", None, "w" * 101), (2, None, "t" * 50, "e" * 51, None)],
        "item_id long, name string, type string, language string, network string",
    )
    nulls = quality.null_violations(df, "item_id", ["name", "network"])
    assert sorted(tuple(r) for r in nulls.collect()) == [(2, "name"), (2, "network")]
    too_long = quality.length_violations(df, "item_id")
    assert sorted(tuple(r) for r in too_long.collect()) == [(1, "name"), (1, "network"), (2, "language")]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (None,), (4.0,)], "v double")
    row = explore.describe(df, {"v": F.col("v")}).first()
    assert (row["count"], row["min"], row["max"], row["q50"]) == (3, 1.0, 4.0, 2.0)
    assert row["mean"] == pytest.approx(7 / 3)
    bins = explore.histogram(df, F.col("v"), 3).orderBy("bin").collect()
    assert [r.n for r in bins] == [1, 1, 1] and bins[0].lower == 1.0
