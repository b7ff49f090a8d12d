import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from akin.config import WEIGHT_SCHEMES, Weights
from akin.operators import neighbours as ops
from akin.operators import pairmath, serve
from akin.operators.pair_stats import PairScores

SCHEMA = (
    "id long, genres array<string>, platform_bucket int, type string, language_bucket int, "
    "term_ids array<int>, tfs array<long>, weights array<double>"
)


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        terms = sorted(rng.sample(range(12), rng.randint(0, 4)))
        tfs = [rng.randint(1, 2) for _ in terms]
        norm = math.sqrt(sum(t * t for t in tfs)) or 1.0
        rows.append(
            (i * 3 + 1, sorted(rng.sample(["a", "b", "c", "d"], rng.randint(0, 3))), rng.randint(0, 2),
             rng.choice(["x", "y", None]), rng.randint(0, 1), terms, tfs, [t / norm for t in tfs])
        )
    return rows


def with_copies(rows, share, seed):
    """A third of the rows become copies of the first."""
    rng = random.Random(seed)
    return [(r[0], *rows[0][1:]) if rng.random() < share else r for r in rows]


@pytest.fixture(scope="module")
def rows():
    return with_copies(random_rows(180, 3), 0.35, 4)


@pytest.fixture(scope="module")
def features(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def cosine_parts(a, b, mode):
    shared = len(set(a[1]) & set(b[1]))
    genre = shared / math.sqrt(len(a[1]) * len(b[1])) if shared else 0.0
    weights = dict(zip(b[5], b[7]))
    text = sum(w * weights.get(t, 0.0) for t, w in zip(a[5], a[7]))
    matches = (a[2] == b[2]) + (a[3] == b[3] and a[3] is not None) + (a[4] == b[4])
    if mode == "mean":
        return genre, text, matches / 3
    return genre, text, matches / math.sqrt((2 + (a[3] is not None)) * (2 + (b[3] is not None)))


def expected_lists(rows, weights, n, low, normalise, mode):
    g, t, m = weights.effective(normalise)
    out = {}
    for a in rows:
        scored = []
        for b in rows:
            if a[0] != b[0]:
                parts = cosine_parts(a, b, mode)
                score = round(g * parts[0] + t * parts[1] + m * parts[2], 9)
                if score >= low:
                    scored.append((-score, b[0]))
        out[a[0]] = [(i, -s) for s, i in sorted(scored)[:n]]
    return out


def lists_of(df):
    out = {}
    for r in df.orderBy("item_id", F.desc("similarity_score"), "similar_item_id").collect():
        out.setdefault(r.item_id, []).append((r.similar_item_id, r.similarity_score))
    return out


def same_lists(found, expected):
    assert found.keys() == {k for k, v in expected.items() if v}
    for item, pairs in found.items():
        assert [i for i, _ in pairs] == [i for i, _ in expected[item]]
        assert [s for _, s in pairs] == pytest.approx([s for _, s in expected[item]], abs=2e-9)


@pytest.mark.parametrize("rough_rows", [512, 40])
@pytest.mark.parametrize("blocks", [(256, 4096), (8, 16), (8, 100)])
@pytest.mark.parametrize(
    "weights, n, low, normalise, mode",
    [
        (Weights(), 20, 0.1, False, "mean"),
        (Weights(), 5, 0.5, True, "concat"),
        (Weights(2, 3, 1), 7, 0.0, True, "mean"),
        (Weights(2, 3, 1), 3, 2.5, False, "concat"),
    ],
)
def test_lists_against_brute_force(
    features, rows, monkeypatch, rough_rows, blocks, weights, n, low, normalise, mode
):
    monkeypatch.setattr(pairmath, "ROUGH_ROWS", rough_rows)
    monkeypatch.setattr(ops, "MIN_BLOCK", blocks[0])
    monkeypatch.setattr(ops, "MAX_BLOCK", blocks[1])
    found = ops.top_neighbours(features, (weights,), n, low, normalise, mode)
    same_lists(lists_of(found), expected_lists(rows, weights, n, low, normalise, mode))


@pytest.mark.parametrize("max_block", [4096, 20])
def test_all_schemes_in_one_run(features, rows, monkeypatch, max_block):
    monkeypatch.setattr(ops, "MAX_BLOCK", max_block)
    found = ops.top_neighbours(features, WEIGHT_SCHEMES, 5, 0.0, True, "concat").cache()
    for scheme in WEIGHT_SCHEMES:
        lists = lists_of(found.filter(F.col("scheme") == scheme.name))
        same_lists(lists, expected_lists(rows, scheme, 5, 0.0, True, "concat"))


@pytest.mark.parametrize(
    "component, weights", [("genre", Weights(1, 0, 0)), ("text", Weights(0, 1, 0)), ("metadata", Weights(0, 0, 1))]
)
def test_lists_by_one_component(features, rows, component, weights):
    found = ops.component_neighbours(features, component, 6)
    same_lists(lists_of(found), expected_lists(rows, weights, 6, 0.0, True, "mean"))


def test_the_parts_add_up_and_nothing_is_its_own_neighbour(features):
    rows = ops.top_neighbours(features, (Weights(),), 20, 0.1, False).collect()
    assert all(r.item_id != r.similar_item_id for r in rows)
    for r in rows:
        mixed = 0.4 * r.genre_score + 0.5 * r.text_score + 0.1 * r.metadata_score
        assert r.similarity_score == pytest.approx(mixed, abs=2e-9)
        assert 0.1 <= r.similarity_score <= 1 + 1e-9


def test_partitions_and_input_order_do_not_matter(spark, rows, features):
    first = sorted(ops.top_neighbours(features).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        shuffled = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(2)
        assert sorted(ops.top_neighbours(shuffled).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_threshold_is_inclusive(spark):
    alike = [(i, [], 0, "x", 0, [], [], []) for i in (1, 2)]
    found = ops.top_neighbours(spark.createDataFrame(alike, SCHEMA), (Weights(),), 5, 0.1, False)
    assert sorted((r.item_id, r.similar_item_id) for r in found.collect()) == [(1, 2), (2, 1)]


def test_one_item_and_no_items(spark):
    one = spark.createDataFrame(random_rows(1, 1), SCHEMA)
    assert ops.top_neighbours(one).collect() == []
    assert ops.top_neighbours(one.limit(0)).collect() == []


def test_weights_must_be_positive_together():
    with pytest.raises(ValueError, match="sum of the weights"):
        Weights(0, 0, 0).effective(False)
    assert Weights(2, 3, 1).effective(True) == pytest.approx((1 / 3, 1 / 2, 1 / 6))


def test_blocks_are_bounded_and_enough():
    for n in (0, 1, 300, 10_000, 1_000_000):
        blocks = ops.block_count(n, 8)
        assert n / blocks <= ops.MAX_BLOCK and blocks >= 1
    assert ops.block_count(10_000, 8) * (ops.block_count(10_000, 8) + 1) // 2 >= 16


def test_given_pairs_get_the_same_scores(spark, rows, features):
    rng = random.Random(9)
    pairs = [tuple(rng.sample([r[0] for r in rows], 2)) for _ in range(100)] + [(1, 10_000)]
    frame = spark.createDataFrame(pairs, "item_id long, similar_item_id long")
    by_id = {r[0]: r for r in rows}
    for mode in ("mean", "concat"):
        found = serve.score_pairs(frame, features, Weights(2, 3, 1), True, mode).collect()
        assert len(found) == 100
        for r in found:
            g, t, m = cosine_parts(by_id[r.item_id], by_id[r.similar_item_id], mode)
            assert (r.genre_score, r.text_score, r.metadata_score) == pytest.approx((g, t, m))
            assert r.similarity_score == pytest.approx((2 * g + 3 * t + m) / 6, abs=2e-9)


def upper(rows, mode, weights):
    g, t, m = weights.effective(True)
    out = {"genre": [], "text": [], "metadata": [], "hybrid": []}
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            parts = cosine_parts(a, b, mode)
            for name, s in zip(out, (*parts, g * parts[0] + t * parts[1] + m * parts[2])):
                out[name].append(s)
    return out


@pytest.mark.parametrize("blocks", [(256, 4096), (8, 32)])
@pytest.mark.parametrize("mode", ["mean", "concat"])
def test_statistics_against_numpy(features, rows, monkeypatch, blocks, mode):
    monkeypatch.setattr(ops, "MIN_BLOCK", blocks[0])
    monkeypatch.setattr(ops, "MAX_BLOCK", blocks[1])
    scores = PairScores(features, Weights(), True, mode)
    found = {r.component: r for r in scores.statistics().collect()}
    for name, values in upper(rows, mode, Weights()).items():
        r = found[name]
        assert r.n_pairs == len(rows) * (len(rows) - 1) // 2
        assert (r.mean, r.std, r.min, r.max, r.median) == pytest.approx(
            (np.mean(values), np.std(values), min(values), max(values), np.median(values)), abs=2e-9
        )


def test_histogram_counts_every_pair(features, rows):
    found = PairScores(features, metadata_mode="mean").histogram(10).collect()
    values = upper(rows, "mean", Weights())
    for name in values:
        mine = sorted((r.bin, r.lower, r.upper, r.n) for r in found if r.component == name)
        assert [b for b, _, _, _ in mine] == list(range(10))
        assert sum(n for _, _, _, n in mine) == len(values[name])
        assert mine[0][1] == pytest.approx(min(values[name]), abs=1e-9)
        assert mine[-1][2] == pytest.approx(max(values[name]), abs=1e-9)


def test_the_range_includes_the_diagonal(spark):
    apart = [(1, ["a"], 0, "x", 0, [0], [1], [1.0]), (2, ["b"], 1, "y", 1, [1], [1], [1.0])]
    found = PairScores(spark.createDataFrame(apart, SCHEMA)).score_range().collect()
    assert {(r.component, r.min, r.max) for r in found} == {
        (c, 0.0, 1.0) for c in ("genre", "text", "metadata", "hybrid")
    }


def test_equal_scores_have_no_spread(spark):
    alike = [(i, ["a"], 0, "x", 0, [0], [1], [1.0]) for i in range(5)]
    found = PairScores(spark.createDataFrame(alike, SCHEMA)).statistics().collect()
    assert {(r.component, r.mean, r.std, r.median) for r in found} == {
        (c, 1.0, 0.0, 1.0) for c in ("genre", "text", "metadata", "hybrid")
    }


def test_asked_items_get_their_lists_out_of_all_items(spark):
    rows = [
        (i, sorted({f"g{i % 3}", f"g{i % 7}"}), i % 4, None if i % 5 == 0 else "t", i % 2, [i % 11, 11 + i % 6], [1, 1], [0.6, 0.8])
        for i in range(900)
    ]
    # Copies, also of asked items, and an item like no other.
    rows += [(1000 + i, *rows[4][1:]) for i in range(40)] + [(2000, [], 9, None, 9, [], [], [])]
    features = spark.createDataFrame(
        rows,
        "id long, genres array<string>, platform_bucket int, type string, language_bucket int, "
        "term_ids array<int>, tfs array<long>, weights array<double>",
    ).withColumn("type_id", F.lit(0))
    weights = Weights(0.3, 0.5, 0.2)
    whole = ops.top_neighbours(features, (weights,), 6, 0.2, True, "mean").drop("scheme")
    asked = spark.createDataFrame([(i,) for i in (4, 4, 5, 77, 1003, 2000, 99999, None)], "item_id long")
    counter = spark.sparkContext.accumulator(0)
    some = ops.neighbours_of(features, asked, weights, 6, 0.2, True, "mean", counter)
    got = sorted(tuple(r) for r in some.collect())
    assert got == sorted(tuple(r) for r in whole.filter("item_id in (4, 5, 77, 1003, 2000)").collect())
    assert {r[0] for r in got} >= {4, 5, 77, 1003}
    profiles = features.drop("id").distinct().count()
    asked_profiles = features.filter("id in (4, 5, 77, 1003, 2000)").drop("id").distinct().count()
    assert counter.value == asked_profiles * profiles
    none = ops.neighbours_of(features, asked.limit(0), weights, 6, 0.2, True, "mean")
    assert none.count() == 0


def test_schemes_share_their_products_and_agree_with_one_by_one(spark, features, monkeypatch):
    monkeypatch.setattr(ops, "MIN_BLOCK", 16)
    monkeypatch.setattr(ops, "MAX_BLOCK", 64)
    schemes = (Weights(0.5, 0.3, 0.2, "a"), Weights(0.1, 0.8, 0.1, "b"), Weights(0, 1, 0, "c"))
    together = ops.top_neighbours(features, schemes, 5, 0.1, True, "mean").collect()
    alone = [r for w in schemes for r in ops.top_neighbours(features, (w,), 5, 0.1, True, "mean").collect()]
    assert sorted(map(tuple, together)) == sorted(map(tuple, alone)) and {r.scheme for r in together} == {"a", "b", "c"}


def test_one_product_per_component_whatever_the_number_of_schemes():
    class Part(np.ndarray):
        products = 0

        def __matmul__(self, other):
            Part.products += 1
            return np.asarray(self) @ np.asarray(other)

    class Side:
        def __init__(self, seed):
            rng = np.random.default_rng(seed)
            self.three = tuple(rng.random((6, 4)).view(Part) for _ in range(3))

        def parts(self, mode):
            return self.three

    a, b = Side(1), Side(2)
    schemes = [(0.5, 0.3, 0.2), (0.2, 0.2, 0.6), (1.0, 0.0, 0.0), (0.1, 0.8, 0.1)]
    rough_of, width = pairmath.rough_scores(a, b, schemes, "mean")
    found = list(rough_of(slice(1, 4)))
    assert Part.products == 3 and width == 12
    for weights, rough in zip(schemes, found, strict=True):
        exact = sum(w * (np.asarray(x)[1:4] @ np.asarray(y).T) for w, x, y in zip(weights, a.three, b.three))
        assert np.allclose(rough, exact, atol=1e-5)


def test_counts_of_pairs_are_exact_beyond_doubles():
    n = np.array([(1 << 57) + 1, 3, (1 << 57) + 5, 1], dtype=np.int64)
    assert pairmath.counted(np.array([1, 0, 1, 1]), n, 3).tolist() == [3, (1 << 58) + 7, 0]


def test_a_task_gives_one_list_a_row_however_many_blocks_it_reads(features, monkeypatch):
    monkeypatch.setattr(ops, "MIN_BLOCK", 8)
    monkeypatch.setattr(ops, "MAX_BLOCK", 32)
    profiles = ops.distinct_profiles(ops.with_profile(features), 6)
    columns, n = ["rep", "copies", "heads", *ops.PAYLOAD], profiles.count()
    blocks, n_blocks = ops.packed_blocks(profiles, columns, n)
    rows = blocks.collect()
    # Each profile is written once, not once per pair of blocks.
    assert n_blocks > 4 and sum(pa.ipc.open_stream(r.data).read_all().num_rows for r in rows) == n
    one = rows[0]
    batch = pa.RecordBatch.from_pylist([{"lo": one.block, "a": bytes(one.data), "hi": r.block, "b": bytes(r.data)} for r in rows])
    found = pa.concat_tables(pairmath.best_of_stream(pairmath.unpacked([batch]), [(0.4, 0.4, 0.2)], 5, 0.0, "mean"))
    lengths = Counter(rep for rep, other in zip(found["rep"].to_pylist(), found["other"].to_pylist()) if rep != other)
    assert set(lengths.values()) == {5} and found.num_rows <= 6 * len(lengths)


def test_pairs_of_blocks_come_once_each(features, monkeypatch):
    monkeypatch.setattr(ops, "MIN_BLOCK", 8)
    profiles = ops.distinct_profiles(ops.with_profile(features), 1)
    columns, n = ["rep", "copies", *ops.PAYLOAD], profiles.count()
    every, once = (
        [(r.lo, r.hi) for r in ops.block_pairs(profiles, columns, n, once).select("lo", "hi").collect()] for once in (False, True)
    )
    assert len(set(every)) == len(every) and {(lo, lo) for lo, _ in every} < set(once)
    assert Counter(map(frozenset, once)) == Counter(set(map(frozenset, every)))


def test_windows_beyond_one_round_leave_no_more_rows(features, monkeypatch):
    def lists():
        return sorted(map(tuple, ops.top_neighbours(features, (Weights(),), 3, 0.0).collect()))

    def statistics():
        return sorted(map(tuple, PairScores(features).statistics().select("component", "n_pairs", "min", "max", "median").collect()))

    whole, counted = lists(), statistics()
    monkeypatch.setattr(ops, "MIN_BLOCK", 8)
    monkeypatch.setattr(ops, "MAX_BLOCK", 16)
    monkeypatch.setattr(ops, "WINDOW_BYTES", 3000)
    merged, seen = ops._merged, []

    def counting(found, n):
        seen.append((found.count(), found.select("rep").distinct().count()))
        return merged(found, n)

    monkeypatch.setattr(ops, "_merged", counting)
    assert lists() == whole
    (n_rows, n_reps), = seen
    # The best so far and those of one round of at most two windows, whatever the number of rounds.
    assert n_reps > 50 and n_rows <= 3 * 4 * n_reps
    assert statistics() == counted


def test_pairs_that_cannot_be_listed_are_not_multiplied(monkeypatch):
    """Two kinds of rows that share nothing: their blocks meet, but hardly a row of one is multiplied with the other."""
    rng, made = np.random.default_rng(5), []
    for i in range(600):
        kind, other = divmod(i, 300)[0], int(rng.integers(0, 3))
        weights = rng.random(4) + 0.2
        # The last rows share a term with the other kind.
        terms = [6 * kind + t for t in (0, 1, 2, 3)] if i % 300 < 290 else [0, 1, 6, 7]
        made.append((i, kind, [f"g{kind}"], other, "xyz"[other], kind, terms, list(weights / np.linalg.norm(weights))))
    blocks = [
        pa.table(
            {
                "rep": [r[0] for r in rows], "copies": [1] * len(rows), "heads": [[r[0]] for r in rows],
                "genres": [r[2] for r in rows], "platform_bucket": pa.array([r[3] for r in rows], pa.int32()),
                "type": [r[4] for r in rows], "language_bucket": pa.array([r[5] for r in rows], pa.int32()),
                "term_ids": pa.array([r[6] for r in rows], pa.list_(pa.int32())), "weights": [r[7] for r in rows],
                "block": pa.array([number] * len(rows), pa.int32()),
            }
        )
        for number, rows in ((k, [r for r in made if r[1] == k]) for k in (0, 1))
    ]
    rough_scores, multiplied = pairmath.rough_scores, []

    def counting(*given):
        rough_of, width = rough_scores(*given)

        def counted(*at):
            for rough in rough_of(*at):
                multiplied.append(rough.size)
                yield rough

        return counted, width

    monkeypatch.setattr(pairmath, "rough_scores", counting)
    # The other block comes first for one of them, and the block itself does not come at all for the other.
    pairs = [(0, 1, pa.concat_tables(blocks)), (0, 0, blocks[0]), (1, 0, pa.concat_tables(blocks[::-1]))]
    mix = (0.4, 0.5, 0.1)
    found = pa.concat_tables(pairmath.best_of_stream(iter(pairs), [mix], 5, 0.0, "mean")).to_pylist()
    # Each block with itself, and little of the other two squares.
    assert 2 * 300**2 <= sum(multiplied) < 2.5 * 300**2
    as_rows = {r[0]: (r[0], r[2], r[3], r[4], r[5], r[6], None, r[7]) for r in made}
    for rep in (0, 7, 150, 295, 299):
        scored = []
        for other in as_rows:
            if other != rep:
                parts = cosine_parts(as_rows[rep], as_rows[other], "mean")
                scored.append((-round(sum(w * p for w, p in zip(mix, parts)), 9), other))
        best = sorted((-f["score"], f["other"]) for f in found if f["rep"] == rep)
        assert [o for _, o in best] == [o for _, o in sorted(scored)[:5]]
    assert not [f for f in found if f["rep"] >= 300 and f["other"] >= 300]


@pytest.mark.parametrize("mode", ["mean", "concat"])
def test_the_range_of_pairs_needs_few_products(features, rows, monkeypatch, mode):
    monkeypatch.setattr(ops, "MIN_BLOCK", 8)
    monkeypatch.setattr(ops, "MAX_BLOCK", 32)
    found = {r.component: (r.low, r.high) for r in PairScores(features, metadata_mode=mode)._ranges({}).collect()}
    for name, values in upper(rows, mode, Weights()).items():
        assert found[name] == pytest.approx((min(values), max(values)), abs=2e-9)
    # In one task: what cannot go beyond the range found so far is not multiplied.
    profiles = ops.counted_profiles(ops.with_profile(features))
    blocks, n_blocks = ops.packed_blocks(profiles, ["rep", "copies", *ops.PAYLOAD], profiles.count())
    packed = {r.block: bytes(r.data) for r in blocks.collect()}
    sizes = {k: pa.ipc.open_stream(v).read_all().num_rows for k, v in packed.items()}
    pairs = [(lo, hi) for lo in packed for hi in packed if lo <= hi]
    batch = pa.RecordBatch.from_pylist([{"lo": lo, "a": packed[lo], "hi": hi, "b": packed[hi]} for lo, hi in pairs])
    scored, seen = pairmath.text_and_hybrid, []

    def counting(*given):
        for name, units in scored(*given):
            seen.append(units.size)
            yield name, units

    monkeypatch.setattr(pairmath, "text_and_hybrid", counting)
    known = {name: (math.inf, -math.inf) for name in pairmath.NAMES}
    alone = pa.concat_tables(pairmath.ranges(pairmath.unpacked([batch]), Weights().effective(True), mode, known))
    assert {r["component"]: (r["low"], r["high"]) for r in alone.to_pylist()} == found
    assert n_blocks > 3 and sum(seen) < sum(sizes[lo] * sizes[hi] for lo, hi in pairs)


def test_genres_and_metadata_are_scored_once_per_kind(monkeypatch):
    """300 rows of two kinds, some with copies: counts of pairs as if each pair had been scored."""
    rng = np.random.default_rng(3)
    rows = [(i, [["a"], ["a", "b"]][i % 2], i % 2, "t", 0, [int(rng.integers(0, 9))], None, [1.0]) for i in range(300)]
    copies = [1 + (i % 10 == 0) for i in range(300)]
    table = pa.table(
        {
            "rep": [r[0] for r in rows], "copies": copies, "genres": [r[1] for r in rows],
            "platform_bucket": pa.array([r[2] for r in rows], pa.int32()), "type": [r[3] for r in rows],
            "language_bucket": pa.array([r[4] for r in rows], pa.int32()),
            "term_ids": pa.array([r[5] for r in rows], pa.list_(pa.int32())), "weights": [r[7] for r in rows],
            "block": pa.array([int(i >= 200) for i in range(300)], pa.int32()),
        }
    )
    one, two = (table.filter(pa.array([b == k for b in table["block"].to_pylist()])) for k in (0, 1))
    mix, edges = Weights().effective(True), {name: (0.0, 1.0) for name in pairmath.NAMES}
    given = [(0, 0, one), (0, 1, pa.concat_tables([one, two])), (1, 1, two)]
    scored = {name: 0 for name in pairmath.NAMES}
    for name, units, *_ in pairmath.scored_rows(given, mix, "mean"):
        scored[name] += len(units)
    assert scored["text"] == 200 * 200 + 200 * 100 + 100 * 100 and scored["genre"] == scored["metadata"] == 3 * 2 * 2
    every = [r for r, n in zip(rows, copies) for _ in range(n)]
    expected = {n: np.bincount(np.clip((np.rint(np.array(v) * 1e9) / 1e9 * 20).astype(int), 0, 19), minlength=20).tolist() for n, v in upper(every, "mean", Weights()).items()}
    (found,) = pairmath.binned(given, mix, "mean", edges, 20)
    for name in pairmath.NAMES:
        assert [r["n"] for r in found.to_pylist() if r["component"] == name] == expected[name]
