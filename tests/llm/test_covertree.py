"""Hard negatives against brute force, in one tree and in many small balls."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from akin.llm import covertree
from akin.llm.covertree import MineParams

SCHEMA = "id long, v array<float>, label int, q string, ball string, n string"


def brute(rows, k=5, percent=80, scale=256):
    used = []
    for i, v, label in {(r[0], None if r[1] is None else tuple(r[1]), r[2]) for r in rows}:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [math.floor(scale * float(np.float32(x))) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, q, label in used:
        if i % 10:
            continue
        others = [(dot(q, c), j, lab) for j, c, lab in used if j != i]
        positives = sorted((-s, j) for s, j, lab in others if lab == label)[:k]
        for minus, j in positives:
            p = -minus
            fits = [(-s, n) for s, n, lab in others if lab != label and percent * p <= 100 * s <= 100 * p]
            out += [(i, j, r + 1, n, p, -s) for r, (s, n) in enumerate(sorted(fits)[:k])]
    return sorted(out)


def rows():
    rng = random.Random(5)
    out = []
    for i in range(400):
        around = rng.choice([(1, 0, 0, 0), (0.6, 0.6, 0, 0), (-1, 0.3, 0, 0.5), (0, 0, 0, 0)])
        v = [c + rng.gauss(0, 0.2) for c in around] if i % 3 else [round(c, 1) for c in around]
        out.append((i, v, rng.randint(0, 3)))
    out += [(1000, None, 1), (1010, [float("nan"), 0, 0, 0], 1), (1020, [1.0, None, 0, 0], 1), (1030, [1.0, 0, 0, 0], None)]
    out += [(1040, [float("inf"), 0, 0, 0], 1), (None, [1.0, 0, 0, 0], 1), (1050, [], 2), (1060, [0.5], 1), (-20, [1.0, 0.5, 0, 0], 1)]
    out = [(i, v if v is None else [None if x is None else float(x) for x in v], label) for i, v, label in out]
    return [*out, out[10], out[10], out[20]]


@pytest.mark.parametrize(
    "params",
    [
        MineParams(),
        MineParams(shard_rows=40, leaf=4, fanout=3, chunk=7),
        MineParams(shard_rows=20, max_balls=3, leaf=1, fanout=2, sample=50),
    ],
)
def test_same_as_brute_force(spark, params):
    data = rows()
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in data], SCHEMA).repartition(3)
    got = covertree.mined(table, F.col("id") % 10 == 0, params)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_large_components_stay_exact(spark):
    big = 3.0e6
    data = [(i, [big + i * 0.25, float(i % 3)], i % 2) for i in range(40)]
    table = spark.createDataFrame(data, "id long, v array<double>, label int")
    got = covertree.mined(table, F.col("id") % 10 == 0)
    assert len(brute([(i, v, lab) for i, v, lab in data])) > 0
    exact = {}
    for i, v, lab in data:
        exact[i] = [math.floor(256 * x) for x in v]
    for r in got.collect():
        assert r["negative_score"] == sum(a * b for a, b in zip(exact[r["anchor_id"]], exact[r["negative_id"]]))


def test_nothing_to_mine(spark):
    none = spark.createDataFrame([], "id long, v array<float>, label int")
    assert covertree.mined(none, F.col("id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 1)], "id long, v array<float>, label int")
    assert covertree.mined(one, F.col("id") % 10 == 0).count() == 0


def test_nodes_hold_what_they_cover_and_far_balls_are_skipped():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 2000
    rows = np.rint(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 8)) * 20)
    space = covertree.Space(8, float((rows**2).sum(axis=1).max()) + 1)
    params = MineParams(leaf=16)
    tree = covertree.CoverTree(space, rows, np.zeros(1000, dtype=int), [np.array([i]) for i in range(1000)], params)
    assert sorted(int(i[0]) for i in tree.ids) == list(range(1000))
    points = space.augmented(tree.rows)
    spans = {}
    for node in reversed(range(len(tree.links))):
        first, n, start, stop = tree.links[node]
        inside = list(range(start, stop)) if not n else [x for c in range(first, first + n) for x in spans[c]]
        spans[node] = inside
        centre = space.augmented(tree.centres[[node]])
        assert np.linalg.norm(points[inside] - centre, axis=1).max() <= tree.radii[node]
    assert spans[0] and sorted(spans[0]) == list(range(1000))
    scored = []
    plain = covertree.scores
    covertree.scores = lambda q, x: scored.append(len(q) * len(x)) or plain(q, x)
    try:
        import pandas as pd

        frame = pd.DataFrame({"a": [1], "q": [rows[7].astype(int).tolist()], "label": [0], "id": [7]})
        frame = frame.assign(lo=covertree.LOW, hi=covertree.HIGH, known=covertree.LOW)
        ask = covertree.Windows(space, frame, 5)
        tree.search(ask, 5, True)
    finally:
        covertree.scores = plain
    want = sorted(((-int(plain(rows[[7]], rows[[i]])[0, 0]), i) for i in range(1000) if i != 7))[:5]
    assert [(-s, i) for s, i in zip(ask.score[0], ask.found[0])] == want
    assert sum(scored) < 300
