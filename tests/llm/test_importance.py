"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from akin.llm import importance
from akin.llm.importance import ResampleParams

SCHEMA = "doc_id long, text string, score string, w string, place string, rank string"
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text, params):
    w = words(text)
    runs = [" ".join(w[i : i + n]) for n in range(1, params.runs + 1) for i in range(len(w) - n + 1)]
    return Counter(zlib.crc32(r.encode()) % params.buckets for r in runs)


def brute(docs, target, params):
    s, t = Counter(), Counter()
    for _, text in docs:
        s += buckets(text, params)
    for text in target:
        t += buckets(text, params)
    all_s, all_t = sum(s.values()) + params.buckets, sum(t.values()) + params.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows, able = [], []
    for doc, text in docs:
        found = buckets(text, params)
        n = sum(found.values())
        weight = sum(gain(b) * c for b, c in found.items()) // n if n else 0
        label = f"{params.seed}:{'' if doc is None else doc}"
        h = int(hashlib.sha256(label.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        row = (doc, n, weight, score)
        if len(words(text)) >= params.min_words:
            able.append(row)
        else:
            rows.append((*row, None))
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = params.percent * len(able) // 100
    return Counter([*rows, *((*r, i + 1 if i < drawn else None) for i, r in enumerate(able))])


def documents():
    rng = random.Random(3)
    vocabulary = ["Wort", "été", "x1", "the", "A", "ſtraße", "9", "end", "Ünder", "many"]
    out = []
    for i in range(120):
        text = rng.choice([" ", "-", "\n", "\t_"]).join(rng.choices(vocabulary, k=rng.randint(0, 40)))
        out.append((rng.choice([i, i - 50, i * 10**15]), text))
    out += [(500, None), (501, ""), (502, "!? ,"), (503, "word " * 3000), (None, "the end " * 30), (-(2**62), "a b " * 20)]
    return [*out, out[4], out[4], (out[5][0], out[6][1])]


@pytest.mark.parametrize(
    "params",
    [
        ResampleParams(),
        ResampleParams(buckets=7, runs=3, percent=60, min_words=2, digit_bits=3, part_rows=9),
        ResampleParams(buckets=50, runs=1, percent=100, min_words=0),
    ],
)
def test_same_as_plain_python(spark, params):
    docs, target = documents(), ["the end of many words", None, "été été A", ""]
    table = spark.createDataFrame([(d, t, "s", "w", "p", "r") for d, t in docs], SCHEMA).repartition(4)
    other = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resampled(table, other, params)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in out.collect()) == brute(docs, target, params)


def test_words_over_block_borders(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    params = ResampleParams(runs=3)
    whole = buckets(text, params)
    for block in (1, 5, 64):
        monkeypatch.setattr(importance, "_BLOCK", block)
        parts = list(importance.feature_blocks(text, params))
        assert sum(n for n, _ in parts) == 500
        assert Counter(int(b) for _, found in parts for b in found) == whole


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert importance.resampled(none, none).count() == 0
    got = importance.resampled(some, none.select("text"))
    assert {r["doc_id"]: (r["n_features"], r["rank"]) for r in got.collect()} == {1: (3, None), 2: (0, None)}


def test_ids_over_the_whole_range_of_longs(spark):
    ids = [-(2**63), -1, 0, 5, 2**63 - 1, None]
    rows = spark.createDataFrame([(i, 0) for i in ids], "doc_id long, score long")
    params = ResampleParams(min_words=0, percent=100)
    docs = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    got = importance.resampled(docs, docs.select("text"), params).collect()
    order = sorted(got, key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["rank"] for r in order] == [1, 2, 3, 4, 5, 6]
    placed = importance.radix_sorted(rows, [(F.lit(3) - F.col("score"), 3)], params, "place").collect()
    assert sorted(r["place"] for r in placed) == list(range(6))
