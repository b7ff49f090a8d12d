"""Removal of repeated passages against a brute-force list of all strings."""

import random
from collections import Counter

import numpy as np
import pytest

from akin.llm import repeats
from akin.llm.repeats import RepeatParams

SCHEMA = "doc_id long, text string, tag string, key string, kept string, h long"


def brute(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; null ids last, one id is one document."""
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - length + 1):
            at = (doc is None, doc or 0, s)
            first[raw[s : s + length]] = min(first.get(raw[s : s + length], at), at)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < (doc is None, doc or 0, s):
                gone[s : s + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        n_spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(raw), int(gone.sum()), n_spans, kept))
    return Counter(out)


def texts():
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    line, passage = word(30), word(90)
    out = [word(rng.randint(0, 200)) for _ in range(30)]
    # One line and one passage in many surroundings, near copies, copies, and texts that repeat themselves.
    out += [word(40) + line + word(40) for _ in range(25)] + [word(5) + passage + word(rng.randint(0, 9)) for _ in range(20)]
    out += [passage * 3, passage, passage, "ab" * 200, "a" * 500, "xyz" * 90 + line, "", None, "short"]
    out += [passage[:i] + "#" + passage[i + 1 :] for i in range(0, 80, 7)]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    # Null ids, repeated rows, and one id with two texts.
    return rows + [(None, passage), (None, word(50)), (None, passage + "!"), rows[3], (7, "other " + passage)]


@pytest.mark.parametrize("group, batch, piece", [(2, 64, 50), (5, 1 << 18, 1 << 22), (4096, 300, 70)])
def test_same_as_brute_force(spark, group, batch, piece):
    rows = texts()
    params = RepeatParams(length=30, anchor=12, group=group, batch=batch, piece=piece)
    docs = spark.createDataFrame([(d, t, "x", "y", "z", 1) for d, t in rows], SCHEMA).repartition(3)
    got = repeats.without_repeats(docs, params).collect()
    mine = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)
    assert mine == brute(rows, 30)


def test_contract_lengths_and_a_long_text(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(99))
    rows = [(1, base + "x"), (2, base + "y"), (3, "z" + base + "x"), (4, base), (5, (base + "x") * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], len(r["kept"])) for r in repeats.without_repeats(docs).collect()}
    assert got == {1: (0, 0, 100), 2: (0, 0, 100), 3: (100, 1, 1), 4: (0, 0, 99), 5: (300_000, 1, 0)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    out = repeats.without_repeats(none)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"] and out.count() == 0


def test_earlier_matches_agrees_with_plain_search():
    rng = np.random.default_rng(1)
    for length in (1, 5, 8, 9, 16, 23):
        data = rng.integers(0, 3, 400).astype(np.uint8)
        starts = np.arange(400 - length + 1)
        position = rng.permutation(len(starts))
        raw = data.tobytes()
        strings = [raw[i : i + length] for i in starts]
        least = {}
        for s, p in zip(strings, position):
            least[s] = min(least.get(s, p), p)
        want = [least[s] < p for s, p in zip(strings, position)]
        assert repeats.earlier_matches(data, starts, position, length).tolist() == want
