"""Groups of the tree search that give all their pairs are not searched again."""

import numpy as np
import pandas as pd

from akin.llm import ngram_join


def frame_of(rng, sizes, params):
    """Groups of near copies and others, sorted by key, each a single cut."""
    rows = []
    for key, size in enumerate(sizes):
        base = rng.integers(0, 2**64, 80, dtype=np.uint64)
        for _ in range(size):
            own = base.copy()
            changed = rng.choice(80, int(rng.integers(0, 40)), replace=False)
            own[changed] = rng.integers(0, 2**64, len(changed), dtype=np.uint64)
            s = np.unique(own)
            node = ngram_join.node_of(s)
            rows.append((key, 0, 0, 0, node, node, len(s), ngram_join.point_of(s, params)))
    return pd.DataFrame(rows, columns=["key", "i", "j", "cut", "node", "label", "n", "point"])


def test_only_groups_with_more_pairs_are_named():
    params = ngram_join.JoinParams(leaf=8)
    frame = frame_of(np.random.default_rng(4), [2, 5, 8, 30, 1, 40], params)

    def found(limit):
        out = pd.concat(ngram_join._tree_pairs(params, limit)(iter([frame.iloc[:33], frame.iloc[33:]])))
        key = frame.set_index("node")["key"]
        pairs = {(a, b) for a, b in out.dropna(subset=["a"])[["a", "b"]].itertuples(index=False) if a != b}
        return {k: {p for p in pairs if key[p[0]] == k} for k in range(6)}, set(out["key"].dropna())

    every, none = found(None)
    some, again = found(1)
    assert not none
    assert again and again < set(range(6))
    assert sum(map(len, some.values())) < sum(map(len, every.values()))
    for key in every:
        assert some[key] <= every[key]
        assert key in again or some[key] == every[key]


def frames_at(frame, at):
    return iter([frame.iloc[:at], frame.iloc[at:]])


def parts_of(nodes, pairs):
    """Node -> smallest node it is connected with."""
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_a_group_gives_fewer_pairs_than_it_has_nodes():
    params = ngram_join.JoinParams(leaf=8)
    frame = frame_of(np.random.default_rng(5), [150, 8, 60, 2], params)
    frame["shingles"] = b""

    def pairs(limit):
        out = pd.concat(ngram_join._tree_pairs(params, limit)(frames_at(frame, 170)))
        return set(out.dropna(subset=["a"])[["a", "b"]].itertuples(index=False, name=None))

    every, some = pairs(None), pairs(1_000)
    assert some < every and len(every) > len(frame) > len(some)
    # With room for all pairs the forest connects what they connect.
    assert parts_of(frame["node"], some) == parts_of(frame["node"], every)
    nodes = pd.concat(ngram_join._tree_nodes(params)(frames_at(frame, 170)))
    assert set(nodes["node"]) == {n for pair in every for n in pair}


def test_groups_are_judged_where_their_pairs_are_found():
    params, rng = ngram_join.JoinParams(leaf=8), np.random.default_rng(6)
    rows = []
    for key, size in enumerate([50, 7, 1]):
        base = rng.integers(0, 2**64, 80, dtype=np.uint64)
        for _ in range(size):
            own = base.copy()
            changed = rng.choice(80, int(rng.integers(0, 12)), replace=False)
            own[changed] = rng.integers(0, 2**64, len(changed), dtype=np.uint64)
            s = np.unique(own)
            node = ngram_join.node_of(s)
            rows.append((key, 0, 0, 0, node, node, len(s), s.tobytes()))
    frame = pd.DataFrame(rows, columns=["key", "i", "j", "cut", "node", "label", "n", "shingles"])
    sets = {r.node: set(np.frombuffer(r.shingles, np.uint64).tolist()) for r in frame.itertuples()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= params.percent * len(sets[a] | sets[b])
    ]
    out = pd.concat(ngram_join._group_links(params)(frames_at(frame, 20)))
    found = set(out[["a", "b"]].itertuples(index=False, name=None))
    assert found <= set(links) and len(links) > len(frame) > len(found) == len(out)
    assert parts_of(sets, found) == parts_of(sets, links)
