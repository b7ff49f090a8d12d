"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt to shards by a hash; each shard's tree is built once and stored. A node keeps a
vantage point and the median distance of its vectors to it. With `t` as the distance of the worst of
the best k so far, a side is left out if the triangle inequality, times `slack`, says that nothing in
it is nearer than `t`. A slack of one is exact; a larger one leaves out more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from akin.sources.scratch import written


@dataclass(frozen=True)
class AnnParams:
    """Neighbours asked for, the pruning factor, vectors of a shard, queries of a block."""

    k: int = 10
    slack: float = 1.0
    shard_rows: int = 8192
    block: int = 512
    leaf: int = 64
    seed: int = 3


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances (len(a), len(b)) in doubles, summed in the order of the components."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i][:, None] - b[:, i][None, :]
        total += d * d
    return np.sqrt(total)


class VantageTree:
    """Nodes are (vantage, median, inside, outside) or (None, rows); vectors are different ones."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], leaf: int, seed: int):
        self.vectors, self.ids = vectors, ids
        self.rng, self.leaf = np.random.default_rng(seed), leaf
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return (None, rows)
        at = int(self.rng.integers(len(rows)))
        vantage, rows = rows[at], np.delete(rows, at)
        d = distances(self.vectors[[vantage]], self.vectors[rows])[0]
        median = float(np.median(d))
        inside = d <= median
        if inside.all():
            return (None, np.append(rows, vantage))
        return (vantage, median, self._build(rows[inside]), self._build(rows[~inside]))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, slack: float):
        """The best k (score, id) of each query, ties to the smaller id, the query's own id left out."""
        self.best_d = np.full((len(queries), k), np.inf)
        self.best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.queries, self.own, self.slack = queries, own, slack
        self._visit(self.root, np.arange(len(queries)))
        return self.best_d, self.best_id

    def _offer(self, q: np.ndarray, rows: np.ndarray) -> None:
        d = distances(self.queries[q], self.vectors[rows])
        k = self.best_d.shape[1]
        ids = np.concatenate([self.ids[r] for r in rows])
        wide = np.repeat(d, [len(self.ids[r]) for r in rows], axis=1)
        wide = np.where(ids[None, :] == self.own[q][:, None], np.inf, wide)
        # Only rows that reach the worst kept one can change anything.
        changed = (wide <= self.best_d[q, -1][:, None]).any(axis=1)
        for i in np.flatnonzero(changed):
            row = q[i]
            ok = np.flatnonzero(np.isfinite(wide[i]) & (wide[i] <= self.best_d[row, -1]))
            all_d = np.concatenate([self.best_d[row], wide[i, ok]])
            all_id = np.concatenate([self.best_id[row], ids[ok]])
            order = np.lexsort((all_id, all_d))[:k]
            self.best_d[row], self.best_id[row] = all_d[order], all_id[order]

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node[0] is None:
            if len(node[1]):
                self._offer(q, node[1])
            return
        vantage, median, inside, outside = node
        d = distances(self.queries[q], self.vectors[[vantage]])[:, 0]
        self._offer(q, np.array([vantage]))
        near = d <= median
        self._visit(inside, q[near])
        self._visit(outside, q[~near])
        # A little room for rounding, so that ties are never lost.
        limit = lambda rows: self.best_d[rows, -1] * (1 + 1e-9) + 1e-12
        across = q[near][(median - d[near]) * self.slack <= limit(q[near])]
        self._visit(outside, across)
        across = q[~near][(d[~near] - median) * self.slack <= limit(q[~near])]
        self._visit(inside, across)


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (array of double): no null, empty or zero vectors, no null or non-finite components."""
    v = F.transform("v", lambda x: x.cast("double"))
    kept = vectors.filter("id is not null and v is not null and size(v) > 0").select("id", v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.filter(~bad).filter(F.exists("v", lambda x: x != 0))


def build(vectors: DataFrame, params: AnnParams) -> DataFrame:
    """shard, dim, tree (binary): one tree per shard and number of components.

    Equal vectors are one point. Of their ids the k + 1 smallest are kept: no query lists more of them.
    The number of shards follows the number of vectors.
    """
    keep = params.k + 1
    point = Window.partitionBy("v").orderBy("id")
    firsts = (
        vectors.distinct().withColumn("shuffled", F.xxhash64("id"))
        .repartition("v", F.pmod("shuffled", F.lit(64)))
    )
    # A hot vector is cut to k + 1 ids in each of 64 parts before its parts meet.
    part = Window.partitionBy("v", F.pmod("shuffled", F.lit(64))).orderBy("id")
    firsts = firsts.withColumn("nth", F.row_number().over(part)).filter(F.col("nth") <= keep).drop("nth", "shuffled")
    firsts = firsts.withColumn("nth", F.row_number().over(point)).filter(F.col("nth") <= keep)
    points = written(firsts.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    shards = max(1, -(-points.count() // params.shard_rows))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("first")
        vectors = np.array(frame["v"].tolist(), dtype=np.float64)
        ids = [np.array(x, dtype=np.int64) for x in frame["ids"]]
        tree = VantageTree(vectors, ids, params.leaf, params.seed)
        raw = pickle.dumps((vectors, ids, tree.root))
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "dim": [vectors.shape[1]], "tree": [raw]})

    dealt = points.select(
        F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"),
        F.element_at("ids", 1).alias("first"), "ids", "v",
    )
    grown = dealt.groupBy("shard", "dim").applyInPandas(grow, "shard int, dim int, tree binary")
    return written(grown, "trees")


def search(trees: DataFrame, queries: DataFrame, params: AnnParams) -> DataFrame:
    """query_id, rank, vec_id, score: every tree meets every block of queries of its dimension."""
    blocks = max(1, -(-queries.count() // params.block))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packed = queries.groupBy(block.alias("block"), F.size("v").alias("dim")).agg(
        F.sort_array(F.collect_list(F.struct("id", "v"))).alias("queries")
    )
    every = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = every.join(packed, ["block", "dim"]).select("tree", "queries")
    pairs = pairs.repartition(F.xxhash64("tree", F.col("queries.id")))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw, asked in zip(frame["tree"], frame["queries"], strict=True):
                vectors, ids, root = pickle.loads(raw)
                tree = VantageTree.__new__(VantageTree)
                tree.vectors, tree.ids, tree.root = vectors, ids, root
                own = np.array([q["id"] for q in asked], dtype=np.int64)
                q = np.array([list(q["v"]) for q in asked], dtype=np.float64)
                d, found = tree.search(q, own, params.k, params.slack)
                row, column = np.nonzero(np.isfinite(d))
                yield pd.DataFrame({"query_id": own[row], "vec_id": found[row, column], "score": d[row, column]})

    best = pairs.mapInPandas(find, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= params.k).select(
        "query_id", "rank", "vec_id", "score"
    )


def nearest(vectors: DataFrame, queries: DataFrame, params: AnnParams = AnnParams()) -> DataFrame:
    """The k nearest of `vectors` (id long, v array) for each row of `queries` (same columns).

    Returns query_id, rank from 1, vec_id, score. A query meets no vector of its own id. Rows that
    cannot be used, see `usable`, take no part on either side; vectors of another length are not
    comparable and not listed. Repeated rows count once; an id with several vectors is listed once for
    each different one, and is several queries under one id, whose best are merged. Fewer candidates
    than k give fewer rows. Empty tables give an empty table.
    """
    base = written(usable(vectors.select(F.col("id").cast("long").alias("id"), "v")), "vectors")
    asked = usable(queries.select(F.col("id").cast("long").alias("id"), "v")).distinct()
    return search(build(base, params), asked, params)
