"""Hard negatives by cover trees over norm-augmented vectors.

Components are scaled to whole numbers, so inner products are exact. With `sqrt(M - |x|^2)` as one more
component, M being the largest squared norm, all candidates have one norm, and the inner product with
an anchor falls with the distance: `q.x = (|q|^2 + M - d^2) / 2`.

1. Equal rows are one point. Centres, far from each other and chosen from a bounded sample, are the top
   level of the tree: every point goes to the nearest one, and the largest distance is the covering
   radius. A centre with many points is split by hash into shards under the same ball.
2. Every shard grows its levels: the centres of a level are taken farthest first until the radius is
   halved or `fanout` are found; each node keeps the true radius of what it covers.
3. A window asks for the best `k` points with scores between two ends. Windows first search the ball
   that promises most, then those balls alone whose bound reaches the window and the k-th score found.
   Inside, nodes are taken best first, those outside the window are skipped, and leaves are scored.

First come windows without ends over the same label (the positives), then one window for every positive
over the other labels (the negatives).
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.sources.scratch import written

LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class MineParams:
    """Positives and negatives asked for, least share of the positive's score, scale; sizes of the tree."""

    k: int = 5
    percent: int = 80
    scale: int = 256
    shard_rows: int = 8192
    max_balls: int = 1024
    sample: int = 4096
    leaf: int = 64
    fanout: int = 16
    chunk: int = 4096


@dataclass(frozen=True)
class Space:
    """Number of components and largest squared norm of all points."""

    dim: int
    norm: float

    def rows(self, vectors) -> np.ndarray:
        """Vectors as rows of whole numbers; shorter ones end in zeros."""
        exact = self.norm < 1 << 53
        out = np.zeros((len(vectors), self.dim), dtype=np.float64 if exact else object)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v if exact else [int(x) for x in v]
        return out

    def augmented(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        rest = np.sqrt(np.maximum(0.0, self.norm - np.einsum("ij,ij->i", x, x)))
        return np.hstack([x, rest[:, None]])

    def radius(self, distances: np.ndarray) -> float:
        """A radius that rounding cannot make too small."""
        return float(distances.max()) * (1 + 1e-9) + 1e-7 * self.norm**0.5

    def bounds(self, queries: np.ndarray, centres: np.ndarray, radii: np.ndarray):
        """Largest and smallest inner product of each query with anything in each ball."""
        q, c = queries.astype(np.float64), centres.astype(np.float64)
        dot, own = q @ c.T, np.einsum("ij,ij->i", q, q)[:, None]
        total = own + self.norm
        d = np.sqrt(np.maximum(0.0, total - 2 * dot))
        reach = np.sqrt(own) * radii
        room = 1e-7 * total + 1
        high = np.minimum(dot + reach, (total - np.maximum(0.0, d - radii) ** 2) / 2) + room
        low = np.maximum(dot - reach, (total - (d + radii) ** 2) / 2) - room
        return high, low


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; those that do not fit a long are an error."""
    return (queries @ rows.T).astype(np.int64)


def spread_centres(points: np.ndarray, first: int, n: int, enough: float = 0.0):
    """Up to `n` points, each the farthest from those before; owner and distance of every point."""
    centres = [first]
    d = np.linalg.norm(points - points[first], axis=1)
    owner = np.zeros(len(points), dtype=np.int64)
    while len(centres) < n and d.max() > enough:
        at = int(d.argmax())
        new = np.linalg.norm(points - points[at], axis=1)
        new[at] = 0.0
        nearer = new < d
        owner[nearer] = len(centres)
        d = np.where(nearer, new, d)
        centres.append(at)
    return np.array(centres), owner, d


class CoverTree:
    """Points sorted by leaf, and per node: centre, radius, first child, children, first and last point."""

    def __init__(self, space: Space, rows: np.ndarray, labels: np.ndarray, ids: list, params: MineParams):
        self.space = space
        points = space.augmented(rows)
        nodes, order, todo = [[0, np.inf, 0, 0, 0, 0]], [], [(0, np.arange(len(rows)), 0)]
        while todo:
            node, members, centre = todo.pop()
            inside = points[members]
            d = np.linalg.norm(inside - points[centre], axis=1)
            nodes[node][:2] = [centre, space.radius(d)]
            if len(members) <= params.leaf or d.max() == 0:
                nodes[node][4:] = [len(order), len(order) + len(members)]
                order.extend(members)
                continue
            first = int(np.flatnonzero(members == centre)[0])
            centres, owner, _ = spread_centres(inside, first, params.fanout, d.max() / 2)
            nodes[node][2:4] = [len(nodes), len(centres)]
            for i, at in enumerate(centres):
                nodes.append([0, 0.0, 0, 0, 0, 0])
                todo.append((len(nodes) - 1, members[owner == i], int(members[at])))
        self.centres = rows[[n[0] for n in nodes]]
        self.radii = np.array([n[1] for n in nodes])
        self.links = np.array([n[2:] for n in nodes])
        self.rows, self.labels, self.ids = rows[order], labels[order], [ids[i] for i in order]

    def search(self, ask: Windows, k: int, same: bool) -> None:
        """Improve the answers of all windows, best node first."""
        every = np.arange(len(ask.lo))
        high, low = self._bounds(ask, every, np.array([0]))
        heap = [(-high.max(), 0, every, high[:, 0], low[:, 0])] if len(every) else []
        while heap:
            _, node, asked, high, low = heapq.heappop(heap)
            open_ = (high >= ask.need(asked)) & (low <= ask.hi[asked])
            asked = asked[open_]
            if not len(asked):
                continue
            first, n, start, stop = self.links[node]
            if not n:
                self._offer(ask, asked, slice(start, stop), k, same)
                continue
            children = np.arange(first, first + n)
            high, low = self._bounds(ask, asked, children)
            alive = (high >= ask.need(asked)[:, None]) & (low <= ask.hi[asked][:, None])
            for i, child in enumerate(children):
                some = alive[:, i]
                if some.any():
                    up = high[some, i]
                    heapq.heappush(heap, (-up.max(), int(child), asked[some], up, low[some, i]))

    def _bounds(self, ask: Windows, asked: np.ndarray, nodes: np.ndarray):
        used, back = np.unique(ask.anchor[asked], return_inverse=True)
        high, low = self.space.bounds(ask.queries[used], self.centres[nodes], self.radii[nodes])
        return high[back], low[back]

    def _offer(self, ask: Windows, asked: np.ndarray, part: slice, k: int, same: bool) -> None:
        used, back = np.unique(ask.anchor[asked], return_inverse=True)
        found = scores(ask.queries[used], self.rows[part])[back]
        ok = (found <= ask.hi[asked][:, None]) & (found >= ask.need(asked)[:, None])
        ok &= (self.labels[part][None, :] == ask.labels[asked][:, None]) == same
        for i in np.flatnonzero(ok.any(axis=1)):
            at = np.flatnonzero(ok[i])
            ids = [self.ids[part.start + j] for j in at]
            values = np.repeat(found[i, at], [len(x) for x in ids])
            ask.offer(asked[i], values, np.concatenate(ids), k)


class Windows:
    """Questions of one chunk: anchors, ends of scores, and the best answers so far."""

    def __init__(self, space: Space, frame: pd.DataFrame, k: int):
        first, self.anchor = np.unique(frame["a"].to_numpy(), return_index=True, return_inverse=True)[1:]
        self.queries = space.rows([frame["q"].iloc[i] for i in first])
        self.labels, self.own = frame["label"].to_numpy(), frame["id"].to_numpy()
        self.lo, self.hi = np.maximum(frame["lo"].to_numpy(), frame["known"].to_numpy()), frame["hi"].to_numpy()
        self.score = np.full((len(frame), k), LOW, dtype=np.int64)
        self.found = np.full((len(frame), k), HIGH, dtype=np.int64)
        self.filled = np.zeros(len(frame), dtype=np.int64)

    def need(self, asked: np.ndarray) -> np.ndarray:
        return np.maximum(self.lo[asked], self.score[asked, -1])

    def offer(self, w: int, values: np.ndarray, ids: np.ndarray, k: int) -> None:
        other = ids != self.own[w]
        n = self.filled[w]
        values = np.concatenate([self.score[w, :n], values[other]])
        ids = np.concatenate([self.found[w, :n], ids[other]])
        best = np.lexsort((ids, ~values))[:k]
        self.filled[w] = len(best)
        self.score[w, : len(best)], self.found[w, : len(best)] = values[best], ids[best]


@dataclass(frozen=True)
class Forest:
    """The balls of the top level, at most `max_balls`, and the stored trees (ball, sub, tree)."""

    space: Space
    centres: np.ndarray
    radii: np.ndarray
    trees: DataFrame


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """Different rows id, label, q (array of long) of `vectors` (id, v, label) that can take part."""
    v = F.transform("v", lambda x: x.cast("double"))
    kept = vectors.filter("id is not null and label is not null and v is not null")
    kept = kept.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return kept.filter(~bad).select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q")).distinct()


def grown(rows: DataFrame, params: MineParams) -> Forest:
    """Deal the points to balls and shards, and grow and store a tree for each shard."""
    spark = rows.sparkSession
    # Of equal rows the k + 1 smallest ids are all that a list can need. Spark cuts before the shuffle too.
    by_id = Window.partitionBy("q", "label").orderBy("id")
    heads = rows.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= params.k + 1)
    points = written(heads.groupBy("q", "label").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, dim, largest = points.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(norm)).first()
    space = Space(dim or 0, (largest or 0.0) * (1 + 1e-9) + 1.0)
    mark = F.xxhash64("q", "label")
    n_balls = min(params.max_balls, max(1, -(-n // params.shard_rows)))
    sample = points.select(mark.alias("mark"), "q").orderBy("mark", "q").limit(params.sample if n_balls > 1 else 1)
    drawn = space.rows([r["q"] for r in sample.collect()])
    if not len(drawn):
        return Forest(space, drawn, np.zeros(0), spark.createDataFrame([], "ball int, sub int, tree binary"))
    centres = drawn[spread_centres(space.augmented(drawn), 0, n_balls)[0]]
    tops = space.augmented(centres)

    @F.pandas_udf("ball int, far double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        d = np.stack([np.linalg.norm(space.augmented(space.rows(vectors)) - c, axis=1) for c in tops], axis=1)
        return pd.DataFrame({"ball": d.argmin(axis=1).astype(np.int32), "far": d.min(axis=1)})

    dealt = written(points.withColumn("at", nearest("q")).select("q", "label", "ids", "at.*"), "dealt")
    sizes = dealt.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()
    radii = np.full(len(centres), -1.0)  # an empty ball is never visited
    for row in sizes:
        radii[row["ball"]] = space.radius(np.array([row["far"]]))
    subs = [(r["ball"], -(-r["n"] // params.shard_rows)) for r in sizes]
    subs = spark.createDataFrame(subs, "ball int, subs long")

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("mark")
        ids = [np.array(x, dtype=np.int64) for x in frame["ids"]]
        tree = CoverTree(space, space.rows(frame["q"].tolist()), frame["label"].to_numpy(), ids, params)
        kept = pickle.dumps(vars(tree))
        return pd.DataFrame({"ball": frame["ball"].iloc[:1], "sub": frame["sub"].iloc[:1], "tree": [kept]})

    # At most `max_balls` rows are broadcast.
    shards = dealt.join(F.broadcast(subs), "ball").withColumn("mark", mark)
    shards = shards.withColumn("sub", F.pmod("mark", "subs").cast("int")).select("ball", "sub", "mark", "q", "label", "ids")
    trees = shards.groupBy("ball", "sub").applyInPandas(grow, "ball int, sub int, tree binary")
    return Forest(space, centres, radii, written(trees, "trees"))


def visits(forest: Forest, windows: DataFrame, first: bool) -> DataFrame:
    """Windows with `ball`: the one that promises most, or all others that can still matter."""
    space, centres, radii = forest.space, forest.centres, forest.radii

    @F.pandas_udf("array<int>")
    def balls(q: pd.Series, lo: pd.Series, hi: pd.Series, known: pd.Series) -> pd.Series:
        high, low = space.bounds(space.rows(q), centres, np.maximum(radii, 0.0))
        # The promise does not look at what is known, so that both rounds name the same ball.
        fits = (high >= lo.to_numpy()[:, None]) & (low <= hi.to_numpy()[:, None]) & (radii >= 0)
        best = np.where(fits, high, -np.inf).argmax(axis=1)
        rows = np.arange(len(best))
        if first:
            chosen = np.zeros_like(fits)
            chosen[rows, best] = fits[rows, best]
        else:
            chosen = fits & (high >= known.to_numpy()[:, None])
            chosen[rows, best] = False
        return pd.Series([np.flatnonzero(c).astype(np.int32) for c in chosen])

    return windows.withColumn("ball", F.explode(balls("q", "lo", "hi", "known")))


def searched(forest: Forest, calls: DataFrame, params: MineParams, same: bool) -> DataFrame:
    """a, n, score, found: the best k in each shard of the balls that windows call on.

    A group is one shard's tree and at most about `chunk` of the windows that call on it.
    """
    shards = forest.trees.select(F.col("ball").alias("ball"), F.col("sub").alias("sub"))
    asked = calls.join(shards, "ball")
    load = asked.groupBy("ball", "sub").agg(F.ceil(F.count(F.lit(1)) / params.chunk).alias("chunks"))
    load = written(load, "load")
    space, k = forest.space, params.k

    def find(trees: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(trees) or not len(frame):
            return pd.DataFrame({"a": [], "n": [], "score": [], "found": []}).astype(np.int64)
        tree = CoverTree.__new__(CoverTree)
        vars(tree).update(pickle.loads(trees["tree"].iloc[0]))
        ask = Windows(space, frame, k)
        tree.search(ask, k, same)
        w, at = np.nonzero(np.arange(k)[None, :] < ask.filled[:, None])
        return pd.DataFrame(
            {"a": frame["a"].to_numpy()[w], "n": frame["n"].to_numpy()[w], "score": ask.score[w, at], "found": ask.found[w, at]}
        )

    chunk = F.pmod(F.xxhash64("a"), F.col("chunks")).cast("int").alias("chunk")
    window = ["a", "id", "label", "q", "n", "lo", "hi", "known"]
    left = forest.trees.join(load, ["ball", "sub"])
    left = left.select("ball", "sub", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).alias("chunk"), "tree")
    right = asked.join(load, ["ball", "sub"]).select("ball", "sub", chunk, *window)
    keys = ["ball", "sub", "chunk"]
    both = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return both.applyInPandas(find, "a long, n long, score long, found long")


def answered(forest: Forest, windows: DataFrame, params: MineParams, same: bool) -> DataFrame:
    """a, n, rank, score, found: the best k of every window (a, id, label, q, n, lo, hi)."""
    best = Window.partitionBy("a", "n").orderBy(F.desc("score"), "found")

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= params.k)

    begun = windows.withColumn("known", F.lit(LOW))
    near = written(top(searched(forest, visits(forest, begun, True), params, same)), "near")
    known = near.filter(F.col("rank") == params.k).select("a", "n", F.col("score").alias("known"))
    left = windows.join(known, ["a", "n"], "left").withColumn("known", F.coalesce("known", F.lit(LOW)))
    far = searched(forest, visits(forest, left, False), params, same)
    return written(top(near.drop("rank").unionByName(far)), "answers")


def mined(vectors: DataFrame, is_anchor: Column, params: MineParams = MineParams()) -> DataFrame:
    """Hard negatives of `vectors` (id, v, label), for the rows for which `is_anchor` holds.

    Returns anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score. Rows with a null
    id, label or vector or a null or non-finite component take no part; a shorter vector counts as ending in
    zeros, an empty one as zeros. Repeated rows count once. A row is no partner of a row of its own id; an id
    with several labels or vectors is several rows, and several anchors under one id. Positives without
    a negative in their window, and anchors without a positive, give no row. Empty tables give an empty
    table. Other columns are ignored. Scores beyond a long are an error.
    """
    rows = written(usable(vectors, params.scale), "rows")
    forest = grown(rows, params)
    if not len(forest.centres):
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], empty)
    anchors = rows.filter(is_anchor).withColumn("a", F.xxhash64("id", "label", "q"))
    whole = [F.lit(0).cast("long").alias("n"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")]
    positives = answered(forest, anchors.select("a", "id", "label", "q", *whole), params, True)
    # No negative fits a positive below zero: its window ends before it begins.
    ends = positives.filter("score >= 0").select(
        "a", F.col("rank").cast("long").alias("n"), F.col("score").alias("hi"), F.col("found").alias("positive_id"),
        F.ceil(F.col("score").cast("decimal(38,0)") * params.percent / 100).cast("long").alias("lo"),
    )
    windows = anchors.join(ends, "a").select("a", "id", "label", "q", "n", "lo", "hi")
    negatives = answered(forest, windows, params, False)
    named = anchors.select("a", F.col("id").alias("anchor_id")).join(ends, "a")
    return negatives.join(named, ["a", "n"]).select(
        "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"),
        F.col("hi").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def oracle(params: MineParams = MineParams()) -> str:
    """DuckDB SQL for the query."""
    return f"""
    WITH rows AS MATERIALIZED (
      SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor({params.scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS MATERIALIZED (
      SELECT a.id AS a, c.id AS c, a.label = c.label AS same,
        list_sum([a.q[i] * c.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
      FROM rows a JOIN rows c ON a.id <> c.id WHERE a.id % 100 = 0
    ), positives AS (
      SELECT a, c AS p, score FROM pairs WHERE same
      QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= {params.k}
    )
    SELECT a AS anchor_id, p AS positive_id,
      (row_number() OVER (PARTITION BY a, p ORDER BY n.score DESC, c))::INTEGER AS rank,
      c AS negative_id, positives.score AS positive_score, n.score AS negative_score
    FROM positives JOIN pairs n USING (a)
    WHERE NOT n.same AND {params.percent} * positives.score <= 100 * n.score AND n.score <= positives.score
    QUALIFY rank <= {params.k}
    """
