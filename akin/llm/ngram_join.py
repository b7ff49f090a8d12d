"""N-gram Jaccard join through count vectors in R-trees.

A document is the set of its distinct word shingles. Shingles are hashed into token groups, and the
numbers of shingles per group are the document's point. Two sets share at most the sum of the smaller
coordinates of their points, so an R-tree over points prunes whole boxes whose sum is too small.

Points alone do not tell shards apart, as random texts have much the same counts. The shards come from
the same idea, made exact: sets that link differ in at most `d` shingles; cut the hash range into
more than `d` token groups, and at least one group holds the very same shingles in both. A document goes to
one shard for each of its groups, named by the group's content. Sizes are cut into bands so that both
sides use the same groups.

Hot shards: copies are one node from the start. In each shard every node is first compared with the
smallest and the largest one only; what these links connect needs no further comparison. Only nodes of different
components meet in the R-trees, whose groups are cut to a bounded size, all pairs of cuts included.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from akin.llm.common import in_bitmap
from akin.llm.components import components
from akin.sources.scratch import discard, written

_CACHED = 200_000


@dataclass(frozen=True)
class JoinParams:
    """Shingle width, threshold in hundredths, fewest coordinates of a point, rows of a cut and a leaf.

    Counts of long texts differ by less of their size, so points of longer texts get more coordinates:
    the power of two from `share` of the size on. Two points are compared at the coarser one's grid.
    A first round verifies of the `first` best pairs of a node those that make up a spanning forest of a group; a second
    one goes to the groups in which there were more, skips what the first one connected, and judges pairs where they are
    found, so neither gives more pairs than a group has nodes.
    """

    words: int = 4
    percent: int = 85
    groups: int = 64
    share: float = 0.6
    first: int = 4
    cut: int = 2048
    leaf: int = 32


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z lower-cased, ASCII white space."""
    if not text:
        return np.zeros(0, np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    width = min(words, len(h))
    count = len(h) - width + 1
    s = np.full(count, width, np.uint64)
    for i in range(width):
        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + count])
    return np.unique(s)


class Bands:
    """Size bands and the number of token groups that two neighbouring bands need."""

    def __init__(self, percent: int):
        self.percent = percent

    def lower(self, band: int) -> int:
        return math.ceil((100 / self.percent) ** band - 1e-9)

    def band(self, size: int) -> int:
        b = int(math.log(size) / math.log(100 / self.percent))
        while self.lower(b + 1) <= size:
            b += 1
        while self.lower(b) > size:
            b -= 1
        return b

    def differ(self, band: int) -> int:
        """The most shingles by which two linked sets differ, the larger one in this band."""
        largest = self.lower(band + 1) - 1
        return (100 - self.percent) * 2 * largest // (100 + self.percent)


def shard_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """One key per token group, for the schemes of the own band and of the next one up.

    Linked sets agree in all but `d` of the groups at most. Some groups are spare, so that the smallest ones, which
    many unlike sets hold as well, can go without a key: a set leaves out all groups of up to as many shingles as it
    can without leaving out more than `spare`. Of the `1 + spare` groups that agree, one is larger than what either
    set leaves out.
    """
    out = []
    own = bands.band(len(s))
    mixed = _mixed(s ^ np.uint64(0xA5A5A5A55A5A5A5A))
    for scheme in (own, own + 1):
        d = bands.differ(scheme)
        if d == 0:
            continue
        spare = 2 + d // 10
        m = d + 1 + spare
        group = np.minimum((s.astype(np.float64) * (m / 2.0**64)).astype(np.int64), m - 1)
        content = np.zeros(m, np.uint64)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        content[group[starts]] = np.add.reduceat(mixed, starts)
        size = np.bincount(group, minlength=m)
        # The size of the first group beyond the spare ones: groups of that size and more give keys.
        kept = size >= np.partition(size, spare)[spare]
        label = np.arange(m, dtype=np.uint64) + np.uint64((scheme + 1) << 32)
        out.append(_mixed(_mixed(label) + content)[kept])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >= 1 << 63 else digest


def node_of(s: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s.tobytes()))


def signatures(docs: DataFrame, params: JoinParams) -> DataFrame:
    """doc_id, n, node (null for an empty set), point, coarse, keys. A task gives a node's keys once."""
    words, percent = params.words, params.percent

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, seen, bands = _Hashes(), set(), Bands(percent)
        for frame in frames:
            for at in range(0, len(frame), 500):
                rows = []
                part = frame.iloc[at : at + 500]
                for text in part["text"]:
                    s = shingle_set(text, words, cache)
                    if not len(s):
                        rows.append((0, None, None, None, None))
                        continue
                    node = node_of(s)
                    if node in seen:
                        rows.append((len(s), node, None, None, None))
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    rows.append((len(s), node, point_of(s, params), point_of(s, params, 0.0), shard_keys(s, bands)))
                n, node, point, coarse, keys = zip(*rows, strict=True)
                node = pd.Series(node, dtype="Int64")
                ids = part["id"].to_numpy()
                yield pd.DataFrame({"id": ids, "n": n, "node": node, "point": point, "coarse": coarse, "keys": keys})

    # Ids go as text: pandas would turn whole numbers with nulls among them into fractions.
    ids = F.col("doc_id").cast("long").cast("string").alias("id")
    signed = docs.select(ids, F.col("text").cast("string").alias("text")).mapInPandas(
        sign, "id string, n long, node long, point binary, coarse binary, keys array<long>"
    )
    return signed.select(F.col("id").cast("long").alias("doc_id"), "n", "node", "point", "coarse", "keys")


def point_of(s: np.ndarray, params: JoinParams, share: float | None = None) -> bytes:
    """The point of a set; a share of zero gives the fewest coordinates."""
    share = params.share if share is None else share
    bits = max(params.groups.bit_length() - 1, math.ceil(math.log2(max(1.0, share * len(s)))))
    coordinate = (_mixed(s) >> np.uint64(64 - bits)).astype(np.int64)
    counts = np.bincount(coordinate, minlength=1 << bits)
    # The first byte says how many bytes a count takes.
    kind = "<u1" if counts.max() < 256 else "<u4"
    return bytes([int(kind[-1])]) + counts.astype(kind).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def folded(raw, width: int) -> np.ndarray:
    """Points of equal length as rows of `width` coordinates: neighbouring groups are added up."""
    x = np.stack([_unpacked(p) for p in raw])
    return x.reshape(len(raw), width, -1).sum(axis=2, dtype=np.int64)


def _width(raw: bytes) -> int:
    return (len(raw) - 1) // raw[0]


def most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the smaller coordinates of points (arrays of bytes), pair by pair."""
    out = np.zeros(len(a), np.int64)
    shapes = np.array([[_width(x), _width(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    for shape in np.unique(shapes, axis=0):
        rows = np.flatnonzero((shapes == shape).all(axis=1))
        width = int(shape.min())
        for part in np.array_split(rows, -(-len(rows) * width // 500_000)):
            out[part] = np.minimum(folded(a[part], width), folded(b[part], width)).sum(axis=1)
    return out


def _overlap(a: Column, b: Column) -> Column:
    @pandas_udf("long")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(most_shared(x.map(bytes).to_numpy(object), y.map(bytes).to_numpy(object)))

    return shared(a, b)


def _enough(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return shared * (100 + percent) >= (n_a + n_b) * percent


class CountTree:
    """A packed R-tree over points; a box keeps its largest coordinates and its smallest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, leaf: int):
        self.points, self.sizes, self.comps = points, sizes, comps
        self.boxes: list[tuple] = []
        self.root = self._build(np.argsort(sizes, kind="stable"), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        own = self.comps[rows]
        single = own[0] if (own == own[0]).all() else None
        if len(rows) <= leaf:
            children = None
        else:
            spread = self.points[rows].var(axis=0)
            rows = rows[np.argsort(self.points[rows, spread.argmax()], kind="stable")]
            children = [self._build(part, leaf) for part in np.array_split(rows, 2)]
        self.boxes.append(
            (self.points[rows].max(axis=0), self.sizes[rows].min(), self.sizes[rows].max(), single, children, rows)
        )
        return len(self.boxes) - 1

    def search(self, points, sizes, comps, percent: int):
        """(query, row, bound) of different components whose bound on the overlap is enough."""
        found = []
        stack = [(self.root, np.arange(len(sizes)))]
        while stack:
            box, q = stack.pop()
            upper, low, high, single, children, rows = self.boxes[box]
            if single is not None:
                q = q[comps[q] != single]
            q = q[(100 * sizes[q] >= percent * low) & (100 * high >= percent * sizes[q])]
            if not len(q):
                continue
            shared = np.minimum(points[q], upper).sum(axis=1)
            q = q[shared * (100 + percent) >= (sizes[q] + low) * percent]
            if not len(q):
                continue
            if children is not None:
                stack += [(child, q) for child in children]
                continue
            for r in rows:
                shared = np.minimum(points[q], self.points[r]).sum(axis=1)
                ok = (shared * (100 + percent) >= (sizes[q] + self.sizes[r]) * percent) & (comps[q] != self.comps[r])
                if ok.any():
                    found.append((q[ok], np.full(int(ok.sum()), r), shared[ok]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _best(query: np.ndarray, bound: np.ndarray, limit: int | None) -> np.ndarray:
    """The rows to keep: all, or the `limit` largest bounds of each query."""
    if limit is None or not len(query):
        return np.arange(len(query))
    order = np.lexsort((-bound, query))
    first = np.flatnonzero(np.r_[True, query[order][1:] != query[order][:-1]])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[nth < limit]


def _forest(u: np.ndarray, v: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The pairs (u, v) of a spanning forest that takes better pairs first."""
    _, flat = np.unique(np.r_[u, v], return_inverse=True)
    live = np.argsort(-score, kind="stable")
    a, b = flat[: len(u)][live], flat[len(u) :][live]
    out = [live[:0]]
    while len(live):
        rank = np.arange(len(live))
        best = np.full(len(flat), len(live))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        ends = np.flatnonzero(best < len(live))
        out.append(live[np.unique(best[ends])])
        # Every end goes to the other end of its best pair; where two go to each other, one stays.
        to = np.arange(len(flat))
        to[ends] = a[best[ends]] + b[best[ends]] - ends
        stays = ends[(to[to[ends]] == ends) & (ends < to[ends])]
        to[stays] = stays
        while (to != to[to]).any():
            to = to[to]
        a, b = to[a], to[b]
        apart = a != b
        a, b, live = a[apart], b[apart], live[apart]
    return np.concatenate(out)


_CROSS = "a long, b long, key long, i long, j long"
_GROUPED = "key long, i long, j long, cut int, node long, label long, n long"


def _cross_rows(a: np.ndarray, b: np.ndarray, again: pd.DataFrame) -> pd.DataFrame:
    """Pairs, and after them the groups (key, i, j) that have more pairs than these."""
    pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
    again = again[["key", "i", "j"]].drop_duplicates()
    return pd.concat([pairs.astype("Int64"), again.astype("Int64")], ignore_index=True)[["a", "b", "key", "i", "j"]]


def _candidates(params: JoinParams, frames: Iterator[pd.DataFrame]):
    """(rows, component, x, y, bound): pairs (x, y) of rows of a group that pass the bound, by the trees.

    Rows come sorted by shard and cut pair; a group has at most two cuts of rows. The rows can be those of several
    groups; components of different groups have different numbers.
    """
    percent, leaf = params.percent, params.leaf

    def solve(group: pd.DataFrame):
        raw = group["point"].map(bytes).to_numpy(object)
        lengths = np.array([_width(p) for p in raw])
        points = np.zeros((len(raw), lengths.min()), np.int64)
        for length in np.unique(lengths):
            points[lengths == length] = folded(raw[lengths == length], points.shape[1])
        sizes, comps = group["n"].to_numpy(np.int64), group["label"].to_numpy(np.int64)
        own = group["cut"].to_numpy(np.int64)
        left, right = np.flatnonzero(own == group["i"].iloc[0]), np.flatnonzero(own == group["j"].iloc[0])
        if len(left) and len(right):
            tree = CountTree(points[left], sizes[left], comps[left], leaf)
            q, r, bound = tree.search(points[right], sizes[right], comps[right], percent)
            yield group, comps, right[q], left[r], bound

    def leaves(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray):
        """Groups that fit one leaf need no boxes: all of them at once, by distance in the group."""
        size = ends - starts
        rows = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        last = np.repeat(ends, size)
        part = frame.iloc[rows]
        points = part["point"].map(bytes).to_numpy(object)
        sizes, comps = part["n"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
        found = []
        for step in range(1, max(2, int(size.max()))):
            x = np.flatnonzero(rows + step < last)
            y = x + step
            low, high = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
            fits = (comps[x] != comps[y]) & (100 * low >= percent * high)
            x, y = x[fits], y[fits]
            shared = most_shared(points[x], points[y])
            ok = shared * (100 + percent) >= (sizes[x] + sizes[y]) * percent
            found.append((x[ok], y[ok], shared[ok]))
        x, y, bound = (np.concatenate([f[i] for f in found]) for i in range(3))
        _, apart = np.unique(np.stack([last, comps]), axis=1, return_inverse=True)
        yield part, apart.reshape(-1), x, y, bound

    def every(frame: pd.DataFrame, starts: np.ndarray, ends: np.ndarray):
        """Groups up to a leaf together, larger ones each with a tree."""
        small = (ends - starts <= leaf) & (frame["i"].to_numpy()[starts] == frame["j"].to_numpy()[starts])
        if small.any():
            yield from leaves(frame, starts[small], ends[small])
        for start, end in zip(starts[~small], ends[~small], strict=True):
            yield from solve(frame.iloc[start:end])

    held = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        names = frame[["key", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
        yield from every(frame, starts[:-1], starts[1:])
        held = frame.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None:
        yield from every(held, np.array([0]), np.array([len(held)]))


def _certain(part: pd.DataFrame, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> np.ndarray:
    sizes = part["n"].to_numpy(np.int64)
    return bound / (sizes[x] + sizes[y])


def _tree_pairs(params: JoinParams, limit: int | None):
    """All pairs; with a limit, of the best pairs of each node those of a spanning forest of its group's components."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, comps, x, y, bound in _candidates(params, frames):
            nodes, kept = part["node"].to_numpy(np.int64), np.arange(len(x))
            left_out = x[:0]
            if limit is not None:
                kept = _best(x, bound, limit)
                kept = kept[_forest(comps[x[kept]], comps[y[kept]], _certain(part, x[kept], y[kept], bound[kept]))]
                pair = np.minimum(x, y) * len(part) + np.maximum(x, y)
                left_out = x[~np.isin(pair, pair[kept])]
            yield _cross_rows(nodes[x[kept]], nodes[y[kept]], part.iloc[left_out])

    return search


def _tree_nodes(params: JoinParams):
    """The nodes of each group that have a pair there."""
    columns = [c.split()[0] for c in _GROUPED.split(", ")]

    def nodes_with_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, x, y, _ in _candidates(params, frames):
            yield part.iloc[np.unique(np.r_[x, y])][columns]

    return nodes_with_pairs


def _group_links(params: JoinParams):
    """Pairs (a, b) that really link: a spanning forest of what the links of a group connect, by whole sets."""
    percent = params.percent

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pointed(frame: pd.DataFrame) -> pd.DataFrame:
            return frame.assign(point=[point_of(np.frombuffer(s, np.uint64), params) for s in frame["shingles"]])

        for part, comps, x, y, bound in _candidates(params, map(pointed, frames)):
            nodes = part["node"].to_numpy(np.int64)
            sets = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
            to: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := to.get(c, c)) != c:
                    to[c] = to.get(up, up)
                    c = up
                return c

            # Of a pair found from both sides one is enough.
            _, one = np.unique(np.minimum(x, y) * len(part) + np.maximum(x, y), return_index=True)
            order = one[np.argsort(-_certain(part, x[one], y[one], bound[one]), kind="stable")]
            keep = []
            for k, p, q in zip(order.tolist(), x[order].tolist(), y[order].tolist(), strict=True):
                a, b = root(int(comps[p])), root(int(comps[q]))
                if a != b and _link(sets[p], sets[q], percent):
                    to[a] = b
                    keep.append(k)
            a, b = nodes[x[keep]], nodes[y[keep]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return judge


def _link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * (100 + percent) >= (len(a) + len(b)) * percent


def _verified(pairs: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """Pairs (a, b) of nodes whose shingle sets really link."""
    percent = params.percent

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for raw_a, raw_b in zip(frame["set_a"], frame["set_b"], strict=True):
                keep.append(_link(np.frombuffer(raw_a, np.uint64), np.frombuffer(raw_b, np.uint64), percent))
            yield frame.loc[keep, ["a", "b"]]

    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    both = second.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInPandas(check, "a long, b long")


def _in_groups(
    shards: DataFrame, points: DataFrame, label: DataFrame, params: JoinParams, only: DataFrame | None = None
) -> DataFrame:
    """key, i, j, cut, node, label, n: the nodes of shards that hold different components, by pairs of cuts.

    Given groups (key, i, j) in `only`, no others come back: the cuts of a shard depend on its nodes alone, so they
    are the same again.
    """
    shard = Window.partitionBy("key")
    # The pairs with a shard's smallest and largest node are judged by now, so these can go; a shard whose other nodes
    # are one component has nothing left, and of shards with the same nodes one is enough.
    if only is not None:
        shards = shards.join(only.select("key").distinct(), "key", "semi")
    others = shards.filter("node <> head and node <> last").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    others = others.select("key", "node", "label")
    open_ = (
        others.groupBy("key")
        .agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("count"),
            F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .filter("low <> high").groupBy("count", "x", "y").agg(F.min("key").alias("key"))
    )
    mixed = others.join(open_.select("key"), "key", "semi")
    order = shard.orderBy("n", "node")
    cuts = (
        mixed.select("key", "node", "label").join(points.select("node", "n"), "node")
        .withColumn("cut", F.floor((F.row_number().over(order) - 1) / params.cut).cast("int"))
        .withColumn("cuts", F.max("cut").over(shard) + 1)
    )
    pair = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda k: F.struct(F.least(k, F.col("cut")).alias("i"), F.greatest(k, F.col("cut")).alias("j")),
    )
    groups = cuts.select("key", "node", "label", "n", "cut", F.explode(pair).alias("pair")).select(
        "key", F.col("pair.i").cast("long").alias("i"), F.col("pair.j").cast("long").alias("j"), "cut", "node", "label", "n"
    )
    if only is not None:
        groups = groups.join(only, ["key", "i", "j"], "semi")
    return groups


def _searched(groups: DataFrame, column: DataFrame, search, schema: str) -> DataFrame:
    """What `search` gives for whole groups, sorted, with a column more of their nodes."""
    # The column is most of a row, so it comes last and moves to the tasks only.
    dealt = groups.join(column, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(search, schema)


def linked(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, node, component_id for every row of `docs` (doc_id long, text string).

    Null, empty and blank texts have no shingles: n_shingles 0, node null, and the row is its own
    component. Rows with equal sets are one node. Null ids are kept; a component's id is its smallest
    id that is not null. Rows are never merged, so repeated rows come back as often as they came. Other
    columns are ignored. A node is a 64-bit hash of the set. An empty table gives an empty table.
    """
    percent = params.percent
    signed = written(signatures(docs, params), "signatures")
    shard = Window.partitionBy("key")
    spread = signed.filter("keys is not null").select(F.explode("keys").alias("key"), "node")
    shards = written(
        spread.select("key", "node", F.min("node").over(shard).alias("head"), F.max("node").over(shard).alias("last"))
        .filter("head <> last")
        .distinct(),
        "shards",
    )
    # The keys are most of the table and needed no more.
    sig = written(signed.drop("keys"), "signatures")
    discard(signed)
    nodes = written(
        sig.filter("node is not null")
        .groupBy("node")
        .agg(F.max("n").alias("n"), F.max("point").alias("point"), F.max("coarse").alias("coarse"), F.min("doc_id").alias("doc_id")),
        "nodes",
    )
    points = nodes.select("node", "n", "point")
    stars = (
        shards.select(F.explode(F.array("head", "last")).alias("a"), F.col("node").alias("b")).filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    # Sizes and the fewest coordinates rule out most pairs, before whole points move.
    stars = written(_bounded(stars, nodes, "coarse", percent), "stars")
    judged = written(_bounded(stars, nodes, "point", percent), "judged")
    first = _links(judged, docs, nodes, params)
    discard(stars, judged)
    label = components(first)

    point = points.select("node", "point")
    cross = written(_searched(_in_groups(shards, points, label, params), point, _tree_pairs(params, params.first), _CROSS).distinct(), "cross")
    more = _links(cross.filter("a is not null").select("a", "b"), docs, nodes, params)
    both = written(first.union(more), "links")
    discard(first, more)
    first, label = both, components(both)
    # A group without more pairs than it gave has been judged whole and need not be searched again.
    again = cross.filter("key is not null").select("key", "i", "j")
    if not again.isEmpty():
        groups = _in_groups(shards, points, label, params, again)
        left = written(_searched(groups, point, _tree_nodes(params), _GROUPED), "left")
        sets = _sets(docs, nodes, left.select("node").distinct(), params)
        more = written(_searched(left, sets, _group_links(params), "a long, b long").distinct(), "links")
        both = written(first.union(more), "links")
        discard(first, left, sets, more)
        first, label = both, components(both)
    discard(shards, first, cross)

    roots = nodes.join(label, "node", "left").select(
        "node", F.coalesce("label", "node").alias("label"), F.col("doc_id").alias("first_id")
    )
    smallest = roots.groupBy("label").agg(F.min("first_id").alias("component"))
    by_node = roots.join(smallest, "label").select("node", "component")
    out = sig.select("doc_id", F.col("n").alias("n_shingles"), "node").join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", "node", component.alias("component_id"))


def _bounded(pairs: DataFrame, nodes: DataFrame, point: str, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and points allow the threshold."""
    points = nodes.select("node", "n", point)
    both = pairs.join(points.toDF("b", "n_b", "point_b"), "b").join(points.toDF("a", "n_a", "point_a"), "a")
    both = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    shared = both.withColumn("shared", _overlap(F.col("point_a"), F.col("point_b")))
    return shared.filter(_enough(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, params: JoinParams) -> DataFrame:
    """Of a written table of pairs, those that really link, written."""
    sets = _sets(docs, nodes, _ends(pairs), params)
    found = written(_verified(pairs, sets, params), "links")
    discard(sets)
    return found


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _node_udf(words: int):
    @pandas_udf("long")
    def node(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _Hashes()
        for text in texts:
            sets = (shingle_set(t, words, cache) for t in text)
            yield pd.Series([node_of(s) if len(s) else None for s in sets], dtype="Int64")

    return node


def _set_rows(words: int):
    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Hashes()
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                found = [shingle_set(t, words, cache) for t in part["text"]]
                nodes = pd.Series([node_of(s) if len(s) else None for s in found], dtype="Int64")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "of": nodes, "shingles": [s.tobytes() for s in found]})

    return sets


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, params: JoinParams) -> DataFrame:
    """The shingle set of each wanted node; a bitmap of ids keeps all other texts out of the shuffle."""
    where = written(nodes.join(wanted, "node", "semi").select("node", "doc_id"), "wanted")
    some = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    some = in_bitmap(some.filter("text is not null"), "id", where, "doc_id", "hit").filter("hit")
    some = some.select(F.col("id").cast("string").alias("id"), "text")
    some = some.mapInPandas(_set_rows(params.words), "id string, of long, shingles binary").withColumn("id", F.col("id").cast("long"))
    found = some.join(where, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("node")))
    row = Window.partitionBy("node", "doc_id").orderBy("of")
    one = found.withColumn("row", F.row_number().over(row)).filter("row = 1")
    sets = written(one.select("node", "shingles"), "sets")
    discard(where)
    return sets


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """The rows of `docs` that stay: of each component the one with the smallest id, all columns kept.

    Rows without shingles stay. Of fully repeated rows one stays. Untouched rows are never shuffled.
    """
    rows = written(linked(docs, params).filter("node is not null"), "linked")
    pairs = rows.groupBy("component_id", "doc_id", "node").agg(F.count(F.lit(1)).alias("copies"))
    best = pairs.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("node").alias("node"))).alias("best")
    )
    judged = pairs.join(best, pairs["component_id"].eqNullSafe(best["component_id"])).select(
        F.col("doc_id").alias("__id"), F.col("node").alias("__of"), "copies",
        (F.col("best.id").eqNullSafe(F.col("doc_id")) & (F.col("best.node") == F.col("node"))).alias("__stays"),
    )
    touched = written(judged.filter("copies > 1 or not __stays").select("__id", "__of", "__stays"), "touched")
    marked = in_bitmap(docs.withColumn("__key", F.col("doc_id").cast("long")), "__key", touched, "__id", "__hit").drop("__key")
    rest = marked.filter("not __hit").drop("__hit")
    some = marked.filter("__hit").drop("__hit").withColumn("__node", _node_udf(params.words)(F.col("text")))
    seen = some.join(touched, some["doc_id"].eqNullSafe(touched["__id"]) & (some["__node"] == touched["__of"]), "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__node").orderBy("__stays"))
    kept = seen.withColumn("__nth", nth).filter("__stays is null or (__stays and __nth = 1)")
    return rest.unionByName(kept.select(*docs.columns))
