"""Removing repeated passages of at least `length` bytes by longest previous factors.

The suffix array of a corpus does not fit a task, so suffixes are dealt out such that equal ones meet:

1. Every stretch of `length` bytes has an anchor, the string of `anchor` bytes with the smallest hash in it
   (the first one, if there are several). Equal stretches have equal anchors at the same place. Neighbouring
   stretches mostly share theirs, so a document is a chain of runs of stretches, one anchor each.
2. Anchors that the corpus has once cannot belong to a repeat and go no further. Runs with equal
   bytes are collapsed: all but the first are repeats as a whole, and need no text.
3. Where an anchor has several different runs left, their bytes are fetched and the runs of an anchor are
   sorted by suffix (prefix doubling). In suffix order a stretch has an earlier match if the previous or the
   next smaller position lies in its run of suffixes with equal `length` bytes: its longest previous
   factor reaches `length`.
4. An anchor with more than `group` different runs is dealt by a longer string around it: the stretches
   are halved by their distance to the anchor, and each half has more bytes in common than the whole.
   This goes on until the groups are small or their stretches equal, so nothing is cut or left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akin.llm.common import having, in_bitmap
from akin.sources.scratch import written


@dataclass(frozen=True)
class RepeatParams:
    """Bytes of a repeat and of an anchor, most different runs of a group, bytes worked on at once."""

    length: int = 100
    anchor: int = 40
    group: int = 4096
    batch: int = 1 << 18
    piece: int = 1 << 22


_MASK = np.uint64((1 << 24) - 1)


def anchor_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes, put together from those of powers of two."""
    base = 0x9E3779B97F4A7C15
    hashes, factor, n = [(1, data.astype(np.uint64) + np.uint64(1), base)], base, 1
    while 2 * n <= size:
        h = hashes[-1][1]
        hashes.append((2 * n, h[:-n] * np.uint64(factor) + h[n:], factor * factor % (1 << 64)))
        n, factor = 2 * n, factor * factor % (1 << 64)
    many, done, out = len(data) - size + 1, 0, np.zeros(len(data) - size + 1, dtype=np.uint64)
    for n, h, factor in reversed(hashes):
        if done + n <= size:
            out = out * np.uint64(factor) + h[done : done + many]
            done += n
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, params: RepeatParams):
    """Place of the anchor of each stretch of `length` bytes, and the hashes by place."""
    h = anchor_hashes(data, params.anchor)
    width = params.length - params.anchor + 1
    least, n = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    many = len(h) - width + 1
    least = np.minimum(least[:many], least[width - n : width - n + many])
    return (least & _MASK).astype(np.int64), h


def runs(texts: list[bytes], params: RepeatParams) -> Iterator[tuple]:
    """Per batch of texts: arrays of text number, first stretch, last stretch, anchor and its hash."""
    todo, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text) - params.length + 1, params.piece):
            # Pieces overlap, so that each stretch lies in one of them.
            part = text[at : at + params.piece + params.length - 1]
            todo.append((number, at, part))
            size += len(part)
            if size >= params.batch:
                yield _runs(todo, params)
                todo, size = [], 0
    if todo:
        yield _runs(todo, params)


def _runs(parts: list[tuple[int, int, bytes]], params: RepeatParams):
    number, base = (np.array([p[i] for p in parts], dtype=np.int64) for i in (0, 1))
    sizes = np.array([len(p[2]) for p in parts])
    begin = np.cumsum(sizes) - sizes
    place, h = anchors(np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8), params)
    new = np.empty(len(place), dtype=bool)
    new[0] = True
    np.not_equal(place[1:], place[:-1], out=new[1:])
    new[begin] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    part = np.searchsorted(begin, first, side="right") - 1
    # The stretches that reach into the next text are none.
    stop = begin[part] + sizes[part] - params.length
    real = first <= stop
    part, first, last = part[real], first[real], np.minimum(last, stop)[real]
    anchor = place[first]
    shift = base[part] - begin[part]
    return number[part], first + shift, last + shift, anchor + shift, h[anchor].view(np.int64)


KEY = ["late", "doc", "tag"]
_KEY = "late int, doc long, tag long"


def keyed(docs: DataFrame) -> DataFrame:
    """late, doc, tag, text: null ids are late; a tag tells texts of one id apart, mostly it is 0."""
    base = docs.select(
        F.col("doc_id").isNull().cast("int").alias("late"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("id_hash", F.xxhash64("late", "doc"))
    text = F.xxhash64("text")
    ids = base.groupBy("late", "doc").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a <> b")
    several = written(ids.select(F.xxhash64("late", "doc").alias("id_hash")), "several")
    marked = in_bitmap(base, "id_hash", several, "id_hash", "several")
    return marked.select("late", "doc", F.when(F.col("several"), text).otherwise(F.lit(0)).alias("tag"), "text")


def _columns(batch: pa.RecordBatch, at: np.ndarray) -> dict:
    return {c: batch.column(c).take(pa.array(at)) for c in KEY}


def repeated_runs(base: DataFrame, params: RepeatParams) -> DataFrame:
    """KEY, h, r, s, e, p: the runs of anchors that occur twice; r is a hash of the run's bytes."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in runs([t.as_py().encode() for t in batch.column(0)], params):
                yield pa.RecordBatch.from_pydict({"h": found[4]})

    counts = base.select("text").mapInArrow(hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    twice = written(counts.filter("n > 1").select("h"), "anchors")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column("text")]
            for number, s, e, p, h in runs(texts, params):
                ends = zip(number.tolist(), s.tolist(), (e + params.length).tolist())
                r = [xxhash.xxh3_64_intdigest(texts[n][a:b]) for n, a, b in ends]
                r = np.array(r, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({**_columns(batch, number), "h": h, "r": r, "s": s, "e": e, "p": p})

    every = base.mapInArrow(rows, f"{_KEY}, h long, r long, s long, e long, p long")
    return written(having(every, "h", twice, "h"), "runs")


def collapsed(rows: DataFrame, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of rows that agree in `same`: the later ones as spans (KEY, s, e), and the first ones."""
    place = F.struct("late", "doc", "s")
    first = rows.groupBy(*same).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first, "firsts").select(*(F.col(c).alias(f"_{c}") for c in same), "first", "n")
    on = [F.col(c) == F.col(f"_{c}") for c in same]
    # A group of one needs no comparison.
    both = rows.join(first.filter("n > 1"), on, "left")
    both = written(both.select(*rows.columns, (place > F.col("first")).alias("later")), "compared")
    firsts = both.filter("later is null or not later").drop("later")
    return both.filter("later"), firsts


def fetched(base: DataFrame, wanted: DataFrame, params: RepeatParams) -> DataFrame:
    """The runs of `wanted` with their bytes: KEY, key, s, at (distance of the anchor), low, high, data.

    Only texts of documents with such runs move.
    """
    by_doc = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("h", "s", "e", "p")).alias("runs"))
    by_doc = written(by_doc.withColumn("k", F.xxhash64(*KEY)), "wanted")
    some = in_bitmap(base.withColumn("k", F.xxhash64(*KEY)), "k", by_doc, "k", "here").filter("here")
    joined = some.select(*KEY, "text").distinct().join(by_doc, KEY).select(*KEY, "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, found) in enumerate(zip(batch.column("text"), batch.column("runs"))):
                raw, found = text.as_py().encode(), found.as_py()
                n = len(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        **_columns(batch, np.full(n, i)),
                        "key": pa.array([x["h"] for x in found], pa.int64()),
                        "s": pa.array([x["s"] for x in found], pa.int64()),
                        "at": pa.array([x["p"] - x["s"] for x in found], pa.int32()),
                        "low": pa.array([0] * n, pa.int32()),
                        "high": pa.array([params.length - params.anchor] * n, pa.int32()),
                        "data": pa.array([raw[x["s"] : x["e"] + params.length] for x in found], pa.binary()),
                    }
                )

    return joined.mapInArrow(cut, _PIECE)


_PIECE = f"{_KEY}, key long, s long, at int, low int, high int, data binary"


def halves(pieces: DataFrame, params: RepeatParams) -> DataFrame:
    """Each piece as the stretches near its anchor and those far from it, keyed by what each half shares."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                middle = (row.low + row.high) // 2
                for low, high in ((row.low, middle), (middle + 1, row.high)):
                    # The anchor lies `at` bytes behind the first stretch and `nearest` behind the last.
                    nearest = row.at - (len(row.data) - params.length)
                    far, near = min(row.at, high), max(nearest, low)
                    if far < near:
                        continue
                    start, stop = row.at - far, row.at - near + params.length
                    shared = row.data[row.at - low : row.at - high + params.length]
                    key = xxhash.xxh3_64_intdigest(shared + bytes([low, high])) - (1 << 63)
                    data = row.data[start:stop]
                    out.append((row.late, row.doc, row.tag, key, row.s + start, far, low, high, data))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])

    return pieces.mapInPandas(split, _PIECE)


def earlier_matches(data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes (at `starts`, of `length` bytes at least) have a longest previous factor of `length`.

    `position` orders the suffixes in the corpus; a suffix is earlier than another if it has a smaller one.
    """
    # Ranks by the first 8, 16, 32 ... bytes at every place.
    padded = np.concatenate([data, np.zeros(length + 8, dtype=np.uint8)])
    rank = np.zeros(len(data), dtype=np.uint64)
    size = min(8, length)
    for i in range(size):
        rank = (rank << np.uint64(8)) | padded[i : i + len(data)]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    many = np.uint64(len(data) + 1)

    def joined(at: np.ndarray, step: int) -> np.ndarray:
        behind = rank[np.minimum(at + step, len(data) - 1)]
        return np.unique(rank[at] * many + behind, return_inverse=True)[1].astype(np.uint64)

    every = np.arange(len(data))
    while 2 * size <= length:
        rank = joined(every, size)
        size *= 2
    order = joined(starts, length - size) if size < length else rank[starts]
    # The suffix array, and the runs of suffixes that agree in `length` bytes.
    suffixes = np.argsort(order, kind="stable")
    run = order[suffixes].astype(np.int64)
    place = position[suffixes]
    step = np.int64(place.max() + 1) if len(place) else np.int64(1)
    # A previous smaller position exists in the run if the smallest one so far is smaller; a later run
    # is put below the ones before it, so that they do not count. Likewise from the other end.
    down, up = place - run * step, place + run * step
    earlier = np.zeros(len(place), dtype=bool)
    earlier[1:] = np.minimum.accumulate(down)[:-1] < down[1:]
    earlier[:-1] |= np.minimum.accumulate(up[::-1])[::-1][1:] < up[:-1]
    out = np.empty(len(starts), dtype=bool)
    out[suffixes] = earlier
    return out


def matched(pieces: DataFrame, params: RepeatParams) -> DataFrame:
    """Spans (KEY, s, e) of stretches with an earlier match; groups by key, many of them to a task."""
    length = params.length
    n = pieces.count()
    tasks = max(1, -(-n // params.group))
    schema = f"{_KEY}, s long, e long"

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = np.array([len(x) for x in frame["data"]])
        data = np.frombuffer(b"".join(frame["data"]), dtype=np.uint8)
        counts = sizes - length + 1
        piece = np.repeat(np.arange(len(frame)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(sizes) - sizes)[piece] + inside
        s = frame["s"].to_numpy()[piece] + inside
        late, doc = frame["late"].to_numpy()[piece], frame["doc"].to_numpy()[piece]
        order = np.lexsort((s, doc, late))
        new = np.zeros(len(order), dtype=np.int64)
        new[1:] = (np.diff(s[order]) != 0) | (np.diff(doc[order]) != 0) | (np.diff(late[order]) != 0)
        position = np.empty(len(order), dtype=np.int64)
        position[order] = np.cumsum(new)
        hit = np.flatnonzero(earlier_matches(data, starts, position, length))
        if not len(hit):
            return pd.DataFrame({c: [] for c in ("late", "doc", "tag", "s", "e")}).astype(np.int64)
        # Hits in a row are one span.
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(piece[hit]) != 0)) + 1
        first, last = hit[np.concatenate([[0], cut])], hit[np.append(cut, len(hit)) - 1]
        rows = frame[KEY].iloc[piece[first]].reset_index(drop=True)
        return rows.assign(s=s[first], e=s[last] + length)

    dealt = pieces.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(find, schema)


def spans(base: DataFrame, params: RepeatParams) -> DataFrame:
    """KEY, s, e: spans of bytes with an earlier match; they may overlap."""
    length = params.length
    later, firsts = collapsed(repeated_runs(base, params), ["h", "r"])
    found = [later.select(*KEY, "s", (F.col("e") + length).alias("e"))]
    variants = firsts.groupBy("h").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    # The stretches of one run lie at different distances from its anchor, so none of them equals another.
    several = written(variants.filter("lo <> hi").select("h"), "several-runs")
    level = written(fetched(base, firsts.join(several, "h", "left_semi"), params), "pieces")
    while True:
        hot = written(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > params.group), "hot")
        found.append(written(matched(level.join(hot, "key", "left_anti"), params), "matches"))
        if hot.isEmpty():
            break
        later, firsts = collapsed(written(halves(level.join(hot, "key", "left_semi"), params), "halves"), ["key", "data"])
        found.append(later.select(*KEY, "s", (F.col("s") + F.length("data")).alias("e")))
        level = firsts
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def without_repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier in the corpus.

    `docs` has doc_id and text. Earlier is a smaller doc_id, or an earlier start in the same document; null ids
    come last. Strings are judged on the input, not on what is left; they never cross documents and may
    overlap. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed stretches) and kept (binary,
    the other bytes) for every row. Null texts are empty. Rows of one doc_id are one document: among
    them only the start counts, so repeated rows do not remove each other. Other columns are ignored.
    """
    base = keyed(docs.select("doc_id", "text"))
    ranges = F.sort_array(F.collect_set(F.struct("s", "e")))
    by_doc = spans(base, params).groupBy(*KEY).agg(ranges.alias("spans"))
    by_doc = written(by_doc.withColumn("k", F.xxhash64(*KEY)), "spans")
    flagged = in_bitmap(base.withColumn("k", F.xxhash64(*KEY)), "k", by_doc, "k", "here")
    whole = flagged.filter("not here").select("late", "doc", "text", F.lit(None).alias("spans"))
    cut = flagged.filter("here").select(*KEY, "text").join(by_doc.drop("k"), KEY, "left").select("late", "doc", "text", "spans")

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def remove(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, some in zip(texts, found):
            raw = text.encode()
            if some is None or not len(some):
                rows.append((0, 0, raw))
                continue
            kept, removed, n, end = [], 0, 0, 0
            for span in some:
                s, e = span["s"], span["e"]
                if s > end or n == 0:
                    kept.append(raw[end:s])
                    n += 1
                    end = s
                removed += max(0, e - end)
                end = max(end, e)
            rows.append((removed, n, b"".join([*kept, raw[end:]])))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    doc_id = F.when(F.col("late") == 0, F.col("doc")).alias("doc_id")
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    return whole.select(
        doc_id, n_bytes, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.encode("text", "UTF-8").alias("kept"),
    ).unionByName(cut.withColumn("r", remove("text", "spans")).select(doc_id, n_bytes, "r.n_removed", "r.n_spans", "r.kept"))
