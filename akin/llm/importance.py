"""Resampling towards a target distribution: hashed n-gram weights, Gumbel noise, and a radix sort.

1. Every run of one to `runs` words is hashed into one of `buckets` counters. The corpus and the target are
   counted once each; the gain of a bucket is the logarithm of the two smoothed shares divided.
2. The weight of a document is the mean gain of its features, found with one array look-up.
3. Weight plus Gumbel noise, which depends on the id and the seed alone, is the score; the best scores
   are a sample without replacement in proportion to the weights.
4. The order comes from a radix sort, last digit first. Each pass counts the digits of every part, sums the
   counts up to the first place of each (digit, part), and sends a row to that place plus its own
   number within the part. No pass compares keys, and no task holds more than a part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.llm.common import partitions
from akin.sources.scratch import written


@dataclass(frozen=True)
class ResampleParams:
    """Counters, words of a run, share drawn in per cent, least words, seed; digits and parts of the sort."""

    buckets: int = 10_000
    runs: int = 2
    percent: int = 25
    min_words: int = 20
    seed: int = 7
    digit_bits: int = 11
    part_rows: int = 1_000_000


# Letters A-Z become small; all other ASCII but digits and a-z parts words; other bytes belong to words.
_TABLE = bytes(
    b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_BLOCK = 1 << 20


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text as UTF-8, in order, in blocks of about a megabyte."""
    data = (text or "").encode().translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def feature_blocks(text: str | None, params: ResampleParams) -> Iterator[tuple[int, np.ndarray]]:
    """Block by block: the number of words, and the bucket of each feature that ends there."""
    # The last words of a block begin runs that end in the next one.
    tail: list[bytes] = []
    for words in word_blocks(text):
        joined, first = tail + words, len(tail)
        hashes = [zlib.crc32(w) for w in joined]
        found = hashes[first:]
        for length in range(2, params.runs + 1):
            # A run's hash goes on from that of the run without its last word.
            hashes = [zlib.crc32(b" " + w, h) for h, w in zip(hashes, joined[length - 1 :])]
            found += hashes[max(0, first - length + 1) :]
        yield len(words), np.array(found, dtype=np.int64) % params.buckets
        tail = joined[len(joined) - params.runs + 1 :] if params.runs > 1 else []


def bucket_counts(texts: DataFrame, params: ResampleParams) -> DataFrame:
    """bucket, n: features of all rows of `texts` (column text); each task sends one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(params.buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_blocks(text.as_py(), params):
                    np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int64), "n": total[at]})

    parts = texts.select("text").mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, params: ResampleParams) -> np.ndarray:
    """Gain of each bucket in thousandths; at most `buckets` rows of each side come to the driver."""

    def counted(texts: DataFrame) -> list[int]:
        counts = [0] * params.buckets
        for row in bucket_counts(texts, params).collect():
            counts[row["bucket"]] = row["n"]
        return counts

    s, t = counted(corpus), counted(target)
    all_s, all_t = float(sum(s) + params.buckets), float(sum(t) + params.buckets)
    return np.array(
        [math.floor(1000 * math.log((y + 1.0) * all_s / ((x + 1.0) * all_t))) for x, y in zip(s, t)], dtype=np.int64
    )


def weighed(docs: DataFrame, gain: np.ndarray, params: ResampleParams) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            n_words = n = total = 0
            for words, found in feature_blocks(text, params):
                n_words, n, total = n_words + words, n + len(found), total + int(gain[found].sum())
            rows.append((n_words, n, total // n if n else 0))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), weigh("text").alias("w")).select("doc_id", "w.*")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths out of the SHA-256 of seed and id; a null id counts as no characters."""
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def digits_of(value: Column, span: int, bits: int) -> list[Column]:
    """The digits of whole numbers from 0 to `span`, the lowest first."""
    return [
        F.call_function("shiftright", value, F.lit(at)).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        for at in range(0, max(1, span.bit_length()), bits)
    ]


def radix_sorted(rows: DataFrame, keys: list[tuple[Column, int]], params: ResampleParams, name: str) -> DataFrame:
    """`rows` with `name`: the place from 0 of each row in the order of `keys`, the most important first.

    A key is a column of whole numbers from 0 and the largest of them. Rows with equal keys take places one
    after the other. The rows of a part are those of the places of one stretch; in the first pass, those
    of one hash. Every pass ends in a scratch table, so a lost task cannot deal out other places.
    """
    kept, n_rows = rows.columns, rows.count()
    parts = max(partitions(rows.sparkSession), -(-n_rows // params.part_rows))
    stretch = max(1, -(-n_rows // parts))
    digits = [d for value, span in reversed(keys) for d in digits_of(value, span, params.digit_bits)]
    current = rows
    for nth, digit in enumerate(digits):
        if nth == 0:
            part, inside = F.pmod(F.xxhash64(*kept), F.lit(parts)), [F.col(c) for c in kept]
        else:
            part, inside = F.floor(F.col(name) / stretch), [F.col(name)]
        dealt = current.withColumn("__part", part.cast("int")).withColumn("__digit", digit)
        counts = dealt.groupBy("__part", "__digit").agg(F.count(F.lit(1)).alias("__n"))
        counts = written(counts, "digit-counts")
        before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # One row per digit: a bounded number, whatever the rows.
        whole = counts.groupBy("__digit").agg(F.sum("__n").alias("__n"))
        starts = whole.select("__digit", before(Window.orderBy("__digit")).alias("__start"))
        offsets = counts.select(
            "__part", "__digit", before(Window.partitionBy("__digit").orderBy("__part")).alias("__before")
        ).join(starts, "__digit")
        number = F.row_number().over(Window.partitionBy("__part", "__digit").orderBy(*inside))
        numbered = dealt.withColumn("__number", number).drop(name)
        placed = numbered.join(offsets, ["__part", "__digit"]).select(
            *kept, (F.col("__start") + F.col("__before") + F.col("__number") - 1).alias(name)
        )
        current = written(placed, "placed")
    return current


def resampled(docs: DataFrame, target: DataFrame, params: ResampleParams = ResampleParams()) -> DataFrame:
    """Draw `percent` of the documents of at least `min_words` words by importance towards `target`.

    Both need a column text, `docs` also doc_id. Returns doc_id, n_features, weight, score and rank for every
    row of `docs`: rank is 1 for the best score, ties to the smaller doc_id and null ids last; it is
    null for rows that are not drawn. Null texts have no words; a row without features weighs 0.
    Repeated rows are documents of their own and take ranks one after the other. Empty tables give an
    empty table, an empty target gives gains against a uniform one. Other columns are ignored.
    """
    gain = gains(docs, target, params)
    scored = weighed(docs, gain, params).withColumn("score", F.col("weight") + noise(F.col("doc_id"), params.seed))
    scored = written(scored, "scored")
    long_enough = scored.filter(F.col("n_words") >= params.min_words)
    ends = long_enough.agg(F.max("score"), F.min("score"), F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    high, low, first, last, n = ends
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < params.min_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    if n == 0:
        return rest
    first, last = (0, 0) if first is None else (first, last)
    # Ids as distances from the smallest one: of any range, in two halves of 32 bits if it must be.
    split = last - first + 1 >= 1 << 62
    if split:
        halves = [(F.call_function("shiftright", F.col("doc_id"), F.lit(32)) + (1 << 31), 1 << 32),
                  (F.col("doc_id").bitwiseAND(F.lit((1 << 32) - 1)), 1 << 32)]
        by_id = [(F.coalesce(value, F.lit(span)), span) for value, span in halves]
    else:
        by_id = [(F.coalesce(F.col("doc_id") - F.lit(first), F.lit(last - first + 1)), last - first + 1)]
    keys = [(F.lit(high) - F.col("score"), high - low), *by_id]
    place = radix_sorted(long_enough.select(*columns), keys, params, "place")
    drawn = params.percent * n // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return place.select(*columns, rank.cast("long").alias("rank")).unionByName(rest)


def oracle(params: ResampleParams = ResampleParams()) -> str:
    """DuckDB SQL for the query; the CRC is spelled out byte by byte."""
    return f"""
    WITH RECURSIVE steps AS (
      SELECT b::BIGINT AS b, 0 AS n, b::BIGINT AS c FROM range(256) t(b)
      UNION ALL SELECT b, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE n < 8
    ), crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
    texts AS (
      SELECT 1 AS side, row_number() OVER () AS row, doc_id, text FROM documents
      UNION ALL SELECT 2, row_number() OVER (), NULL, text FROM benchmark
    ), worded AS MATERIALIZED (
      SELECT side, row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
    ), runs AS MATERIALIZED (
      SELECT side, row, unnest(w) AS f FROM worded
      UNION ALL SELECT side, row, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM worded
    ), hashed AS MATERIALIZED (
      SELECT f, xor(list_reduce(
          [(('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT) FOR i IN range(1, strlen(f) + 1)],
          lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)
        % {params.buckets} AS bucket
      FROM (SELECT DISTINCT f FROM runs), crc
    ), used AS MATERIALIZED (SELECT side, row, bucket FROM runs JOIN hashed USING (f)),
    sums AS (
      SELECT bucket, count(*) FILTER (side = 1) AS s, count(*) FILTER (side = 2) AS t,
        sum(count(*) FILTER (side = 1)) OVER () AS all_s, sum(count(*) FILTER (side = 2)) OVER () AS all_t
      FROM used GROUP BY bucket
    ), gain AS (
      SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + {params.buckets})::DOUBLE
        / ((s + 1)::DOUBLE * (all_t + {params.buckets})::DOUBLE)))::BIGINT AS g FROM sums
    ), weights AS (
      SELECT row, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM used JOIN gain USING (bucket)
      WHERE side = 1 GROUP BY row
    ), scored AS (
      SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{params.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296)))::BIGINT AS score
      FROM worded LEFT JOIN weights USING (row) WHERE side = 1
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY n_words >= {params.min_words} ORDER BY score DESC, doc_id) AS place,
        count(*) OVER (PARTITION BY n_words >= {params.min_words}) AS n FROM scored
    )
    SELECT doc_id, n_features, weight, score,
      CASE WHEN n_words >= {params.min_words} AND place <= {params.percent} * n // 100 THEN place END AS rank FROM placed
    """
