"""Values at given ranks of a column that is never sorted or gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int]) -> list:
    """The values at 0-based ranks of the non-null values in order; None beyond the last.

    Each pass counts the values of the intervals that hold a wanted rank in equal buckets, and
    narrows the rank down to one bucket, until a bucket holds a single value. A pass brings back
    bucket counts only, and they are combined before the shuffle, so a hot value costs nothing.
    """
    values = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull())
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    solved: dict[int, object] = {}
    # (low, high) of an interval -> (values below it, wanted ranks inside it)
    wanted = sorted({r for r in ranks if r < n})
    intervals = {(low, high): (0, wanted)} if wanted else {}
    while intervals:
        narrow = {}
        for (lo, hi), (before, inside) in intervals.items():
            if lo == hi:
                solved.update(dict.fromkeys(inside, lo))
            else:
                narrow[(lo, hi)] = (before, inside)
        intervals = _narrowed(values, narrow) if narrow else {}
    return [solved.get(r) for r in ranks]


def _narrowed(values: DataFrame, intervals: dict) -> dict:
    """One pass: each interval cut to the buckets that hold its wanted ranks."""
    keys = list(intervals)
    number = F.coalesce(
        *(F.when(F.col("v").between(lo, hi), F.lit(i)) for i, (lo, hi) in enumerate(keys))
    )
    bucket = F.coalesce(
        *(
            F.when(
                F.col("i") == i,
                F.least(
                    F.floor((F.col("v") - lo) / max((hi - lo) / BUCKETS, 5e-324)),
                    F.lit(BUCKETS - 1),
                ),
            )
            for i, (lo, hi) in enumerate(keys)
        )
    )
    counts = (
        values.withColumn("i", number)
        .filter(F.col("i").isNotNull())
        .groupBy("i", bucket.alias("b"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .orderBy("i", "lo")
        .collect()
    )
    out = {}
    for i, key in enumerate(keys):
        before, inside = intervals[key]
        for row in (r for r in counts if r.i == i):
            here = [r for r in inside if before <= r < before + row.n]
            if here:
                out[(row.lo, row.hi)] = (before, here)
            before += row.n
    return out
