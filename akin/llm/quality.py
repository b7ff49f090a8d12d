"""Quality rules whose thresholds adapt to each language and source, with DataFrame functions only.

Every measure of a text is put into a bucket of a mergeable quantile sketch: buckets whose width grows
with the value, so that a quantile is off by at most one part in 16. A sketch is the number of rows per
bucket; sketches of any parts of the data merge by adding these up. Thresholds are read from the
sketches of a language and source and joined back to the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.sources.scratch import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Measure:
    """A number per text, in thousandths; rows outside the fences fail.

    The fences stand `reach` times the distance of the quartiles from these, but at least `least` from
    the outer quartile: where nearly all rows are alike, a small difference is no fault.
    """

    name: str
    reach: float
    least: int
    low: bool = False


@dataclass(frozen=True)
class QualityParams:
    """Sketches of fewer rows than `enough` take the one of the language, then that of all rows."""

    measures: tuple[Measure, ...] = (
        Measure("symbols", 3.0, 150),
        Measure("dup_lines", 3.0, 400),
        Measure("repeats", 3.0, 300),
        Measure("runs", 3.0, 300),
        Measure("word_length", 5.0, 3000, low=True),
    )
    min_words: int = 20
    max_repeat_percent: int = 30
    enough: int = 50


def _window_hashes(words: Column):
    """Hashes of all runs of eight words: of two, of twice two, of twice four."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def doubled(h: Column, step: int) -> Column:
        ahead = F.slice(h, F.lit(step + 1), F.greatest(F.size(h), F.lit(1)))
        behind = F.slice(h, F.lit(1), F.greatest(F.size(h) - step, F.lit(0)))
        return F.zip_with(behind, ahead, lambda a, b: F.xxhash64(a, b))

    return hashed, doubled


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    A null text has no words and no lines; all five are 0. `__n_runs` has the number of words that
    equal the word before.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    squeezed = F.trim(F.regexp_replace(text, SPACE, " "))
    rows = docs.withColumn("__squeezed", squeezed)
    rows = rows.withColumn("__words", F.when(F.col("__squeezed") == "", F.array().cast("array<string>")).otherwise(F.split("__squeezed", " ")))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.translate("__squeezed", " ", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "__lines": lines,
        }
    )
    rows = rows.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    hashed, doubled = _window_hashes(F.col("__words"))
    rows = rows.withColumn("__h1", hashed).drop("__lines", "__squeezed", "__words")
    ahead = F.slice("__h1", F.lit(2), F.greatest(F.size("__h1"), F.lit(1)))
    same = F.filter(F.zip_with("__h1", ahead, lambda a, b: a == b), lambda x: x)
    rows = rows.withColumn("__n_runs", F.size(same))
    for step, name, before in ((1, "__h2", "__h1"), (2, "__h4", "__h2"), (4, "__h8", "__h4")):
        rows = rows.withColumn(name, doubled(F.col(before), step)).drop(before)
    placed = F.array_sort(F.transform("__h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size("__h8") > F.size(F.array_distinct("__h8"))
    rows = rows.withColumn("__placed", F.when(twice, placed).otherwise(_no_places())).drop("__h8")
    # Sorted by hash, a window that comes twice has an equal neighbour.
    here = F.col("__placed")
    pairs = F.zip_with(
        here, F.concat(F.slice(here, F.lit(2), F.greatest(F.size(here), F.lit(1))), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    rows = rows.withColumn("__pairs", F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])).drop("__placed")
    spots = F.array_sort(F.array_distinct(F.flatten(F.transform("__pairs", lambda p: F.array(p["a"]["i"], p["b"]["i"])))))
    rows = rows.withColumn("__spots", spots).drop("__pairs")
    covered = F.aggregate(
        "__spots",
        F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(8), i - acc["last"])).alias("n"), i.alias("last")),
    )["n"]
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("__spots")


def _no_places() -> Column:
    return F.array().cast("array<struct<h:bigint,i:int>>")


def _values() -> dict[str, Column]:
    """The measures, in thousandths, from the counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.floor(F.col("n_symbols") * 1000 / words),
        "dup_lines": F.floor(F.col("n_dup_lines") * 1000 / F.greatest(F.col("__n_lines"), F.lit(1))),
        "repeats": F.floor(F.col("n_repeat_words") * 1000 / words),
        "runs": F.floor(F.col("__n_runs") * 1000 / words),
        "word_length": F.floor(F.col("word_chars") * 1000 / words),
    }


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number from 0 on: exact below 32, then 16 buckets for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.when(value < 32, value).otherwise(shift * 16 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("long")


def floor_of(at: Column) -> Column:
    """The smallest value of a bucket."""
    shift = F.floor(at / 16) - 1
    return F.when(at < 32, at).otherwise((at - shift * 16) * F.pow(F.lit(2.0), shift)).cast("long")


def sketches(rows: DataFrame, names: list[str]) -> DataFrame:
    """lang, source, measure, bucket, n: mergeable, at most a few hundred buckets each."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), bucket(F.col(f"__{n}")).alias("bucket")) for n in names)))
    long = rows.select("__lang", "__source", each.alias("m")).select("__lang", "__source", "m.*")
    return long.groupBy("__lang", "__source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, keys: list[str], params: QualityParams) -> DataFrame:
    """keys, rows, and low and high fences of every measure."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket")
    summed = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("rows") * q, floor_of(F.col("bucket"))))
    quartiles = summed.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))
    fences = []
    for m in params.measures:
        here = F.col("measure") == m.name
        room = F.greatest(F.lit(m.reach) * (F.col("q3") - F.col("q1")), F.lit(float(m.least)))
        fences.append(F.max(F.when(here, F.col("q3") + room)).alias(f"high_{m.name}"))
        if m.low:
            fences.append(F.max(F.when(here, F.col("q1") - room)).alias(f"low_{m.name}"))
    return quartiles.groupBy(*keys).agg(F.max("rows").alias("rows"), *fences)


def judged(docs: DataFrame, params: QualityParams = QualityParams(), drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs`, without the columns of `drop`, with the counts of `measured`, base_failed and kept, for every row.

    base_failed: fewer than `min_words` words, or more than `max_repeat_percent` of them repeated. kept:
    not base_failed and inside all fences of the row's language and source. Null languages and sources
    are values of their own. Thresholds come from rows that pass the base rules; if a group has too few
    of them, those of the language count, then those of all rows, then none. Repeated rows are judged
    alike. Columns of `docs` with a name given here are replaced. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rest = docs.drop(*[c for c in own if c in docs.columns])
    ids = rest.withColumns(
        {
            "__lang": F.col("lang").cast("string"),
            "__source": F.col("source").cast("string"),
            "__n_lines": F.size(F.split(F.trim(text), "\n")),
        }
    )
    counted = measured(ids)
    names = [m.name for m in params.measures]
    counted = counted.withColumns({f"__{n}": v for n, v in _values().items() if n in names})
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    counted = written(counted.withColumn("base_failed", failed).drop(*drop), "measured")
    sketch = written(sketches(counted.filter("not base_failed"), names), "sketches")
    out = counted
    levels = (("a", ["__lang", "__source"]), ("b", ["__lang"]), ("c", []))
    for tag, keys in levels:
        found = thresholds(sketch, keys, params).filter(F.col("rows") >= params.enough)
        found = found.select(*(F.col(k).alias(f"__{tag}{k}") for k in keys), F.struct(*(c for c in found.columns if c not in keys)).alias(f"__t{tag}"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{tag}{k}"))
        if keys:
            out = out.join(found, on, "left")
        else:
            # One row for all rows together.
            only = found.first()
            kind = found.schema[f"__t{tag}"].dataType.simpleString()
            out = out.withColumn(f"__t{tag}", _literal(only, kind))
    out = out.withColumn("__t", F.coalesce("__ta", "__tb", "__tc"))
    fine = F.lit(True)
    for m in params.measures:
        fine = fine & (F.col(f"__{m.name}") <= F.col(f"__t.high_{m.name}"))
        if m.low:
            fine = fine & (F.col(f"__{m.name}") >= F.col(f"__t.low_{m.name}"))
    kept = ~F.col("base_failed") & F.coalesce(fine, F.lit(True))
    return out.withColumn("kept", kept).select(*(c for c in rest.columns if c not in drop), *own)


def _literal(row, kind: str) -> Column:
    if row is None:
        return F.lit(None).cast(kind)
    values = row[0].asDict()
    return F.struct(*(F.lit(v).alias(k) for k, v in values.items())).cast(kind)
