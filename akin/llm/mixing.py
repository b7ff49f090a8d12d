"""Mix sources to target weights by systematic sampling.

Every document of a source expects `target / size of the source` copies. The expected copies are summed
up along the documents of the source, a random offset is added, and a document is emitted once for each
integer that its stretch crosses. Documents are lined up by size, so that neighbours stand in for each
other and the words taken come near the target.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.llm.common import with_running
from akin.sources.scratch import written


@dataclass(frozen=True)
class MixParams:
    """Weights go round the sources in order; `share` of all words is taken; no source over `most`."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    seed: int = 11

    @property
    def offset(self) -> float:
        return random.Random(self.seed).random()


def n_words(text: Column) -> Column:
    """The number of stretches without white space (blank, tab to carriage return); null: 0."""
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    blanks = F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))
    return F.when(F.coalesce(F.length(squeezed), F.lit(0)) == 0, F.lit(0)).otherwise(blanks + 1).cast("long")


def targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Sources (source, source_size) with their target in words, and their weight.

    Sources by code point, null last, get the weights in turn. A source stops at `most` times its size;
    what it leaves is shared anew by weight. Filled in closed form: sources that stop are those with
    the least room for their weight. There is one row per source; they meet in one window.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in params.weights)), F.col("turn"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(params.weights) + 1
    weighed = sizes.withColumn("turn", turn.cast("int")).withColumn("weight", w).drop("turn")
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(params.most))
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything) * F.lit(params.share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / weights).withColumn("stops", F.col("cap") / F.col("weight") <= F.col("level"))
    free = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * free)
    return level.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of `docs`.

    Null texts have size 0; rows with a null source are a source of their own. Repeated rows are
    documents of their own. A source without words has target 0, and its documents get no copy. Ties
    go by doc_id. Other columns are ignored. An empty table gives an empty one.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text").cast("string")).alias("size"),
    )
    sized = written(sized.withColumn("one", F.lit(1)), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), params)
    lined = with_running(sized, ["source"], [F.desc("size"), F.col("doc_id")], "one", "before")
    # One row per source; Spark broadcasts them if they are few.
    named = sources.withColumnRenamed("source", "of")
    joined = lined.join(named, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.lit(params.offset)
    crossed = F.floor((F.col("before") + 1) * rate + offset) - F.floor(F.col("before") * rate + offset)
    copies = F.least(crossed, F.lit(int(params.most))).cast("long")
    return joined.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The rows of `docs`, each as often as the plan says, all columns kept.

    The plan is joined by (doc_id, source, size). Rows that share all three share their copies evenly.
    """
    key = ["doc_id", "source", "size"]
    counts = plan(docs, params).groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    counts = counts.filter("__copies > 0").select(*(F.col(c).alias(f"__{c}") for c in key), "__copies", "__rows")
    marked = docs.withColumn("__words", n_words(F.col("text").cast("string")))
    on = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    joined = marked.join(counts, on)
    alone = joined.filter("__rows = 1").withColumn("__times", F.col("__copies"))
    same = Window.partitionBy("__doc_id", "__source", "__size").orderBy("text")
    shared = joined.filter("__rows > 1").withColumn("__nth", F.row_number().over(same).cast("long"))
    upto = lambda n: F.floor(n * F.col("__copies") / F.col("__rows"))
    shared = shared.withColumn("__times", (upto(F.col("__nth")) - upto(F.col("__nth") - 1)).cast("long")).drop("__nth")
    both = alone.unionByName(shared).filter("__times > 0")
    return both.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def oracle(params: MixParams = MixParams()) -> str:
    """DuckDB SQL for the plan (without copies)."""
    weights = "[" + ", ".join(f"{float(w)!r}::DOUBLE" for w in params.weights) + "]"
    return f"""
    WITH sized AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
      FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
    ), weighed AS (
      SELECT *, {weights}[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % {len(params.weights)} + 1] AS weight,
        source_size * {params.most!r}::DOUBLE AS cap FROM sources
    ), levels AS (
      SELECT *, ((sum(source_size) OVER ())::DOUBLE * {params.share!r}::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM weighed
    ), aimed AS (
      SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap
        ELSE weight * max(level) FILTER (cap / weight > level) OVER () END AS target FROM levels
    ), lined AS (
      SELECT s.*, a.source_size, a.target, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY s.source ORDER BY s.size DESC, s.doc_id NULLS FIRST) - 1 AS k
      FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
    )
    SELECT doc_id, size, source_size, target,
      (size * least(floor((k + 1) * rate + {params.offset!r}::DOUBLE) - floor(k * rate + {params.offset!r}::DOUBLE),
        {int(params.most)}))::BIGINT AS taken
    FROM lined
    """
