"""Top neighbours of every item: exact, in blocks, with copies scored once.

1. Items with the same features form one profile. Scores only depend on the features, so profiles
   are scored instead of items; of a group of copies, however large, the `top_n + 1` smallest ids
   are all that can ever be listed.
2. Profiles go into blocks of bounded size, like ones side by side. A task holds one block and scores it against
   itself and a window of the others. What it has found sets a floor for each row, and of the others only runs of rows
   that by a bound can reach it are multiplied; only the best partners of each row in all of them leave the task.
   When the windows do not hold all blocks, they come in rounds, and the best so far are merged after each.
3. The results of a profile are merged, spelled out into items, and given to its members.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.config import Weights
from akin.operators import pairmath
from akin.sources.scratch import DENSE, discard, written

MIN_BLOCK, MAX_BLOCK = 256, 8192
MAX_TASKS = 100_000
WINDOW_BYTES = 256 << 20  # packed blocks that a task reads beside its own in one round

PAYLOAD = (
    "genres",
    "platform_bucket",
    "type",
    "language_bucket",
    "term_ids",
    "weights",
)

_FOUND = (
    "scheme int, rep long, copies long, other long, score double, genre_score double, "
    "text_score double, metadata_score double, heads array<long>"
)


def with_profile(features: DataFrame) -> DataFrame:
    """Features with a key that is equal for equal features (whole numbers and strings only)."""
    content = F.to_json(
        F.struct("genres", "platform_bucket", "type", "language_bucket", "term_ids", "tfs")
    )
    return features.withColumn("profile", F.unhex(F.sha2(content, 256)))


def distinct_profiles(keyed: DataFrame, n_heads: int) -> DataFrame:
    """One row per profile: smallest id, the `n_heads` smallest ids, payload.

    `copies` is the number of heads, so it says whether there are copies, not how many. The limit on
    the window is applied before the shuffle as well, so a hot profile arrives as a few rows per task.
    """
    by_id = Window.partitionBy("profile").orderBy("id")
    return (
        keyed.withColumn("_n", F.row_number().over(by_id))
        .filter(F.col("_n") <= n_heads)
        .groupBy("profile")
        .agg(
            F.min("id").alias("rep"),
            F.sort_array(F.collect_list("id")).alias("heads"),
            *(F.any_value(c).alias(c) for c in PAYLOAD),
        )
        .withColumn("copies", F.size("heads").cast("long"))
    )


def counted_profiles(keyed: DataFrame) -> DataFrame:
    """One row per profile: smallest id, number of items, payload; combined before the shuffle."""
    return keyed.groupBy("profile").agg(
        F.min("id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        *(F.any_value(c).alias(c) for c in PAYLOAD),
    )


def block_count(n_rows: int, parallelism: int) -> int:
    """Enough blocks to bound their size, and enough block pairs to keep all cores busy."""
    for_memory = math.ceil(n_rows / MAX_BLOCK)
    for_cores = math.ceil(math.sqrt(8 * parallelism))
    return max(1, for_memory, min(for_cores, math.ceil(n_rows / MIN_BLOCK)))


# Rows that are alike in these stand side by side, so that one bound serves many of them.
ALIKE = ("language_bucket", "genres", "type", "platform_bucket", "rep")


def packed_blocks(profiles: DataFrame, columns: list[str], n_rows: int) -> tuple[DataFrame, int]:
    """(block, data): the rows of each block as one Arrow stream, and the number of blocks.

    Blocks are ranges of like rows; the ids break ties, so that they are bounded whatever is alike.
    """
    n_blocks = block_count(n_rows, profiles.sparkSession.sparkContext.defaultParallelism)
    schema = pa.schema([("block", pa.int32()), ("data", pa.binary())])
    pack = pairmath.packed

    def run(batches):
        rows = [batch for batch in batches if batch.num_rows]
        if rows:
            number = TaskContext.get().partitionId()
            table = pa.Table.from_batches(rows)
            table = table.append_column("block", pa.array(np.full(table.num_rows, number, np.int32)))
            yield from pa.table([[number], [pack(table)]], schema=schema).to_batches()

    rows = profiles.select(*columns).repartitionByRange(n_blocks, *ALIKE).sortWithinPartitions(*ALIKE)
    blocks = written(rows.mapInArrow(run, "block int, data binary"), "blocks")
    return blocks, blocks.agg(F.coalesce(F.max("block") + 1, F.lit(1))).first()[0]


def block_pairs(profiles: DataFrame, columns: list[str], n_rows: int, once: bool) -> DataFrame:
    """(lo, a, hi, b): all ordered pairs of packed blocks, or with `once` each unordered one.

    Nothing is copied to disk per pair: a task holds one block and reads a window of the others, which
    is bounded by its bytes. It gets all pairs of its block in one stream and can sum them up.
    """
    return paired(*packed_blocks(profiles, columns, n_rows), once)


def paired(blocks: DataFrame, n_blocks: int, once: bool) -> DataFrame:
    """The pairs of `block_pairs`, out of blocks that are packed already."""
    rounds = round_count(blocks, n_blocks)
    pairs = [paired_round(blocks, n_blocks, once, rounds, nth) for nth in range(rounds)]
    return reduce(DataFrame.union, pairs)


def round_count(blocks: DataFrame, n_blocks: int) -> int:
    """Rounds in which all blocks come up as the windows of tasks."""
    n_bytes = blocks.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    return max(1, math.ceil(n_bytes / (WINDOW_BYTES * _windows(blocks, n_blocks))))


def _windows(blocks: DataFrame, n_blocks: int) -> int:
    """Windows of one round: more than one only while there are fewer blocks than keep the cores busy."""
    return min(math.ceil(2 * blocks.sparkSession.sparkContext.defaultParallelism / n_blocks), n_blocks)


def paired_round(blocks: DataFrame, n_blocks: int, once: bool, rounds: int, nth: int) -> DataFrame:
    """Every block with those of one round, so that what tasks give back can be merged round by round."""
    windows = _windows(blocks, n_blocks)
    left = blocks.select(F.col("block").alias("lo"), F.col("data").alias("a"))
    right = blocks.select(F.col("block").alias("hi"), F.col("data").alias("b"))
    right = right.filter(F.pmod("hi", F.lit(rounds)) == nth)
    left = left.repartitionById(n_blocks, F.col("lo"))
    right = right.repartitionById(windows, F.pmod(F.floor(F.col("hi") / rounds), F.lit(windows)).cast("int"))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    if not once:
        return pairs
    # Every block meets half of the others, so that the tasks are alike.
    ahead = F.pmod(F.col("hi") - F.col("lo"), F.lit(n_blocks))
    return pairs.filter((2 * ahead < n_blocks) | ((2 * ahead == n_blocks) & (F.col("lo") < F.col("hi"))))


def in_rounds(blocks: DataFrame, n_blocks: int, once: bool, run, merged, last, label: str) -> DataFrame:
    """`last` of what `run` gives for all pairs of blocks, written down.

    One round of windows at a time, and `merged` takes what the rounds so far have given together: what lies on
    disk grows with the items, not with their number times that of the rounds.
    """
    rounds, done = round_count(blocks, n_blocks), None
    for nth in range(rounds):
        found = run(paired_round(blocks, n_blocks, once, rounds, nth))
        if done is not None:
            found = done.unionByName(found)
        before, done = done, written((merged if nth + 1 < rounds else last)(found), label, DENSE)
        if before is not None:
            discard(before)
    return done


def streamed_in_arrow(pairs: DataFrame, schema: str, score) -> DataFrame:
    """Run `score` on an iterator of (lo, hi, table with the rows of both) of each task; it gives tables."""
    template, unpack = _arrow_schema(schema), pairmath.unpacked

    def run(batches):
        for table in score(unpack(batches)):
            yield from table.cast(template).to_batches()

    return pairs.mapInArrow(run, schema)


def grouped_in_arrow(groups, schema: str, score) -> DataFrame:
    """Run `score(table, lo, hi)` on each group; a group without a result gives no rows."""
    template = _arrow_schema(schema)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        result = score(table, key[0].as_py(), key[1].as_py())
        return template.empty_table() if result is None else result.cast(template)

    return groups.applyInArrow(run, schema)


_ARROW = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "array<long>": pa.list_(pa.int64()),
}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in ddl.split(", "))])


def top_neighbours(
    features: DataFrame,
    schemes: tuple[Weights, ...] = (Weights(),),
    top_n: int = 20,
    min_similarity: float = 0.1,
    normalise: bool = True,
    metadata_mode: str = "mean",
) -> DataFrame:
    """(scheme, item_id, similar_item_id, similarity_score and the three component scores).

    The `top_n` best other items of every item with a score of at least `min_similarity`, ranked by
    score at nine decimals and then by id, for each weighting scheme.
    """
    mixes = tuple(w.effective(normalise) for w in schemes)
    keyed = with_profile(features)
    profiles = written(distinct_profiles(keyed, top_n + 1), "profiles")
    blocks, n_blocks = packed_blocks(profiles, ["rep", "copies", "heads", *PAYLOAD], profiles.count())
    copied = written(_copied(profiles), "copied")
    # Of the features, only what is read next stays on disk.
    discard(profiles)
    best_of = pairmath.best_of_stream

    def score(tables):
        return best_of(tables, mixes, top_n, min_similarity, metadata_mode)

    n = top_n + 1
    # Both branches below read the lists, and scoring must not run again when an executor is lost.
    lists = in_rounds(
        blocks, n_blocks, False, lambda pairs: streamed_in_arrow(pairs, _FOUND, score),
        lambda found: _foremost(found, n), lambda found: _merged(found, n), "lists",
    )
    discard(blocks)
    return _given(lists, copied, keyed, top_n, schemes)


def _copied(profiles: DataFrame) -> DataFrame:
    """(profile, _rep) of the profiles that have copies."""
    return profiles.filter(F.col("copies") > 1).select("profile", F.col("rep").alias("_rep"))


def _given(
    lists: DataFrame, copied: DataFrame, keyed: DataFrame, top_n: int, schemes: tuple[Weights, ...]
) -> DataFrame:
    """The lists of profiles as rows of the items in `keyed`; `copied` as `_copied` gives it."""
    # One list per copied profile against all its members: AQE splits the members of a hot one.
    members = (
        keyed.select(F.col("id").alias("item_id"), "profile")
        .join(copied, "profile")
        .select("item_id", "_rep")
    )
    alone = lists.filter(F.col("copies") == 1).withColumn("item_id", F.col("rep"))
    shared = lists.filter(F.col("copies") > 1).join(members, F.col("rep") == F.col("_rep"))
    columns = ["scheme", "item_id", "best"]
    return _listed(alone.select(*columns).union(shared.select(*columns)), top_n, schemes)


def neighbours_of(
    features: DataFrame,
    items: DataFrame,
    weights: Weights = Weights(),
    top_n: int = 20,
    min_similarity: float = 0.1,
    normalise: bool = True,
    metadata_mode: str = "mean",
    counter: Accumulator | None = None,
) -> DataFrame:
    """The lists that `top_neighbours` gives to `items` (column item_id), out of all items.

    Asked profiles meet every profile, no other pair is scored: k x n products instead of n x n.
    The first block gives every asked row a floor, the n-th best score so far, and only what
    reaches it comes back from the others. `counter` gets the number of pairs scored. Unknown,
    null and repeated items give nothing more.
    """
    mixes = (weights.effective(normalise),)
    keyed = with_profile(features)
    asked_items = keyed.join(items.select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
    asked_items = written(asked_items.select("id", "profile"), "asked-items")
    profiles = written(distinct_profiles(keyed, top_n + 1), "profiles")
    asked = written(profiles.join(asked_items.select("profile").distinct(), "profile", "left_semi"), "asked")
    n_asked, n_rows = asked.count(), profiles.count()
    cores = profiles.sparkSession.sparkContext.defaultParallelism
    sides = max(1, math.ceil(n_asked / MAX_BLOCK))
    blocks = max(1, math.ceil(n_rows / MAX_BLOCK), min(2 * cores, math.ceil(n_rows / MIN_BLOCK)))
    columns = ["rep", "copies", "heads", *PAYLOAD]
    best_of = pairmath.best_of_asked

    def number(n: int) -> Column:
        return F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")

    def scored(asked: DataFrame, first: int, last: int) -> DataFrame:
        """Asked rows, with their floors, against the blocks from `first` to `last`."""
        left = asked.select(*columns, "floor", (-1 - number(sides)).alias("block")).withColumn("lo", F.col("block"))
        left = left.withColumn("hi", F.explode(F.sequence(F.lit(first), F.lit(last))))
        right = profiles.select(*columns, F.lit(0.0).alias("floor"), number(blocks).alias("block"))
        right = right.filter(F.col("block").between(first, last))
        right = right.withColumn("lo", F.explode(F.sequence(F.lit(-sides), F.lit(-1)))).withColumn("hi", F.col("block"))
        n_tasks = min(2 * sides * (last - first + 1), MAX_TASKS)
        groups = left.unionByName(right).repartition(n_tasks, "lo", "hi").groupBy("lo", "hi")

        def score(table, lo, hi):
            return best_of(table, lo, hi, mixes, top_n, min_similarity, metadata_mode, counter)

        return written(grouped_in_arrow(groups, _FOUND, score), "found")

    begun = asked.withColumn("floor", F.lit(float(min_similarity)))
    found = scored(begun, 0, 0)
    if blocks > 1:
        nth = Window.partitionBy("rep").orderBy(F.desc("score"), "other")
        # Other profiles only: an item can be missing from the list of its own profile.
        others = found.filter(F.col("rep") != F.col("other")).withColumn("nth", F.row_number().over(nth))
        floors = others.filter(F.col("nth") == top_n).select("rep", F.col("score").alias("floor"))
        left = asked.join(floors, "rep", "left").withColumn("floor", F.coalesce("floor", F.lit(float(min_similarity))))
        found = found.unionByName(scored(left, 1, blocks - 1))
    lists = written(_merged(found, top_n + 1), "lists")
    return _given(lists, _copied(profiles), asked_items, top_n, (weights,)).drop("scheme")


def _foremost(found: DataFrame, n: int) -> DataFrame:
    """The `n` best rows for each profile and scheme."""
    best = Window.partitionBy("scheme", "rep").orderBy(F.desc("score"), "other")
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= n).drop("_n")


def _merged(found: DataFrame, n: int) -> DataFrame:
    """The `n` best items for each profile, as one ordered array per profile and scheme."""
    packed = (
        _foremost(found, n)
        .groupBy("scheme", "rep")
        .agg(
            F.min("copies").alias("copies"),
            F.collect_list(
                F.struct("score", "genre_score", "text_score", "metadata_score", "heads")
            ).alias("c"),
        )
    )
    spelled_out = F.flatten(
        F.transform(
            "c",
            lambda c: F.transform(
                c["heads"],
                lambda item: F.struct(
                    (-c["score"]).alias("order"),
                    item.alias("similar_item_id"),
                    c["genre_score"].alias("genre_score"),
                    c["text_score"].alias("text_score"),
                    c["metadata_score"].alias("metadata_score"),
                ),
            ),
        )
    )
    return packed.select(
        "scheme", "rep", "copies", F.slice(F.sort_array(spelled_out), 1, n).alias("best")
    )


def _listed(lists: DataFrame, top_n: int, schemes: tuple[Weights, ...]) -> DataFrame:
    """Each item's list without the item itself, one row per neighbour."""
    others = F.slice(
        F.filter("best", lambda x: x["similar_item_id"] != F.col("item_id")), 1, top_n
    )
    names = F.array(*(F.lit(w.name) for w in schemes))
    return lists.select(
        F.element_at(names, F.col("scheme") + 1).alias("scheme"), "item_id", F.inline(others)
    ).select(
        "scheme",
        "item_id",
        "similar_item_id",
        (-F.col("order")).alias("similarity_score"),
        _rounded("genre_score"),
        _rounded("text_score"),
        _rounded("metadata_score"),
    )


def _rounded(name: str) -> Column:
    return F.round(name, 9).alias(name)


def component_neighbours(
    features: DataFrame, component: str, top_n: int = 10, metadata_mode: str = "mean"
) -> DataFrame:
    """Best items by one component alone: only its own features make up the profiles."""
    blank = {
        "genres": F.array().cast("array<string>"),
        "platform_bucket": F.lit(0),
        "type": F.lit(None).cast("string"),
        "language_bucket": F.lit(0),
        "term_ids": F.array().cast("array<int>"),
        "tfs": F.array().cast("array<bigint>"),
        "weights": F.array().cast("array<double>"),
    }
    used = {
        "genre": {"genres"},
        "text": {"term_ids", "tfs", "weights"},
        "metadata": {"platform_bucket", "type", "language_bucket"},
    }[component]
    narrow = features.select("id", *((F.col(c) if c in used else v.alias(c)) for c, v in blank.items()))
    weights = Weights(*(float(component == c) for c in ("genre", "text", "metadata")), component)
    return top_neighbours(
        narrow, (weights,), top_n, 0.0, normalise=True, metadata_mode=metadata_mode
    ).select("item_id", "similar_item_id", "similarity_score")
