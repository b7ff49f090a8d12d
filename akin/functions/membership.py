"""A set of strings as a bitmap inside an expression: no false negatives, few false positives."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The largest bitmap, 8 MB. It goes to the tasks with the plan.
MOST_BITS = 1 << 26


def _slot(value: Column, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n_bits))


def _n_bits(keys: DataFrame) -> int | None:
    """Bits of a bitmap with at least eight a key; None for too many keys."""
    n_bits = max(1 << 15, 1 << (8 * keys.count()).bit_length())
    return None if n_bits > MOST_BITS else n_bits


def _merged(slots: DataFrame, n_bits: int) -> bytes:
    """The bitmap with the bits of column `slot`, counted from one as Spark's bitmap functions do.

    Partial bitmaps of 4 KB are merged before and after the shuffle, and only the bits reach the driver.
    """
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = bytearray(n_bits // 8)
    for part, some in parts.collect():
        bits[(part - 1) * len(some) : part * len(some)] = some
    return bytes(bits)


def bitmap(keys: DataFrame, key: str, slots_of) -> bytes | None:
    """The bits that `slots_of(strings, number of bits)` gives for the keys, for a test in Python; None for too many."""
    n_bits = _n_bits(keys)
    if n_bits is None:
        return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slots_of(batch.column(0), n_bits) + 1)], ["slot"])

    return _merged(keys.select(key).mapInArrow(run, "slot long"), n_bits)


def may_hold(keys: DataFrame, key: str) -> Callable[[Column], Column] | None:
    """A test whether a string can be one of `keys`, usable inside array lambdas; None for too many keys.

    Each key sets one of at least eight bits per key; only the bits reach the driver, never the keys.
    """
    n_bits = _n_bits(keys)
    if n_bits is None:
        return None
    whole = F.lit(_merged(keys.select((_slot(F.col(key), n_bits) + 1).alias("slot")), n_bits))

    def test(value: Column) -> Column:
        slot = _slot(value, n_bits)
        byte = F.substring(whole, (F.call_function("shiftright", slot, F.lit(3)) + 1).cast("int"), F.lit(1))
        number = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.call_function("shiftright", number, slot.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return test
