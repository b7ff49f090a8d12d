"""Counts and weights of words and word pairs: numpy on Arrow batches, used inside tasks.

Words get numbers within a batch, so that rows are counted as numbers and each different word is looked up once.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers get these functions with the job and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GATHERED = 32 << 20  # bytes of batches that are counted together

COUNTED = pa.schema([("term", pa.string()), ("df", pa.int64()), ("tf", pa.int64())])
VECTORS = {"term_ids": pa.int32(), "tfs": pa.int64(), "weights": pa.float64()}


def numbered(words) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a list array, and for each word in it its number and its row."""
    flat = words.flatten()
    known = flat.dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    return known.dictionary, known.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(words)), sizes)


def neighbours(codes: np.ndarray, rows: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of words that start a pair: by number, whether a word can be the first or the second of one."""
    together = (rows[1:] == rows[:-1]) & first[codes[:-1]] & second[codes[1:]]
    return np.flatnonzero(together)


def pair_numbers(words: pa.Array, codes: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different pairs of words that start at the given places, and for each place its number."""
    pairs, place = np.unique(codes[at] * len(words) + codes[at + 1], return_inverse=True)
    a, b = np.divmod(pairs, max(len(words), 1))
    return pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " "), place


def slots(words: pa.Array, n_bits: int) -> np.ndarray:
    """The bit of each word in a bitmap."""
    return np.fromiter((zlib.crc32(w.as_buffer()) % n_bits for w in words), np.int64, len(words))


def _whole(batches):
    """Tables of several batches, up to a bounded size."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _counts(terms: pa.Array, number: np.ndarray, row: np.ndarray) -> pa.Table:
    """In how many rows each term stands, and how often."""
    width = max(len(terms), 1)
    df = np.bincount(np.unique(row * width + number) % width, minlength=len(terms))
    tf = np.bincount(number, minlength=len(terms))
    return pa.table([terms.cast(pa.string()), pa.array(df, pa.int64()), pa.array(tf, pa.int64())], schema=COUNTED)


def word_counts(batches):
    """(term, df, tf) of the words, for some rows at a time."""
    for table in _whole(batches):
        yield from _counts(*numbered(table["words"].combine_chunks())).to_batches()


def pair_counts(batches, bits: np.ndarray | None):
    """(term, df, tf) of the pairs of words whose bits are set in a bitmap, or of all pairs, for some rows at a time."""
    for table in _whole(batches):
        words, codes, rows = numbered(table["words"].combine_chunks())
        known = np.ones(len(words), bool)
        if bits is not None:
            slot = slots(words, 8 * len(bits))
            known = (bits[slot >> 3] >> (slot & 7)) & 1 == 1
        at = neighbours(codes, rows, known, known)
        pairs, number = pair_numbers(words, codes, at)
        yield from _counts(pairs, number, rows[at]).to_batches()


class Terms:
    """The vocabulary, in the order of its ids, as tasks use it."""

    def __init__(self, terms: list[str], ids: list[int], idf: list[float]):
        self.terms, self.ids, self.idf = pa.array(terms, pa.string()), np.array(ids, np.int32), np.array(idf)
        cuts = [(t, i) for t in terms for i, c in enumerate(t) if c == " "]
        self.first = pa.array(sorted({t[:i] for t, i in cuts}), pa.string())
        self.second = pa.array(sorted({t[i + 1 :] for t, i in cuts}), pa.string())

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The place in the vocabulary of each word or pair, -1 for those that are no term."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def vectors(self, words) -> list[pa.Array]:
        """Ids, counts and weights (TF-IDF, length one) of the terms of each row."""
        known, codes, rows = numbered(words)
        single = self.numbers(known)[codes]
        first, second = (pc.is_in(known, value_set=x).to_numpy(zero_copy_only=False) for x in (self.first, self.second))
        at = neighbours(codes, rows, first, second)
        pairs, place = pair_numbers(known, codes, at)
        term = np.concatenate([single, self.numbers(pairs)[place]])
        row = np.concatenate([rows, rows[at]])[term >= 0]
        found, tf = np.unique(row * len(self.terms) + term[term >= 0], return_counts=True)
        row, term = np.divmod(found, max(len(self.terms), 1))
        raw = tf * self.idf[term]
        norm = np.sqrt(np.bincount(row, raw * raw, len(words)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))])
        values = self.ids[term], tf, raw / norm[row]
        return [
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind))
            for v, kind in zip(values, VECTORS.values())
        ]


def with_vectors(batches, terms: Terms, rest: list[str], keep_empty: bool):
    """The columns of `rest` and the vectors of each row, instead of its words."""
    for batch in batches:
        table = pa.table({**{c: batch.column(c) for c in rest}, **dict(zip(VECTORS, terms.vectors(batch.column("words"))))})
        if not keep_empty:
            table = table.filter(pc.greater(pc.list_value_length(table["term_ids"]), 0))
        yield from table.to_batches()
