"""Pack documents into sequences along a space-filling curve.

Documents become hashed bags of token ids, projected to a few dimensions; cells of a grid over these
are numbered along a Hilbert curve. Documents are range-sorted by that number, laid end to end, and cut
every `length` tokens, so that a sequence holds neighbours of the curve. The rest that does not fill a
sequence is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akin.llm.common import with_running
from akin.sources.scratch import written

_CACHED = 300_000
_CACHED_PARTS = 600_000
_MARK = ";"

#: A tokenizer that cuts stretches like this gives the ids of a stretch part by part.
_KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}
#: Stretches of characters that its normaliser leaves alone or lower-cases one by one, and their parts.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-zß-öø-ÿ0-9]+")
#: Texts of such stretches only, blanks and line ends. Their parts are found in one go.
_PLAIN_TEXT = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class PackParams:
    """`tokenizer` is the path of a vocabulary file that every executor has; None: the public one."""

    length: int = 2048
    tokenizer: str | None = None
    end: int = 1
    hashed: int = 256
    dimensions: int = 3
    bits: int = 10
    seed: int = 5


class _Pieces(dict):
    """Stretch of text between blanks and line ends -> its ids as bytes.

    Ids do not reach over a blank or a line end: the tokenizer drops white space and its merges stay
    inside a word. So a text's ids are those of its stretches, one after the other.
    """

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.tokenizer, self.kind = tokenizer, kind
        mark = tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.parts = _Parts(tokenizer, kind) if _cuts_as_known(tokenizer) else None
        # An added token is found before a stretch is cut.
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or r"(?!)")

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts: a plain text is cut into parts at once, others go by their stretches."""
        out: list = [None] * len(texts)
        if self.parts is not None:
            part, plain, added, cut = self.parts.__getitem__, _PLAIN_TEXT.fullmatch, self.added.search, _PARTS.findall
            for i, text in enumerate(texts):
                if plain(text) and not added(text):
                    out[i] = b"".join(map(part, cut(text.lower())))
        rest = {i: texts[i].replace("\n", " ").split(" ") for i, found in enumerate(out) if found is None}
        self.learn({w for words in rest.values() for w in words})
        for i, words in rest.items():
            out[i] = b"".join(map(self.__getitem__, words))
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > _CACHED:
            self.clear()
            new = list(words)
        if self.parts is not None:
            part, plain, added, cut = self.parts.__getitem__, _PLAIN.fullmatch, self.added.search, _PARTS.findall
            for w in new:
                if plain(w) and not added(w):
                    self[w] = b"".join(map(part, cut(w.lower())))
            new = [w for w in new if w not in self]
        plain = [w for w in new if _MARK not in w] if self.mark is not None else []
        for i in range(0, len(plain), 2_000):
            self._together(plain[i : i + 2_000])
        left = [w for w in new if w not in self]
        for i in range(0, len(left), 20_000):
            self._alone(left[i : i + 20_000])

    def _together(self, part: list[str]) -> None:
        """Many stretches in one call, told apart by the id of the mark, which none of them holds."""
        found = self.tokenizer.encode_batch_fast([f" {_MARK} ".join(part)], add_special_tokens=False)[0].ids
        ids = np.array(found, dtype=self.kind)
        at = np.flatnonzero(ids == self.mark)
        # A character that is normalised into the mark would shift the stretches: then each goes alone.
        if len(at) == len(part) - 1:
            for word, lo, hi in zip(part, [0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True):
                self[word] = ids[lo:hi].tobytes()

    def _alone(self, part: list[str]) -> None:
        for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
            self[word] = np.array(found.ids, dtype=self.kind).tobytes()


class _Parts(dict):
    """Part of a plain stretch, in lower case -> its ids as bytes, straight from the tokenizer's model."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.form = tokenizer.model, "<%dH" if kind == "<u2" else "<%dI"
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= _CACHED_PARTS:
            self.clear()
        found = self.model.tokenize(part if part.isascii() else part.translate(self.spelled))
        ids = self[part] = struct.pack(self.form % len(found), *(t.id for t in found))
        return ids


def _cuts_as_known(tokenizer) -> bool:
    about = json.loads(tokenizer.to_str())
    return all(about[name] == spec for name, spec in _KNOWN.items()) and not about["model"].get("dropout")


@lru_cache(maxsize=1)
def _learned(path: str, end: int) -> _Pieces:
    """The stretches that this worker process knows; later tasks go on with them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    width = 2 if max(tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
    return _Pieces(tokenizer, f"<u{width}")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Number along the Hilbert curve of each row of grid cells (n, dimensions), bits per dimension.

    The transposed form of the index is computed as published by J. Skilling (2004), all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _directions(params: PackParams) -> np.ndarray:
    return np.random.default_rng(params.seed).normal(size=(params.hashed, params.dimensions))


def curve_keys(bags: np.ndarray, params: PackParams) -> np.ndarray:
    """Curve numbers of rows of hashed token counts: lengths one, projected, squeezed into the grid."""
    norms = np.sqrt((bags**2).sum(axis=1, keepdims=True))
    spots = 1 / (1 + np.exp(-2.0 * (bags / np.maximum(norms, 1e-12)) @ _directions(params)))
    cells = np.minimum((spots * (1 << params.bits)).astype(np.int64), (1 << params.bits) - 1)
    return hilbert(cells, params.bits)


def tokenized(docs: DataFrame, params: PackParams) -> DataFrame:
    """doc_id, ids (little-endian, `width` bytes each: two if the vocabulary allows), n, width, curve."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _learned(params.tokenizer or public_tokenizer(), params.end)
        kind = pieces.kind
        width = int(kind[-1])
        end = np.array([params.end], dtype=kind).tobytes()
        for frame in frames:
            for at in range(0, len(frame), 300):
                part = frame.iloc[at : at + 300]
                ids = [raw + end for raw in pieces.ids([t or "" for t in part["text"]])]
                bags = np.zeros((len(ids), params.hashed))
                for i, raw in enumerate(ids):
                    spread = (np.frombuffer(raw, kind).astype(np.uint64) * np.uint64(2654435761)) >> np.uint64(7)
                    bags[i] = np.bincount((spread % np.uint64(params.hashed)).astype(np.int64), minlength=params.hashed)
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].to_numpy(),
                        "ids": ids,
                        "n": [len(raw) // width for raw in ids],
                        "width": width,
                        "curve": curve_keys(bags, params),
                    }
                )

    # Ids go as text: pandas would turn whole numbers with nulls among them into fractions.
    ids = F.col("doc_id").cast("long").cast("string").alias("doc_id")
    chosen = docs.select(ids, F.col("text").cast("string").alias("text"))
    coded = chosen.mapInPandas(encode, "doc_id string, ids binary, n long, width int, curve long")
    return coded.withColumn("doc_id", F.col("doc_id").cast("long"))


def _pieces(total: int, length: int):
    """Whole sequences, then the rest in powers of two."""
    whole = total // length * length
    rest, ends, at = total - whole, [], whole
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            at += 1 << b
            ends.append(at)
    starts = np.array([whole, *ends[:-1]], dtype=np.int64) if ends else np.zeros(0, np.int64)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, raw, width, first in zip(frame["doc_id"], frame["ids"], frame["width"], frame["first"], strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                n, done = len(ids), 0
                while done < n:
                    at = first + done
                    if at < whole:
                        sequence, start = divmod(at, length)
                        end = at - start + length
                    else:
                        k = int(np.searchsorted(starts, at, side="right")) - 1
                        sequence, start, end = whole // length + k, at - int(starts[k]), ends[k]
                    size = min(n - done, end - at)
                    crc = zlib.crc32(ids[done : done + size].tobytes())
                    rows.append((doc_id, done, size, crc, n, sequence, start))
                    done += size
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut


def packed(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is a document of the end id alone. Null ids stay null. Repeated rows are
    documents of their own; ties on the curve go by doc_id, then by the ids' check sum. Long documents
    are cut at the ends of sequences. Other columns are ignored. An empty table gives an empty one.
    """
    rows = tokenized(docs, params).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumn("tie", F.crc32("ids")), "tokens")
    narrow = rows.select("row", "n", "curve", "doc_id", "tie")
    placed = with_running(narrow, [], ["curve", "doc_id", "tie", "row"], "n", "first")
    total = int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    joined = rows.select("row", "doc_id", "ids", "width").join(placed.select("row", "first"), "row")
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    named = joined.select(F.col("doc_id").cast("string").alias("doc_id"), "ids", "width", "first")
    pieces = named.mapInPandas(_pieces(total, params.length), schema)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
