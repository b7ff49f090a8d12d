"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives, other texts are unlabelled: nothing is taken to be clean.
A linear numpy classifier over the presence of words and character n-grams is trained on the
class-prior-corrected risk `prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])`; when the
second term is negative, its gradient is turned round.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from akin.sources.scratch import written

WORD = re.compile(r"[^\W\d_]+")
_CACHED = 200_000


@dataclass(frozen=True)
class ToxicityParams:
    """The sample that the classifier is fitted on is bounded by the first two; all texts are scored."""

    max_positive: int = 6_000
    max_unlabelled: int = 24_000
    max_features: int = 4_096
    min_positive: int = 4
    margin: float = 4.0
    min_share: float = 0.5
    grams: tuple[int, ...] = (4, 5, 6)
    prior: float | None = None
    steps: int = 600
    rate: float = 0.1
    decay: float = 1e-5
    seed: int = 7


def grams_of(word: str, sizes: tuple[int, ...]) -> set[str]:
    """The word itself and its character n-grams, its ends marked."""
    marked = f"^{word}$"
    out = {marked}
    for n in sizes:
        out.update(marked[i : i + n] for i in range(len(marked) - n + 1))
    return out


class _Known(dict):
    """Word -> something made from the features it brings; words come again and again."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= _CACHED:
            self.clear()
        value = self[word] = self.make(word)
        return value


def _brings(features, sizes: tuple[int, ...]) -> _Known:
    index = {f: i for i, f in enumerate(features)}
    return _Known(lambda word: tuple(sorted(index[g] for g in grams_of(word, sizes) if g in index)))


def present(text: str | None, brings: _Known) -> list[int]:
    """Feature numbers, each as often as there are different words that bring it."""
    return sorted(i for word in set(WORD.findall((text or "").lower())) for i in brings[word])


@dataclass(frozen=True)
class Classifier:
    features: tuple[str, ...]
    weights: np.ndarray
    bias: float
    grams: tuple[int, ...]

    def by_word(self) -> _Known:
        brings = _brings(self.features, self.grams)
        return _Known(lambda word: float(sum(self.weights[i] for i in brings[word])))

    def scores(self, texts, by_word: _Known) -> np.ndarray:
        """Sorted before the sum, so that equal texts get equal scores."""
        z = [
            self.bias + sum(sorted(filter(None, map(by_word.__getitem__, set(WORD.findall((t or "").lower()))))))
            for t in texts
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(np.array(z, dtype=float), -50, 50)))


def sample(docs: DataFrame, positives: DataFrame, params: ToxicityParams) -> DataFrame:
    """text, positive: a bounded sample by hash of the id; `docs` and `positives` by doc_id."""
    by_hash = F.xxhash64(F.col("doc_id"), F.lit(params.seed))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    some = ids.orderBy(by_hash, "doc_id").limit(params.max_unlabelled)
    known = positives.select("doc_id").join(ids, "doc_id").distinct()
    known = known.orderBy(by_hash, "doc_id").limit(params.max_positive)
    picked = some.withColumn("positive", F.lit(False)).union(known.withColumn("positive", F.lit(True)))
    # At most max_positive + max_unlabelled rows of a number and a flag.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # Copies would make chance features look frequent.
    return rows.dropDuplicates(["text", "positive"]).select("doc_id", "text", "positive")


def _words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many positive and unlabelled texts of the batch each word is."""
    for frame in frames:
        p, u = Counter(), Counter()
        for text, positive in zip(frame["text"], frame["positive"], strict=True):
            (p if positive else u).update(set(WORD.findall((text or "").lower())))
        yield pd.DataFrame([(w, p[w], u[w]) for w in p.keys() | u.keys()], columns=["word", "p", "u"])


def _grams(sizes: tuple[int, ...]):
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p, u = Counter(), Counter()
            for word, in_p, in_u in zip(frame["word"], frame["p"], frame["u"], strict=True):
                for gram in grams_of(word, sizes):
                    p[gram] += in_p
                    u[gram] += in_u
            yield pd.DataFrame([(g, p[g], u[g]) for g in p], columns=["feature", "p", "u"])

    return split


def choose(examples: DataFrame, prior: float, docs: dict[bool, int], params: ToxicityParams) -> tuple[list[str], float]:
    """The features that stand out most among the positives.

    A feature counts once for each text and word that brings it. One is taken if, under the prior, at
    least `min_share` of its occurrences are in toxic texts, and by more than chance. Also gives the
    prior, lowered if these features show that unlabelled texts hold fewer toxic ones. `docs` has the
    numbers of positive and unlabelled texts.
    """
    words = (
        examples.select("text", "positive").mapInPandas(_words, "word string, p long, u long")
        .groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    )
    words = written(words, "words")
    n_p, n_u = (float(v or 0) for v in words.agg(F.sum("p"), F.sum("u")).first())
    if not n_p or not n_u:
        return [], prior
    counts = (
        words.filter("p > 0").mapInPandas(_grams(params.grams), "feature string, p long, u long")
        .groupBy("feature").agg(F.sum("p").alias("p"))
        .filter(F.col("p") >= params.min_positive)
    )
    # Only features of the positives matter, so the many other ones are dropped before their shuffle.
    others = (
        words.filter("u > 0").mapInPandas(_grams(params.grams), "feature string, p long, u long")
        .select("feature", "u").join(counts, "feature")
        .groupBy("feature", "p").agg(F.sum("u").alias("u"))
    )
    counts = written(counts.join(others.select("feature", "u"), "feature", "left").fillna(0, "u"), "counts")
    # Twice the log of the odds against chance; the more features there are, the more is asked for.
    expected = F.greatest(F.col("u"), F.lit(0.5)) * (n_p / n_u)
    surprise = 2 * (F.col("p") * F.log(F.col("p") / expected) - (F.col("p") - expected))
    enough = 2 * np.log(max(2, counts.count())) + params.margin
    toxic_share = prior * (F.col("p") / n_p) / (F.greatest(F.col("u"), F.lit(0.5)) / n_u)
    best = counts.withColumn("surprise", surprise).filter(F.col("p") > expected)
    best = best.filter(F.col("surprise") >= enough).filter(toxic_share >= params.min_share)
    rows = best.orderBy(F.desc("surprise"), "feature").limit(params.max_features).collect()
    # A feature of toxic texts alone is as frequent in unlabelled texts as toxic ones are, times its
    # frequency in those: the most telling features bound the prior from above.
    ratios = [(r["u"] / docs[False]) / (r["p"] / docs[True]) for r in rows[:50] if r["u"]]
    return [r["feature"] for r in rows], min([prior, *([float(np.quantile(ratios, 0.1))] if ratios else [])])


def train(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, params: ToxicityParams):
    """Weights and bias that minimise the non-negative risk, by Adam over all examples."""
    lengths = np.array([len(r) for r in rows])
    at = np.repeat(np.arange(len(rows)), lengths)
    ids = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    x = np.zeros(width + 1)
    x[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda v: 1.0 / (1.0 + np.exp(-np.clip(v, -50, 50)))
    for step in range(1, params.steps + 1):
        g = x[-1] + np.bincount(at, weights=x[ids], minlength=len(rows))
        s = sigmoid(g)
        cost = np.logaddexp(0.0, g)  # the loss of calling an example negative
        negative = cost[~positive].sum() / n_u - prior * cost[positive].sum() / n_p
        turn = 1.0 if negative >= 0 else -1.0
        slope = np.where(positive, prior / n_p * (s - 1.0), 0.0) if turn > 0 else np.zeros(len(rows))
        slope = slope + turn * np.where(positive, -prior / n_p * s, s / n_u)
        grad = np.r_[np.bincount(ids, weights=slope[at], minlength=width), slope.sum()]
        grad[:-1] += params.decay * x[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        x = x - params.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Classifier:
    """A classifier from `docs` (doc_id, text) and the labels (doc_id, toxic) that may be learnt from.

    An id with several labels counts as toxic if one of them says so; null labels are ignored. The
    prior is the share of toxic among labelled ids unless given. Without a known positive, or with
    nothing but positives, the score of every text is that share.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "labels")
    total, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = params.prior if params.prior is not None else (toxic / total if total else 0.0)
    constant = Classifier((), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))), params.grams)
    if not 0 < prior < 1:
        return constant
    examples = written(sample(docs, known.filter("toxic = 1"), params), "examples")
    n = dict(examples.groupBy("positive").count().collect())
    if not n.get(True) or not n.get(False):
        return constant
    features, prior = choose(examples, prior, n, params)
    sizes = params.grams

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        brings = _brings(features, sizes)
        for frame in frames:
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"], "positive": frame["positive"], "ids": [present(t, brings) for t in frame["text"]]}
            )

    seen = examples.mapInPandas(rows, "doc_id long, positive boolean, ids array<int>").collect()
    seen = sorted(seen, key=lambda r: (r["doc_id"], r["positive"], r["ids"]))
    positive = np.array([r["positive"] for r in seen])
    weights, bias = train([np.array(r["ids"], np.int64) for r in seen], positive, len(features), prior, params)
    return Classifier(tuple(features), weights, bias, sizes)


def scored(docs: DataFrame, model: Classifier, column: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 for every row; a null text counts as an empty one."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        by_word = model.by_word()
        for texts in batches:
            yield pd.Series(model.scores(texts, by_word), dtype="float64")

    return docs.withColumn(column, score(F.col("text").cast("string")))


def held_out(doc_id: str = "doc_id"):
    """Labels of these ids are never learnt from. A null id is not held out."""
    digest = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(digest, F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), threshold: float = 0.3) -> DataFrame:
    """Every row of `docs` with held_out, score and predicted; only labels not held out are learnt from.

    Unlabelled texts, too, come from ids that are not held out. Columns other than doc_id, text and
    toxic play no part. Repeated rows get equal scores. Empty tables give an empty table.
    """
    free = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    free = free.filter(~held_out())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = fit(free, known.filter(~held_out()), params)
    out = scored(docs, model, "score").withColumn("held_out", held_out())
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
