"""Find secrets: fixed formats, and stretches whose characters look random.

Candidates are long runs of the characters that keys are written in. Every character class has a window
and a threshold; the Shannon entropy of each window is computed from counts that change by one
character as the window moves on. Allow-list rules suppress runs that only look random.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The formats. Letters in either case are spelled out, as case folding knows more letters.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join(re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", w) for w in _WORDS)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run is read to its end, so only runs that are long enough need to be matched.
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Runs of a class, the window that slides over them and the entropy that makes a window suspect."""

    name: str
    pattern: str
    window: int
    bits: float


@dataclass(frozen=True)
class ScanParams:
    """Classes in order: a run belongs to the first that fits. Allow-list patterns fit whole runs."""

    run: str = r"[A-Za-z0-9+/_=-]{20,}"
    classes: tuple[CharClass, ...] = (
        CharClass("hex", r"[0-9a-fA-F]+", 20, 2.9),
        CharClass("alphanumeric", r"[A-Za-z0-9]+", 20, 3.5),
        CharClass("base64", r"[A-Za-z0-9+/_=-]+", 24, 3.8),
    )
    allowed: tuple[str, ...] = (
        r"[^0-9]*",  # words, joined words and paths without a digit
        r"[0-9+/_=-]*",  # numbers, dates, rules
        r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUIDs
        r"(?:[A-Za-z]+[/_=-]+)*[A-Za-z]+[/_=-]?[0-9]{1,4}",  # names with a number
        r"(?:[A-Za-z0-9]{1,12}[/_=-])+[A-Za-z0-9]{1,12}",  # slugs and paths of short parts
        r"(?i:.*(?:example|sample|placeholder|xxxx|0123456789|abcdefgh).*)",  # stand-ins
    )


def entropies(text: str, window: int) -> Iterator[float]:
    """Bits per character of every window; one window over all of a shorter text."""
    size = min(window, len(text))
    if not size:
        return
    counts: dict[str, int] = {}
    weigh = lambda n: n * math.log2(n) if n else 0.0
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += weigh(n + 1) - weigh(n)
        counts[c] = n + 1
        if i >= size:
            gone = text[i - size]
            n = counts[gone]
            total += weigh(n - 1) - weigh(n)
            counts[gone] = n - 1
        if i >= size - 1:
            yield math.log2(size) - total / size


class Scanner:
    def __init__(self, params: ScanParams):
        self.run = re.compile(params.run)
        self.classes = [(re.compile(c.pattern), c) for c in params.classes]
        self.allowed = [re.compile(p) for p in params.allowed]

    def suspect(self, run: str) -> bool:
        if any(p.fullmatch(run) for p in self.allowed):
            return False
        kind = next((c for p, c in self.classes if p.fullmatch(run)), None)
        return kind is not None and any(e >= kind.bits for e in entropies(run, kind.window))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end), sorted."""
        spans = []
        if ":" in text or "=" in text:
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(spans)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Suspect runs that no base span holds."""
        found = [(m.start(), 3, m.end()) for m in self.run.finditer(text) if self.suspect(m[0])]
        return [s for s in found if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """`docs` plus n_assign, n_access, n_hex, n_entropy, base_sha256 and spans, for every row.

    Spans are whole matches in code points, end exclusive. Null and empty texts have no spans: counts 0,
    the digest of the empty string, spans empty. Repeated rows give equal results. Columns of `docs`
    with one of these names are replaced. An empty table gives an empty table.
    """

    @pandas_udf("n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(params)
        for texts in batches:
            rows = []
            for text in texts:
                base = scanner.base(text or "")
                extra = scanner.added(text or "", base)
                counts = [sum(s[1] == k for s in base) for k in range(3)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, len(extra), digest, _joined(sorted(base + extra))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    found = docs.withColumn("__scan", scan(F.col("text").cast("string")))
    names = ("n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans")
    return found.withColumns({n: F.col(f"__scan.{n}") for n in names}).drop("__scan")
