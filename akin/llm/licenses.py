"""Licence scans by conditional compression.

Candidate blocks are lines that speak of licences, and runs of lines around them. Each is compressed alone and with every template as
a raw zstandard dictionary: the more a template shortens a block, the more of its wording they share.
The templates with the largest reductions are then confirmed by the exact differences in wording.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from akin.llm.license_texts import TEMPLATES

CANDIDATE = re.compile(
    r"licen[sc]|spdx|copyright|permission is hereby|permission to use|redistribution and use|free software|creative commons|"
    r"public domain|warrant|notice shall be included|endorse or promote|waived all|anyone is free to",
    re.I,
)
WORDS = re.compile(r"\w+(?:[.-]\w+)*")
#: Comment marks at both ends of a line, and tags that name licences by their identifiers.
MARKS = re.compile(r"^\s*(?:/\*+|\*+/?|//+!?|#+|;+|--+|%+|>+|<!--|\"\"\"|\'\'\'|(?:rem|dnl)\b)?\s*|\s*(?:\*+/|-->|\*+)?\s*$", re.I)
SPDX = re.compile(r"SPDX-License-Identifier:([^\n]*)", re.I)


@dataclass(frozen=True)
class LicenseParams:
    """Winners to confirm at a time, until one is, and the differing words that a variant may have, in percent of the wording."""

    winners: int = 3
    most_different: int = 25
    level: int = 3


@dataclass(frozen=True)
class Match:
    license: str
    part: int
    saved: int
    missing: tuple[str, ...]
    extra: tuple[str, ...]


class Matcher:
    def __init__(self, params: LicenseParams):
        import zstandard

        self.params = params
        self.parts = [(name, i, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
        self.words = [WORDS.findall(text.lower()) for _, _, text in self.parts]
        plain = {"write_checksum": False, "write_content_size": False}
        self.alone = zstandard.ZstdCompressor(level=params.level, **plain)
        self.given = [
            zstandard.ZstdCompressor(
                level=params.level, write_dict_id=False, **plain,
                dict_data=zstandard.ZstdCompressionDict(
                    " ".join(text.lower().split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
            )
            for _, _, text in self.parts
        ]
        self.known: dict[tuple[str, bool], list[tuple[Match, int, int, int]]] = {}

    def ranked(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template), the largest first, ties in the order of the templates."""
        raw = " ".join(block.lower().split()).encode("utf-8", "surrogatepass")
        size = len(self.alone.compress(raw))
        saved = [(size - len(c.compress(raw)), i) for i, c in enumerate(self.given)]
        return sorted(saved, key=lambda s: (-s[0], s[1]))

    def confirm(self, block: str, i: int, saved: int) -> Match | None:
        """The template's wording is looked up in the block; words around it are not counted."""
        found = self.placed(WORDS.findall(block.lower()), i, saved)
        return found and found[0]

    def placed(self, have: list[str], i: int, saved: int) -> tuple[Match, int, int] | None:
        """The match and its range of words; single words far off are left out if the whole does not fit."""
        want = self.words[i]
        runs = [b for b in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if b.size]
        if not runs:
            return None
        most = self.params.most_different * len(want) / 100
        top = low = high = max(range(len(runs)), key=lambda r: runs[r].size)
        gap = lambda r: runs[r].b - runs[r - 1].b - runs[r - 1].size
        while low > 0 and gap(low) <= most:
            low -= 1
        while high + 1 < len(runs) and gap(high + 1) <= most:
            high += 1
        for kept in (runs, runs[low : high + 1], runs[top : top + 1]):
            missing, extra, a, b = [], [], 0, kept[0].b
            for run in kept:
                missing += want[a : run.a]
                extra += have[b : run.b]
                a, b = run.a + run.size, run.b + run.size
            missing += want[a:]
            if max(len(missing), len(extra)) <= most:
                return Match(self.parts[i][0], self.parts[i][1], saved, tuple(missing), tuple(extra)), kept[0].b, b
        return None

    def match(self, block: str) -> Match | None:
        """The winner that differs least; among equals the one that saves most."""
        found = self.matches(block, False)
        return min(found, key=lambda f: (f[3], f[1]))[0] if found else None

    def matches(self, block: str, wide: bool) -> list[tuple[Match, int, int, int]]:
        """All matches of a block with their ranges of words and the round that found them, no two overlap.

        Of the winners the one that differs least is taken, in a wide block the one with most wording;
        then the words on both sides of it are searched in the same way.
        """
        if (block, wide) not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[block, wide] = self._matches(WORDS.findall(block.lower()), block, wide)
        return self.known[block, wide]

    def _matches(self, words: list[str], block: str, wide: bool) -> list[tuple[Match, int, int, int]]:
        out, todo = [], [(0, len(words), block, [])]
        while todo:
            low, high, text, head = todo.pop(0)
            have, ranked = head + words[low:high], [(s, i) for s, i in self.ranked(text) if s > 0]
            found, n = [], self.params.winners
            while ranked and not found:
                found = [f for f in (self.placed(have, i, s) for s, i in ranked[:n]) if f]
                ranked = ranked[n:]
            if not found:
                continue
            if wide:
                size = lambda f: f[2] - f[1] - 2 * len(f[0].extra) - len(f[0].missing)
                best, start, end = max(found, key=size)
            else:
                best, start, end = min(found, key=lambda f: len(f[0].missing) + len(f[0].extra))
            begin, start, end = have[start:end], low + max(0, start - len(head)), low + end - len(head)
            if end <= low:
                continue
            out.append((best, start, end, len(out)))
            under = begin[: begin.index("under") + 1] if "under" in begin else []
            for a, b, before in ((low, start, []), (end, high, under if words[end : end + 1] in (["or"], ["and"]) else [])):
                rest = before + words[a:b]
                if b - a > 1 and CANDIDATE.search(" ".join(rest)):
                    todo.append((a, b, " ".join(rest), before))
        return out

    def tagged(self, line: str) -> list[Match]:
        """The licences that an SPDX tag names."""
        names = {name.lower(): name for name in TEMPLATES}
        out = []
        for tag in SPDX.findall(line):
            for word in re.findall(r"[\w.+-]+", tag):
                name = names.get(re.sub(r"(?:-only|-or-later|\+)$", "", word.lower()))
                if name:
                    out.append(Match(name, -1, 0, (), ()))
        return out

    def scan(self, text: str) -> list[tuple]:
        if not CANDIDATE.search(text):
            return []
        lines = text.split("\n")
        starts, at = [], 0
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        hits = [n for n, line in enumerate(lines) if CANDIDATE.search(line)]
        found = []  # wording, line block first, first line, first word in it, last line, word after, match
        for n in hits:
            words = len(WORDS.findall(lines[n].lower()))
            tags = self.tagged(lines[n])
            found += [(words + 1, 0, n, 0, n, words, m) for m in tags]
            if not tags:
                found += [self._found(m, 0, [(n, w) for w in range(words)], a, b) for m, a, b, _ in self.matches(lines[n].strip(), False)]
        for run in self.runs(lines, hits):
            counts = [(n, MARKS.sub("", lines[n])) for n in run]
            at_word = [(n, w) for n, line in counts for w in range(len(WORDS.findall(line.lower())))]
            found += [self._found(m, 1, at_word, a, b) for m, a, b, _ in self.matches(" ".join(line for _, line in counts), True)]
        taken: list[tuple] = []
        for f in sorted(found, key=lambda f: (-f[0], f[1:6])):
            clash = [t for t in taken if (f[2], f[3]) < (t[4], t[5]) and (t[2], t[3]) < (f[4], f[5])]
            if all(t[6].part == f[6].part == -1 and t[6] != f[6] for t in clash):
                taken.append(f)
        out = []
        for _, _, n, _, last, _, m in sorted(taken, key=lambda f: f[2:6]):
            exact = not m.missing and not m.extra
            out.append((m.license, m.part, n, starts[n], starts[last] + len(lines[last]), m.saved, exact, " ".join(m.missing), " ".join(m.extra)))
        return out

    @staticmethod
    def _found(m: Match, wide: int, at_word: list[tuple[int, int]], a: int, b: int) -> tuple:
        (first, word), (last, end) = at_word[a], at_word[b - 1]
        return (b - a - 2 * len(m.extra) - len(m.missing), wide, first, word, last, end + 1, m)

    def runs(self, lines: list[str], hits: list[int]) -> list[list[int]]:
        """Runs of two or more lines with words in them, as far around the hits as a template can reach."""
        reach = 2 * max(map(len, self.words))
        near: set[int] = set()
        for n in hits:
            for step in (-1, 1):
                at, left = n, reach
                while 0 <= at < len(lines) and left > 0 and (size := len(WORDS.findall(lines[at]))):
                    near.add(at)
                    at, left = at + step, left - (size if at != n else 0)
        out: list[list[int]] = []
        for n in sorted(near):
            if out and out[-1][-1] == n - 1:
                out[-1].append(n)
            else:
                out.append([n])
        return [run for run in out if len(run) > 1]


MATCHES = (
    "array<struct<license:string,part:int,line:int,start:long,end:long,saved_bytes:int,exact:boolean,missing:string,extra:string>>"
)


def scanned(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """`docs` plus matches (each wording or SPDX tag, in lines and over lines) and licenses (names, sorted).

    Null and empty texts, and texts without such lines, have no matches. A line is matched whole, however
    long; `start` and `end` are those of the lines that a match lies in, and the part of a tag is -1. Repeated rows give equal results. Columns of `docs` with these names are replaced. An empty
    table gives an empty table.
    """

    @pandas_udf(MATCHES)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(params)
        for texts in batches:
            yield pd.Series([matcher.scan(t) if t else [] for t in texts], dtype="object")

    out = docs.withColumn("matches", scan(F.col("text").cast("string")))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return out.withColumn("licenses", F.array_join(names, ","))
