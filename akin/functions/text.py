"""Text functions as native column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and word classes spelled out so that every regex engine agrees on them.
WHITESPACE = r"[\s\x0B\x1c-\x1f\x{85}\p{Z}]+"
TAG = r"<[^>]+>"
# A Hangul syllable decomposes into several letters, so one alone is already a token.
TOKEN = r"[\p{L}\p{N}_]{2,}|[\x{AC00}-\x{D7A3}]"

LAST_WITH_A_BASE = 0x2FFFF  # no character beyond has a decomposition or is a combining mark

# The English stop words that Apache Spark ships.
STOP_WORD_TEXT = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
"""

# Words with an apostrophe never come out of the tokeniser whole, so their parts are listed.
STOP_WORDS = tuple(sorted(set(re.findall(r"\w\w+", STOP_WORD_TEXT))))


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """(from, to) for `translate`: letters to their base letter; combining marks are dropped."""
    source, target, dropped = [], [], []
    for code in range(128, LAST_WITH_A_BASE + 1):
        char = chr(code)
        if unicodedata.combining(char):
            dropped.append(char)
            continue
        plain = [c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)]
        if len(plain) == 1 and plain[0] != char:
            source.append(char)
            target.append(plain[0])
    return "".join(source + dropped), "".join(target)


def clean_html(text: Column) -> Column:
    """Drop tags without putting a space in, collapse whitespace, strip; null becomes ''."""
    untagged = F.regexp_replace(text, TAG, "")
    return F.coalesce(F.trim(F.regexp_replace(untagged, WHITESPACE, " ")), F.lit(""))


def clean_texts(texts: Column) -> Column:
    return F.transform(texts, clean_html)


def combine_text(summary: Column, children: Column) -> Column:
    """Clean summary and non-empty child texts, joined by one space each."""
    present = F.filter(
        F.coalesce(children, F.array().cast("array<string>")), lambda t: F.length(t) > 0
    )
    return F.array_join(F.concat(F.array(clean_html(summary)), clean_texts(present)), " ")


@lru_cache(maxsize=1)
def spelled_out() -> dict[str, str]:
    """Letters that stand for several (ligatures, units, fractions) -> what they stand for.

    Hangul syllables are left out: they stay whole, see TOKEN.
    """
    out = {}
    for code in range(128, LAST_WITH_A_BASE + 1):
        char = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) > 1 and not "\uac00" <= char <= "\ud7a3":
            out[char] = plain
    return out


@lru_cache(maxsize=1)
def _several() -> tuple[str, str]:
    """A regex for the letters of `spelled_out`, and the map as one literal for `str_to_map`."""
    codes = sorted(map(ord, spelled_out()))
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    ranges = (f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))
    # One comparison passes over an ASCII character; the class alone tries its hundreds of ranges on each.
    return f"(?=[^\\x00-\\x7F])[{''.join(ranges)}]", "\x01".join(f"{k}\x02{v}" for k, v in spelled_out().items())


def fold(text: Column) -> Column:
    """Lowercase without accents; a letter that stands for several is spelled out.

    Each different such letter of a text is looked up once, however long the text is; what it stands
    for holds no such letter, so the order of the replacements does not matter. Plain ASCII has no accents.
    """
    source, target = accent_map()
    letters, entries = _several()
    lower = F.lower(text)
    known = F.str_to_map(F.lit(entries), F.lit("\x01"), F.lit("\x02"))
    met = F.array_distinct(F.regexp_extract_all(lower, F.lit(letters), F.lit(0)))
    spelled = F.aggregate(met, lower, lambda done, c: F.replace(done, c, F.element_at(known, c)))
    plain = F.when(lower.rlike(letters), spelled).otherwise(lower)
    return F.when(lower.rlike(r"[^\x00-\x7F]"), F.translate(plain, source, target)).otherwise(lower)


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of two or more characters, in order, without the stop words."""
    words = F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a space; takes a column reference, not a long expression."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), rest),
        F.slice(words, F.lit(2), rest),
        lambda a, b: F.concat_ws(" ", a, b),
    )
