"""Replace personal data by keyed surrogates, with DataFrame functions only.

E-mail and IPv4 addresses, payment cards, phone and social security numbers, IBANs and titled names are
found by pattern. The surrogate of an entity is a keyed hash put into the entity's own format: check
digits hold, a card keeps its issuer digit, a phone its country code, a name its gender and script, and
the way each occurrence is written (separators, capitals) stays. The same entity gets the same
surrogate in the whole table, in whatever way it is written. Surrogates are checked over the whole
table: none is shared by two entities, and none equals an entity that occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.sources.scratch import written

# Titles by gender, first names by gender and script, name syllables by script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "г-жа")
FIRST_NAMES = {
    ("latin", "male"): ("Adam", "Albert", "Anton", "Bruno", "Daniel", "David", "Felix", "Hugo", "Leon", "Lucas",
                        "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    ("latin", "female"): ("Alice", "Anna", "Clara", "Diana", "Elena", "Emma", "Eva", "Helena", "Irene", "Julia",
                          "Laura", "Lucia", "Maria", "Nora", "Sara", "Sofia"),
    ("cyrillic", "male"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Максим", "Никита",
                           "Олег", "Павел", "Роман", "Степан", "Тимур", "Юрий"),
    ("cyrillic", "female"): ("Алина", "Анна", "Вера", "Дарья", "Елена", "Зоя", "Инна", "Кира", "Лидия", "Марина",
                             "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"),
}
SYLLABLES = {
    "latin": ("bar", "cor", "dan", "fel", "gar", "hol", "kel", "lam", "mar", "nor", "pel", "ran", "sol", "tam", "ven", "wil"),
    "cyrillic": ("бар", "вол", "гор", "дем", "жар", "зим", "кор", "лад", "мир", "нор", "пол", "рад", "сол", "тар", "фед", "яс"),
}
# What entities look like.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CAPITAL = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?"
_TITLE = "(?:" + "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True)) + r")\.?"
# IBAN lengths by country; other countries are found by the general form.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(
    rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
    + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, countries in _IBAN_LENGTHS.items()
)
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NOT_CALLED = r"(?<!\+[0-9]{1,3}[ .-])"
def _spaced_digits(least: int, most: int) -> str:
    """Digits with signs between, written out: Java looks back only over what has a plain maximum."""
    one, more = r"[ .()-]{0,3}[0-9]", ""
    for _ in range(most - least):
        more = f"(?:{one}{more})?"
    return one * least + more


#: What is looked for, in this order, in what the ones before have left; so no kind swallows its neighbour.
#: Forms of fixed length come before those of free length. None: candidates of CARDS with right check digits.
PASSES = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])"),
    ("ip", rf"(?<![0-9.+]){_IP}"),
    ("phone", r"(?:(?<![A-Za-z0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?<![A-Za-z0-9+(])(?<!\+[0-9]{1,3}[ .-])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[ .-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])"),
    ("ssn", rf"(?<![0-9-]){_NOT_CALLED}{_SSN}"),
    ("card", None),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("phone", r"(?:(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5}|(?<![A-Za-z0-9+(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9A-Za-z+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9A-Za-z])" + rf"(?<!\+{_spaced_digits(1, 7)}\)?)(?<!\+{_spaced_digits(16, 23)}\)?)"),
    ("card", None),
    ("ssn", rf"(?<![0-9-]){_SSN}"),
    ("ip", rf"(?<![0-9.]){_IP}"),
    ("name", rf"(?<!\p{{L}}){_TITLE} {_CAPITAL}(?: {_CAPITAL})?"),
)
#: What stands before a card: in the first search no telephone number or account that has begun.
_CARD_STARTS = (
    rf"(?<![0-9+])(?<!\+{_spaced_digits(1, 9)}[ .()-]{{1,3}})(?<![A-Z]{{2}}[0-9]{{2}} ?)",
    r"(?<![0-9+])",
)
#: Groups as printed on cards, any start; then any groups, at every length, from the digits that issuers have, and the longest.
_CARDS = (
    (
        r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}", r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{4}",
        r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{3}", r"[0-9]{13,19}",
    ),
    (
        *(rf"[2-6](?:[ -]?[0-9]){{{n - 1}}}" for n in (16, 15, 19, 18, 17, 14, 13)),
        r"(?:[0-9][ -]?){12,18}[0-9]",
    ),
)
_THIRTEEN = r"(?<![0-9+])(?:[0-9][ -]?){12}[0-9]"
ANY = "|".join(f"(?:{p})" for p in (*(p for _, p in PASSES if p), _THIRTEEN))
#: Cheap: texts without any of this hold no entity.
HINT = "[0-9@]|" + "|".join(MALE_TITLES + FEMALE_TITLES)


@dataclass(frozen=True)
class PiiParams:
    """`key` is the secret; `rounds` bounds the search for a free surrogate, which then fails loudly."""

    key: str = "change me"
    rounds: int = 32


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum of a string of digits; the last digit is doubled, or the one before it."""
    chars = F.split(F.reverse(digits), "")

    def add(total: Column, item: Column) -> Column:
        d = item["d"].cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        odd = item["i"] % 2 == (0 if double_last else 1)
        return total + F.when(odd, doubled).otherwise(d)

    items = F.transform(chars, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(F.filter(items, lambda x: x["d"] != ""), F.lit(0), add)


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _cards(text: Column, search: int) -> Column:
    """The pattern of the cards with right check digits that a text holds, wherever they start; null if none."""
    start = _CARD_STARTS[search]
    found = [F.regexp_extract_all(text, F.lit(f"{start}(?=({shape})(?![0-9]))"), F.lit(1)) for shape in _CARDS[search]]
    right = F.filter(F.array_distinct(F.concat(*found)), lambda v: _luhn_sum(_plain(v), False) % 10 == 0)
    either = F.array_join(F.transform(right, lambda v: F.concat(F.lit(r"\Q"), v, F.lit(r"\E"))), "|")
    return F.when(F.size(right) > 0, F.concat(F.lit(f"{start}(?:"), either, F.lit(")(?![0-9])")))


def pieces(text: Column) -> Column:
    """The text as an array of (value, kind): rest, entity, rest, ... , rest. Rests have no kind and may be empty."""

    def cut(value: Column, kind: str, pattern: Column) -> Column:
        between = F.split(value, pattern, -1)
        found = F.regexp_extract_all(value, pattern, F.lit(0))
        rows = F.zip_with(
            between, found,
            lambda b, v: F.array(_piece(b, F.lit(None)), _piece(v, F.when(v.isNotNull(), F.lit(kind)))),
        )
        return F.filter(F.flatten(rows), lambda x: x["value"].isNotNull())

    def searched(kind: str, fixed: str | None, search: int):
        def step(piece: Column) -> Column:
            value, whole = piece["value"], F.array(piece)
            if fixed is not None:
                return F.when(piece["kind"].isNull() & value.rlike(fixed), cut(value, kind, F.lit(fixed))).otherwise(whole)
            hit = piece["kind"].isNull() & value.rlike(_THIRTEEN)
            made = F.transform(
                F.array(_cards(value, search)), lambda p: F.when(p.isNull(), whole).otherwise(cut(value, kind, p))
            )
            return F.when(hit, made[0]).otherwise(whole)

        return step

    out, searches = F.array(_piece(text, F.lit(None))), 0
    for kind, fixed in PASSES:
        out = F.flatten(F.transform(out, searched(kind, fixed, searches)))
        searches += fixed is None
    return out


def _piece(value: Column, kind: Column) -> Column:
    return F.struct(value.cast("string").alias("value"), kind.cast("string").alias("kind"))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^({_TITLE}) ", 1)


def canonical(kind: Column, value: Column) -> Column:
    """Equal for all ways of writing an entity."""
    female = F.regexp_replace(_title(value), r"\.$", "").isin(*FEMALE_TITLES)
    person = F.concat(
        F.when(female, F.lit("female")).otherwise(F.lit("male")), F.lit(":"),
        F.lower(F.regexp_replace(value, rf"^{_TITLE} ", "")),
    )
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "ip", value)
        .when(kind == "name", person)
        .otherwise(_plain(value))
    )


def _stream(params: PiiParams, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(params.key), *parts), 256)


def _digits(hexes: Column) -> Column:
    return F.translate(hexes, "abcdef", "274951")


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", "abcdefghklmnoprt")


def _reshaped(value: Column, hexes: Column) -> Column:
    """Letters become letters, digits digits, all else stays."""
    at = lambda s, i: F.substring(s, i % 64 + 1, F.lit(1))
    chars = F.transform(
        F.split(value, ""),
        lambda c, i: F.when(c.rlike("[0-9]"), at(_digits(hexes), i))
        .when(c.rlike("[a-z]"), at(_letters(hexes), i))
        .when(c.rlike("[A-Z]"), F.upper(at(_letters(hexes), i)))
        .otherwise(c),
    )
    return F.array_join(chars, "")


def _iban(plain: Column, hexes: Column) -> Column:
    body, country = _reshaped(F.substring(plain, F.lit(5), F.length(plain)), hexes), F.substring(plain, 1, 2)
    chars = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    rest = F.aggregate(
        chars,
        F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _name(plain: Column, hexes: Column, attempt: Column) -> Column:
    """The surname grows by a syllable with every attempt, so there is no last free name."""
    number = lambda start: F.conv(F.substring(hexes, start, F.lit(1)), 16, 10).cast("int") + 1

    def of(script: str) -> Column:
        pick = lambda values, start: F.element_at(F.array(*map(F.lit, values)), number(start))
        first = F.when(plain.startswith("female:"), pick(FIRST_NAMES[script, "female"], F.lit(1))).otherwise(
            pick(FIRST_NAMES[script, "male"], F.lit(1))
        )
        syllables = F.transform(F.sequence(F.lit(1), attempt + 3), lambda k: pick(SYLLABLES[script], k % 64 + 1))
        last = F.initcap(F.array_join(syllables, ""))
        return F.when(F.instr(plain, " ") > 0, F.concat(first, F.lit(" "), last)).otherwise(last)

    new = F.when(plain.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))
    return F.concat(F.split_part(plain, F.lit(":"), F.lit(1)), F.lit(":"), F.lower(new))


def surrogate(params: PiiParams, kind: Column, plain: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity at an attempt."""
    hexes = _stream(params, kind, plain, attempt.cast("string"))
    digits, n = _digits(hexes), F.length(plain)
    high = lambda start: F.translate(F.substring(digits, start, 1), "01", "68")
    octet = lambda start: (F.conv(F.substring(hexes, start, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    private = plain.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)")
    first = F.when(private, F.lit("10")).otherwise((F.conv(F.substring(hexes, 1, 4), 16, 10).cast("int") % 15 + 240).cast("string"))
    domain = F.substring_index(plain, "@", -1)
    ending = F.substring_index(domain, ".", -1)
    ending = F.when(ending.isin("com", "net", "org"), ending).otherwise(F.lit("com"))
    local = F.concat(
        _reshaped(F.substring_index(plain, "@", 1), hexes),
        F.when(attempt > 0, attempt.cast("string")).otherwise(F.lit("")),
    )
    host = F.substring(_letters(_stream(params, F.lit("domain"), domain)), 1, 8)
    body = F.concat(F.substring(plain, 1, 1), F.substring(digits, F.lit(1), n - 2))
    check = ((10 - _luhn_sum(body, True) % 10) % 10).cast("string")
    kept = F.when(n > 10, F.substring(plain, F.lit(1), n - 10)).otherwise(F.lit(""))
    rest = F.concat(high(1), F.substring(digits, 2, 2), high(4), F.substring(digits, 5, 6))
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), host, F.lit(".example."), ending))
        .when(kind == "ip", F.concat_ws(".", first, octet(5), octet(9), octet(13)))
        .when(kind == "card", F.concat(body, check))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, 1, 8)))
        .when(kind == "iban", _iban(plain, hexes))
        .when(kind == "name", _name(plain, hexes, attempt))
        .otherwise(F.concat(kept, F.substring(rest, F.lit(1), F.least(n, F.lit(10)))))
    )


def formatted(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate in the way the occurrence is written."""
    shown = F.when(value == F.upper(value), F.upper(new)).otherwise(new)
    person = F.substring_index(new, ":", -1)
    person = F.when(F.regexp_replace(value, rf"^{_TITLE} ", "") == F.upper(F.regexp_replace(value, rf"^{_TITLE} ", "")), F.upper(person)).otherwise(F.initcap(person))
    walked = F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike("[0-9A-Za-z]"),
                F.substring(new, F.length(_plain(F.substring(value, F.lit(1), i))) + 1, F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )
    return (
        F.when(kind == "email", shown)
        .when(kind == "ip", new)
        .when(kind == "name", F.concat(_title(value), F.lit(" "), person))
        .otherwise(walked)
    )


def registry(entities: DataFrame, params: PiiParams) -> DataFrame:
    """kind, plain, new: one surrogate per entity, none shared and none that is an entity itself.

    All entities try their first hash; of those that meet, the smallest keeps it and the others go on.
    """
    known = written(entities.select("kind", "plain").distinct(), "entities")
    trial = known.withColumn("attempt", F.lit(0))
    for _ in range(params.rounds):
        named = trial.withColumn("new", surrogate(params, F.col("kind"), F.col("plain"), F.col("attempt")))
        order = Window.partitionBy("kind", "new").orderBy("attempt", "plain")
        ranked = named.withColumn("nth", F.row_number().over(order))
        real = known.select("kind", F.col("plain").alias("new"), F.lit(True).alias("real"))
        judged = ranked.join(real, ["kind", "new"], "left").withColumn("taken", (F.col("nth") > 1) | F.col("real").isNotNull())
        judged = written(judged.select("kind", "plain", "new", "attempt", "taken"), "surrogates")
        if judged.filter("taken").isEmpty():
            return judged.select("kind", "plain", "new")
        trial = judged.select("kind", "plain", (F.col("attempt") + F.col("taken").cast("int")).alias("attempt"))
    raise RuntimeError(f"no free surrogate for every entity after {params.rounds} rounds")


def replaced(docs: DataFrame, params: PiiParams = PiiParams(), entities: str | None = None) -> DataFrame:
    """`docs` with `text` in which every entity is replaced; all rows and columns stay.

    With `entities`, a column of that name lists the kinds found in order, comma-joined (empty if none).
    Null and empty texts, and texts without entities, stay as they are and are not shuffled. Repeated
    rows and repeated entities get the same surrogates. An empty table gives an empty table.
    """
    text = F.col("text").cast("string")
    hit = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    extra = [F.lit("").alias(entities)] if entities else []
    rest = docs.filter(~hit).select("*", *extra)
    hits = docs.filter(hit).withColumn("__row", F.monotonically_increasing_id())
    hits = hits.withColumn("__pieces", pieces(text))
    hits = hits.withColumn("__found", F.filter("__pieces", lambda p: p["kind"].isNotNull()))
    parts = F.transform(F.filter("__pieces", lambda p: p["kind"].isNull()), lambda p: p["value"])
    hits = written(hits.withColumn("__parts", parts).drop("__pieces"), "hits")
    seen = hits.select("__row", F.posexplode("__found").alias("pos", "piece")).select("__row", "pos", "piece.*")
    seen = written(seen.withColumn("plain", canonical(F.col("kind"), F.col("value"))), "found")
    joined = seen.join(registry(seen, params), ["kind", "plain"])
    new = formatted(F.col("kind"), F.col("value"), F.col("new"))
    put = joined.select("__row", F.struct("pos", new.alias("put"), "kind").alias("item"))
    by_row = put.groupBy("__row").agg(F.sort_array(F.collect_list("item")).alias("__put"))
    put = F.coalesce(F.col("__put.put"), F.array().cast("array<string>"))
    parts = F.zip_with("__parts", put, lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    kinds = [F.coalesce(F.array_join("__put.kind", ","), F.lit("")).alias(entities)] if entities else []
    columns = [F.array_join(parts, "").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return rest.unionByName(hits.join(by_row, "__row", "left").select(*columns, *kinds))
