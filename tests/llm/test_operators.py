"""The operators against brute force on small tables, with odd rows: nulls, blanks, repeats, long texts."""

import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

from akin.llm import ann, html_blocks, licenses, mixing, ngram_join, packing, pii, quality, secret_scan, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, copies string"
WORDS = [a + b + c for a in ("ba", "do", "ke", "lu") for b in ("rin", "sto", "mak", "fel", "nu") for c in "abcdefghijklmnoprstu"]


def documents():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 90))) for _ in range(60)]
    base = [rng.choice(WORDS) for _ in range(120)]
    for i in range(30):
        other = list(base)
        for _ in range(i % 6):
            other[rng.randrange(len(other))] = "changed"
        texts.append(" ".join(other))
    texts += [texts[3], texts[3].upper(), "", "  \n\t ", None, "one", "one two three", "ONE two three", "x " * 30_000]
    texts += ["mail a.b@mail.example.com or A.B@MAIL.EXAMPLE.COM, 42.144.35.254", "password=abcdefgh12345678"]
    rows = [
        (i, t, ("en", "de", None)[i % 3], ("s0", "s1", "s2", None)[i % 4], None, "a", "b", "c") for i, t in enumerate(texts)
    ]
    return [*rows, rows[5], rows[5], (None, "null id " * 4, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same_key(row):
    return (row["doc_id"] is None, row["doc_id"])


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_join_links_what_brute_force_links(docs, words, percent):
    rows = documents()
    sets = [shingles(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    want = Counter(
        (r[0], len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)
    )
    params = ngram_join.JoinParams(words=words, percent=percent, cut=16, leaf=4)
    got = ngram_join.linked(docs, params).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = ngram_join.one_of_each(docs, params)
    assert kept.columns == docs.columns
    blank = sum(not s for s in sets)
    assert kept.count() == blank + len({find(i) for i, s in enumerate(sets) if s})


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_sets_that_link_share_a_shard(percent):
    rng, bands = np.random.default_rng(3), ngram_join.Bands(percent)
    for _ in range(400):
        size = int(rng.integers(1, 400))
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        most = bands.differ(bands.band(size) + 1)
        gone = int(rng.integers(0, most + 1))
        kept = base[min(gone // 2, size - 1):]
        other = np.unique(np.r_[kept, rng.integers(0, 2**64, gone - gone // 2, dtype=np.uint64)])
        base = np.unique(base)
        shared = len(np.intersect1d(base, other))
        if 100 * shared < percent * (len(base) + len(other) - shared) or np.array_equal(base, other):
            continue
        assert len(np.intersect1d(ngram_join.shard_keys(base, bands), ngram_join.shard_keys(other, bands)))


def test_point_bound_is_never_below_the_overlap():
    rng, params = np.random.default_rng(1), ngram_join.JoinParams()
    for n in (3, 50, 2000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: len(a) // 2], rng.integers(0, 2**63, n * 2).astype(np.uint64)])
        points = [np.array([ngram_join.point_of(x, params)], dtype=object) for x in (a, b)]
        assert ngram_join.most_shared(*points)[0] >= len(np.intersect1d(a, b))


def test_mix_reaches_targets(docs):
    rows = mixing.plan(docs).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r["source"], [0, 0, 0.0, 0])
        s = sizes[r["source"]]
        s[0], s[1], s[2], s[3] = s[0] + r["size"], s[1] + r["taken"], r["target"], max(s[3], r["size"])
        assert r["taken"] <= 2 * r["size"] and r["source_size"] is not None
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (5, 2, 1) * 9, strict=False))
    left, goal, free = 1.5 * sum(s[0] for s in sizes.values()), {}, dict(weights)
    while True:
        given = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in free if given[s] > 2 * sizes[s][0]]
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * sizes[s][0]
            left -= goal[s]
            del free[s]
    goal.update(given)
    for source, (_, taken, target, largest) in sizes.items():
        assert target == pytest.approx(goal[source])
        assert abs(taken - target) <= largest
    again = Counter(map(tuple, mixing.plan(docs).collect()))
    assert again == Counter(map(tuple, rows))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


def test_packing_is_an_exact_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer())
    pieces = packing.packed(docs).collect()
    want = Counter()
    for r in documents():
        want[r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1] += 1
    got = Counter()
    for r in pieces:
        got[r["doc_id"], r["doc_tokens"]] += r["start"] == 0
    assert got == want
    by = {r[0]: r[1] for r in documents()}
    for r in pieces:
        ids = np.array([*tokenizer.encode(by[r["doc_id"]] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    sequences = {}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sequences.values())


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_surrogates_are_consistent_and_distinct(spark, docs):
    out = {r["doc_id"]: r["text"] for r in pii.replaced(docs).collect()}
    for r in documents():
        if r[1] is None or "mail" not in r[1]:
            assert out[r[0]] == r[1]
    new = next(t for t in out.values() if t and "mail " in t)
    lower, upper = re.findall(r"\S+@[\w.]+\w", new)
    assert lower != "a.b@mail.example.com" and lower.upper() == upper and "42.144" not in new
    values = [f"+1 ({a}) 555-{b:04d}" for a in (201, 988) for b in range(300)]
    many = spark.createDataFrame([(i, f"call {v} now", "x") for i, v in enumerate(values)], "doc_id long, text string, new string")
    texts = [r["text"] for r in pii.replaced(many, entities="kinds").filter("kinds = 'phone'").collect()]
    assert len(set(texts)) == len(values) and not {f"call {v} now" for v in values} & set(texts)
    assert all(re.fullmatch(r"call \+1 \([2-9]\d\d\) \d{3}-\d{4} now", t) for t in texts)


def test_cards_keep_their_check_digit(spark):
    one = spark.createDataFrame([(1, "card 4041-8949-7460-8795, not 1234567890123456")], "doc_id long, text string")
    text = pii.replaced(one).first()["text"]
    card = re.search(r"card ([\d-]+)", text)[1].replace("-", "")
    total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(card)))
    assert card != "4041894974608795" and total % 10 == 0 and text.endswith("1234567890123456")


ENTITIES = {
    "email": "a.b@mail.example.com", "ip": "190.137.223.204", "iban": "AT61 1904 3002 3457 3201", "card": "4111 1111 1111 1111",
    "ssn": "123-45-6789", "phone": "+1 (826) 555-4081", "name": "Mr Smith",
}


def test_adjacent_entities_are_all_replaced(spark):
    values = [*ENTITIES.items(), ("ip", "8.8.4.4"), ("phone", "+44 20 7946 0958"), ("phone", "826-555-4081"), ("card", "371449635398431")]
    rows = [(f"{a},{b}", f"{x} {y}", f"{x}|{y}") for a, x in values for b, y in values if (a, b) != ("name", "name")]
    rows += [("card", "4111 1111 1111 1111 12/26", "4111 1111"), ("card", "4111 1111 1111 1111 123", "4111 1111"),
             ("phone,ip", "+1 (826) 555-4081 1.2.3.4", "1.2.3.4"), ("card", "1234 4111 1111 1111 1111", "1111 1111")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, want string, text string, old string")
    out = pii.replaced(frame, entities="kinds").collect()
    assert [(r["old"], r["kinds"]) for r in out if r["kinds"] != r["want"]] == []
    assert not [r["text"] for r in out for v in r["old"].split("|") if v in r["text"]]


def test_names_never_run_out(spark):
    names = [f"Mr {a}{b}{c}" for a in ("Bo", "Ke", "La", "Mi") for b in WORDS[:60] for c in WORDS[:20]]
    frame = spark.createDataFrame([(n,) for n in names], "text string")
    out = [r["text"] for r in pii.replaced(frame).collect()]
    assert len(set(names)) == len(names) > 4096
    assert len(set(out)) == len(names) and not set(out) & set(names)


def test_toxicity_finds_held_out_words(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(WORDS, k=40)
        if toxic := i % 8 == 0:
            words += [f"nasty{rng.choice('abcdef')}" for _ in range(3)]
        rows.append((i, " ".join(words), "s"))
        if i % 2 == 0:
            labels.append((i, int(toxic), None))
    rows += [(1000, None, "s"), (1001, "", "s"), rows[0]]
    out = toxicity.toxicity(
        spark.createDataFrame(rows, "doc_id long, text string, score string"),
        spark.createDataFrame(labels, "doc_id long, toxic int, text string"),
    ).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [(r["doc_id"] % 8 == 0, r["predicted"]) for r in out if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([a == bool(b) for a, b in held]) > 0.95
    blank = {r["score"] for r in out if not r["text"]}
    assert len(blank) == 1 and 0 <= blank.pop() <= 1


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(empty, none).count() == 0


def test_quality_counts_and_verdicts(spark, docs):
    junk = [(2000 + i, " ".join(w + "###" for w in WORDS[:50]), "en", "s0", None, "", "", "") for i in range(2)]
    out = quality.judged(docs.union(spark.createDataFrame(junk, SCHEMA)))
    for r in out.collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        spots = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(spots))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(spots) > 30 * len(words))
        assert r["kept"] == (not r["base_failed"] and "###" not in text)


def test_sketch_buckets_hold_their_floor(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).select("id", quality.floor_of(F.col("b")).alias("low"))
    assert all(0 <= r["id"] - r["low"] <= r["id"] / 16 for r in rows.collect())


def test_secret_entropy_and_base(docs):
    text = "é api_key: 'Zx8Qw3Er7Ty1Ui9Op5As' AKIAABCDEFGHIJKLMN 0123456789abcdef kF9x2LmQ7vRt4Wz8Bn3Yc6Hd1 einfachesuperlangeswort"
    scanner = secret_scan.Scanner(secret_scan.ScanParams())
    base = scanner.base(text)
    assert [text[s:e] for s, _, e in base] == ["api_key: 'Zx8Qw3Er7Ty1Ui9Op5As", "AKIAABCDEFGHIJKLMN", "0123456789abcdef"]
    assert [text[s:e] for s, _, e in scanner.added(text, base)] == ["kF9x2LmQ7vRt4Wz8Bn3Yc6Hd1"]
    sample = "aabbccddaabbzzxy12"
    for i, got in enumerate(secret_scan.entropies(sample, 6)):
        counts = np.array(list(Counter(sample[i : i + 6]).values())) / 6
        assert got == pytest.approx(-(counts * np.log2(counts)).sum())
    out = secret_scan.scanned(docs).collect()
    assert sum(r["n_assign"] for r in out) == 1 and all(r["spans"] is not None for r in out)


def test_html_blocks():
    tree = html_blocks.trained()
    page = (
        "<nav><ul><li><a href='/'>Home</a></ul></nav><div class=ad>Buy a boat now and then.</div><article><h1>A &amp; B</h1>"
        "<p>One  two\n<b>three</b><br>four.<p>Of.</p><aside>Not this one at all.</aside></article>"
        "<section id=comments><p>I like it very much, thanks.</p></section><script>var p = '<p>no</p>';</script><footer>&copy; x</footer>"
    )
    assert html_blocks.main_text(page, tree) == "A & B\n\nOne two three four.\n\nOf."
    for odd in (None, "", " ", "<", "<p", "</p></div>", "<!-- open", "<a " + "x" * 50_000, "<div>" * 3000):
        assert isinstance(html_blocks.main_text(odd, tree), str)


def test_html_wrappers_do_not_hide_the_article():
    tree, body = html_blocks.trained(), "<h1>Title</h1></header><p>The first paragraph has a few words of its own.</p><p>Short.</p>"
    want = "Title\n\nThe first paragraph has a few words of its own.\n\nShort."
    wrappers = (
        ("<html class='no-nav'><body class='single has-sidebar'>", "</body></html>"), ("<body class='comments-open'>", "</body>"),
        ("<div class='content-sidebar-wrap'>", "</div>"), ("<div id='page' class='no-sidebar'>", "</div>"),
        ("<div class='site-sidebar-left'>", "</div>"), ("<div title='the hidden river' data-class='ad'>", "</div>"),
    )
    for before, after in wrappers:
        for header in ("<header>", "<header class='entry-header'>"):
            page = f"{before}<article>{header}{body}</article><div class='comments'><article><p>I like it very much.</p></article></div>{after}"
            assert html_blocks.main_text(page, tree) == want
    for hidden in ("<div hidden>", "<div style='display: none'>", "<div class='related-posts'>", "<div class='footer-wrapper'>"):
        assert html_blocks.main_text(f"{hidden}<p>Some more words that nobody sees here.</p></div>", tree) == ""


def test_license_variants():
    matcher = licenses.Matcher(licenses.LicenseParams())
    exact = matcher.match("Licensed under CC BY-NC 4.0.")
    assert exact.license == "CC-BY-NC-4.0" and not exact.missing and not exact.extra
    other = matcher.match("This work is licensed under the GNU General Public License, version 2.")
    assert other.license == "GPL-2.0"
    assert matcher.match("A licence to kill is not a wording that any template holds") is None


def test_license_notices_over_lines_and_side_by_side():
    matcher = licenses.Matcher(licenses.LicenseParams())
    names = lambda text: {m[0] for m in matcher.scan(text)}
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause"):
        for part in licenses.TEMPLATES[name][1:]:
            lines = textwrap.wrap(part, 60)
            for mark in ("", " * ", "# ", "// "):
                found = matcher.scan("Some words before.\n\n" + "\n".join(mark + line for line in lines) + "\n\nint main()")
                assert [(m[0], m[2], m[6]) for m in found] == [(name, 2, True)]
    assert names("Licensed under the MIT License. Licensed under CC BY 4.0.") == {"MIT", "CC-BY-4.0"}
    assert names("Licensed under the MIT License or the Apache License, Version 2.0.") == {"MIT", "Apache-2.0"}
    assert names("x = 1\n// SPDX-License-Identifier: MIT OR GPL-2.0-only") == {"MIT", "GPL-2.0"}
    assert matcher.scan("a\nLicensed under the MIT License.\nb")[0][:5] == ("MIT", 1, 1, 2, 33)


def test_nearest_is_exact_and_relaxed_is_close(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(600, 8)).astype("float32")
    vectors[100:140] = vectors[100]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [rows[7], (900, None, "x"), (901, [0.0] * 8, "x"), (902, [float("nan")] * 8, "x"), (903, [1.0, None], "x"), (None, [1.0] * 8, "x")]
    frame = spark.createDataFrame(rows, "id long, v array<float>, rank string")
    asked = frame.filter("id % 50 = 0")
    want = set()
    for i in range(0, 600, 50):
        d = np.sqrt(((vectors[i].astype(float) - vectors.astype(float)) ** 2).sum(axis=1))
        best = sorted((d[j], j) for j in range(600) if j != i)[:10]
        want |= {(i, k + 1, j) for k, (_, j) in enumerate(best)}
    for slack, least in ((1.0, 1.0), (1.3, 0.9)):
        got = ann.nearest(frame, asked, ann.AnnParams(shard_rows=150, block=5, leaf=8, slack=slack)).collect()
        found = {(r["query_id"], r["vec_id"]) for r in got}
        assert len(found & {(q, j) for q, _, j in want}) >= least * len(want)
        if slack == 1.0:
            assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want
    assert ann.nearest(frame.limit(0), asked.limit(0)).count() == 0


def test_empty_tables(empty):
    for operator in (ngram_join.linked, ngram_join.one_of_each, mixing.plan, mixing.mixed, packing.packed, pii.replaced,
                     quality.judged, secret_scan.scanned, licenses.scanned):
        assert operator(empty).count() == 0


def test_license_rows(docs):
    assert licenses.scanned(docs).filter("size(matches) > 0").count() == 0
