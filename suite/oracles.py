"""The registered queries again, as DuckDB SQL on the same tables.

Written from the definitions, relationally, and not from the Spark plans: word pairs by `lead`,
vocabularies by ranking all terms, similarities by joining all pairs of items.
"""

from __future__ import annotations

from akin.functions.text import STOP_WORDS, TAG, TOKEN, WHITESPACE

STAMP = "2025-01-05 03:00:00"
WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def clean(text: str) -> str:
    return (
        f"coalesce(trim(regexp_replace(regexp_replace({text}, '{TAG}', '', 'g'), "
        f"'{WHITESPACE}', ' ', 'g')), '')"
    )


def word_list(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '{TOKEN}')"


PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: str, sql: str) -> None:
    """A named common table expression and the ones it reads."""
    PARTS[name] = (needs.split(), sql)


def query(needs: str, sql: str) -> str:
    """`sql` behind the common table expressions it needs, each before its readers."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    if not order:
        return sql
    heads = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order)
    return f"WITH {heads}\n{sql}"


# --- items --------------------------------------------------------------------------------------

part(
    "catalog",
    "",
    f"""
    SELECT d.doc_id AS id, p.p_name AS name,
        CASE WHEN p.p_size % 10 = 0 THEN [] ELSE string_split(p.p_name, ' ') END AS genres,
        d.text AS summary, {clean('d.text')} AS summary_clean,
        CASE WHEN l.toxic = 1 THEN 'TOXIC' WHEN l.quality = 1 THEN 'GOOD'
             WHEN l.quality = 0 THEN 'POOR' END AS type,
        d.lang AS language, p.p_type AS status,
        CASE WHEN p.p_size % 3 <> 0 THEN p.p_brand END AS network,
        CASE WHEN p.p_size % 3 = 0 AND p.p_size % 2 = 0 THEN d.source END AS webchannel,
        CASE WHEN p.p_size % 3 <> 0 THEN p.p_brand WHEN p.p_size % 2 = 0 THEN d.source END AS platform,
        CASE WHEN p.p_size % 7 <> 0 THEN p.p_retailprice END AS rating_avg
    FROM documents d LEFT JOIN part p ON p.p_partkey = d.doc_id
    LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
part(
    "metadata",
    "catalog",
    f"""
    SELECT id AS item_id, name, genres, coalesce(nullif(summary_clean, ''), summary) AS summary,
        rating_avg AS rating, type, language, platform AS network, '{STAMP}' AS synced_at
    FROM catalog""",
)
part("toxic", "", "SELECT doc_id AS item_id FROM labels WHERE toxic = 1")

# --- features -----------------------------------------------------------------------------------

part(
    "words",
    "catalog",
    f"""
    SELECT id, pos, w FROM (
        SELECT id, unnest({word_list('summary_clean')}) AS w,
            generate_subscripts({word_list('summary_clean')}, 1) AS pos FROM catalog)
    WHERE w NOT IN ({WORDS})""",
)
part(
    "item_terms",
    "words",
    """
    SELECT id, term, count(*) AS tf FROM (
        SELECT id, w AS term FROM words
        UNION ALL
        SELECT id, w || ' ' || lead(w) OVER (PARTITION BY id ORDER BY pos) FROM words)
    WHERE term IS NOT NULL GROUP BY id, term""",
)
part(
    "term_vocab",
    "item_terms",
    """
    SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, tf,
        ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf
    FROM (
        SELECT t.*, n FROM
            (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM item_terms GROUP BY term) t,
            (SELECT count(*) AS n FROM catalog)
        WHERE df >= 2 AND df <= 0.8::DOUBLE * n
        ORDER BY tf DESC, term LIMIT 500)""",
)
part(
    "tfidf",
    "term_vocab",
    """
    SELECT id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (
        SELECT i.id, v.term_id, i.tf * v.idf AS w FROM item_terms i JOIN term_vocab v USING (term))""",
)
part(
    "genre_vocab",
    "catalog",
    """
    SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS genre_id
    FROM (SELECT DISTINCT unnest(genres) AS genre FROM catalog)""",
)
part(
    "type_vocab",
    "catalog",
    """
    SELECT type, row_number() OVER (ORDER BY type) - 1 AS type_id
    FROM (SELECT DISTINCT type FROM catalog WHERE type IS NOT NULL)""",
)


def ranks(column: str, n: int) -> str:
    return f"""
    SELECT value, n, row_number() OVER (ORDER BY n DESC, value) - 1 AS rank FROM (
        SELECT {column} AS value, count(*) AS n FROM catalog WHERE {column} IS NOT NULL GROUP BY 1)
    QUALIFY rank < {n}"""


part("platform_rank", "catalog", ranks("platform", 20))
part("language_rank", "catalog", ranks("language", 2))
part(
    "items",
    "catalog platform_rank language_rank",
    """
    SELECT c.id, list_distinct(c.genres) AS genres, c.type,
        coalesce(p.rank, 20) AS platform_bucket, coalesce(l.rank, 2) AS language_bucket
    FROM catalog c LEFT JOIN platform_rank p ON p.value = c.platform
    LEFT JOIN language_rank l ON l.value = c.language""",
)

# --- pairs --------------------------------------------------------------------------------------

part(
    "text_pairs",
    "tfidf",
    """
    SELECT a.id AS i, b.id AS j, sum(a.weight * b.weight) AS s
    FROM tfidf a JOIN tfidf b USING (term_id) WHERE a.id < b.id GROUP BY 1, 2""",
)


def scores(left: str, right: str) -> str:
    matches = " + ".join(
        f"coalesce(({left}.{c} = {right}.{c})::INT, 0)"
        for c in ("platform_bucket", "type", "language_bucket")
    )
    return f"""
        CASE WHEN len({left}.genres) = 0 OR len({right}.genres) = 0 THEN 0 ELSE
            len(list_intersect({left}.genres, {right}.genres))
            / sqrt((len({left}.genres) * len({right}.genres))::DOUBLE) END AS genre_score,
        ({matches}) / 3::DOUBLE AS mean_score,
        ({matches}) / sqrt((2 + ({left}.type IS NOT NULL)::INT)::DOUBLE
            * (2 + ({right}.type IS NOT NULL)::INT)) AS concat_score"""


part(
    "half",
    "items text_pairs",
    f"""
    SELECT a.id AS i, b.id AS j, coalesce(t.s, 0) AS text_score, {scores('a', 'b')}
    FROM items a JOIN items b ON a.id < b.id LEFT JOIN text_pairs t ON t.i = a.id AND t.j = b.id""",
)
part(
    "pairs",
    "half",
    """
    SELECT i AS item_id, j AS similar_item_id, * EXCLUDE (i, j) FROM half
    UNION ALL SELECT j, i, * EXCLUDE (i, j) FROM half""",
)


def mix(g: float, t: float, m: float, metadata: str, scale: bool) -> str:
    total = g + t + m if scale else 1.0
    return (
        f"round({g!r}::DOUBLE / {total!r}::DOUBLE * genre_score"
        f" + {t!r}::DOUBLE / {total!r}::DOUBLE * text_score"
        f" + {m!r}::DOUBLE / {total!r}::DOUBLE * {metadata}, 9)"
    )


def best(score: str, source: str, n: int, low: float, keys: str = "item_id") -> str:
    return f"""
    SELECT * FROM (SELECT *, {score} AS similarity_score FROM {source})
    WHERE similarity_score >= {low!r}::DOUBLE
    QUALIFY row_number() OVER (PARTITION BY {keys}
        ORDER BY similarity_score DESC, similar_item_id) <= {n}"""


part(
    "stored",
    "pairs",
    f"""
    SELECT item_id, similar_item_id, similarity_score, round(genre_score, 9) AS genre_score,
        round(text_score, 9) AS text_score, round(mean_score, 9) AS metadata_score,
        '{STAMP}' AS computed_at
    FROM ({best(mix(0.4, 0.5, 0.1, 'mean_score', False), 'pairs', 20, 0.1)})""",
)
FOUR = """round(similarity_score, 6) AS similarity_score, round(genre_score, 6) AS genre_score,
    round(text_score, 6) AS text_score, round(metadata_score, 6) AS metadata_score"""
part(
    "remixed",
    "pairs",
    f"""
    SELECT item_id, similar_item_id, similarity_score, round(genre_score, 9) AS genre_score,
        round(text_score, 9) AS text_score, round(mean_score, 9) AS metadata_score,
        '{STAMP}' AS computed_at
    FROM ({best(mix(0.3, 0.6, 0.1, 'mean_score', True), 'pairs', 10, 0.2)})""",
)
part(
    "bought",
    "",
    """
    SELECT DISTINCT a.l_partkey AS item_id, b.l_partkey AS similar_item_id
    FROM lineitem a JOIN lineitem b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_partkey <> b.l_partkey""",
)
part(
    "scored",
    "bought items tfidf",
    f"""
    SELECT p.item_id, p.similar_item_id, coalesce(t.s, 0) AS text_score, {scores('a', 'b')}
    FROM bought p JOIN items a ON a.id = p.item_id JOIN items b ON b.id = p.similar_item_id
    LEFT JOIN (
        SELECT q.item_id, q.similar_item_id, sum(x.weight * y.weight) AS s
        FROM bought q JOIN tfidf x ON x.id = q.item_id
        JOIN tfidf y ON y.id = q.similar_item_id AND y.term_id = x.term_id GROUP BY 1, 2) t
        ON t.item_id = p.item_id AND t.similar_item_id = p.similar_item_id""",
)
part(
    "long_pairs",
    "half",
    f"""
    SELECT 'genre' AS component, round(genre_score, 9) AS s FROM half
    UNION ALL SELECT 'text', round(text_score, 9) FROM half
    UNION ALL SELECT 'metadata', round(concat_score, 9) FROM half
    UNION ALL SELECT 'hybrid', {mix(0.4, 0.5, 0.1, 'concat_score', True)} FROM half""",
)

# --- requests -----------------------------------------------------------------------------------

part(
    "requests",
    "",
    r"""
    SELECT page_id AS request_id,
        nullif(regexp_extract(url, '^https?://[^/]+/[a-z]+/([^/?#]+)', 1), '') AS item_id,
        nullif(regexp_extract(url, '[?&]page=([^&#]+)', 1), '') AS n,
        nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), '') AS min_similarity
    FROM pages""",
)
part(
    "valid",
    "requests",
    """
    SELECT request_id, item_id, n, min_similarity,
        CASE WHEN no_id THEN 'item_id is required'
            WHEN item_id IS NULL THEN 'item_id must be an integer'
            WHEN n IS NULL THEN 'n must be an integer'
            WHEN min_similarity IS NULL THEN 'min_similarity must be a number'
            WHEN n < 1 OR n > 50 THEN 'n must be between 1 and 50'
            WHEN min_similarity < 0 OR min_similarity > 1
                THEN 'min_similarity must be between 0 and 1' END AS error
    FROM (SELECT request_id, item_id IS NULL AS no_id,
        CASE WHEN regexp_full_match(item_id, '[+-]?[0-9]+') THEN item_id::BIGINT END AS item_id,
        CASE WHEN n IS NULL THEN 10
            WHEN regexp_full_match(n, '[+-]?[0-9]+') THEN n::BIGINT END AS n,
        CASE WHEN min_similarity IS NULL THEN 0.0
            ELSE try_cast(min_similarity AS DOUBLE) END AS min_similarity
        FROM requests)""",
)


def served(n: int, low: float) -> str:
    return query(
        "stored",
        f"""
        SELECT s.item_id, s.similar_item_id, {FOUR}, l.doc_id AS request_id,
            row_number() OVER (PARTITION BY l.doc_id
                ORDER BY s.similarity_score DESC, s.similar_item_id) AS rank
        FROM labels l JOIN stored s ON s.item_id = l.doc_id
        WHERE s.similarity_score >= {low!r}::DOUBLE QUALIFY rank <= {n}""",
    )


# --- queries ------------------------------------------------------------------------------------

ORACLES: dict[str, str] = {}
GENRES = "array_to_string(genres, '|') AS genres"

ORACLES["load_catalog_capped"] = query(
    "catalog",
    "SELECT id, name, language, length(summary) AS n_chars FROM catalog ORDER BY id LIMIT 300",
)
ORACLES["load_catalog_json"] = query(
    "catalog",
    """SELECT id, CASE WHEN id % 9 <> 1 THEN name END AS name, CASE WHEN id % 9 <> 1 THEN language END AS language,
    length(summary) AS n_chars FROM catalog WHERE id % 9 NOT IN (0, 3)""",
)
ORACLES["load_catalog_json_rejects"] = query(
    "catalog",
    """SELECT id, CASE id % 9 WHEN 0 THEN 'damaged' ELSE 'no id' END AS reason FROM catalog WHERE id % 9 IN (0, 3)""",
)
ORACLES["catalog_page"] = query(
    "catalog",
    """SELECT id, name, (SELECT count(*) FROM catalog) AS total, 60::BIGINT AS "offset",
    40::BIGINT AS "limit" FROM catalog ORDER BY id LIMIT 40 OFFSET 60""",
)
ORACLES["lookup_by_keys"] = query(
    "metadata toxic",
    f"""SELECT item_id, name, {GENRES}, rating, type, language, network FROM metadata
    WHERE item_id IN (SELECT item_id FROM toxic)""",
)
ORACLES["lookup_children_by_keys"] = """
    SELECT conv_id, turn, role, text FROM conversations
    QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)"""
ORACLES["prepare_catalog"] = query(
    "catalog",
    f"""SELECT id, name, {GENRES}, summary, summary_clean, type, language, status, platform,
    rating_avg FROM catalog""",
)
ORACLES["nan_to_null"] = """
    SELECT p_partkey, p_size, CASE WHEN isnan(r) THEN NULL ELSE r END AS rating FROM (
        SELECT p_partkey, p_size,
            CASE WHEN p_size % 7 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice END AS r FROM part)"""
ORACLES["sync_metadata"] = query("metadata", "SELECT * EXCLUDE (genres), " + GENRES + " FROM metadata")

PATTERNS = ["red widget", "STEEL", "bolt$", "^(old|new) r", "no such name"]
ORACLES["find_by_name"] = query(
    "catalog",
    " UNION ALL ".join(
        f"""SELECT '{p}' AS pattern, f.id, f.name, array_to_string(f.genres, '|') AS genres
        FROM (SELECT min(id) AS first FROM catalog WHERE regexp_matches(name, '(?i){p}'))
        LEFT JOIN catalog f ON f.id = first"""
        for p in PATTERNS
    ),
)
ORACLES["enrich_with_children"] = query(
    "catalog",
    """
    SELECT c.id AS item_id, c.name, c.summary, array_to_string(c.genres, '|') AS genres,
        c.network, c.webchannel, c.rating_avg AS rating, c.type, c.language, c.status,
        coalesce(s.texts, '') AS season_summaries, coalesce(s.n_texts, 0) AS n_summaries,
        coalesce(s.n, 0) AS season_count
    FROM catalog c LEFT JOIN (
        SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) > 0) AS n_texts,
            string_agg(text, '|' ORDER BY turn) FILTER (length(text) > 0) AS texts
        FROM conversations WHERE turn > 0 GROUP BY conv_id) s ON s.conv_id = c.id""",
)
ORACLES["nest_children"] = """
    SELECT p.conv_id AS item_id, p.text AS summary, coalesce(s.n, 0) AS child_count,
        coalesce(s.lines, '') AS children
    FROM conversations p LEFT JOIN (
        SELECT conv_id, count(*) AS n,
            string_agg(concat_ws(':', turn, role, text), '|' ORDER BY turn) AS lines
        FROM conversations WHERE turn > 0 GROUP BY conv_id) s ON s.conv_id = p.conv_id
    WHERE p.turn = 0"""

ORACLES["clean_html"] = f"SELECT page_id, {clean('html')} AS text FROM pages"
ORACLES["clean_texts"] = f"""
    SELECT p.conv_id AS item_id, coalesce(s.texts, '') AS texts
    FROM conversations p LEFT JOIN (
        SELECT conv_id, string_agg({clean('text')}, '|' ORDER BY turn) AS texts
        FROM conversations WHERE turn > 0 AND length(text) > 0 GROUP BY conv_id) s
        ON s.conv_id = p.conv_id
    WHERE p.turn = 0"""
ORACLES["combine_text"] = f"""
    SELECT conv_id AS item_id, string_agg({clean('text')}, ' ' ORDER BY turn) AS text
    FROM conversations WHERE turn = 0 OR length(text) > 0 GROUP BY conv_id HAVING min(turn) = 0"""
ORACLES["tokenize"] = f"""
    SELECT doc_id, len(words)::BIGINT AS n_words, array_to_string(words, ' ') AS words FROM (
        SELECT doc_id, list_filter({word_list(clean('text'))}, lambda w: w NOT IN ({WORDS})) AS words
        FROM documents)"""

ORACLES["genre_counts"] = query(
    "catalog",
    """SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM catalog)
    GROUP BY genre ORDER BY n DESC, genre LIMIT 20""",
)


def counted(column: str, top: int | None) -> str:
    limit = f"QUALIFY row_number() OVER (ORDER BY n DESC, value) <= {top}" if top else ""
    return f"""
    SELECT '{column}' AS column_name, value, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent,
        count(*) OVER () AS n_distinct
    FROM (SELECT {column} AS value, count(*) AS n FROM catalog WHERE {column} IS NOT NULL GROUP BY 1)
    {limit}"""


ORACLES["value_counts"] = query(
    "catalog",
    " UNION ALL ".join(
        f"({counted(c, n)})"
        for c, n in (("type", None), ("platform", 15), ("language", 10), ("status", None))
    ),
)


def described(name: str, value: str) -> str:
    quartiles = ", ".join(
        f"round(quantile_cont(v, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)
    )
    return f"""
    SELECT '{name}' AS column_name, count(v) AS count, round(avg(v), 6) AS mean,
        round(stddev_samp(v), 6) AS std, min(v) AS min, {quartiles}, max(v) AS max
    FROM (SELECT ({value})::DOUBLE AS v FROM catalog)"""


ORACLES["describe_numeric"] = query(
    "catalog",
    described("rating_avg", "rating_avg")
    + " UNION ALL "
    + described("summary_length", "coalesce(length(summary), 0)"),
)


def bins(name: str, value: str, where: str, n: int) -> str:
    return f"""
    SELECT '{name}' AS measure, b.bin, round(e.lo + e.w * b.bin, 6) AS lower,
        round(e.lo + e.w * (b.bin + 1), 6) AS upper, coalesce(c.n, 0) AS n
    FROM range({n}) b(bin), (SELECT min({value})::DOUBLE AS lo,
        (max({value}) - min({value}))::DOUBLE / {n} AS w FROM catalog WHERE {where}) e
    LEFT JOIN (
        SELECT least(floor(({value} - lo) / w), {n - 1})::BIGINT AS bin, count(*) AS n
        FROM catalog, (SELECT min({value})::DOUBLE AS lo,
            (max({value}) - min({value}))::DOUBLE / {n} AS w FROM catalog WHERE {where})
        WHERE {where} GROUP BY 1) c ON c.bin = b.bin"""


ORACLES["histogram"] = query(
    "catalog",
    bins("rating", "rating_avg", "rating_avg IS NOT NULL", 30)
    + " UNION ALL "
    + bins("length", "length(summary)", "length(summary) > 0", 50),
)
ORACLES["child_coverage"] = query(
    "catalog",
    """
    SELECT count(*) AS n_items, count(*) FILTER (texts > 0) AS n_with_summaries,
        round(avg(coalesce(n, 0)), 6) AS mean_season_count
    FROM catalog LEFT JOIN (
        SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) > 0) AS texts
        FROM conversations WHERE turn > 0 GROUP BY conv_id) ON conv_id = id""",
)
ORACLES["quality_report"] = query(
    "catalog",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS feature, count(*) FILTER ({has}) AS available, count(*) AS total,
        round(count(*) FILTER ({has}) * 100.0::DOUBLE / count(*), 6) AS percent FROM catalog"""
        for name, has in (
            ("genres", "len(genres) > 0"),
            ("summary", "length(summary_clean) > 0"),
            ("rating", "rating_avg IS NOT NULL"),
            ("platform", "platform IS NOT NULL"),
            ("type", "type IS NOT NULL"),
            ("language", "language IS NOT NULL"),
        )
    ),
)
ORACLES["missing_values"] = query(
    "catalog",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM catalog"
        for c in (
            "id", "name", "genres", "summary", "summary_clean", "type", "language", "status",
            "platform", "rating_avg",
        )
    )
    + ") WHERE n_missing > 0",
)
ORACLES["check_unique_keys"] = query(
    "catalog stored",
    """
    SELECT md5(summary_clean) AS key, count(*) AS n FROM catalog GROUP BY summary_clean HAVING n > 1
    UNION ALL
    SELECT concat_ws('-', item_id, similar_item_id), count(*) AS n FROM stored
    GROUP BY item_id, similar_item_id HAVING n > 1""",
)
ORACLES["check_not_null"] = query(
    "metadata",
    " UNION ALL ".join(
        f"SELECT item_id AS key, '{c}' AS column_name FROM metadata WHERE {c} IS NULL"
        for c in ("name", "rating", "network", "type", "synced_at")
    ),
)
ORACLES["check_lengths"] = query(
    "metadata",
    " UNION ALL ".join(
        f"SELECT item_id AS key, '{c}' AS column_name FROM metadata WHERE length({c}) > {n}"
        for c, n in (("name", 10), ("type", 50), ("network", 8), ("summary", 255))
    ),
)

ORACLES["topn_categories"] = query(
    "platform_rank language_rank",
    """SELECT 'platform' AS column_name, * FROM platform_rank
    UNION ALL SELECT 'language', * FROM language_rank""",
)
ORACLES["genre_vocab"] = query("genre_vocab", "SELECT * FROM genre_vocab")
ORACLES["type_vocab"] = query("type_vocab", "SELECT * FROM type_vocab")
ORACLES["term_vocab"] = query(
    "term_vocab", "SELECT term, term_id, df, tf, round(idf, 6) AS idf FROM term_vocab"
)
ORACLES["genre_multihot"] = query(
    "genre_vocab",
    """SELECT DISTINCT id, genre_id FROM (SELECT id, unnest(genres) AS genre FROM catalog)
    JOIN genre_vocab USING (genre)""",
)
ORACLES["tfidf"] = query("tfidf", "SELECT id, term_id, round(weight, 6) AS weight FROM tfidf")
ORACLES["platform_onehot"] = query("items", "SELECT id, platform_bucket FROM items")
ORACLES["type_onehot"] = query(
    "type_vocab", "SELECT id, type_id FROM catalog LEFT JOIN type_vocab USING (type)"
)
ORACLES["language_onehot"] = query("items", "SELECT id, language_bucket FROM items")

part(
    "summary_rows",
    "items genre_vocab type_vocab tfidf",
    """
    SELECT * FROM (VALUES
        ('genre', (SELECT count(*) FROM genre_vocab), (SELECT sum(len(genres)) FROM items)),
        ('text', (SELECT count(*) FROM term_vocab), (SELECT count(*) FROM tfidf)),
        ('platform', 21, (SELECT count(*) FROM items)),
        ('type', (SELECT count(*) FROM type_vocab), (SELECT count(type) FROM items)),
        ('language', 3, (SELECT count(*) FROM items))) t(feature_group, n_columns, n_filled)""",
)
SUMMARY = query(
    "summary_rows",
    """
    SELECT feature_group, n AS n_rows, n_columns::BIGINT AS n_columns, n_filled::BIGINT AS n_filled,
        round(1 - n_filled / (n::DOUBLE * n_columns), 6) AS sparsity
    FROM (SELECT * FROM summary_rows
        UNION ALL SELECT 'all', sum(n_columns), sum(n_filled) FROM summary_rows),
        (SELECT count(*) AS n FROM items)""",
)
ORACLES["feature_summary"] = SUMMARY
ORACLES["feature_store_roundtrip"] = SUMMARY
ORACLES["feature_sums"] = query(
    "items platform_rank language_rank",
    """
    SELECT 'genre' AS feature_group, feature, count(*) AS n
        FROM (SELECT unnest(genres) AS feature FROM items) GROUP BY 2
    UNION ALL SELECT 'platform', coalesce(r.value, '(other)'), count(*)
        FROM items LEFT JOIN platform_rank r ON r.rank = platform_bucket GROUP BY 2
    UNION ALL SELECT 'type', type, count(*) FROM items WHERE type IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'language', coalesce(r.value, '(other)'), count(*)
        FROM items LEFT JOIN language_rank r ON r.rank = language_bucket GROUP BY 2""",
)
ORACLES["combined_features"] = query(
    "items genre_vocab type_vocab tfidf",
    """
    SELECT id, (first + feature)::BIGINT AS feature_id, round(value, 6) AS value FROM (
        SELECT id, 0 AS g, genre_id AS feature, 1::DOUBLE AS value
            FROM (SELECT id, unnest(genres) AS genre FROM items) JOIN genre_vocab USING (genre)
        UNION ALL SELECT id, 1, term_id, weight FROM tfidf
        UNION ALL SELECT id, 2, platform_bucket, 1 FROM items
        UNION ALL SELECT id, 3, type_id, 1 FROM items JOIN type_vocab USING (type)
        UNION ALL SELECT id, 4, language_bucket, 1 FROM items)
    JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS g, unnest([0, a, a + b, a + b + 21, a + b + 21 + c]) AS first
        FROM (SELECT (SELECT count(*) FROM genre_vocab) AS a, (SELECT count(*) FROM term_vocab) AS b,
            (SELECT count(*) FROM type_vocab) AS c)) USING (g)""",
)
ORACLES["top_terms"] = query(
    "tfidf",
    """
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term_id) AS rank,
        term, round(weight, 6) AS weight
    FROM tfidf JOIN term_vocab USING (term_id) QUALIFY rank <= 10""",
)

for _name, _column, _alias in (
    ("genre_similarity", "genre_score", "genre_score"),
    ("text_similarity", "text_score", "text_score"),
    ("metadata_similarity_concat", "concat_score", "metadata_score"),
    ("metadata_similarity_mean", "mean_score", "metadata_score"),
):
    ORACLES[_name] = query(
        "scored",
        f"SELECT item_id, similar_item_id, round({_column}, 6) AS {_alias} FROM scored",
    )
ORACLES["hybrid_similarity"] = query(
    "scored",
    f"""SELECT item_id, similar_item_id,
        round({mix(2.0, 3.0, 1.0, 'mean_score', True)}, 6) AS normalised,
        round({mix(0.4, 0.5, 0.1, 'mean_score', False)}, 6) AS raw FROM scored""",
)
ORACLES["similarity_topn"] = query(
    "stored", f"SELECT item_id, similar_item_id, {FOUR} FROM stored"
)
ORACLES["component_topn"] = query(
    "pairs",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS component, item_id, similar_item_id,
        round(similarity_score, 6) AS similarity_score
        FROM ({best(f'round({column}, 9)', 'pairs', 5, 0.0)})"""
        for name, column in (
            ("genre", "genre_score"),
            ("text", "text_score"),
            ("metadata", "mean_score"),
        )
    ),
)
ORACLES["weight_sweep"] = query(
    "pairs",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS scheme, item_id, similar_item_id,
        round(similarity_score, 6) AS similarity_score
        FROM ({best(mix(g, t, m, 'concat_score', True), 'pairs', 5, 0.0)})"""
        for name, g, t, m in (
            ("Balanced", 1.0, 1.0, 1.0),
            ("Text-Heavy", 0.3, 0.6, 0.1),
            ("Genre-Heavy", 0.6, 0.3, 0.1),
            ("Text+Genre", 0.4, 0.5, 0.1),
            ("No Metadata", 0.5, 0.5, 0.0),
        )
    ),
)
ORACLES["similarity_stats"] = query(
    "long_pairs",
    """SELECT component, count(*) AS n_pairs, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std,
        round(min(s), 6) AS min, round(max(s), 6) AS max, round(median(s), 6) AS median
    FROM long_pairs GROUP BY component""",
)
ORACLES["score_range"] = query(
    "long_pairs tfidf",
    """
    SELECT component, round(min(s), 6) AS min, round(max(s), 6) AS max FROM (
        SELECT * FROM long_pairs
        UNION ALL SELECT unnest(['genre', 'text', 'metadata', 'hybrid']),
            unnest([g, t, 1, 0.4 * g + 0.5 * t + 0.1])
        FROM (SELECT (len(genres) > 0)::INT::DOUBLE AS g,
            (id IN (SELECT id FROM tfidf))::INT::DOUBLE AS t FROM items))
    GROUP BY component""",
)
part("edges", "long_pairs", "SELECT component, min(s) AS lo, max(s) AS hi FROM long_pairs GROUP BY 1")
ORACLES["pair_histogram"] = query(
    "edges",
    """
    SELECT e.component, b.bin, round(lo + (hi - lo) / 50 * b.bin, 6) AS lower,
        round(lo + (hi - lo) / 50 * (b.bin + 1), 6) AS upper, coalesce(n, 0) AS n
    FROM edges e CROSS JOIN range(50) b(bin)
    LEFT JOIN (
        SELECT component, least(floor((s - lo) * 50 / (hi - lo)), 49)::BIGINT AS bin, count(*) AS n
        FROM long_pairs JOIN edges USING (component) GROUP BY 1, 2) c
        ON c.component = e.component AND c.bin = b.bin""",
)

ORACLES["store_similarities"] = query(
    "stored", f"SELECT item_id, similar_item_id, {FOUR}, computed_at FROM stored"
)
ORACLES["replace_neighbours"] = query(
    "stored remixed toxic",
    f"""
    SELECT item_id, similar_item_id, {FOUR} FROM (
        SELECT * EXCLUDE (computed_at) FROM stored WHERE item_id NOT IN (SELECT item_id FROM toxic)
        UNION ALL BY NAME
        SELECT * EXCLUDE (computed_at) FROM remixed WHERE item_id IN (SELECT item_id FROM toxic))""",
)
ORACLES["store_append"] = ORACLES["store_similarities"]
ORACLES["store_replace"] = query(
    "stored remixed toxic",
    f"""
    SELECT item_id, similar_item_id, {FOUR}, computed_at FROM stored
        WHERE item_id NOT IN (SELECT item_id FROM toxic)
    UNION ALL
    SELECT item_id, similar_item_id, {FOUR}, '2025-02-01 00:00:00' FROM remixed
        WHERE item_id IN (SELECT item_id FROM toxic)""",
)
ORACLES["store_delete"] = query(
    "stored toxic",
    f"""SELECT item_id, similar_item_id, {FOUR}, computed_at FROM stored
    WHERE item_id NOT IN (SELECT item_id FROM toxic)""",
)
ORACLES["delete_items"] = query(
    "stored toxic",
    """SELECT t.item_id, count(s.item_id) AS n_deleted, count(s.item_id) > 0 AS found
    FROM toxic t LEFT JOIN stored s ON s.item_id = t.item_id GROUP BY 1""",
)
ORACLES["store_delete_counts"] = ORACLES["delete_items"]
ORACLES["kept_after_delete"] = query(
    "metadata toxic",
    "SELECT item_id, name FROM metadata WHERE item_id NOT IN (SELECT item_id FROM toxic)",
)
ORACLES["upsert_metadata"] = query(
    "metadata toxic",
    f"""
    SELECT item_id, name, {GENRES}, rating, synced_at FROM metadata
        WHERE item_id NOT IN (SELECT item_id FROM toxic)
    UNION ALL
    SELECT unnest([item_id, -1 - item_id]), upper(name), {GENRES}, rating, '2025-02-01 00:00:00'
        FROM metadata WHERE item_id IN (SELECT item_id FROM toxic)""",
)
ORACLES["store_upsert"] = ORACLES["upsert_metadata"]
STATS = """count(*) AS total_records, count(DISTINCT item_id) AS unique_items,
    round(count(*)::DOUBLE / count(DISTINCT item_id), 6) AS avg_similarities_per_item,
    max(computed_at) AS last_computed"""
ORACLES["store_stats"] = query("stored", f"SELECT {STATS} FROM stored")
ORACLES["system_stats"] = query(
    "stored",
    f"""SELECT {STATS}, (SELECT count(*) FROM catalog) AS cached_items, 0.4::DOUBLE AS genre_weight,
    0.5::DOUBLE AS text_weight, 0.1::DOUBLE AS metadata_weight FROM stored""",
)
RUN = query(
    "stored",
    f"""SELECT {STATS}, count(DISTINCT item_id) AS computed_items, 20::BIGINT AS top_n_per_item,
    0.1::DOUBLE AS min_similarity FROM stored""",
)
ORACLES["run_stats"] = RUN
ORACLES["full_build"] = RUN
ORACLES["neighbour_counts"] = query(
    "stored", "SELECT item_id, count(*) AS n FROM stored GROUP BY item_id"
)
ORACLES["neighbour_counts_asked"] = query(
    "stored toxic",
    """SELECT a.item_id, count(s.item_id) AS n
    FROM (SELECT unnest([item_id, -1 - item_id]) AS item_id FROM toxic) a LEFT JOIN stored s USING (item_id) GROUP BY 1""",
)
ORACLES["distinct_sources"] = query("stored", "SELECT DISTINCT item_id FROM stored")
ORACLES["reweight_stored_pairs"] = query(
    "remixed", f"SELECT item_id, similar_item_id, {FOUR} FROM remixed"
)
ORACLES["rebuild_with_weights"] = query(
    "remixed", f"SELECT item_id, similar_item_id, {FOUR}, computed_at FROM remixed"
)

ORACLES["validate_requests"] = query("valid", "SELECT * FROM valid")
ORACLES["similar_items"] = served(10, 0.0)
ORACLES["recommend_threshold"] = served(20, 0.5)
ORACLES["recommend_with_metadata"] = query(
    "stored metadata",
    f"""
    SELECT l.doc_id AS request_id, l.doc_id AS source_item_id, row_number() OVER (
            PARTITION BY l.doc_id ORDER BY s.similarity_score DESC, s.similar_item_id) AS rank,
        m.item_id, m.name, array_to_string(m.genres, '|') AS genres, m.summary, m.rating, m.type,
        m.language, m.network, {FOUR}
    FROM labels l JOIN stored s ON s.item_id = l.doc_id
    JOIN metadata m ON m.item_id = s.similar_item_id WHERE m.type IS NOT NULL QUALIFY rank <= 5""",
)
ORACLES["recommend_json"] = query(
    "valid stored metadata",
    """
    SELECT v.request_id,
        CASE WHEN v.error IS NOT NULL THEN 400 WHEN l.n IS NULL THEN 404 ELSE 200 END::BIGINT AS status,
        CASE WHEN v.error IS NULL THEN v.item_id END AS item_id, l.n AS count,
        CASE WHEN v.error IS NULL AND l.n IS NULL
            THEN 'No recommendations found for this item' END AS message, v.error,
        CASE WHEN v.error IS NULL THEN coalesce(l.ids, '') END AS ids,
        CASE WHEN v.error IS NULL THEN coalesce(l.names, '') END AS names,
        CASE WHEN v.error IS NULL THEN coalesce(l.networks, '') END AS networks
    FROM valid v LEFT JOIN (
        SELECT request_id, count(*) AS n, string_agg(similar_item_id::VARCHAR, ',' ORDER BY rank) AS ids,
            string_agg(m.name, ',' ORDER BY rank) AS names,
            string_agg(coalesce(m.network, '-'), ',' ORDER BY rank) AS networks
        FROM (SELECT v.request_id, s.similar_item_id, row_number() OVER (PARTITION BY v.request_id
                ORDER BY s.similarity_score DESC, s.similar_item_id) AS rank
            FROM valid v JOIN stored s ON s.item_id = v.item_id
            WHERE v.error IS NULL AND s.similarity_score >= v.min_similarity QUALIFY rank <= v.n) r
        JOIN metadata m ON m.item_id = r.similar_item_id GROUP BY 1) l USING (request_id)""",
)
ORACLES["verify_sample"] = query(
    "stored metadata",
    """
    SELECT f.item_id AS source_item_id, r.rank, r.similar_item_id AS item_id, m.name,
        array_to_string(m.genres, '|') AS genres, round(r.similarity_score, 6) AS similarity_score,
        r.rank IS NULL AS none_found
    FROM (SELECT item_id FROM metadata ORDER BY item_id LIMIT 3) f
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY item_id
        ORDER BY similarity_score DESC, similar_item_id) AS rank FROM stored QUALIFY rank <= 5) r
        ON r.item_id = f.item_id
    LEFT JOIN metadata m ON m.item_id = r.similar_item_id""",
)
