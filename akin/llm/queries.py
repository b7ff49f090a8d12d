"""The registered queries of the subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akin.llm import covertree, importance, mixing
from akin.llm.common import table


def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.licenses import scanned

    found = scanned(table(spark, sf, "documents"))
    show = lambda m: F.concat_ws(
        ":", m["license"], m["line"], m["start"], m["end"], F.when(m["exact"], "exact").otherwise("variant")
    )
    return found.select(
        "doc_id", "licenses", F.size("matches").cast("long").alias("n_blocks"),
        F.array_join(F.transform("matches", show), ",").alias("blocks"),
    )


def op2_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.pii import replaced

    out = replaced(table(spark, sf, "documents"), entities="kinds")
    n = F.when(F.col("kinds") == "", 0).otherwise(F.size(F.split("kinds", ",")))
    return out.select("doc_id", "text", n.cast("long").alias("n_entities"), "kinds")


def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.mixing import plan

    return plan(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_html_text(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.html_blocks import extracted

    return extracted(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.toxicity import toxicity

    out = toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.packing import packed

    return packed(table(spark, sf, "documents"))


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.secret_scan import scanned

    found = scanned(table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.quality import judged

    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, drop=("text", "lang", "source"))


def op9_vantage_trees(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.ann import nearest

    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(vectors, vectors.filter("id % 100 = 0"))


def op10_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.ngram_join import linked

    return linked(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_importance(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.importance import resampled

    return resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.covertree import mined

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("v"), moved.alias("label")
    )
    return mined(vectors, F.col("id") % 100 == 0)


def op13_repeats(spark: SparkSession, sf: str) -> DataFrame:
    from akin.llm.repeats import without_repeats

    out = without_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_vantage_trees": op9_vantage_trees,
    "op10_ngram_join": op10_ngram_join,
    "op11_importance": op11_importance,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_repeats": op13_repeats,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.oracle(),
    "op11_importance": importance.oracle(),
    "op12_hard_negatives": covertree.oracle(),
    "op9_vantage_trees": """
    WITH usable AS (
      SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce([(q.v[i] - c.v[i]) * (q.v[i] - c.v[i]) FOR i IN range(1, len(q.v) + 1)], lambda a, b: a + b)) AS score
      FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank, vec_id, score
    FROM pairs QUALIFY rank <= 10
    """,
}
