"""The operators over the driver's tables: one query each, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import collocations, exact_dedup, html_extract, line_dedup, media, mixing, near_dedup, packing, pii, quality_model, quality_rules, spelling, url_filter
from quillgraph.llm.common import table
from quillgraph.llm.sql import LINE_DEDUP_SQL, NEAR_DEDUP_SQL, PII_SQL, QUALITY_RULES_SQL

THRESHOLD = 0.3


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of operator 2's policy does, alone and beside the others, out of the ledger's bits."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    vectors, model = quality_model.train(documents, table(spark, sf_dir, "labels"))
    scored = quality_model.score(documents, vectors, model)
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality_rules, quality_ablations, op3_quality_classifier, op4_line_dedup, op5_packing, op6_near_dedup, op7_url_filters, op8_media, op9_html_extraction, op10_mixing, op11_exact_dedup, op12_spelling_variants, op13_collocations)}
_RULES = ", ".join(f"({1 << bit}, '{name}')" for bit, name, _ in quality_rules.RULES if name in quality_rules.POLICIES["v1"])
ABLATIONS_SQL = f"""WITH q AS ({QUALITY_RULES_SQL}), r(bit, rule) AS (VALUES {_RULES}), w AS (SELECT CAST(sum(bit) AS BIGINT) AS whole FROM r)
  SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS failing, count(*) FILTER (failed_bits & whole = bit) AS failing_alone, count(*) FILTER (failed_bits & whole = 0) AS kept_by_all FROM q, r, w GROUP BY rule"""
ORACLES = {"quality_ablations": ABLATIONS_SQL, "op1_pii": PII_SQL, "op2_quality_rules": QUALITY_RULES_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op6_near_dedup": NEAR_DEDUP_SQL, "op7_url_filters": url_filter.SQL,
    "op11_exact_dedup": exact_dedup.SQL, "op12_spelling_variants": spelling.SQL, "op13_collocations": collocations.SQL}
