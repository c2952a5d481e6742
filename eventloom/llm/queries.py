"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ctw, exact, ngram_join, packing, quality, secrets, substring, tokens, toxicity
from .textkit import documents

def in_batch() -> Column:
    """Documents with odd ids play the new batch, as do those whose id is no number; those with even ids are the snapshot."""
    return F.expr("coalesce(try_cast(doc_id AS decimal(38, 0)) % 2 <> 0, true)")


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


def op2_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return toxicity.detect(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_secret_scans(spark, sf_dir):
    return secrets.scan(documents(spark, sf_dir))


def op4_token_counts(spark, sf_dir):
    return tokens.section_tokens(documents(spark, sf_dir))


def op5_exact_dedup(spark, sf_dir):
    return exact.duplicates(documents(spark, sf_dir), in_batch())


def op6_quality_rules(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.near_links(documents(spark, sf_dir))


def op8_byte_bpe(spark, sf_dir):
    return tokens.encode(documents(spark, sf_dir))


def op9_lm_scoring(spark, sf_dir):
    return ctw.score_corpus(documents(spark, sf_dir))


def op10_substring_dedup(spark, sf_dir):
    return substring.near_passages(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_toxicity,
        op3_secret_scans,
        op4_token_counts,
        op5_exact_dedup,
        op6_quality_rules,
        op7_ngram_jaccard_join,
        op8_byte_bpe,
        op9_lm_scoring,
        op10_substring_dedup,
    )
}

ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT DISTINCT doc_id, keeper_id FROM (
          SELECT doc_id, coalesce(min(doc_id) FILTER (WHERE doc_id % 2 = 0) OVER same, min(doc_id) OVER same) AS keeper_id
          FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL WINDOW same AS (PARTITION BY text))
        WHERE doc_id <> keeper_id""",
}
