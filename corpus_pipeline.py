"""The corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents.

Defined cases, for all stages: a null or empty text, a null in any column and a very long text never stop a stage; columns other than doc_id and
text, whatever their names, are kept as they are by all but the last; an empty table gives an empty table.  What each stage makes of these, of repeated
rows and of ties is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import exact, ngram_join, packing, quality, secrets, textkit
from eventloom.llm.queries import in_batch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality model takes for good.

    A null or blank text is judged by the length rule and the share of good documents alone; each repeated row is judged alike and
    stays or goes with the others; a posterior that ties with the threshold stays.
    """
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text.

    Null texts all stay; of empty texts one does; of repeated rows, and of rows that tie in doc_id, one stays, by the other columns as JSON; null ids come last.
    """
    return exact.keep_one(docs, in_batch())


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.

    Null, empty and blank texts and rows without doc_id all stay; rows of one doc_id stay or go together.
    """
    return ngram_join.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets masked; n_chars follows the text.

    Null, empty and blank texts stay as they are; repeated rows are masked alike, and a secret that stands several times is masked each time.
    """
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins that the documents' tokens are packed in.

    Null and empty texts are in no bin; very long ones are cut; repeated rows are packed each; pieces of one length go by doc_id, null last.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: The votes are fitted by expectation-maximisation and the joins are approximate: no stage but exact dedup is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = textkit.documents(spark, sf_dir)
    given = None
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with textkit.released(spark, kept):
            kept.append(textkit.materialize(stage(spark, docs, sf_dir), name))
        if given is not None:
            textkit.drop_materialized(given)
        docs = given = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
