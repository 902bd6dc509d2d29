"""The document pipeline: five stages, each on the documents that its predecessor kept.

Toxic documents go; one document of each near-duplicate group stays; live-looking secrets are masked in the
text; the rest is put in mixed order of its sources; and the texts are cut and packed into sequences that are
numbered in that order. All stages but the last return the columns of ``documents``; the mixed order passes from
stage to stage as the order of rows in the written files. Packing has no SQL form, so ``run`` has none.

In every stage a null or empty text is an empty text and stays until the end, where it is its end id alone; null and
repeated doc_ids are rows of their own; columns beyond those of ``documents`` are not read and do not pass; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, ngram_join, packing, secrets, toxicity
from tidemark.llm.shared import DOCUMENT_COLUMNS, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the kernel machine, trained on the labelled ones among them, does not call toxic.

    Without labels of both kinds all documents stay, or none if all labels are toxic.
    """
    return toxicity.drop_toxic(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each near-duplicate group; texts without words are groups of their own."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return ngram_join.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked."""
    return secrets.redact(docs.select(*DOCUMENT_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order of their sources; a null source is a source."""
    return mixing.in_mixed_order(docs.select(*DOCUMENT_COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and place; sequences follow the order of the files' rows."""
    return packing.pack_documents(docs, ordered=True, added=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("secret_scan", mask_secrets),
    ("pfair_mixing", mix_sources),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
