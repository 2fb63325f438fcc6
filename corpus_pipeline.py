"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of documents; further columns of the input go at the
first stage, whatever they are called.

Defined results: a null or blank text fails the quality rules, so its document goes; so does a text
of which only white space is left when its repeated bytes are cut out; null ids, languages and
sources stay null, and a null source is a host and a queue of its own; of rows that repeat an id
and a text one stays; texts of any length are worked on whole; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.common import Scratch, table
from dagframe.llm.near_dedup import drop_near_duplicates
from dagframe.llm.packing import pack
from dagframe.llm.quality_rules import drop_rejected
from dagframe.llm.secrets import redact
from dagframe.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, by their own text or by their host."""
    return drop_rejected(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go from the texts; a cut that splits a character takes its rest along. A document that has nothing left goes."""
    kept = remove_repeats(docs.withColumn("_row", F.struct("doc_id", "lang", "source")).select("_row", "doc_id", "text"), carry=["_row"], as_text=True)
    kept = kept.where("n_removed = 0 or length(trim(kept)) > 0")
    return kept.select("_row.doc_id", F.col("kept").alias("text"), "_row.lang", "_row.source", F.length("kept").cast("long").alias("n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are masked; no document goes."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of 1024-token sequences that hold the remaining documents."""
    return pack(docs).drop("queue")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeats),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: SQL can't express the tokenizer of the last stages; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
