"""The corpus pipeline: each stage applies one operator to all that its predecessor kept.

Stages take and return the columns of documents, but for the last, which returns token counts, ids and digests. run() writes each stage as
Parquet in the shared folder and reads it back, so that a later stage starts from files and not from a long lineage; a stage's files go
once the next one's are there.

Defined results, in every stage: a null text is an empty one (the quality rules reject it), a null id is an id like any other that names
nothing, repeated rows are judged alike, and an empty table gives an empty one; columns beyond doc_id and text pass through whatever their
names are, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe, decontaminate, quality, simhash, substrings
from cadenza.llm.shared import remove, shared_dir, table
from cadenza.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule. Rows with a null text go; repeated rows stay or go together."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id: five-word shingles, a Jaccard similarity of 0.8 or more.

    Texts of equal shingles are copies, those without words among them. Rows that share the least id all stay, as do rows with a null id.
    """
    return simhash.keep_one(docs, width=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that an earlier document has. n_chars follows the text where there is such a column.

    Rows that share an id do not remove from each other; a null id comes after all others. Texts that lose nothing stay as they are.
    """
    out = substrings.deduplicate(docs)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. An empty text is clean; rows that share an id go if one of them is contaminated."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every row that is left; an empty text has no tokens."""
    return bpe.round_trip(docs, keep_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("tokenization", tokenization),
]
#: Jaccard groups and BPE have no SQL form at this size; tests/llm/test_pipeline_stages.py holds all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder, before = shared_dir(spark), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
