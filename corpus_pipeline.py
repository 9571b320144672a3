"""The corpus pipeline: documents in, token digests out. Each stage reads what the one before it wrote.

All stages take empty tables, null keys and null or empty texts (a null text is an empty one), texts of any length and
repeated rows; all but the last keep the columns of their input, whatever further ones it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, decontaminate, simhash, suffix, toxicity
from millrace.llm.queries import BPE_FILE, table, tokenizer_path
from millrace.plans.materialize import materialize, release


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones of ``docs``, does not call toxic: those that score less
    than the threshold. Without labels of both kinds every document stays; equal texts stay or go together."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, keep_below=toxicity.THRESHOLD)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest key, null keys last, then the smallest text
    digest. Empty texts are one group; of rows with equal key and text the one with the least other columns stays."""
    return simhash.one_of_each(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur elsewhere too; every document stays, its number of
    characters is set anew where its text has changed."""
    return suffix.without_repeats(docs, chars="n_chars")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; without items every document stays. Repeated rows stay or go together."""
    return decontaminate.without_contained(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of its text decoded from them, a row a document."""
    return bpe.round_trip(docs, tokenizer_path(BPE_FILE))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_stage),
    ("suffix_array_dedup", suffix_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written and read again for the next."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = materialize(docs, f"stage-{name}")
            release(before)  # what the stage read
            docs = before = written
    return docs


#: No stage but the last could be put in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None
