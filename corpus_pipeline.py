"""A training corpus from ``documents``: toxicity, quality, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  Models are fitted
on the folder's own documents and labels; filters keep every column of ``documents``, whatever other columns there are.

In every stage null, empty and very long texts, null and repeated ids and repeated rows are allowed, and an empty table gives an
empty one; a stage's docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relq.llm.common import materialize, prepare, read
from relq.llm.decontam import drop_contaminated
from relq.llm.packing import ATTENTION, DOCUMENTS, pack, token_pieces, tokenizer_path
from relq.llm.quality import fit_quality, reject_low_quality
from relq.llm.simhash import drop_near_duplicates
from relq.llm.toxicity import fit_toxicity, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject.

    Null, empty and wordless texts have no events and stay; rows with equal texts go or stay together; without labels the
    prior weights decide.
    """
    return reject_toxic(docs, fit_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null, empty and blank texts are scored as measures of zero; rows with equal texts go or stay together, at the threshold they stay; without labels of
    both kinds no row goes that the model cannot tell apart.
    """
    return reject_low_quality(docs, fit_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (3 words, 3 bits): the one with the smallest id, null ids last.

    Null and blank texts are copies of one another; of rows that repeat id and text one stays; rows that repeat an id with unrelated
    texts are in components of their own.
    """
    prepare(spark)
    return drop_near_duplicates(docs, shingle=3, distance=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark.

    Null, empty and wordless texts have none and stay; rows that repeat an id are told apart by their text; without items all stay.
    """
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences of 2,048 tokens, 2,048 documents and 2,048 squared of attention.

    Null and empty texts are their end id; rows that repeat an id are documents of their own; equal lengths may go either way.
    """
    prepare(spark)
    return pack(token_pieces(docs, tokenizer_path()), documents=DOCUMENTS, attention=ATTENTION).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

ORACLE_SQL = None  # trained models and packing are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
