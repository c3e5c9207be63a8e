"""Table scans (A1, A8): parquet in, explicit columns out so pruning reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.templates import LANG_LABELS

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def label_of_lang(lang) -> F.Column:
    """Class label of the stand-in corpus: position of ``lang`` in the fixed language list, 0-based."""
    return (F.array_position(F.array(*[F.lit(x) for x in LANG_LABELS]), lang) - 1).cast("int")


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a labelled corpus ``(doc_id, text, label)``.

    Rows whose language is outside the four classes have no label and are not part of the corpus.
    The session option ``relq.corpus.partitions`` (unset: none) deals the corpus out by ``doc_id``
    first; it is for tables written as fewer splits than the cores that are to read them.
    """
    docs = read_table(spark, sf_dir, "documents")
    # an IN list on the raw column is pushed to the parquet scan (row-group pruning)
    corpus = (docs.where(F.col("lang").isin(*LANG_LABELS))
              .select("doc_id", "text", label_of_lang(F.col("lang")).alias("label")))
    partitions = spark.conf.get("relq.corpus.partitions", None)
    return corpus.repartition(int(partitions), "doc_id") if partitions else corpus


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 stand-in: ``(doc_id, embedding, label)`` from the embeddings table."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
