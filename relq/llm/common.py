"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.operators.positions import materialize
from relq.session import checkpoint_dir, configure

__all__ = ["materialize", "prepare", "read", "unused", "filter_rows", "known_labels", "labelled_sample", "class_weights", "training_row", "to_hex64", "batches_of"]


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime options and the shared folder; safe to call again."""
    configure(spark)
    # whole texts go to Python: a batch of 1,000 long ones must fit beside the JVM's heap
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    checkpoint_dir(spark)
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, in a session that is prepared."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that ``df`` has no column of, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def training_row(key: Column, modulus: int, held_out: int) -> Column:
    """True where ``crc32(key as text) mod modulus`` is not ``held_out`` (null keys are training rows)."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus != held_out, F.lit(True))


def to_hex64(c: Column) -> Column:
    """A long as 16 lowercase hex digits of its unsigned value."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def batches_of(arrays: dict[str, object], schema: pa.Schema, rows: int = 65536) -> Iterator[pa.RecordBatch]:
    """Numpy columns of equal length as Arrow batches of at most ``rows`` rows."""
    n = len(next(iter(arrays.values())))
    for at in range(0, n, rows):
        yield pa.record_batch([pa.array(arrays[f.name][at:at + rows], type=f.type) for f in schema], schema=schema)


def filter_rows(docs: DataFrame, text_col: str, make_keep) -> DataFrame:
    """``docs`` with its own columns, without the rows that a test of the text rejects: no shuffle, no join.

    ``make_keep()`` runs once a task and returns ``keep(texts) -> boolean array``.
    """
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make_keep()
        for b in it:
            if b.num_rows:
                yield b.filter(pa.array(keep(b.column(at).to_pylist())))

    return docs.mapInArrow(run, docs.schema)


def known_labels(labels: DataFrame, id_col: str, label_col: str, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """``(__id, label)`` of all training rows: labels other than 0 and 1, null ids and held-out ids are left out; an id
    that the labels repeat counts once, with its largest label."""
    return (labels.where(training_row(F.col(id_col), modulus, held_out) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
            .groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))


def class_weights(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> np.ndarray:
    """How many training rows of label 0 and of label 1 a row of :func:`labelled_sample` stands for."""
    n = dict(known_labels(labels, id_col, label_col).groupBy("label").count().collect())
    return np.array([max(1.0, n.get(label, 0) / per_class) for label in (0, 1)])


def picked_labels(labels: DataFrame, id_col: str, label_col: str, per_class: int, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """``(__id, label)`` of at most ``per_class`` training rows of either label, those with the smallest hashes of their id."""
    known = known_labels(labels, id_col, label_col, modulus, held_out)
    order = F.xxhash64("__id", F.lit(17))
    return known.where("label = 0").orderBy(order).limit(per_class).unionByName(known.where("label = 1").orderBy(order).limit(per_class))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int,
                    modulus: int = 5, held_out: int = 0) -> DataFrame:
    """``(doc_id, label, text)`` of at most ``per_class`` training rows of either label.

    The rows are those with the smallest hashes of their id, so the sample is the same however the
    tables are cut.  The ids are few (``2 * per_class``) and broadcast.
    """
    picked = picked_labels(labels, id_col, label_col, per_class, modulus, held_out)
    # only the two columns that are read take part: others of ``docs`` may have any name
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "label", "text"))
