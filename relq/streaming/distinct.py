"""Ordered distinct queries on a stream of samples.

State is one row a distinct query: the smallest sample id it came with.  A late sample may lower it, so the result does not depend
on the order in which files arrive.  Update mode sends on only the queries that a micro-batch changed; each epoch
writes them to a folder of its own, which a repeated epoch replaces.  The first-seen order is read from that log.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.functions.text import extract_query
from relq.operators.retrieval import rank_queries
from relq.session import checkpoint_dir

SAMPLE_SCHEMA = "sample_id long, input string"


def read_sample_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSONL samples ``(sample_id, input)`` arriving as files in ``path``."""
    r = spark.readStream.schema(SAMPLE_SCHEMA).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def first_seen(samples: DataFrame) -> DataFrame:
    """``(query, first_seen)`` of a stream (or table) of samples; inputs without a separator, null inputs and null ids are left out."""
    q = samples.select("sample_id", extract_query(F.col("input")).alias("query")).where("query is not null and sample_id is not null")
    return q.groupBy("query").agg(F.min("sample_id").alias("first_seen"))


def run_to_log(changes: DataFrame, log_path: str, checkpoint: str | None = None) -> None:
    """Consume what is available; every micro-batch's changed rows go to ``log_path/epoch=N``."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(changes.sparkSession).rstrip("/"), f"relq-stream-{uuid.uuid4().hex[:12]}")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log_path}/epoch={epoch}")

    (changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt)
     .trigger(availableNow=True).start().awaitTermination())


def ordered_queries(spark: SparkSession, log_path: str, n: int | None = None) -> DataFrame:
    """The log's queries in first-seen order, the first ``n`` or all, as ``first_queries`` gives them."""
    log = spark.read.parquet(log_path)
    return rank_queries(log.groupBy("query").agg(F.min("first_seen").alias("first_seen")), n)
