"""Stage-1 scoring of questions and answers that both arrive on streams.

Gold rows carry the time they were asked, answers the time they came.  A left outer join in event time pairs them: an answer counts
when it comes within ``wait`` of its question, and a question whose answer never comes leaves the state, unanswered, once
the watermark has passed that time.  Repeated answers are dropped within the watermark, the first one counts.
Joined rows are written an epoch a folder, so a repeated epoch replaces its own rows, and the metrics are
those of the batch form over that table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.functions import jsonparse as J
from relq.session import checkpoint_dir

GOLD_SCHEMA = "sample_id long, gold boolean, asked_at timestamp"
ANSWER_SCHEMA = "sample_id long, answer string, answered_at timestamp"


def read_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSONL rows of ``schema`` arriving as files in ``path``, oldest first."""
    r = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def scored_arrivals(gold: DataFrame, answers: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(sample_id, gold, pred)``, a row a question, in append mode: ``pred`` is null where the answer is unreadable, came too late
    or never came.  Rows may be ``late`` against the newest of their stream.

    Rows with a negative id are heartbeats, which only move the watermark on.  They are not filtered here: a filter would be pushed below
    the watermark, and they would not count for it."""
    g = gold.withWatermark("asked_at", late)
    a = answers.withWatermark("answered_at", late).dropDuplicatesWithinWatermark(["sample_id"])
    a = J.with_lenient_flag(a.select(F.col("sample_id").alias("answered"), "answered_at", "answer"), "answer", "pred").drop("answer")
    meet = ((F.col("sample_id") == F.col("answered")) & (F.col("answered_at") >= F.col("asked_at"))
            & (F.col("answered_at") <= F.col("asked_at") + F.expr(f"interval {wait}")))
    return g.join(a, meet, "leftOuter").select("sample_id", "gold", "pred")


def run_to_epochs(rows: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Consume what is available in append mode; every micro-batch's rows go to ``path/epoch=N``."""
    ckpt = checkpoint or os.path.join(checkpoint_dir(rows.sparkSession).rstrip("/"), f"relq-stream-{uuid.uuid4().hex[:12]}")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    (rows.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", ckpt)
     .trigger(availableNow=True).start().awaitTermination())


def accuracy_of(spark: SparkSession, path: str) -> DataFrame:
    """D1, D2 of the rows written so far, without heartbeats."""
    return spark.read.parquet(path).where("sample_id >= 0").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("pred") == F.col("gold")).alias("correct"),
        F.count_if(F.col("pred").isNull()).alias("failed"),
    ).withColumn("accuracy", F.round(F.col("correct") / F.greatest(F.col("total"), F.lit(1)), 6))
