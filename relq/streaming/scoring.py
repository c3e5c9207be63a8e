"""Answer scoring on a stream of model answers (Structured Streaming).

The parsing policies are stateless column expressions, so they run unchanged on
a streaming DataFrame; the metrics are streaming aggregates (complete mode).
A static left side cannot be outer-joined to a stream, so on a stream a missing
answer is simply not counted yet (the batch form counts it as a failed parse).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.functions import jsonparse as J
from relq.session import checkpoint_dir

ANSWER_SCHEMA = "sample_id long, answer string"


def read_answer_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSONL answers ``(sample_id, answer)`` arriving as files in ``path``; a line that is no such object fails the job.

    A micro-batch takes all files that are there, or ``max_files_per_trigger`` of them: each one joins the static
    gold table, so the caller sizes it to the rate of arrival."""
    r = spark.readStream.schema(ANSWER_SCHEMA).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def s1_metrics(answers: DataFrame, gold_flags: DataFrame) -> DataFrame:
    """Stage-1 accuracy over the answers seen so far (stream-static inner join, then one aggregate).

    The static side is planned again for every micro-batch: pass a stored table (or one
    written with ``relq.operators.positions.materialize``), not a derivation from the corpus.
    """
    pred = J.with_lenient_flag(answers.select("sample_id", "answer"), "answer", "pred")
    joined = pred.join(gold_flags, "sample_id", "inner")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("pred") == F.col("gold")).alias("correct"),
        F.count_if(F.col("pred").isNull()).alias("failed"),
    ).withColumn("accuracy", F.round(F.col("correct") / F.greatest(F.col("total"), F.lit(1)), 6))


def scored_answers(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Per-answer stage-2 indicators, append mode (stateless apart from the static join)."""
    joined = answers.join(gold, "sample_id", "inner")
    return J.with_strict_columns(J.with_lenient_flag(joined, "answer", "lenient_flag"), "answer", "relevant")


def run_to_table(agg: DataFrame, out_path: str, checkpoint: str | None = None) -> None:
    """Drive a complete-mode aggregate until the available input is consumed; each
    micro-batch overwrites ``out_path`` (parquet) with the current totals."""
    spark = agg.sparkSession
    ckpt = checkpoint or os.path.join(checkpoint_dir(spark).rstrip("/"), f"relq-stream-{uuid.uuid4().hex[:12]}")

    def sink(batch_df: DataFrame, _epoch: int) -> None:
        batch_df.write.mode("overwrite").parquet(out_path)

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


def s2_metrics(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Stage-2 rates over the answers seen so far (same definitions as the batch ``s2_rates``)."""
    sc = scored_answers(answers, gold)
    n = F.count(F.lit(1))
    rate = lambda c: F.round(F.try_divide(F.count_if(c).cast("double"), n.cast("double")), 6)
    qt = F.col("reason_complete") & F.coalesce(F.col("gen_query_topic") == F.col("gold_query_topic"), F.lit(False))
    dt = F.col("reason_complete") & F.coalesce(F.col("gen_document_topic") == F.col("gold_document_topic"), F.lit(False))
    return sc.agg(n.alias("samples"), rate(F.col("json_valid")).alias("json_valid_rate"),
                  rate(F.col("relevance_match")).alias("relevance_agreement"),
                  rate(F.col("reason_complete")).alias("reason_completeness"),
                  rate(qt).alias("query_topic_accuracy"), rate(dt).alias("document_topic_accuracy"))
