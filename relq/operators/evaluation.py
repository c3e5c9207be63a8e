"""Evaluation metrics over gold rows and model answers.

All metrics are single global aggregates: partial aggregation in every task,
one tiny final merge, so they scale with the input and never gather rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relq.functions import jsonparse as J
from relq.functions.similarity import with_similarity
from relq.operators.positions import materialize


def _rate(num, den):
    return F.try_divide(num.cast("double"), den.cast("double"))


def s1_scored(gold_flags: DataFrame, answers: DataFrame) -> DataFrame:
    """C4 + H11: each gold row with its lenient predicted flag; a missing answer is a failed parse."""
    pred = J.with_lenient_flag(answers.select("sample_id", "answer"), "answer", "pred").drop("answer")
    return gold_flags.join(pred, "sample_id", "left")


def s1_accuracy(gold_flags: DataFrame, answers: DataFrame) -> DataFrame:
    """Total (readable gold), correct, failed (no flag), accuracy = correct / max(total, 1)."""
    scored = s1_scored(gold_flags, answers)
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("pred") == F.col("gold")).alias("correct"),
        F.count_if(F.col("pred").isNull()).alias("failed"),
    ).withColumn("accuracy", F.round(F.col("correct") / F.greatest(F.col("total"), F.lit(1)), 6))


def majority_baseline(gold_flags: DataFrame) -> DataFrame:
    """Share of the commoner gold flag, the accuracy of always answering it."""
    p = F.avg(F.col("gold").cast("double"))
    return gold_flags.agg(F.count(F.lit(1)).alias("total"),
                          F.round(F.greatest(p, 1 - p), 6).alias("majority_rate"))


def s2_scored(gold: DataFrame, answers: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per-row stage-2 indicators (C4, H13-H15b); missing answers count as invalid.
    ``carry`` names answer columns to keep (e.g. an answer class)."""
    joined = gold.join(answers.select("sample_id", "answer", *carry), "sample_id", "left")
    return J.with_strict_columns(joined, "answer", "relevant").select(
        "sample_id", *carry, "relevant", "gold_query_topic", "gold_document_topic", "gold_summary",
        "json_valid", "relevance_match", "reason_complete", "gen_query_topic", "gen_document_topic", "gen_summary")


def s2_rates(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Five rates over all rows (invalid answers count as misses); null on empty input."""
    sc = s2_scored(gold, answers)
    n = F.count(F.lit(1))
    qt = F.col("reason_complete") & F.coalesce(F.col("gen_query_topic") == F.col("gold_query_topic"), F.lit(False))
    dt = F.col("reason_complete") & F.coalesce(F.col("gen_document_topic") == F.col("gold_document_topic"), F.lit(False))
    return sc.agg(
        n.alias("samples"),
        F.round(_rate(F.count_if(F.col("json_valid")), n), 6).alias("json_valid_rate"),
        F.round(_rate(F.count_if(F.col("relevance_match")), n), 6).alias("relevance_agreement"),
        F.round(_rate(F.count_if(F.col("reason_complete")), n), 6).alias("reason_completeness"),
        F.round(_rate(F.count_if(qt), n), 6).alias("query_topic_accuracy"),
        F.round(_rate(F.count_if(dt), n), 6).alias("document_topic_accuracy"),
    )


def summary_scores(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """H16 per row: ``(sample_id, reason_complete, similarity)``; similarity is null unless the
    reason is complete with a string summary.  The parsed summaries are written once; distinct pairs of them are scored."""
    sc = materialize(s2_scored(gold, answers).select("sample_id", "reason_complete", "gen_summary", "gold_summary"))
    return with_similarity(sc, "gen_summary", "gold_summary").select("sample_id", "reason_complete", "similarity")


def mean_summary_similarity(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Mean similarity over complete rows only; null when there are none."""
    return summary_scores(gold, answers).agg(
        F.count_if(F.col("similarity").isNotNull()).alias("complete_rows"),
        F.round(F.avg("similarity"), 6).alias("mean_summary_similarity"))
