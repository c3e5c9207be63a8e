"""Metric report sink (A9): one-row metric frames to long form with fixed decimals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, metrics: dict[str, int], source: str) -> DataFrame:
    """``(source, metric, value, text)`` rows from a one-row frame; ``metrics`` maps column -> decimals."""
    parts = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE), {d}" for m, d in metrics.items())
    long = df.selectExpr(f"stack({len(metrics)}, {parts}) AS (metric, value, decimals)")
    return long.select(F.lit(source).alias("source"), "metric", F.round("value", 6).alias("value"),
                       _fixed(F.col("value"), F.col("decimals"), sorted(set(metrics.values()))).alias("text"))


def _fixed(value, decimals, choices):
    out = F.lit(None).cast("string")
    for d in choices:
        out = F.when(decimals == d, F.format_string(f"%.{d}f", value)).otherwise(out)
    return F.when(value.isNotNull(), out)
