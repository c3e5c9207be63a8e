"""Length quantiles from mergeable sketches (D14), and batch buckets from them.

A KLL sketch is aggregated in every task and merged once; its size depends on ``k`` alone.  Sketches of several runs are kept
as rows of a small table and merged from there, without a look at the rows they came from.  With k = 1,000 the rank of a quantile is
off by less than 0.5 % of the rows, whatever their number (in 99 % of cases; ``RANK_ERROR`` allows twice that).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K = 1000
RANK_ERROR = 0.01
QUANTILES = (0.5, 0.95, 0.99)


def length_sketches(rows: DataFrame, measures: dict[str, Column], k: int = K, run: str = "") -> DataFrame:
    """``(run, measure, n, sketch)``: one sketch a measure over all its non-null values (none: no row)."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("long").alias("v")) for m, c in measures.items()])
    long = rows.select(F.inline(each)).where(F.col("v").isNotNull())
    return long.groupBy("measure").agg(F.count("v").alias("n"), F.kll_sketch_agg_bigint("v", k).alias("sketch")).select(F.lit(run).alias("run"), "measure", "n", "sketch")


def merged_sketches(sketches: DataFrame, k: int = K) -> DataFrame:
    """``(measure, n, sketch)`` of all runs together."""
    return sketches.groupBy("measure").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def append_sketches(sketches: DataFrame, path: str) -> None:
    sketches.write.mode("append").parquet(path)


def read_sketches(spark: SparkSession, path: str, k: int = K) -> DataFrame:
    return merged_sketches(spark.read.parquet(path), k)


def quantiles(sketches: DataFrame, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """``(measure, n, quantile, value)`` of ``(measure, n, sketch)`` rows."""
    each = F.array(*[F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias("value")) for q in at])
    return sketches.select("measure", "n", F.inline(each))


def rank_errors(rows: DataFrame, measures: dict[str, Column], found: DataFrame) -> DataFrame:
    """``found`` with ``rank_error``: how far the share of values at or below (and below) each quantile's value is from it."""
    each = F.array(*[F.struct(F.lit(m).alias("m"), c.cast("long").alias("v")) for m, c in measures.items()])
    counts = rows.select(F.inline(each)).where(F.col("v").isNotNull()).groupBy("m", "v").count()  # a row a distinct length
    met = counts.join(F.broadcast(found), F.col("m") == F.col("measure"))  # a few rows a measure
    share = met.groupBy("measure", "n", "quantile", "value").agg(
        (F.sum(F.when(F.col("v") < F.col("value"), F.col("count")).otherwise(0)) / F.col("n")).alias("below"),
        (F.sum(F.when(F.col("v") <= F.col("value"), F.col("count")).otherwise(0)) / F.col("n")).alias("upto"))
    q = F.col("quantile")
    return share.select("measure", "n", "quantile", "value", F.greatest(F.col("below") - q, q - F.col("upto"), F.lit(0.0)).alias("rank_error"))


def bucket_edges(sketch: DataFrame, measure: str, buckets: int) -> list[int]:
    """Rising length edges that cut the measure into about ``buckets`` equal parts; lengths up to an edge are below it."""
    at = tuple(i / buckets for i in range(1, buckets))
    found = quantiles(sketch.where(F.col("measure") == measure), at).collect() if at else []
    return sorted({r.value for r in found})
