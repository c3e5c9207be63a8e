"""Row positions without a one-partition window.

Spark rows have no order, so a position is defined by a sort key.  The table is
range-partitioned on the key and sorted inside each partition; each row gets
(partition, index in partition); the per-partition counts (one row per
partition, a bounded table) give each partition's offset by a prefix sum; the
position is offset + index.  The tagged rows are written once as a parquet table
in the shared checkpoint folder and read back, so the count and the numbering
read the same tags, the count reads one column, and a lost executor recomputes
nothing upstream.  (An eager ``checkpoint()`` would compute the input twice:
once to count it and once to write it.)
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relq.session import checkpoint_dir


PARTITION_BYTES = 128 << 20


def _num_partitions(df: DataFrame) -> int:
    """Range partitions for numbering: at least the shuffle setting, more as the planned size asks for.

    The size is the optimizer's estimate (no job), so partitions stay near ``PARTITION_BYTES``
    however large the input is."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PARTITION_BYTES), 1_000_000))


def _scratch_path(spark, what: str) -> str:
    return os.path.join(checkpoint_dir(spark).rstrip("/"), f"relq-{what}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared checkpoint folder and read it back."""
    path = _scratch_path(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_position(df: DataFrame, order: list, name: str = "pos", num_partitions: int | None = None,
                  materialize_input: bool = False) -> DataFrame:
    """Add a 0-based position by ``order`` (a list of column names/expressions, ascending, unique).

    Range partitioning samples its input in a job of its own before the shuffle, so an
    expensive input is computed twice; ``materialize_input`` writes it once first (for a
    small but costly input such as an aggregate).  For a wide, costly input number a
    cheap key table instead and join (:func:`number_by_key`).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if materialize_input:
        df = materialize(df)
    n = num_partitions or _num_partitions(df)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    path = _scratch_path(spark, "positions")
    (df.repartitionByRange(n, *order_cols)
       .sortWithinPartitions(*order_cols)
       .withColumn("_pid", F.spark_partition_id())
       .withColumn("_mid", F.monotonically_increasing_id())
       .write.mode("overwrite").parquet(path))
    tagged = spark.read.parquet(path)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a prefix sum over a table whose size is the partition count
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(name, (F.col("_off") + local).cast("long"))
            .drop("_pid", "_mid", "_off"))


def number_by_key(rows: DataFrame, keys: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Positions of ``rows`` by a unique ``key``, computed on a cheap ``keys`` table (the same
    key set, e.g. taken before an expensive step) and joined to the rows: the rows themselves
    are computed once and never range-sampled."""
    return rows.join(with_position(keys.select(key), [key], name=name), key, "inner")


_PCT = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*%\s*$")


def _bound(b, total: int | None):
    if b is None:
        return None
    if isinstance(b, str):
        m = _PCT.match(b)
        if not m:
            raise ValueError(f"slice bound must be an int or 'N%': {b!r}")
        return int(total * float(m.group(1)) // 100)
    if int(b) < 0:
        raise ValueError(f"slice bounds are counted from the start: {b!r}")
    return int(b)


def slice_rows(df: DataFrame, key: str, start=None, stop=None) -> DataFrame:
    """A2: Python-style half-open positional slice ``[start:stop]`` by a unique ``key``.

    Bounds are non-negative ints or percentages (``"50%"``).  Positions are computed
    on the key column alone; the two boundary keys then filter the full table, so the
    filter reaches the parquet scan and the wide columns are never shuffled.
    """
    pos = with_position(df.select(key), [key])
    total = None
    if any(isinstance(b, str) for b in (start, stop)):
        total = pos.count()
    a, b = _bound(start, total), _bound(stop, total)
    cond = F.lit(True)
    if a is not None:
        cond = cond & (F.col("pos") >= a)
    if b is not None:
        cond = cond & (F.col("pos") < b)
    lo, hi = pos.where(cond).agg(F.min(key), F.max(key)).first()
    if lo is None:
        return df.where(F.lit(False))
    return df.where((F.col(key) >= F.lit(lo)) & (F.col(key) <= F.lit(hi)))


def grouped_prefix_sum(df: DataFrame, group: str, order: str, value: str, out: str,
                       chunk: int = 1024) -> DataFrame:
    """Inclusive running sum of ``value`` within ``group`` by a numeric ``order`` (unique in the group).

    Skew-safe: one group may hold a large share of all rows, so rows are cut into
    chunks of ``chunk`` consecutive order values.  Chunk totals (a partial
    aggregation) get their offsets from a window over chunk totals only, and the
    running sum inside a chunk is a window over at most ``chunk`` rows.  No window
    partition ever holds a whole group.
    """
    d = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    sums = d.groupBy(group, "_chunk").agg(F.sum(value).alias("_cs"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(group, "_chunk", F.coalesce(F.sum("_cs").over(before), F.lit(0)).alias("_co"))
    inside = Window.partitionBy(group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (d.join(offs, [group, "_chunk"], "inner")
            .withColumn(out, F.col("_co") + F.sum(value).over(inside))
            .drop("_chunk", "_co"))


def head_rows(df: DataFrame, key: str, n: int, require_full: bool = False) -> DataFrame:
    """the first ``n`` rows by ``key`` (a top-n: sort-and-limit per task, then one merge of
    n rows per task).  ``require_full`` fails when fewer than ``n`` rows exist, as selecting
    ``range(n)`` from a shorter dataset does; the line reader instead returns what there is."""
    head = df.orderBy(key).limit(n)
    if require_full:
        have = head.count()
        if have < n:
            raise ValueError(f"asked for the first {n} rows, the input has {have}")
    return head
