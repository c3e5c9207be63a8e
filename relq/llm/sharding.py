"""Operator 1: minimax contiguous partition into shards of near equal bytes.

Documents of equal text are one atomic group.  Groups are ordered by the MD5 of their text; a shard
is a run of groups.  The smallest capacity for which a greedy walk needs no more than the wanted
shards is found by binary search, and the greedy cuts at that capacity are the shards.

The walk needs prefix sums of the ordered group sizes, which may be many.  The driver holds them as
segments: sums over common prefixes of the key, at most 65,536 to begin with.  Treating segments as
atomic bounds the best capacity from above, cutting them anywhere bounds it from below; segments in
which a cut may fall at a capacity between both are refined by one hex digit (at most
``REFINE`` of them a round, one grouped query), until both bounds agree or all such segments are
single groups.  So the result is exact and the driver never holds a row or a group list of the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import materialize, read
from relq.operators.positions import with_position

START_DIGITS = 4  # hex digits of the first segments: 65,536
REFINE = 20_000  # segments refined in a round


def greedy_cuts(total: np.ndarray, capacity: int) -> list[int]:
    """Ends of the runs that a greedy walk fills up to ``capacity``; ``total`` are prefix sums from 0."""
    ends, at, n = [], 0, len(total) - 1
    while at < n:
        stop = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        if stop == at:
            raise ValueError("an item exceeds the capacity")
        ends.append(stop)
        at = stop
    return ends


def smallest_capacity(sizes: np.ndarray, shards: int, least: int = 0) -> int:
    """The smallest capacity, ``least`` or more, for which greedy runs over ``sizes`` number ``shards`` or fewer."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    low = max(least, -(-int(total[-1]) // shards), int(sizes.max()) if len(sizes) else 0)
    high = max(low, int(total[-1]))
    while low < high:
        mid = (low + high) // 2
        if len(greedy_cuts(total, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _relaxed(total: np.ndarray, single: np.ndarray, capacity: int) -> int:
    """Runs needed if segments of many groups could be cut anywhere: a lower bound."""
    runs, at, n = 0, 0, len(total) - 1
    position = 0
    while position < total[n]:
        limit = position + capacity
        at = int(np.searchsorted(total, limit, side="right")) - 1
        # inside a single group the run ends before it
        position = int(total[at]) if at < n and single[at] and total[at] > position else min(limit, int(total[n]))
        runs += 1
    return runs


class Segments:
    """Ordered runs of groups by key prefix: ``keys`` with ``bytes``, ``rows``, ``groups`` and largest group."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows)
        self.rows = rows
        self.keys = [r[0] for r in rows]
        self.bytes, self.docs, self.groups, self.largest = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(1, 5))
        self.total = np.concatenate([[0], np.cumsum(self.bytes)])

    def bounds(self, shards: int) -> tuple[int, int]:
        """(lower, upper) bound of the smallest capacity."""
        high = smallest_capacity(self.bytes, shards)
        low = max(-(-int(self.total[-1]) // shards), int(self.largest.max()))
        top = high
        single = self.groups == 1
        while low < top:
            mid = (low + top) // 2
            if _relaxed(self.total, single, mid) <= shards:
                top = mid
            else:
                low = mid + 1
        return low, high

    def open(self, shards: int, low: int, high: int) -> list[int]:
        """Segments of several groups in which a greedy cut at a capacity from ``low`` to ``high`` may fall."""
        out: set[int] = set()
        left = right = 0
        n = len(self.keys)
        for _ in range(shards):
            left = int(self.total[int(np.searchsorted(self.total, left + low, side="right")) - 1])
            right = min(right + high, int(self.total[-1]))
            a = int(np.searchsorted(self.total, left, side="right")) - 1
            b = int(np.searchsorted(self.total, right, side="left"))
            out.update(range(a, min(b, n)))
        return sorted((i for i in out if self.groups[i] > 1), key=lambda i: -self.bytes[i])[:REFINE]


def _segment_rows(groups: DataFrame, digits: int) -> list[tuple]:
    return [tuple(r) for r in groups.groupBy(F.substring("h", 1, digits).alias("key")).agg(
        F.sum("bytes"), F.sum("docs"), F.count("*"), F.max("bytes")).collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], list[int], int]:
    """(first key of each shard after the first, first row of each shard, capacity) over ``groups (h, bytes, docs)``."""
    spark = groups.sparkSession
    seg = Segments(_segment_rows(groups, START_DIGITS))
    if not seg.keys:
        return [], [0], 0
    low, high = seg.bounds(shards)
    while low < high:
        todo = seg.open(shards, low, high)
        if not todo:
            break  # the cuts fall between single groups: the upper bound is met
        new = [r for i, r in enumerate(seg.rows) if i not in set(todo)]
        for digits in sorted({len(seg.keys[i]) for i in todo}):
            keys = spark.createDataFrame([(seg.keys[i],) for i in todo if len(seg.keys[i]) == digits], "k string")
            part = groups.join(F.broadcast(keys), F.substring("h", 1, digits) == F.col("k"), "left_semi")
            new += _segment_rows(part, digits + 1)
        seg = Segments(new)
        low, high = seg.bounds(shards)
    ends = greedy_cuts(seg.total, high)
    firsts = np.concatenate([[0], np.cumsum(seg.docs)])
    return [seg.keys[e] for e in ends[:-1]], [0] + [int(firsts[e]) for e in ends[:-1]], high


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, h, shard, slot)`` of every row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1.  Null and empty texts are one group.
    Slots follow (text key, id) and are gapless from 0 in each shard; rows that repeat an id or all
    their values have slots of their own.  With fewer groups than shards the last shards are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                   F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("h")))
    groups = materialize(slim.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("docs")))
    keys, first, _ = minimax_cuts(groups, shards)
    shard = sum(((F.col("h") >= k).cast("int") for k in keys), F.lit(0))
    placed = with_position(slim, ["h", "doc_id"], name="__pos").withColumn("shard", shard)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "h", "shard", (F.col("__pos") - start).alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in 16 shards by bytes.

    A null text has no bytes and shares a group with the empty one only by its size; long texts are atoms that may exceed a
    shard's share; equal texts stay together; repeated rows and ids, or null ones, each have a slot; an empty table gives
    no rows; columns beyond ``doc_id`` and ``text`` are not read.
    """
    return shard_by_bytes(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
