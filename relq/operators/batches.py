"""Training rows: masks per sample, fixed-size padded batches, masked-out report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relq.functions import masks as M
from relq.operators.positions import materialize, number_by_key, with_position


def with_masks(tok: DataFrame, n_keep: int = 5) -> DataFrame:
    """Add stage-1, stage-2 and answer label arrays (needs input_ids, n_prompt, relevant_idx)."""
    ids, s, found = F.col("input_ids"), F.col("n_prompt"), F.col("relevant_idx") >= 0
    return (tok.withColumn("labels_s1", M.mask_stage1(ids, s, found, n_keep))
               .withColumn("labels_s2", M.mask_stage2(ids, s, found, n_keep))
               .withColumn("labels_answer", M.mask_answer(ids, s)))


def padded_batches(rows: DataFrame, batch_size: int = 4, pad_id=None, key: str = "sample_id",
                   labels: str = "labels_s1", weights: str | None = None, keys: DataFrame | None = None, lengths: str | None = None) -> DataFrame:
    """E2 + D13 + H24 + H25: consecutive rows (by ``key``) in batches of ``batch_size``,
    each padded to its longest row.  ``pad_id`` defaults to each row's EOS id column ``eos_id``.

    Batch ids come from the distributed position (E1); the per-batch maximum is a
    window over at most ``batch_size`` rows.  Pass ``keys`` (the same keys from before
    tokenization) to number a cheap key table and join, rather than range-sorting the
    token rows, whose computation the range sampling would repeat.  If ``keys`` also has the number of ids of each row, named by
    ``lengths``, the maximum comes from there and the token rows are shuffled once.
    """
    batch = F.floor(F.col("pos") / batch_size).cast("long").alias("batch_id")
    if keys is not None and lengths:
        pos = with_position(keys.select(key, F.col(lengths).alias("_n")), [key])
        return _padded(_measured(rows, pos.select(key, batch), pos.select(key, "_n"), key), pad_id, key, labels, weights)
    pos = number_by_key(rows, keys, key) if keys is not None else with_position(rows, [key])
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    return _padded(pos.withColumn("batch_id", batch).withColumn("max_len", longest), pad_id, key, labels, weights)


def _measured(rows: DataFrame, placed: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """Rows with ``batch_id`` by their key (``placed``) and the ``max_len`` of the batch, found on keys and lengths (``_n``) alone."""
    longest = placed.join(lengths, key).groupBy("batch_id").agg(F.max("_n").alias("max_len"))
    return rows.join(placed.join(longest, "batch_id"), key)


def _padded(rows: DataFrame, pad_id, key: str, labels: str, weights: str | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a ``batch_id``, each padded to the longest of its batch, ``max_len``."""
    pad_val = F.col("eos_id") if pad_id is None else F.lit(pad_id)
    n, m = F.size("input_ids"), F.col("max_len")
    cols = [key, *carry, "batch_id", "max_len",
            F.concat("input_ids", F.array_repeat(pad_val, m - n)).alias("input_ids"),
            M.attention(n, m).alias("attention_mask"),
            M.pad(F.col(labels), m, M.IGNORE).alias("labels")]
    if weights:
        cols.append(M.pad(F.col(weights), m, 0.0).alias("loss_weights"))
    return rows.select(*cols)


def bucketed_batches(rows: DataFrame, edges: list[int], batch_size: int = 4, pad_id=None, key: str = "sample_id",
                     labels: str = "labels_s1", weights: str | None = None) -> DataFrame:
    """E2 + D13 + H24 with length buckets: like :func:`padded_batches`, but a batch holds rows of one bucket only.

    Bucket i has the lengths above ``edges[i - 1]`` and up to ``edges[i]``; within it rows follow ``key``.  Lengths and keys
    are numbered together, (bucket, key) first, and the start of each bucket is subtracted, so no bucket is sorted in one
    task however common its lengths.  The last batch of a bucket may be smaller.  Adds ``bucket``; batch ids are
    unique and follow (bucket, position).
    """
    bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<int>"), lambda e: e < F.size("input_ids")))
    held = materialize(rows.withColumn("bucket", bucket))
    keys = with_position(held.select("bucket", key), ["bucket", key])
    keys = materialize(keys.withColumnRenamed("bucket", "_bucket"))
    begin = keys.groupBy("_bucket").agg(F.min("pos").alias("_begin"), F.count(F.lit(1)).alias("_n"))  # a row a bucket
    w = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.select("_bucket", "_begin", F.coalesce(F.sum(F.ceil(F.col("_n") / batch_size)).over(w), F.lit(0)).alias("_batches"))
    placed = keys.join(F.broadcast(begin), "_bucket").select(key, (F.col("_batches") + F.floor((F.col("pos") - F.col("_begin")) / batch_size)).cast("long").alias("batch_id"))
    lengths = held.select(key, F.size("input_ids").alias("_n"))
    return _padded(_measured(held, placed, lengths, key), pad_id, key, labels, weights, ("bucket",))


def padding_share(batches: DataFrame) -> DataFrame:
    """``(rows, tokens, cells, padding_share)`` of padded batches: how much of their area is padding."""
    size, used = F.size("attention_mask"), F.size(F.filter("attention_mask", lambda x: x == 1))
    sums = batches.agg(F.count(F.lit(1)).alias("rows"), F.sum(used).cast("long").alias("tokens"), F.sum(size).cast("long").alias("cells"))
    return sums.withColumn("padding_share", F.round(F.try_divide(F.col("cells") - F.col("tokens"), F.col("cells")), 6))


def masked_out_report(rows: DataFrame, max_len: int) -> DataFrame:
    """Rows without any target token, truncated rows, target-token totals."""
    none1 = F.forall("labels_s1", lambda x: x == M.IGNORE)
    none2 = F.forall("labels_s2", lambda x: x == M.IGNORE)
    tgt = lambda c: F.size(F.filter(c, lambda x: x != M.IGNORE))
    return rows.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("n_full_untruncated") > max_len).alias("truncated"),
        F.count_if(F.col("n_prompt") >= max_len).alias("prompt_fills_window"),
        F.count_if(none1).alias("no_target_s1"),
        F.count_if(none2).alias("no_target_s2"),
        F.sum(tgt(F.col("labels_s1"))).cast("long").alias("target_tokens_s1"),
        F.sum(tgt(F.col("labels_s2"))).cast("long").alias("target_tokens_s2"),
    )
