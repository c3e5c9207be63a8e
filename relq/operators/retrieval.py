"""Exact top-k retrieval and precision at k.

Scoring is a blocked scan.  A query matrix of a checked size is broadcast; each task multiplies its Arrow
batches of index vectors (``mapInArrow``, no Python object per vector) by it with numpy and keeps a running top-k per query,
so a task emits at most k rows per query and no (query, document) pair is ever a
row.  The final top-k per query merges k rows per task (E4).  Ties go to the
lower document id, in the task and in the merge alike.  A query table beyond that size is dealt with the index
over a grid (:mod:`relq.operators.grid`), with the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relq.functions.jsonparse import with_judge_flag
from relq.functions.text import extract_query
from relq.operators.chat import prompt_column
from relq.operators.grid import grid_topk, unit_rows
from relq.operators.positions import with_position

# A query matrix up to this size is broadcast; beyond it neither side is.
MAX_QUERY_BYTES = 64 << 20
# Queries and index rows that a task scores at once: a memory tile with no influence on the result.
QUERY_TILE = 1024
ROW_TILE = 1024

HITS_SCHEMA = "query_id long, doc_id long, score double"


def _topk_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Row indices of the k best (score desc, id asc), exact under ties."""
    if len(scores) <= k:
        cand = np.arange(len(scores))
    else:
        thr = np.partition(scores, len(scores) - k)[len(scores) - k]
        cand = np.nonzero(scores >= thr)[0]
    order = np.lexsort((ids[cand], -scores[cand]))
    return cand[order[:k]]


def _merge_topk(best_sc: np.ndarray, best_id: np.ndarray, sc: np.ndarray, ids: np.ndarray, k: int):
    """Per column (query): the k best of (running best + new batch) by (score desc, id asc).

    Vectorised over queries: an argpartition keeps the k + slack best rows of each column,
    a column-wise lexsort orders them.  Only a column whose ties reach past the slack is
    redone exactly, one column at a time.
    """
    c_sc = np.vstack([best_sc, sc])
    c_id = np.vstack([best_id, np.broadcast_to(ids[:, None], sc.shape)])
    n = c_sc.shape[0]
    m = min(n, k + 8)
    if m < n:
        part = np.argpartition(-c_sc, m - 1, axis=0)[:m]
        p_sc, p_id = np.take_along_axis(c_sc, part, 0), np.take_along_axis(c_id, part, 0)
    else:
        p_sc, p_id = c_sc, c_id
    order = np.lexsort((p_id, -p_sc), axis=0)[:k]
    new_sc, new_id = np.take_along_axis(p_sc, order, 0), np.take_along_axis(p_id, order, 0)
    if m < n and new_sc.shape[0] == k:
        cut = np.nonzero(p_sc.min(axis=0) >= new_sc[-1])[0]  # ties may continue past the slack
        for j in cut:
            keep = _topk_rows(c_id[:, j], c_sc[:, j], k)
            new_sc[:, j], new_id[:, j] = c_sc[keep, j], c_id[keep, j]
    return new_sc, new_id


def _scorer(bq, k: int, id_col: str, vec_col: str, dim: int, digits: int | None):
    """Arrow batches in, one small batch of (query_id, doc_id, score) out per task.

    The list column is flattened into one ``(rows, dim)`` matrix without a Python object per
    vector; a vector that is null or of another length fails the job.  A task holds the scores of one tile of
    rows by one tile of queries at a time, whatever the sizes of its batches and of the query table, and only the
    rows of a tile that reach the k-th best score of some query meet the running best."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def score(batches):
        qids, qmat = bq.value
        tiles = [slice(a, a + QUERY_TILE) for a in range(0, len(qids), QUERY_TILE)]
        best = [(np.empty((0, len(qids[t]))), np.empty((0, len(qids[t])), dtype=np.int64)) for t in tiles]
        for rb in batches:
            if rb.num_rows == 0:
                continue
            vecs = rb.column(vec_col)
            if not pc.all(pc.fill_null(pc.equal(pc.list_value_length(vecs), dim), False)).as_py():
                raise ValueError(f"an index vector is null or has not the queries' {dim} dimensions")
            ids = rb.column(id_col).to_numpy(zero_copy_only=False).astype(np.int64)
            vecs = vecs.flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, dim)
            for at in range(0, rb.num_rows, ROW_TILE):
                own, x = ids[at:at + ROW_TILE], unit_rows(vecs[at:at + ROW_TILE].astype(np.float64))
                for i, t in enumerate(tiles):
                    scores = x @ qmat[t].T  # (rows, queries) of the tile
                    if digits is not None:
                        scores = scores.round(digits)
                    if len(best[i][0]) == k:
                        rows = np.flatnonzero(~(scores < best[i][0][-1]).all(axis=1))
                        if not len(rows):
                            continue
                        best[i] = _merge_topk(*best[i], scores[rows], own[rows], k)
                    else:
                        best[i] = _merge_topk(*best[i], scores, own, k)
        for t, (best_sc, best_id) in zip(tiles, best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids[t][None, :], best_sc.shape[0], axis=0).ravel(order="F"), pa.int64()),
                 pa.array(best_id.ravel(order="F"), pa.int64()),
                 pa.array(best_sc.ravel(order="F"), pa.float64())],
                names=["query_id", "doc_id", "score"])
    return score


def knn_topk(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "doc_id", vec_col: str = "embedding",
             query_id: str = "query_id", query_vec: str = "embedding",
             max_query_bytes: int = MAX_QUERY_BYTES, digits: int | None = None) -> DataFrame:
    """the k best index rows per query by inner product of L2-normalised vectors.

    Returns ``(query_id, rank, doc_id, score)``; rank is 1-based.  Query vectors must have one
    length, the index vectors the same.  Queries of up to ``max_query_bytes`` are broadcast, more are joined
    with the index on a grid.  With ``digits`` scores are rounded before they
    are compared, so that equal scores are ties however they were summed.
    """
    spark = index.sparkSession
    size = F.size(query_vec)
    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("dim"),
                        F.count_if(F.col(query_vec).isNull()).alias("nulls"), F.min(size).alias("low")).first()
    nq, dim = int(stats["n"]), int(stats["dim"] or 0)
    if nq == 0:
        return spark.createDataFrame([], HITS_SCHEMA + ", rank long").select("query_id", "rank", "doc_id", "score")
    if stats["nulls"] or stats["low"] != dim:
        raise ValueError("query vectors must not be null and must have one length")
    if nq * dim * 8 > max_query_bytes:
        return grid_topk(index, queries, k, id_col, vec_col, query_id, query_vec, digits)
    rows = queries.select(F.col(query_id).cast("long").alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qv")).toArrow()
    qids = rows["_qid"].to_numpy().astype(np.int64)
    qmat = unit_rows(rows["_qv"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qids), dim))
    bq = spark.sparkContext.broadcast((qids, qmat))
    cand = index.select(id_col, vec_col).mapInArrow(_scorer(bq, k, id_col, vec_col, dim, digits), HITS_SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (cand.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k)
            .select(F.col("query_id").alias(query_id), "rank", "doc_id", "score"))


def first_queries(samples: DataFrame, n: int | None = 10, input_col: str = "input", key: str = "sample_id",
                  carry: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """The first ``n`` distinct queries (None: all) in first-seen order.

    ``min(key)`` per query is algebraic, so every task pre-aggregates and a hot
    query never gathers its rows; only the distinct queries reach the final sort.  ``carry``
    columns are those of the row where the query was first seen.  An input without a separator is left out, or with
    ``strict`` an error.
    """
    q = samples.select(key, *carry, extract_query(F.col(input_col), strict).alias("query")).where(F.col("query").isNotNull())
    firsts = q.groupBy("query").agg(F.min(key).alias("first_seen"), *[F.min_by(c, key).alias(c) for c in carry])
    return rank_queries(firsts, n, carry)


def rank_queries(firsts: DataFrame, n: int | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(query, first_seen, *carry)`` rows, one a query, with their place in first-seen order: the first ``n`` or all."""
    if n is None:
        return with_position(firsts, ["first_seen"], materialize_input=True).select(
            "query", "first_seen", *carry, (F.col("pos") + 1).alias("query_rank"))
    w = Window.orderBy("first_seen")  # over the n rows of the limit below
    top = firsts.orderBy("first_seen").limit(n)
    return top.select("query", "first_seen", *carry, F.row_number().over(w).cast("long").alias("query_rank"))


def attach(hits: DataFrame, index: DataFrame, cols: list[str], id_col: str = "doc_id") -> DataFrame:
    """Fetch index columns for the k hits only (the wide ``text`` never meets the scoring)."""
    # every hit comes from the index, so an inner join loses none and lets the few hits be the small side
    return hits.join(index.select(id_col, *cols), id_col, "inner")


def label_judge(hits: DataFrame, queries: DataFrame, index: DataFrame, query_id: str = "query_id") -> DataFrame:
    """J4 (gold form): a hit is relevant when its label equals the query's label."""
    ql = queries.select(F.col(query_id), F.col("label").alias("query_label"))
    h = attach(hits, index, ["label"]).join(ql, query_id, "left")
    return h.withColumn("relevant", F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)))


def precision_at_k(judged: DataFrame, k: int = 5, query_id: str = "query_id") -> DataFrame:
    """Relevant hits / k per query (k fixed, a short hit list still divides by k)."""
    return judged.groupBy(query_id).agg(
        F.round(F.count_if(F.col("relevant")) / F.lit(float(k)), 6).alias("p_at_k"))


def mean_precision_at_k(per_query: DataFrame) -> DataFrame:
    """Unweighted mean over queries; null when there are no queries."""
    return per_query.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("p_at_k"), 6).alias("mean_p_at_k"))


def rag_prompts(hits: DataFrame, queries: DataFrame, index: DataFrame, query_id: str = "query_id") -> DataFrame:
    """C5 + H6 (``rag``): ``(query_id, rank, doc_id, prompt)``, the judge's prompt for every hit."""
    found = attach(hits, index, ["text"]).join(queries.select(query_id, "query"), query_id)
    return found.select(query_id, "rank", "doc_id", prompt_column("rag", instruction=None, inp=None, query="query", document="text").alias("prompt"))


def answer_judge(hits: DataFrame, answers: DataFrame, query_id: str = "query_id") -> DataFrame:
    """H14 over an answers table ``(query_id, doc_id, answer)``: ``hits`` plus ``relevant``; a missing or
    unreadable answer is not relevant."""
    flags = with_judge_flag(answers.select(query_id, "doc_id", "answer"), "answer", "relevant").drop("answer")
    return hits.join(flags, [query_id, "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
