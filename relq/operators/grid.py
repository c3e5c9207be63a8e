"""Exact top-k between two tables of any size (C6, E4, F1): a grid of vector blocks.

Neither side is broadcast or collected.  Both tables are packed into blocks of bounded size, a row each, inside
the tasks that read them.  Query blocks are dealt to the rows of a grid and index blocks to its columns; every query block goes
to each column and every index block to each row, by a shuffle on (row, column).  A cell is one task's work: one matrix
product, of which at most k rows a query are kept.  Grid rows and columns are as many as their tables' bytes ask for, so a
cell's memory does not depend on either size.  The cells' rows meet in a ranking per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from relq.operators.positions import materialize

BLOCK_BYTES = 1 << 20  # vectors of a block
CELL_BYTES = 8 << 20  # vectors of a cell's side
HITS = "query_id long, doc_id long, score double"
HITS_SCHEMA = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
TILE = 4 << 20  # scores that stand in memory at once
SIDE = 1024  # queries, and index rows, whose scores a cell holds at once
PAIRS = 1 << 16  # pairs that are scored in double precision at once


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def vector_matrix(column: pa.Array, dim: int, what: str) -> np.ndarray:
    """The vectors of a list column as one matrix of doubles; a null or another length fails the job."""
    if not pc.all(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)).as_py():
        raise ValueError(f"{what} vector is null or has not {dim} dimensions")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def vector_dim(df: DataFrame, vec_col: str) -> int:
    """The length of the first vector, 0 without any."""
    first = df.select(F.size(vec_col).alias("d")).where(F.col("d") >= 0).head(1)
    return int(first[0].d) if first else 0


def vector_blocks(df: DataFrame, id_col: str, vec_col: str, dim: int, what: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, n, ids, vectors)``: the table's vectors as packed blocks of at most ``block_bytes``, floats as they are."""
    dtype = Packed(dim, df.schema[vec_col].dataType).dtype
    most = max(1, block_bytes // (dim * np.dtype(dtype).itemsize))
    schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def emit() -> pa.RecordBatch:
            nonlocal number, ids, parts, held
            i, v = np.concatenate(ids), np.concatenate(parts)
            row = pa.record_batch([[number], [len(i)], [i.tobytes()], [v.tobytes()]], schema=schema)
            number, ids, parts, held = number + 1, [], [], 0
            return row

        for b in it:
            x = vector_matrix(b.column(1), dim, what).astype(dtype)
            own = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(own):
                take = min(most - held, len(own) - at)
                ids.append(own[at:at + take])
                parts.append(x[at:at + take])
                held, at = held + take, at + take
                if held == most:
                    yield emit()
        if held:
            yield emit()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(
        run, "block long, n long, ids binary, vectors binary")


class Packed:
    """How the vectors of a table are packed."""

    def __init__(self, dim: int, vec_type):
        self.dim = dim
        self.dtype = np.float32 if isinstance(vec_type, ArrayType) and isinstance(vec_type.elementType, FloatType) else np.float64

    def read(self, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, dtype=np.int64), unit_rows(np.frombuffer(vectors, dtype=self.dtype).reshape(-1, self.dim).astype(np.float64))


def best_of(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, ok: np.ndarray | None = None) -> pa.Table:
    """The k best (score falling, id rising) of every row of ``scores`` (queries, documents)."""
    s = scores if ok is None else np.where(ok, scores, -np.inf)
    if s.shape[1] > k:  # all that reach the last place, ties included
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        keep = s >= floor[:, None]
    else:
        keep = np.ones(s.shape, dtype=bool)
    if ok is not None:
        keep &= ok
    q, d = np.nonzero(keep)
    order = np.lexsort((ids[d], -s[q, d], q))
    q, d = q[order], d[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    q, d = q[first], d[first]
    return pa.table([qids[q], ids[d], s[q, d]], schema=HITS_SCHEMA)


def score_block(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, digits: int | None, exclude_self: bool) -> list[pa.Table]:
    """The best of every query in one block, tile by tile."""
    out, step = [], max(1, TILE // max(1, len(ids)))
    for at in range(0, len(qids), step):
        s = q[at:at + step] @ x.T
        if digits is not None:
            s = s.round(digits)
        own = qids[at:at + step]
        out.append(best_of(own, ids, s, k, own[:, None] != ids[None, :] if exclude_self else None))
    return out


class Best:
    """The k best index rows (score falling, id rising) of each of a tile of queries, over blocks that come one after another.

    A block is multiplied in single precision; only the pairs that may reach the k-th best score of their query, by a bound on what
    that product can be off, are scored in double precision.  Those are few once some blocks were seen.
    """

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, digits: int | None, exclude_self: bool):
        self.qids, self.q, self.k, self.digits, self.exclude_self = qids, q, k, digits, exclude_self
        self.single = q.astype(np.float32)
        # vectors are of length 1 at most: dim + 2 roundings of 2 ** -24, more than doubled, and a step of the rounded scores
        self.off = (q.shape[1] + 8) * 2.0 ** -23 + (0 if digits is None else 10.0 ** -digits)
        self.at, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # the best, query by query
        self.floor, self.last = np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max)  # the k-th of each query

    def add(self, ids: np.ndarray, x: np.ndarray, single: np.ndarray) -> None:
        s = self.single @ single.T
        low, short = self.floor - self.off, np.flatnonzero(np.isneginf(self.floor))
        if len(short):  # no k-th best yet: this block has a bound, the place after as many pairs as a query makes with itself
            place = self.k
            if self.exclude_self:
                order = np.sort(ids)
                place += int((np.searchsorted(order, self.qids[short], "right") - np.searchsorted(order, self.qids[short])).max())
            if s.shape[1] > place:
                own = np.nan_to_num(s[short], nan=-np.inf)
                low[short] = np.partition(own, s.shape[1] - place, axis=1)[:, s.shape[1] - place] - 2 * self.off
        at, row = np.nonzero(s >= low.astype(np.float32)[:, None])
        for a in range(0, len(at), PAIRS):
            self.merge(at[a:a + PAIRS], row[a:a + PAIRS], ids, x)

    def merge(self, at: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """The best with pairs of a query and a row of a block, scored in double precision."""
        if self.exclude_self:
            other = self.qids[at] != ids[row]
            at, row = at[other], row[other]
        s, own = np.einsum("ij,ij->i", self.q[at], x[row]), ids[row]
        if self.digits is not None:
            s = s.round(self.digits)
        new = (s > self.floor[at]) | ((s == self.floor[at]) & (own < self.last[at]))
        if not new.any():
            return
        at, own, s = (np.concatenate(p) for p in ((self.at, at[new]), (self.ids, own[new]), (self.scores, s[new])))
        order = np.lexsort((own, -s, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        order, place = order[place < self.k], place[place < self.k]
        self.at, self.ids, self.scores = at[order], own[order], s[order]
        full = place == self.k - 1
        self.floor[self.at[full]], self.last[self.at[full]] = self.scores[full], self.ids[full]

    def table(self) -> pa.Table:
        return pa.table([self.qids[self.at], self.ids, self.scores], schema=HITS_SCHEMA)


def merge_best(tables: list[pa.Table], k: int) -> pa.Table:
    """The k best rows of each query in several tables of hits."""
    t = pa.concat_tables(tables)
    q, d, s = (t[c].to_numpy() for c in t.column_names)
    order = np.lexsort((d, -s, q))
    q = q[order]
    return t.take(pa.array(order[np.arange(len(q)) - np.searchsorted(q, q) < k]))


def ranked(hits: DataFrame, k: int, query_id: str) -> DataFrame:
    """Ranks 1 to k of the hits of each query."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .select(F.col("query_id").alias(query_id), "rank", "doc_id", "score"))


def empty_hits(spark, query_id: str) -> DataFrame:
    return spark.createDataFrame([], f"`{query_id}` long, rank long, doc_id long, score double")


def grid_topk(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "doc_id", vec_col: str = "embedding",
              query_id: str = "query_id", query_vec: str = "embedding", digits: int | None = None, exclude_self: bool = False,
              block_bytes: int = BLOCK_BYTES, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """F1 for any number of queries: ``(query_id, rank, doc_id, score)``, the k best index rows by inner product of unit vectors.

    Ties go to the smaller id.  Vectors must not be null and must have one length on both sides; an empty side gives no rows.  Query
    ids must be unique.  ``exclude_self`` leaves out the index row that has the query's id.
    """
    spark, dim = index.sparkSession, vector_dim(queries, query_vec)
    if not dim or not vector_dim(index, vec_col):
        return empty_hits(spark, query_id)
    sides = [(queries, query_id, query_vec, "a query"), (index, id_col, vec_col, "an index")]
    pack = [Packed(dim, df.schema[v].dataType) for df, _, v, _ in sides]
    q, x = (materialize(vector_blocks(df, i, v, dim, what, block_bytes)) for df, i, v, what in sides)
    lines, columns = (max(1, -(-(t.agg(F.sum("n")).first()[0] or 0) * dim * p.dtype().itemsize // cell_bytes)) for t, p in zip((q, x), pack))
    deal = F.pmod(F.xxhash64("block"), F.lit(lines)).cast("int"), F.pmod(F.xxhash64("block"), F.lit(columns)).cast("int")
    left = q.select("ids", "vectors", deal[0].alias("line"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("at"))
    right = x.select("ids", "vectors", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"), deal[1].alias("at"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        best = [HITS_SCHEMA.empty_table()]
        blocks = [pack[1].read(i.as_py(), v.as_py()) for i, v in zip(b["ids"], b["vectors"])]
        docs = [(i[at:at + SIDE], x[at:at + SIDE], x[at:at + SIDE].astype(np.float32)) for i, x in blocks for at in range(0, len(i), SIDE)]
        for i, v in zip(a["ids"], a["vectors"]):
            qids, m = pack[0].read(i.as_py(), v.as_py())
            for at in range(0, len(qids), SIDE):
                tile = Best(qids[at:at + SIDE], m[at:at + SIDE], k, digits, exclude_self)
                for d in docs:
                    tile.add(*d)
                best.append(tile.table())
        return pa.concat_tables(best)

    return ranked(left.groupBy("line", "at").cogroup(right.groupBy("line", "at")).applyInArrow(cell, HITS), k, query_id)
