"""An index whose blocks can be skipped, and the exact search over it.

The vectors are laid out by their nearest centres and cut into blocks, a Parquet row each.  A summary has for every
block its own centre, the largest angle of a vector to it, and its least and greatest id.  On the unit sphere
angles obey the triangle inequality: no vector of a block is nearer to a query than the angle between query and
centre less the block's radius, so cos(angle - radius) bounds every score in the block.

A search first reads each query's most promising block, which gives a floor for its k-th best score, and then only the
blocks whose bound reaches the floor.  Summaries lie in pages of bounded size that meet the query blocks on a grid; a
pair that is read carries the vectors of just the queries that need the block.  The result is that of a full scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.operators.grid import HITS, HITS_SCHEMA, Packed, empty_hits, merge_best, ranked, score_block, unit_rows, vector_blocks, vector_dim, vector_matrix
from relq.operators.positions import materialize

BLOCK_ROWS = 1024
MAX_CENTRES = 1024  # layout centres, whatever the size of the table
SAMPLE_PER_CENTRE = 32
PAGE = 1024  # block summaries that one cell holds
SLACK = 1e-9  # rounding of angles and scores


# ---- layout -------------------------------------------------------------------------------------

def layout_centres(index: DataFrame, id_col: str, vec_col: str, dim: int, rows: int, block_rows: int, steps: int = 8) -> np.ndarray:
    """Unit centres for the layout, by spherical k-means on a sample of bounded size: the rows with the smallest id hashes."""
    k = min(MAX_CENTRES, max(1, -(-rows // block_rows)))
    sample = index.orderBy(F.xxhash64(F.col(id_col).cast("long"), F.lit(5)), id_col).limit(SAMPLE_PER_CENTRE * k).select(vec_col).toArrow()
    x = unit_rows(vector_matrix(sample.column(0).combine_chunks(), dim, "an index"))
    x = x[(x != 0).any(axis=1)]
    if not len(x):
        return np.zeros((1, dim))
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(steps):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where((sums != 0).any(axis=1, keepdims=True), unit_rows(sums), c)
    return c


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def write_clustered_index(index: DataFrame, path: str, id_col: str = "doc_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> None:
    """A7 with a layout: ``path/blocks`` has the blocks, ``path/summary`` a small row for each.

    Vectors must not be null and must have one length; an empty table gives an empty index.
    """
    spark, dim = index.sparkSession, vector_dim(index, vec_col)
    pack = Packed(dim, index.schema[vec_col].dataType)
    rows = index.count() if dim else 0
    centres = layout_centres(index, id_col, vec_col, dim, rows, block_rows) if rows else np.zeros((1, 1))
    near = spark.sparkContext.broadcast(centres)  # MAX_CENTRES vectors at most
    placed = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("c1", pa.int32()), ("c2", pa.int32()), ("apart", pa.float64())])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = near.value
        for b in it:
            if b.num_rows:
                raw = vector_matrix(b.column(1), dim, "an index")
                x = unit_rows(raw)
                s = x @ c.T
                first = s.argmax(axis=1)
                best = s[np.arange(len(s)), first]
                s[np.arange(len(s)), first] = -np.inf
                zero = ~(x != 0).any(axis=1)  # without a direction: blocks of their own
                yield pa.record_batch([b.column(0), pa.array([v.tobytes() for v in raw.astype(pack.dtype)], type=pa.binary()),
                                       pa.array(np.where(zero, -1, first).astype(np.int32)), pa.array(s.argmax(axis=1).astype(np.int32)), pa.array(best)], schema=placed)

    cut_schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("centre", pa.binary()),
                            ("radius", pa.float64()), ("min_id", pa.int64()), ("max_id", pa.int64())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, group, ids, vectors = TaskContext.get().partitionId() << 32, None, [], []

        def emit() -> pa.RecordBatch:
            nonlocal number
            i, packed = np.array(ids, dtype=np.int64), b"".join(vectors)
            _, x = pack.read(i.tobytes(), packed)
            centre = unit_rows(x.sum(axis=0, keepdims=True))
            whole = (x != 0).any() and (centre != 0).any()
            radius = float(angle(x, centre).max()) if whole else float(np.pi)
            number += 1
            return pa.record_batch([[number - 1], [len(i)], [i.tobytes()], [packed], [centre.tobytes()], [radius], [int(i.min())], [int(i.max())]], schema=cut_schema)

        for b in it:
            for i, v, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                if ids and (c != group or len(ids) == block_rows):
                    yield emit()
                    ids, vectors = [], []
                group = c
                ids.append(i)
                vectors.append(v)
        if ids:
            yield emit()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(index.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
                         .mapInArrow(place, "id long, v binary, c1 int, c2 int, apart double")
                         .repartitionByRange(n, "c1", "c2", "apart", "id").sortWithinPartitions("c1", "c2", "apart", "id")
                         .mapInArrow(cut, "block long, n long, ids binary, vectors binary, centre binary, radius double, min_id long, max_id long"))
    kind = json.dumps({"dim": dim, "float": pack.dtype == np.float32})
    blocks.select("block", "n", "ids", "vectors").write.mode("overwrite").parquet(f"{path}/blocks")
    blocks.select("block", "n", "centre", "radius", "min_id", "max_id", F.lit(kind).alias("kind")).write.mode("overwrite").parquet(f"{path}/summary")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """``(block, n, centre, radius, min_id, max_id, kind)``: what a search knows of a block before it reads it."""
    return spark.read.parquet(f"{path}/summary")


# ---- search -------------------------------------------------------------------------------------

PAIR = pa.schema([("block", pa.int64()), ("wanted", pa.int64()), ("qids", pa.binary()), ("queries", pa.binary())])


def clustered_topk(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, query_id: str = "query_id", query_vec: str = "embedding",
                   digits: int | None = None, id_range: tuple[int | None, int | None] = (None, None), page: int = PAGE,
                   counts: dict | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)`` of a written index, equal to the full scan's.

    ``id_range`` keeps documents with ids from the first to before the second bound; blocks outside are skipped by their ids.
    Query vectors must not be null and must have one length, the index's; an empty side gives no rows.  ``counts``, if given, gets
    the numbers of (query, block) pairs, of those whose bound had to be looked up, and of those read.
    """
    low, high = id_range
    summary = read_summary(spark, path)
    if low is not None:
        summary = summary.where(F.col("max_id") >= low)
    if high is not None:
        summary = summary.where(F.col("min_id") < high)
    head, dim = summary.head(1), vector_dim(queries, query_vec)
    if not head or not dim:
        return empty_hits(spark, query_id)
    kind = json.loads(head[0].kind)
    if dim != kind["dim"]:
        raise ValueError(f"the queries have {dim} dimensions, the index {kind['dim']}")
    docs_of = Packed(dim, None)
    docs_of.dtype = np.float32 if kind["float"] else np.float64
    queries_of = Packed(dim, queries.schema[query_vec].dataType)
    slack = SLACK + (0.0 if digits is None else 10.0 ** -digits)
    pages = max(1, -(-summary.count() // page))
    paged = materialize(summary.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int"))
                        .groupBy("page").agg(F.collect_list(F.struct("block", "centre", "radius")).alias("s")))
    asked = materialize(vector_blocks(queries, query_id, query_vec, dim, "a query").withColumnRenamed("block", "q"))
    blocks = spark.read.parquet(f"{path}/blocks").select("block", "ids", "vectors")
    each_page = F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")

    def bounds(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, raw query vectors, blocks, greatest possible scores) of a cell."""
        qids, x = queries_of.read(row["ids"], row["vectors"])
        raw = np.frombuffer(row["vectors"], dtype=queries_of.dtype).reshape(-1, dim)
        c = np.frombuffer(b"".join(s["centre"] for s in row["s"]), dtype=np.float64).reshape(-1, dim)
        r = np.array([s["radius"] for s in row["s"]])
        return qids, raw, np.array([s["block"] for s in row["s"]]), np.cos(np.maximum(0, angle(x, c) - r)) + slack

    # the most promising block of each query
    def promise(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                qids, _, number, most = bounds(row)
                at = most.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qids), row["q"])), pa.array(np.arange(len(qids))), pa.array(number[at]),
                                                  pa.array(most[np.arange(len(qids)), at])], ["q", "place", "block", "most"])

    cells = asked.select("q", "ids", "vectors", each_page).join(paged, "page").select("q", "ids", "vectors", "s")
    best = (cells.mapInArrow(promise, "q long, place long, block long, most double").groupBy("q", "place")
            .agg(F.max_by("block", F.struct("most", "block")).alias("block")))

    def carry(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                raw = np.frombuffer(row["vectors"], dtype=queries_of.dtype).reshape(-1, dim)
                qids = np.frombuffer(row["ids"], dtype=np.int64)
                for s in row["first"]:
                    yield pa.record_batch([[s["block"]], [len(s["places"])], [qids[s["places"]].tobytes()], [raw[s["places"]].tobytes()]], schema=PAIR)

    first = (best.groupBy("q", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))
             .groupBy("q").agg(F.collect_list(F.struct("block", "places")).alias("first")))
    starts = asked.join(first, "q").select("ids", "vectors", "first").mapInArrow(carry, "block long, wanted long, qids binary, queries binary")

    def scan(pairs: DataFrame) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [HITS_SCHEMA.empty_table()], 0
            for b in it:
                for row in b.to_pylist():
                    qids, q = queries_of.read(row["qids"], row["queries"])
                    ids, x = docs_of.read(row["ids"], row["vectors"])
                    if low is not None or high is not None:
                        inside = np.ones(len(ids), dtype=bool) if low is None else ids >= low
                        inside &= True if high is None else ids < high
                        ids, x = ids[inside], x[inside]
                    found = score_block(qids, q, ids, x, k, digits, False)
                    held += found
                    rows += sum(t.num_rows for t in found)
                    if rows > 1 << 18:
                        best_now = merge_best(held, k)
                        held, rows = [best_now], best_now.num_rows
                        if rows > 1 << 17:
                            yield from best_now.to_batches()
                            held, rows = [HITS_SCHEMA.empty_table()], 0
            yield from merge_best(held, k).to_batches()

        return pairs.join(blocks, "block").select("qids", "queries", "ids", "vectors").mapInArrow(run, HITS)

    # a query's floor: its k-th score in that block, if the block has as many
    floors = materialize(scan(starts).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")))

    def reach(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                qids, raw, number, most = bounds(row)
                known = {x["query_id"]: x["floor"] for x in row["floors"] if x["floor"] is not None}
                floor = np.array([known.get(i, -np.inf) for i in qids.tolist()])
                for j in np.flatnonzero((most >= floor[:, None]).any(axis=0)).tolist():
                    own = np.flatnonzero(most[:, j] >= floor)
                    yield pa.record_batch([[int(number[j])], [len(own)], [qids[own].tobytes()], [raw[own].tobytes()]], schema=PAIR)

    def names(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row in b.to_pylist():
                qids = np.frombuffer(row["ids"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qids), row["q"])), pa.array(qids)], ["q", "query_id"])

    by_block = (asked.select("q", "ids").mapInArrow(names, "q long, query_id long").join(floors, "query_id")
                .groupBy("q").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors")))
    cells = asked.join(by_block, "q", "left").select("ids", "vectors", F.coalesce("floors", F.array().cast("array<struct<query_id:bigint,floor:double>>")).alias("floors"), each_page)
    pairs = materialize(cells.join(paged, "page").select("ids", "vectors", "floors", "s").mapInArrow(reach, "block long, wanted long, qids binary, queries binary"))
    if counts is not None:
        asked_n = asked.agg(F.sum("n")).first()[0]
        counts.update(pairs=asked_n * summary.count(), read=pairs.agg(F.sum("wanted")).first()[0] or 0,
                      blocks=summary.count(), blocks_read=pairs.select("block").distinct().count())
    return ranked(scan(pairs), k, query_id)
