"""Operator 13: hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become whole numbers, floor(scale * x); scores are their exact inner products.  Candidates are put in the
order of (label, place on a Hilbert curve through the dimensions that vary most, id) and cut into blocks, a
Parquet row each, with the least and greatest value of every dimension: the zone map.  Anchors, a stated share of the
same rows, form blocks with zone maps of their own.

Interval arithmetic on two zone maps bounds every score between their blocks.  Only pairs of an anchor block and a
candidate block whose bounds reach a window of the anchors are read; inside a pair the bounds of each single anchor
against the zone map choose the anchors that are multiplied with the block.

1. Positives: an anchor's own block gives a first floor for its best scores; blocks of its label that cannot reach
   the floor are not read.
2. Negatives: every (anchor, positive) has a window of scores, [share * positive score, positive score]; blocks of
   other labels whose bounds miss all windows of an anchor block are not read.

Zone maps meet on a grid: those of candidate blocks lie in pages of bounded size, and every anchor block's map goes to
every page.  No row is a pair of vectors; a task keeps the best of each window, so it emits at most k rows a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relq.llm.common import batches_of, materialize, read
from relq.llm.vectors import dimension, scaled_floor, summed, whole_vectors

SCALE = 256
ANCHORS = 100  # ids divisible by it are anchors
POSITIVES = 5
NEGATIVES = 5
SHARE = (80, 100)  # a negative's score is at least 80/100 of the positive's
BLOCK = 512  # candidates of a block
ANCHOR_BLOCK = 128
PAGE = 512  # zone maps of a page
CURVE_DIMS = 8
CURVE_BITS = 7
LARGEST = 1 << 31
HELD_ROWS = 1 << 18  # rows of a task's running best before they are merged


# ---- curve --------------------------------------------------------------------------------------

def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of cell numbers (below 2^bits, columns are dimensions) on the Hilbert curve.

    From the highest bit down, a set bit of a dimension flips the lower bits of the first one, a clear bit swaps
    them; a Gray code then turns the transposed bits into the place.
    """
    x = cells.astype(np.int64).copy()
    d = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(d):
            up = (x[:, i] >> b) & 1 == 1
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(up, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = place << 1 | (x[:, i] >> b) & 1
    return place


# ---- interval arithmetic ------------------------------------------------------------------------

def bounds(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of any vectors from boxes ``a`` (rows) and boxes ``b`` (columns)."""
    least, most = (np.zeros((len(lo_a), len(lo_b))) for _ in range(2))
    for i in range(lo_a.shape[1]):  # a dimension at a time: the products never stand in memory for all of them
        p = [np.multiply.outer(x[:, i], y[:, i]) for x in (lo_a, hi_a) for y in (lo_b, hi_b)]
        least += np.minimum(np.minimum(p[0], p[1]), np.minimum(p[2], p[3]))
        most += np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
    return least, most


def _rows(packed, dim: int, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(packed, dtype=dtype).reshape(-1, dim)


# ---- blocks -------------------------------------------------------------------------------------

def whole_rows(df: DataFrame, id_col: str, vec_col: str, label: Column, dim: int, scale: int = SCALE) -> DataFrame:
    """``(id, label, c)``: the rows that take part, one an id, with their packed whole numbers."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("c", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, x = whole_vectors(b.column(2), dim)
            c = scaled_floor(x, scale, LARGEST).astype(np.int32)
            take = pa.array(at)
            yield pa.record_batch([b.column(0).take(take), b.column(1).take(take), pa.array([v.tobytes() for v in c], type=pa.binary())], schema=schema)

    rows = (df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
            .where("id is not null and label is not null").mapInArrow(run, "id long, label long, c binary"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "c")).alias("r")).select("id", "r.label", "r.c")


def _spread(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dimensions that vary most, their least, their greatest value) in all rows."""
    schema = pa.schema([("i", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("s", pa.float64()), ("q", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                c = _rows(b"".join(b.column(0).to_pylist()), dim).astype(np.float64)
                yield pa.record_batch([pa.array(np.arange(dim, dtype=np.int32)), pa.array(c.min(axis=0).astype(np.int64)), pa.array(c.max(axis=0).astype(np.int64)),
                                       pa.array(np.full(dim, len(c))), pa.array(c.sum(axis=0)), pa.array((c * c).sum(axis=0))], schema=schema)

    t = (rows.select("c").mapInArrow(run, "i int, lo long, hi long, n long, s double, q double").groupBy("i")
         .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.sum("q") / F.sum("n") - (F.sum("s") / F.sum("n")) ** 2).alias("var")).toPandas())
    t = t.sort_values(["var", "i"], ascending=[False, True]).head(CURVE_DIMS)
    return tuple(t[k].to_numpy() for k in ("i", "lo", "hi"))


BLOCKS = "block long, label long, ids binary, c binary, lo binary, hi binary"


def candidate_blocks(rows: DataFrame, dim: int, block: int = BLOCK) -> DataFrame:
    """``(block, label, ids, c, lo, hi)``: at most ``block`` neighbours on the curve with one label, and their zone map."""
    dims, lo, hi = _spread(rows, dim)
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("c", pa.binary()), ("place", pa.int64())])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                c = _rows(b"".join(b.column(2).to_pylist()), dim)[:, dims].astype(np.float64)
                cells = ((c - lo) * ((1 << CURVE_BITS) - 1) / np.maximum(hi - lo, 1)).astype(np.int64)
                yield pa.record_batch([*b.columns, pa.array(hilbert_index(cells, CURVE_BITS))], schema=schema)

    out = pa.schema([("block", pa.int64()), ("label", pa.int64()), *((n, pa.binary()) for n in ("ids", "c", "lo", "hi"))])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, None

        def emit(label: int, ids: list[int], vectors: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            c = _rows(b"".join(vectors), dim)
            number += 1
            return pa.record_batch([[number - 1], [label], [np.array(ids, dtype=np.int64).tobytes()], [c.tobytes()],
                                    [c.min(axis=0).tobytes()], [c.max(axis=0).tobytes()]], schema=out)

        for b in it:
            for i, label, c in zip(*(b.column(k).to_pylist() for k in range(3))):
                if held and (held[0] != label or len(held[1]) == block):
                    yield emit(*held)
                    held = None
                if held is None:
                    held = (label, [], [])
                held[1].append(i)
                held[2].append(c)
        if held:
            yield emit(*held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.mapInArrow(place, "id long, label long, c binary, place long").repartitionByRange(n, "label", "place", "id")
            .sortWithinPartitions("label", "place", "id").mapInArrow(cut, BLOCKS))


ANCHOR_NAMES = ("ids", "c", "lo", "hi", "low", "high", "scores")
ANCHOR_FIELDS = "anchors long, label long, " + ", ".join(f"{n} binary" for n in ANCHOR_NAMES)
ANCHOR_SCHEMA = pa.schema([("anchors", pa.int64()), ("label", pa.int64()), *((n, pa.binary()) for n in ANCHOR_NAMES)])


def _anchor_row(number: int, label: int, ids: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """A block of anchors: their ids, vectors and zone map, the span of each one's windows and the scores of its positives."""
    cells = [ids, c, c.min(axis=0), c.max(axis=0), low.astype(np.float64), high.astype(np.float64), scores.astype(np.float64)]
    return pa.record_batch([[number], [label], *([x.tobytes()] for x in cells)], schema=ANCHOR_SCHEMA)


def anchor_blocks(blocks: DataFrame, dim: int, modulus: int, positives: int, size: int = ANCHOR_BLOCK) -> DataFrame:
    """The rows whose id is divisible by ``modulus`` in blocks of one label; an anchor's span goes from the floor that its own
    candidate block gives to its best ``positives`` scores, without a top."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, held_label = TaskContext.get().partitionId() << 32, [], None

        def emit() -> pa.RecordBatch:
            nonlocal number, held
            number += 1
            ids, c, low = (np.concatenate(x) for x in zip(*held))
            held = []
            return _anchor_row(number - 1, held_label, ids, c, low, np.full(len(ids), np.inf), np.zeros((len(ids), 1)))

        for b in it:
            for r in b.to_pylist():
                ids, c = np.frombuffer(r["ids"], dtype=np.int64), _rows(r["c"], dim)
                own = np.flatnonzero(ids % modulus == 0)
                for at in range(0, len(own), size):
                    part = own[at:at + size]
                    if held and (held_label != r["label"] or sum(len(h[0]) for h in held) + len(part) > size):
                        yield emit()
                    held_label = r["label"]
                    s = products(c[part], c)
                    s[ids[None, :] == ids[part][:, None]] = -np.inf
                    floor = np.sort(s, axis=1)[:, -positives] if s.shape[1] >= positives else np.full(len(part), -np.inf)
                    held.append((ids[part], c[part], floor))
        if held:
            yield emit()

    return blocks.select("label", "ids", "c").mapInArrow(run, ANCHOR_FIELDS)


def window_blocks(anchors: DataFrame, chosen: DataFrame, dim: int, share: tuple[int, int], positives: int) -> DataFrame:
    """The anchor blocks again, of the anchors that have a window: the span of all windows and the scores of the positives
    (NaN: no such positive, or one below zero, whose window is empty)."""
    schema = pa.schema([("anchors", pa.int64()), ("label", pa.int64()), ("id", pa.int64()), ("c", pa.binary())])

    def single(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], dtype=np.int64)
                yield pa.record_batch([pa.array(np.full(len(ids), r["anchors"])), pa.array(np.full(len(ids), r["label"])), pa.array(ids),
                                       pa.array([v.tobytes() for v in _rows(r["c"], dim)], type=pa.binary())], schema=schema)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        scores = np.full((t.num_rows, positives), np.nan)
        for i, p in enumerate(t["p"].to_pylist()):
            for x in p:
                scores[i, x["place"] - 1] = x["positive_score"]
        low, high = np.nanmin(scores, axis=1) * share[0] / share[1], np.nanmax(scores, axis=1)
        return pa.Table.from_batches([_anchor_row(t["anchors"][0].as_py(), t["label"][0].as_py(), t["id"].to_numpy(),
                                                  _rows(b"".join(t["c"].to_pylist()), dim), low, high, scores)])

    own = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("place", "positive_score")).alias("p"))  # ``positives`` at most
    rows = anchors.select("anchors", "label", "ids", "c").mapInArrow(single, "anchors long, label long, id long, c binary")
    return rows.join(own, F.col("id") == F.col("anchor_id")).select("anchors", "label", "id", "c", "p").groupBy("anchors").applyInArrow(pack, ANCHOR_FIELDS)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as doubles, in which whole numbers below 2^53 are exact."""
    if a.size and b.size and float(np.abs(a.astype(np.int64)).max()) * float(np.abs(b.astype(np.int64)).max()) * a.shape[1] >= 2.0 ** 53:
        raise ValueError("scores beyond 2^53 are not exact")
    return a.astype(np.float64) @ b.astype(np.float64).T


# ---- which blocks to read -----------------------------------------------------------------------

def block_pairs(anchors: DataFrame, blocks: DataFrame, dim: int, same_label: bool, page: int = PAGE) -> DataFrame:
    """``(anchors, block)``: the pairs whose bounds reach the windows of the anchor block."""
    zones = blocks.select("block", "label", "lo", "hi")
    pages = max(1, -(-zones.count() // page))
    paged = zones.withColumn("page", F.pmod(F.xxhash64("block"), F.lit(pages)).cast("int")).groupBy("page").agg(
        F.collect_list(F.struct("block", "label", "lo", "hi")).alias("zones"))
    schema = pa.schema([("anchors", pa.int64()), ("block", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                z = r["zones"]
                number = np.array([x["block"] for x in z])
                lo, hi = (_rows(b"".join(x[k] for x in z), dim).astype(np.float64) for k in ("lo", "hi"))
                low, high = (np.frombuffer(r[k], dtype=np.float64) for k in ("low", "high"))
                least, most = bounds(*(_rows(r[k], dim).astype(np.float64) for k in ("a_lo", "a_hi")), lo, hi)
                reach = (np.array([x["label"] for x in z]) == r["label"]) == same_label
                reach &= (most[0] >= low.min()) & (least[0] <= high.max())
                found = number[reach]
                if len(found):
                    yield from batches_of({"anchors": np.full(len(found), r["anchors"]), "block": found}, schema)

    maps = anchors.select("anchors", "label", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "low", "high",
                          F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))
    return maps.join(paged, "page").select("anchors", "label", "a_lo", "a_hi", "low", "high", "zones").mapInArrow(run, "anchors long, block long")


def scan(anchors: DataFrame, blocks: DataFrame, pairs: DataFrame, dim: int, best: Callable, arrow: pa.Schema, keys: int, most: int) -> DataFrame:
    """What ``best(anchors' columns, candidate ids, scores)`` finds in the pairs that are read: columns of longs, first ``keys`` that
    name a window, then the candidate's id and score.  A task keeps the first ``most`` of a window by score and id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            t = pa.concat_tables(held)
            cols = [c.to_numpy() for c in t.columns]
            by = np.lexsort([cols[keys], -cols[keys + 1], *cols[:keys]])
            new = np.ones(len(by), dtype=bool)
            new[1:] = np.any([c[by][1:] != c[by][:-1] for c in cols[:keys]], axis=0)
            start = np.flatnonzero(new)
            rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
            return t.take(pa.array(by[rank < most]))

        for b in it:
            for r in b.to_pylist():
                a = {k: np.frombuffer(r["a"][k], dtype=np.int64 if k == "ids" else np.float64) for k in ("ids", "low", "high")}
                a["scores"] = np.frombuffer(r["a"]["scores"], dtype=np.float64).reshape(len(a["ids"]), -1)
                c = _rows(r["a"]["c"], dim)
                least, greatest = bounds(c.astype(np.float64), c.astype(np.float64), *(_rows(r[k], dim).astype(np.float64) for k in ("lo", "hi")))
                reach = np.flatnonzero((greatest[:, 0] >= a["low"]) & (least[:, 0] <= a["high"]))
                if len(reach):
                    held.append(pa.table(best({k: v[reach] for k, v in a.items()}, np.frombuffer(r["ids"], dtype=np.int64), products(c[reach], _rows(r["c"], dim))), schema=arrow))
                    rows += held[-1].num_rows
                if rows > HELD_ROWS:
                    held = [merged()]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:  # many windows: the final ranking merges them
                        yield from held[0].to_batches(max_chunksize=65536)
                        held, rows = [], 0
        if rows:
            yield from merged().to_batches(max_chunksize=65536)

    a = anchors.select("anchors", F.struct("ids", "c", "low", "high", "scores").alias("a"))
    return (pairs.join(a, "anchors").join(blocks.select("block", "ids", "c", "lo", "hi"), "block")
            .select("a", "ids", "c", "lo", "hi").mapInArrow(run, ", ".join(f"{f.name} long" for f in arrow)))


def first_rows(s: np.ndarray, ids: np.ndarray, ok: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` first entries of each row among those that are ``ok``, by score and smaller id."""
    v = np.where(ok, s, -np.inf)
    if v.shape[1] > most:  # all that reach the last place, ties included
        last = np.partition(v, v.shape[1] - most, axis=1)[:, v.shape[1] - most]
        ok = ok & (v >= last[:, None])
    row, col = np.nonzero(ok)
    by = np.lexsort([ids[col], -s[row, col], row])
    row, col = row[by], col[by]
    start = np.searchsorted(row, row)
    first = np.arange(len(row)) - start < most
    return row[first], col[first]


# ---- mining -------------------------------------------------------------------------------------

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_hard_negatives(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: int = SCALE,
                        anchors: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE,
                        block: int = BLOCK, counts: dict | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows whose id is divisible by ``anchors``.

    An anchor's positives are its first ``positives`` other rows of one label; a positive's negatives the first ``negatives`` rows
    of other labels with ``share[0] * positive <= share[1] * score <= share[1] * positive``; first is the higher score, then the
    smaller id.  Rows with a null id, label or vector, an empty vector, a component that is null or not finite, or another
    length than most take no part.  An id that several rows have counts once, with its smallest label, then
    its least vector.  An empty table, one without anchors or with one label gives no rows.  ``counts``, if given, gets
    the numbers of block pairs and of those read.
    """
    spark = df.sparkSession
    dim = dimension(df, vec_col)
    if not dim:
        return spark.createDataFrame([], MINED)
    rows = materialize(whole_rows(df, id_col, vec_col, F.col(label) if isinstance(label, str) else label, dim, scale))
    if not rows.head(1):
        return spark.createDataFrame([], MINED)
    blocks = materialize(candidate_blocks(rows, dim, block))
    first = materialize(anchor_blocks(blocks, dim, anchors, positives))
    near = materialize(block_pairs(first, blocks, dim, True))

    def best_positives(a: dict, ids: np.ndarray, s: np.ndarray) -> dict:
        row, col = first_rows(s, ids, ids[None, :] != a["ids"][:, None], positives)
        return {"anchor_id": a["ids"][row], "positive_id": ids[col], "positive_score": s[row, col].astype(np.int64)}

    arrow = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score")])
    found = scan(first, blocks, near, dim, best_positives, arrow, 1, positives)
    w = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = materialize(found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives))

    second = materialize(window_blocks(first, chosen, dim, share, positives))
    far = materialize(block_pairs(second, blocks, dim, False))
    if counts is not None:
        n = [x.count() for x in (first, blocks, near, far)]
        counts.update(pairs=n[0] * n[1], positives=n[2], negatives=n[3])

    def best_negatives(a: dict, ids: np.ndarray, s: np.ndarray) -> dict:
        out = []
        for k in range(positives):
            p = a["scores"][:, k][:, None]
            row, col = first_rows(s, ids, (share[0] * p <= share[1] * s) & (s <= p), negatives)
            out.append((a["ids"][row], np.full(len(row), k + 1), ids[col], s[row, col].astype(np.int64)))
        return dict(zip(("anchor_id", "place", "negative_id", "negative_score"), (np.concatenate(x) for x in zip(*out))))

    arrow = pa.schema([(n, pa.int64()) for n in ("anchor_id", "place", "negative_id", "negative_score")])
    found = scan(second, blocks, far, dim, best_negatives, arrow, 2, negatives)
    w = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return (ranked.join(chosen, ["anchor_id", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``embeddings``; labels of ids divisible by 7 are moved up by one modulo 10 first.

    Rows with a null id, label or vector, or a component that is null or not finite take no part; ties go to the smaller
    id; a repeated id counts once; an empty table gives no rows; other columns are not read.
    """
    label = F.col("label")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_hard_negatives(read(spark, sf_dir, "embeddings"), label=moved)
