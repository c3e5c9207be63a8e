"""Operator 10: SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The binary Golay code of length
23 is perfect: every word lies within 3 errors of exactly one codeword.  A segment is decoded to
that codeword's 12-bit index (its centre) and to the codewords that the words one bit away decode
to: one or six indices (its keys).  If two segments differ in at most one bit, the centre of either
is among the keys of the other.

Pigeonhole: two fingerprints at distance 3 or less have a pair of segments with at most one error
in each (leave out the segment with the most errors).  So for each of the three segment pairs
(i, j) every fingerprint emits left rows (key of i, centre of j) and right rows (centre of i, key
of j), about 32 rows in all, and every link is met as a left and a right row under one 24-bit key.
Candidates are verified on the whole 64 bits.

Exact copies meet first: keys are built from distinct fingerprints.  A key with many rows is cut
into blocks of bounded size whose left and right parts are paired block by block; a block emits at
most a spanning forest of its links, never all its pairs, which keeps every component whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import batches_of, materialize, read, to_hex64, unused
from relq.llm.components import components

SEGMENTS = ((0, 23), (23, 23), (46, 18))  # (first bit, bits)
SEGMENT_PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator polynomial of the code
MAX_DISTANCE = 3  # what three segments and one error a segment can promise
BLOCK = 4096  # rows of a side that one task pairs at once


# ---- fingerprints -------------------------------------------------------------------------------

def simhash(text: bytes | None, shingle: int = 3, seed: int = 42, step: int = 1 << 16) -> int:
    """Majority bits of the XXH64 of all word shingles (repeats included) of one text, unsigned."""
    words = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, step):  # a very long text is counted in steps
        part = np.array([h(joined[a:b - 1], seed) for a, b in
                         zip(starts[at:min(at + step, n)], ends[at + k - 1:at + k - 1 + step])], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, k1, k2, fp)``: two hashes of the text (null like empty) and the signed 64-bit fingerprint of every row; null
    and blank texts have 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([simhash(t.as_py(), shingle) for t in b.column(3)], dtype=np.uint64)
            yield pa.record_batch([*b.columns[:3], pa.array(fp.view(np.int64))], schema=schema)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_keys(text_col), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, k1 long, k2 long, fp long"))


def text_keys(text_col: str) -> tuple[Column, Column]:
    t = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2")


# ---- the code -----------------------------------------------------------------------------------

def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=None)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits; the error pattern of every remainder."""
    low = np.array([_remainder(x) for x in range(1 << 12)], dtype=np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], dtype=np.int64)
    leader = np.full(1 << 11, -1, dtype=np.int64)
    bits = [1 << i for i in range(23)]
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i]),
                *(a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    for e in patterns:
        leader[_remainder(e)] = e
    assert (leader >= 0).all()  # perfect code: 2048 patterns, 2048 remainders
    return low, high, leader


@lru_cache(maxsize=None)
def _near(bits: int) -> np.ndarray:
    """For each remainder, the error patterns to the codewords that the word and its neighbours in
    ``bits`` positions decode to; rows are padded with the first pattern."""
    _, _, leader = _tables()
    rows = []
    for s in range(1 << 11):
        found = [int(leader[s])]
        for i in range(bits):
            e = (1 << i) ^ int(leader[s ^ _remainder(1 << i)])
            if e not in found:
                found.append(e)
        rows.append(found)
    width = max(map(len, rows))
    return np.array([r + r[:1] * (width - len(r)) for r in rows], dtype=np.int64)


def segment_codes(words: np.ndarray, bits: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(centre, keys) of 23-bit words: 12-bit codeword indices, keys as a padded 2-d array."""
    low, high, leader = _tables()
    words = words.astype(np.int64)
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words ^ leader[s]) >> 11, (words[:, None] ^ _near(bits)[s]) >> 11


def emit_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, fp) rows of distinct fingerprints; side 0 is left, 1 is right."""
    u = fp.view(np.uint64)
    codes = [segment_codes((u >> np.uint64(a)) & np.uint64((1 << n) - 1), n) for a, n in SEGMENTS]
    out = []
    for p, (i, j) in enumerate(SEGMENT_PAIRS):
        (ci, ki), (cj, kj) = codes[i], codes[j]
        for side, k in ((0, ki << 12 | cj[:, None]), (1, ci[:, None] << 12 | kj)):
            fresh = np.ones(k.shape, dtype=bool)
            fresh[:, 1:] = k[:, 1:] != k[:, :1]  # padding repeats the first
            rows, _ = np.nonzero(fresh)
            out.append((k[fresh] | p << 24, np.full(len(rows), side, dtype=np.int8), fp[rows]))
    return tuple(np.concatenate(x) for x in zip(*out))


# ---- links --------------------------------------------------------------------------------------

def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges with the components of the edges (a, b): one edge a node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        m = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, m)
        np.minimum.at(new, y, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(run: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int,
           chunk: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links among rows sorted by (run, side): forests over chunks of left-right pairs."""
    first_right = np.flatnonzero(side == 1)
    right_run, start, count = np.unique(run[first_right], return_index=True, return_counts=True)
    left = np.flatnonzero(side == 0)
    pos = np.searchsorted(right_run, run[left])
    ok = pos < len(right_run)
    ok[ok] = right_run[pos[ok]] == run[left[ok]]
    left, pos = left[ok], pos[ok]
    n = count[pos]
    cut = 0
    total = np.cumsum(n)
    while cut < len(left):
        base = total[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(total, base + chunk, side="right")))
        m = n[cut:stop]
        l_at = np.repeat(left[cut:stop], m)
        offset = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        r_at = first_right[np.repeat(start[pos[cut:stop]], m) + offset]
        x, y = fp[l_at], fp[r_at]
        hit = (x != y) & (np.bitwise_count((x ^ y).view(np.uint64)) <= distance)
        if hit.any():
            yield _forest(x[hit], y[hit])
        cut = stop


def near_links(fps: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` at ``distance`` bits or fewer.

    Not all links are returned: within each block a spanning forest of them is, so the connected
    components are those of all links.
    """
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance must be 0 to {MAX_DISTANCE}")
    key_schema = pa.schema([("key", pa.int64()), ("side", pa.int8()), ("fp", pa.int64())])

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                key, side, fp = emit_keys(b.column(0).to_numpy())
                yield from batches_of({"key": key, "side": side, "fp": fp}, key_schema)

    rows = fps.select("fp").mapInArrow(keys, "key long, side byte, fp long")
    left = F.col("side") == 0
    # keys with more rows than a block (one in ``block`` rows at most); written, so that their real size is
    # known when the join is planned
    hot = materialize(rows.groupBy("key").agg(F.count_if(left).alias("nl"), F.count_if(~left).alias("nr"))
                      .where(F.greatest("nl", "nr") > block)
                      .select(F.col("key").alias("k"), F.ceil(F.col("nl") / block).alias("bl"),
                              F.ceil(F.col("nr") / block).alias("br")))
    # one block for most keys; of a hot key, every left block meets every right block
    bl, br = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("bl", "br"))
    own = F.pmod(F.xxhash64("fp"), F.when(left, bl).otherwise(br)).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.when(left, br).otherwise(bl) - 1).cast("int")))
    blocks = (rows.join(hot, F.col("key") == F.col("k"), "left")
              .select("key", "side", "fp", own.alias("own"), other.alias("other"))
              .select("key", F.when(left, F.col("own")).otherwise(F.col("other")).alias("i"),
                      F.when(left, F.col("other")).otherwise(F.col("own")).alias("j"), "side", "fp")
              .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side"))
    link_schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def pairs(cols: list[np.ndarray], run: np.ndarray) -> Iterator[pa.RecordBatch]:
            for u, v in _links(run, cols[3], cols[4], distance):
                yield from batches_of({"u": u, "v": v}, link_schema)

        for b in it:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.zeros(len(cols[0]), dtype=bool)
            for c in cols[:3]:
                new[1:] |= c[1:] != c[:-1]
            run = np.cumsum(new)
            last = int(np.searchsorted(run, run[-1]))  # the last block may go on in the next batch
            if last:
                yield from pairs([c[:last] for c in cols], run[:last])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from pairs(held, np.zeros(len(held[0]), dtype=np.int64))

    return blocks.mapInArrow(link, "u long, v long")


def _rooted(fps: DataFrame, distance: int, max_rounds: int) -> DataFrame:
    """``(fp, first_id, root)`` of each distinct fingerprint: its smallest id and the component's smallest fingerprint."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(distinct, distance), max_rounds)
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       distance: int = 3, max_rounds: int = 60) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: the smallest id reachable over links of
    ``distance`` bits or fewer, the row's own included.

    Null and blank texts have fingerprint 0 and link like any other.  Rows that repeat an id each
    get a row.  A null id never names a component; a component of null ids alone has null.
    """
    # written once: fingerprints are read for the keys and again for the result
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    rooted = _rooted(fps, distance, max_rounds)
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    return fps.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         distance: int = 3, max_rounds: int = 60) -> DataFrame:
    """``docs`` with one row of each component, all columns kept.

    It is the row with the smallest id (a null id comes last); of rows that repeat that id, the one whose text has the smallest
    hash, and of rows alike in both any one.  Rows that repeat an id with unrelated texts are in components of their own, and so
    each has its survivor.  Null and blank texts are copies of one another.  An empty table stays empty.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("s")
    kept = fps.join(_rooted(fps, distance, max_rounds).select("fp", "root"), "fp").groupBy("root").agg(first)
    own = unused(docs, "id", "k1", "k2")
    theirs = unused(docs, *(f"{c}_kept" for c in own))
    named = docs.select("*", *(c.alias(n) for n, c in zip(own, (F.col(id_col).cast("long"), *text_keys(text_col)))))
    keys = kept.select(*(F.col(f"s.{c}").alias(n) for n, c in zip(theirs, ("doc_id", "k1", "k2"))))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, theirs)]
    return named.join(keys, same[0] & same[1] & same[2], "left_semi").dropDuplicates(own).drop(*own)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, 3-word shingles, links at 3 bits or fewer.

    Null and blank texts have fingerprint zero and link like any other; long texts are read whole; repeated rows and ids each have
    a row; a null id never names a component, and one of null ids alone has a null name; an empty table gives no rows;
    columns beyond ``doc_id`` and ``text`` are not read.
    """
    out = simhash_components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", to_hex64(F.col("fp")).alias("fingerprint"), "component_id")
