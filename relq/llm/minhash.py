"""Operator 4: document fingerprints by one-permutation MinHash with optimal densification.

Every word shingle is hashed once; the top bits choose a bin and each bin keeps its smallest hash.  An
empty bin copies the bin that a hash of (bin, attempt) points to, for the first attempt that points to
a filled one, so equal sets fill equally and the copies of different bins are independent.  Of each
bin the low bits are kept, packed as hex.  Two bins of different shingles agree by chance in one of
2^bits cases; the estimate of the likeness is corrected for that.

The edited text of the registered query needs the next document.  Documents are dealt once, by ranges of
their ids, with the first document of each range added to the range before it, so one sort and one
streaming pass a range see every neighbour; no window over all rows, no second shuffle of the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relq.llm.common import read

SHINGLE = 5
BINS = 512  # a power of two
BITS = 4  # low bits kept of each bin; two bins a byte

_M64 = (1 << 64) - 1


@lru_cache(maxsize=None)
def _attempts(bins: int, start: int, count: int = 64) -> np.ndarray:
    """Targets of ``count`` attempts from ``start`` on, for every bin: (bin, attempt) mixed by splitmix64."""
    x = (np.arange(bins, dtype=np.uint64)[:, None] << np.uint64(32)) | np.arange(start, start + count, dtype=np.uint64)
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(bins)).astype(np.int64)


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Every empty bin gets the value of the first filled bin that its attempts point to."""
    out = values.copy()
    todo = np.flatnonzero(~filled)
    start = 0
    while len(todo):
        target = _attempts(len(values), start)[todo]
        ok = filled[target]
        found = ok.any(axis=1)
        out[todo[found]] = values[target[found, ok[found].argmax(axis=1)]]
        todo = todo[~found]
        start += 64
    return out


def shingle_hashes(text: bytes, shingle: int = SHINGLE, step: int = 1 << 18) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles (A-Z lower-cased, ASCII white space), in parts; all words if fewer; none for none."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    k = min(shingle, len(words))
    n = len(words) - k + 1
    h = xxhash.xxh64_intdigest
    for at in range(0, n, step):
        yield np.array([h(joined[a:b - 1]) for a, b in zip(starts[at:min(at + step, n)], ends[at + k - 1:at + k - 1 + step])], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> str:
    """Packed low bits of the densified bins as hex; the empty string for a text without words."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    low = np.full(bins, _M64, dtype=np.uint64)
    filled = np.zeros(bins, dtype=bool)
    for h in shingle_hashes((text or "").encode(), shingle):
        h = np.sort(h)
        at = (h >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        low[at[first]] = np.minimum(low[at[first]], h[first])
        filled[at[first]] = True
    if not filled.any():
        return ""
    code = (densify(low, filled) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(((code[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).ravel()).tobytes().hex()


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1; two empty ones are alike, one is not like any other."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(bytes.fromhex(a), dtype=np.uint8) ^ np.frombuffer(bytes.fromhex(b), dtype=np.uint8)
    groups = np.unpackbits(x).reshape(-1, bits)
    match = 1 - groups.any(axis=1).mean()
    chance = 2.0 ** -bits
    return float(min(1.0, max(0.0, (match - chance) / (1 - chance))))


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text_col`` added; null and wordless texts have the empty string."""
    @F.pandas_udf("string")
    def fp(s: pd.Series) -> pd.Series:
        return s.map(fingerprint, na_action=None)
    return docs.withColumn(out, fp(F.col(text_col)))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``following`` (or all)."""
    m = len(text) // 4
    return text[:len(text) - m] + following[:m]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document, and their likenesses.

    "Next" is by ascending id (null first), then text; after the last comes the first.  Null texts are empty.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    # ids that begin a range, the smallest of all among them: one long a range reaches the driver
    edges = np.array(sorted({r[1] for r in docs.select(key.alias("k")).repartitionByRange(ranges, "k")
                             .groupBy(F.spark_partition_id()).agg(F.min("k")).collect()}), dtype=np.int64)

    @F.pandas_udf("array<long>")
    def places(k: pd.Series) -> pd.Series:
        """The range of an id; for the first id of a range also the range before it, as -1 - range."""
        at = np.searchsorted(edges, k.to_numpy(), side="right") - 1
        first = edges[at] == k.to_numpy()
        return pd.Series([[a, -1 - (a - 1) % len(edges)] if f else [a] for a, f in zip(at.tolist(), first)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # (range, id, text, fingerprint) of the row that waits for its successor
        for b in it:
            out = []
            for place, ahead, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if last is not None and last[0] != place:
                    last = None  # its successor came as the range's last row
                if ahead and last is None:
                    continue  # one successor is enough
                own = fingerprint(text)
                if last is not None:
                    changed = edited(last[2], text)
                    fp = fingerprint(changed)
                    out.append((last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), last[3], fp,
                                likeness(last[3], fp), likeness(last[3], own)))
                last = None if ahead else (place, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) if i < 2 else pa.array(c) for i, c in enumerate(zip(*out))],
                                                 [f.split()[0] for f in OUT.split(", ")])

    place = F.col("place")
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .select("doc_id", "k", "text", F.explode(places("k")).alias("place"))
             .select(F.when(place < 0, -1 - place).otherwise(place).alias("range"), (place < 0).alias("ahead"), "doc_id", "k", "text"))
    # the added rows sort behind the range's own
    return (dealt.repartition("range").sortWithinPartitions("range", "ahead", "k", "text").select("range", "ahead", "doc_id", "text")
            .mapInArrow(run, OUT))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, each with its successor by id.

    Null texts are empty, wordless ones have the empty fingerprint; long texts are read whole; a null id comes first, and of
    repeated ids the smaller text; a single row follows itself; an empty table gives no rows; columns beyond ``doc_id`` and ``text`` are not read.
    """
    return neighbour_fingerprints(read(spark, sf_dir, "documents"))
