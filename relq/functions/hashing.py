"""Deterministic pseudo-random picks as column expressions (H1, H2).

The sample format draws its query, instruction and negative label at random.
Here every draw is a pure function of ``(seed, key, purpose)``: the same on every
partitioning, every rerun after a lost executor, and in DuckDB (md5 + hex).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def hash_hex(seed: int, *parts) -> Column:
    """md5 hex of ``seed|part1|part2...``; parts are columns or literals."""
    return F.md5(F.concat_ws("|", _s(seed), *[_s(p) for p in parts]))


def hash_u32(seed: int, *parts) -> Column:
    """The first 32 bits of :func:`hash_hex` as a non-negative bigint."""
    return F.conv(F.substring(hash_hex(seed, *parts), 1, 8), 16, 10).cast("bigint")


def hash_words(seed: int, words: pa.Array, purpose: str) -> np.ndarray:
    """:func:`hash_u32` of (seed, word, purpose) for the words of an Arrow array, inside a task."""
    head, tail = f"{seed}|".encode(), f"|{purpose}".encode()
    drawn = b"".join(hashlib.md5(head + w + tail, usedforsecurity=False).digest()[:4] for w in words.cast(pa.binary()).to_pylist())
    return np.frombuffer(drawn, dtype=">u4").astype(np.int64)


def pick(seed: int, key, purpose: str, n: int) -> Column:
    """0-based uniform index into a list of ``n`` items (H1)."""
    return hash_u32(seed, key, purpose) % F.lit(n)


def sample_without_replacement(candidates: Column, k: int, seed: int, key, purpose: str) -> Column:
    """k elements of an int array, drawn without replacement (H2).

    Candidates are ordered by ``(md5(seed|key|purpose|c), c)`` and the first k kept,
    which is a uniform random k-subset in a uniformly random order.
    """
    keyed = F.transform(candidates, lambda c: F.struct(hash_hex(seed, key, purpose, c).alias("h"), c.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["v"])
