"""Summary similarity (H16): the Ratcliff-Obershelp ratio ``2M/T`` of two strings.

M counts the characters of the longest common run, of the longest ones left and right of it, and so on.  Argument order matters
(generated, gold): of equally long runs the first in ``generated`` counts, then the first in ``gold``; in a gold text of 200
characters or more, characters that make up more than about a hundredth of it start no run, but extend one.

The job scores distinct pairs once, whatever their number of rows, and joins the ratio back.  Inside a task many pairs are
compared at the same time: a round finds the longest run of every open pair of segments, one step a character of
``generated`` and all positions of ``gold`` at once, and leaves the segments beside it for the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_TEXT = 200  # gold texts from here on have common characters that start no run
CELLS = 1 << 21  # places that one round compares at once


def _codes(texts: list[str], filler: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points in rows of equal width, lengths)."""
    rows = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for t in texts]
    size = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.full((len(rows), int(size.max(initial=0)) + 1), filler, dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out, size


def _common(codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which places of long texts hold a character too common to start a run."""
    out = np.zeros(codes.shape, dtype=bool)
    for i in np.flatnonzero(size >= LONG_TEXT).tolist():
        kinds, at, count = np.unique(codes[i, :size[i]], return_inverse=True, return_counts=True)
        out[i, :size[i]] = (count > size[i] // 100 + 1)[at]
    return out


def _longest(a: np.ndarray, b: np.ndarray, starts: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest common run of each segment (pair, a from, a to, b from, b to): places in a and b, length."""
    pair, a_from, a_to, b_from, b_to = s.T
    wide = int((b_to - b_from).max())
    at = b_from[:, None] + np.arange(wide)
    inside = at < b_to[:, None]
    at = np.minimum(at, b.shape[1] - 1)
    gold = np.where(inside & starts[pair[:, None], at], b[pair[:, None], at], -3)
    run = np.zeros((len(s), wide + 1), dtype=np.int32)
    size, i_best, j_best = np.zeros(len(s), dtype=np.int64), a_from.copy(), b_from.copy()
    for i in range(int((a_to - a_from).max())):
        own = np.where(a_from + i < a_to, a[pair, np.minimum(a_from + i, a.shape[1] - 1)], -4)
        run[:, 1:] = np.where(gold == own[:, None], run[:, :-1] + 1, 0)
        j = run.argmax(axis=1)
        m = run[np.arange(len(s)), j].astype(np.int64)
        longer = m > size
        size = np.where(longer, m, size)
        i_best, j_best = np.where(longer, a_from + i - m + 1, i_best), np.where(longer, b_from + j - m, j_best)
    while True:  # common characters before the run
        grow = (i_best > a_from) & (j_best > b_from)
        grow &= a[pair, np.maximum(i_best - 1, 0)] == b[pair, np.maximum(j_best - 1, 0)]
        if not grow.any():
            break
        i_best, j_best, size = i_best - grow, j_best - grow, size + grow
    while True:  # and behind it
        i, j = i_best + size, j_best + size
        grow = (i < a_to) & (j < b_to)
        grow &= a[pair, np.minimum(i, a.shape[1] - 1)] == b[pair, np.minimum(j, b.shape[1] - 1)]
        if not grow.any():
            return i_best, j_best, size
        size = size + grow


def ratios(generated: list[str], gold: list[str]) -> np.ndarray:
    """The ratio of each pair of strings; two empty ones are alike."""
    a, a_size = _codes(generated, -1)
    b, b_size = _codes(gold, -2)
    starts = ~_common(b, b_size)
    matched = np.zeros(len(generated), dtype=np.int64)
    zero = np.zeros(len(generated), dtype=np.int64)
    todo = np.column_stack([np.arange(len(generated)), zero, a_size, zero, b_size])
    while True:
        todo = todo[(todo[:, 1] < todo[:, 2]) & (todo[:, 3] < todo[:, 4])]
        if not len(todo):
            break
        todo = todo[np.argsort(todo[:, 4] - todo[:, 3], kind="stable")]  # segments of like width together
        step = max(1, CELLS // (int((todo[:, 4] - todo[:, 3]).max()) + 1))
        left = []
        for k in range(0, len(todo), step):
            s = todo[k:k + step]
            i, j, n = _longest(a, b, starts, s)
            np.add.at(matched, s[:, 0], n)
            s, i, j, n = s[n > 0], i[n > 0], j[n > 0], n[n > 0]
            left += [np.column_stack([s[:, 0], s[:, 1], i, s[:, 3], j]), np.column_stack([s[:, 0], i + n, s[:, 2], j + n, s[:, 4]])]
        todo = np.concatenate(left)
    total = a_size + b_size
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


def ratio(a: str, b: str) -> float:
    return float(ratios([a], [b])[0])


def pair_similarity(pairs: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` of distinct, non-null string pairs ``(a, b)``."""
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("similarity", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, 512):
                part = big.slice(at, 512)
                yield pa.record_batch([*part.columns, pa.array(ratios(part.column(0).to_pylist(), part.column(1).to_pylist()))], schema=schema)

    return pairs.select("a", "b").mapInArrow(run, "a string, b string, similarity double")


def with_similarity(df: DataFrame, generated: str, gold: str, out: str = "similarity") -> DataFrame:
    """``df`` with the ratio of two string columns, null where either is null.  ``df`` is read twice: pass a written table."""
    pairs = df.select(F.col(generated).alias("a"), F.col(gold).alias("b")).where("a is not null and b is not null").distinct()
    scored = pair_similarity(pairs).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("similarity").alias(out))
    return df.join(scored, (F.col(generated) == F.col("_a")) & (F.col(gold) == F.col("_b")), "left").drop("_a", "_b")
