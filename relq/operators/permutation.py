"""A full shuffle without a sort (F2): a keyed bijection on row positions.

A position x below n is written as (left, right) with left below a and right below b, where a is about the root of n and
a * b is n or little more.  Feistel rounds add a keyed hash of one half to the other, modulo that half's range, so a round can be
undone and the whole is a bijection on a * b places.  A place at or beyond n goes through the rounds again until it falls below n
(cycle walking), which keeps the map a bijection on the n positions.  Fewer than a places are beyond n, so a
position walks at all only with a probability of about 1 / a.

Where a row goes is a function of its own position, seed and n: no row is exchanged or compared with another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relq.functions.hashing import hash_u32
from relq.templates import DEFAULT_SEED

ROUNDS = 6
MOST_STEPS = 64  # walks of a position; one needs more with a probability of a to the power of -64


def halves(n: int) -> tuple[int, int]:
    """The ranges (a, b) of the two halves of a position below ``n``."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _round(i: int, a: int, b: int, seed: int):
    """Round ``i``: the right half moves by a hash of the left one, or the left by one of the right."""
    def moved(half: Column, other: Column, most: int) -> Column:
        return (half + hash_u32(seed, F.lit(i), other, "permute")) % most

    if i % 2:
        return lambda p: F.struct(p["l"].alias("l"), moved(p["r"], p["l"], b).alias("r"))
    return lambda p: F.struct(moved(p["l"], p["r"], a).alias("l"), p["r"].alias("r"))


def _rounds(x: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    pair = F.array(F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r")))
    for i in range(rounds):  # the pair stands in an array, so a round computes each half once
        pair = F.transform(pair, _round(i, a, b, seed))
    return F.get(F.transform(pair, lambda p: p["l"] * b + p["r"]), F.lit(0))


def permuted(position: Column, n: int, seed: int = DEFAULT_SEED, rounds: int = ROUNDS) -> Column:
    """The place of ``position`` (a long, 0 to n - 1) in a shuffle of ``n`` rows; null stays null, another position is an error."""
    a, b = halves(n)
    if a * b >= 1 << 53:
        raise ValueError("too many positions")
    once = _rounds(position, a, b, seed, rounds)
    steps = min(a * b - n, MOST_STEPS)
    if steps:
        once = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda x, _: F.when(x < n, x).otherwise(_rounds(x, a, b, seed, rounds)))
    outside = (position < 0) | (position >= n)
    return (F.when(outside, F.raise_error(F.lit(f"a position is not below {n}")).cast("long"))
            .when(position.isNotNull(), F.when(once < n, once).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))))


def permute(numbered: DataFrame, n: int, position: str = "pos", out: str = "shuffle_pos", seed: int = DEFAULT_SEED) -> DataFrame:
    """``numbered`` with the shuffled place of each row in place of its ``position``: one projection."""
    return numbered.withColumn(out, permuted(F.col(position).cast("long"), n, seed)).drop(position)
