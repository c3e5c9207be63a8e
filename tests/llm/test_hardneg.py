"""Operator 13: against brute force, the curve, bounds that hold, blocks that are skipped, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relq.llm.hardneg import bounds, first_rows, hilbert_index, mine_hard_negatives, op13_hard_negatives

SF = "/root/testdata/sf0.001"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=100, k=5):
    """``rows``: (id, label, vector) that take part, ids unique."""
    c = {i: (label, [math.floor(256 * float(x)) for x in v]) for i, label, v in rows}
    out = []
    for a, (label, va) in c.items():
        if a % every:
            continue
        score = sorted((-sum(x * y for x, y in zip(va, vb)), b) for b, (_, vb) in c.items() if b != a)
        for ps, p in [(-s, b) for s, b in score if c[b][0] == label][:k]:
            low = [(-s, b) for s, b in score if c[b][0] != label and 80 * ps <= -100 * s <= 100 * ps][:k]
            out += [(a, p, r, b, ps, s) for r, (s, b) in enumerate(low, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def test_registered_query(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows)
    assert want and rows_of(op13_hard_negatives(spark, SF)) == want


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        place = hilbert_index(cells, bits)
        assert sorted(place.tolist()) == list(range(1 << bits * d))
        step = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
        assert (step == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, size=(2, 40, 6))
    least, most = bounds(*(f(a, axis=0)[None, :].astype(float) for f in (np.min, np.max)), *(f(b, axis=0)[None, :].astype(float) for f in (np.min, np.max)))
    s = a @ b.T
    assert least[0, 0] <= s.min() and s.max() <= most[0, 0]
    point = a.astype(float)
    least, most = bounds(point, point, b.astype(float), b.astype(float))
    assert (least == s).all() and (most == s).all()


def test_first_rows_ties():
    s = np.array([[1.0, 3, 3, 3, 2], [5, 5, 5, 5, 5]])
    ids = np.array([9, 8, 7, 6, 5])
    row, col = first_rows(s, ids, np.ones(s.shape, dtype=bool), 2)
    assert ids[col].tolist() == [6, 7, 5, 6] and row.tolist() == [0, 0, 1, 1]


def clusters(n=1500, dim=12, seed=2):
    """Ten far clusters, labels mixed in each: most blocks cannot hold a window."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(10, dim)) * 3
    at = rng.integers(0, 10, size=n)
    x = centre[at] + rng.normal(size=(n, dim)) * 0.05
    return [(i, int(rng.integers(0, 3)), [float(v) for v in r]) for i, r in enumerate(x)]


SCHEMA = "vec_id long, label int, embedding array<double>"


def test_blocks_are_skipped(spark):
    rows, counts = clusters(), {}
    out = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(4), block=32, counts=counts)
    assert rows_of(out) == brute(rows)
    assert counts["positives"] + counts["negatives"] < 0.5 * counts["pairs"]


def test_partitions_do_not_matter(spark):
    rows = clusters(300, 3, 5)
    want = brute(rows, every=10)
    for n, block in ((1, 7), (9, 512)):
        assert rows_of(mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(n), anchors=10, block=block)) == want


def test_ties_and_hot_vector(spark):
    """A third of all rows are one vector; half of the scores tie."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [0.5, 0.5, 0.0] if i % 3 == 0 else [float(x) for x in rng.integers(-2, 3, 3) / 4]) for i in range(200)]
    assert rows_of(mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), anchors=10, block=16)) == brute(rows, every=10)


def test_odd_rows(spark):
    rows = clusters(200, 4, 7)
    odd = [(None, 1, [1.0] * 4), (1000, None, [1.0] * 4), (1100, 1, None), (1200, 1, []), (1300, 1, [1.0, None, 1.0, 1.0]),
           (1400, 1, [float("nan")] * 4), (1500, 1, [float("inf")] * 4), (1600, 1, [1.0, 2.0]), rows[0], (100, 99, [9.0] * 4)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows + odd], SCHEMA + ", block int, ids string, score int")
    assert rows_of(mine_hard_negatives(df)) == brute(rows)


def test_nothing_to_mine(spark):
    assert rows_of(mine_hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert rows_of(mine_hard_negatives(spark.createDataFrame([(100, None, [1.0])], SCHEMA))) == []
    assert rows_of(mine_hard_negatives(spark.createDataFrame([(101, 1, [1.0]), (102, 2, [1.0])], SCHEMA))) == []
    one = [(i, 1, [1.0, float(i)]) for i in range(100, 400, 50)]
    assert rows_of(mine_hard_negatives(spark.createDataFrame(one, SCHEMA))) == []
    below = [(100, 1, [1.0]), (101, 1, [-1.0]), (102, 2, [-1.0])]
    assert rows_of(mine_hard_negatives(spark.createDataFrame(below, SCHEMA))) == []


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="a component times 256"):
        mine_hard_negatives(spark.createDataFrame([(100, 1, [1e300]), (101, 1, [0.0])], SCHEMA)).count()


def test_label_as_a_column(spark):
    rows = clusters(200, 3, 8)
    out = mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), label=F.lit(0) + F.col("label"))
    assert rows_of(out) == brute(rows)
