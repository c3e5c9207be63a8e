"""Operator 12: whitening against numpy's eigenvectors, exact sums, odd rows."""

import math

import numpy as np
import pytest

from relq.llm.whitening import Centred, bidiagonalise, op12_whitening, whiten, whole_blocks

SF = "/root/testdata/sf0.001"


def brute(rows):
    keep = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in keep], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = [sum(int(n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    z = np.array([[float(n * a - b) / n for a, b in zip(r, s)] for r in x])
    e, v = np.linalg.eigh(z.T @ z / n)
    return keep, n, dev, z, e[::-1], v[:, ::-1]


def check(out, rows, k):
    keep, n, dev, z, e, v = brute(rows)
    got = out.toPandas()
    assert len(got) == k * n and set(got.component) == set(range(1, k + 1)) and (got.n == n).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    for c in range(k):
        part = got[got.component == c + 1].set_index("vec_id")
        want = z @ v[:, c] / np.sqrt(e[c])
        have = part.loc[[i for i, _ in keep], "whitened"].to_numpy()
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert np.allclose(part.explained, e[c] / e.sum(), rtol=1e-10)
        assert part.loc[[i for i, _ in keep], "deviation"].tolist() == dev


def test_registered_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(op12_whitening(spark, SF), rows, 32)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<double>, component string, n int").repartition(3)
    check(whiten(df), rows, 5)


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(4)
    v = [[float(a) for a in rng.normal(size=3)] for _ in range(20)]
    df = spark.createDataFrame([(None, x) for x in v[:10]] + [(7, x) for x in v[10:]] + [(7, v[0])], "vec_id long, embedding array<float>")
    out = whiten(df, components=2).toPandas()
    assert len(out) == 42 and out.vec_id.isna().sum() == 20 and (out.n == 21).all()


def test_too_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 9, schema)).count() == 0


def test_exhausted_space(spark):
    """Repeated singular values and a direction without deviation: every other direction is found."""
    corners = [(4 * i + j, [float(s if k == i else 0) for k in range(4)] + [5.0]) for i in range(4) for j, s in enumerate((-1, 1))]
    df = spark.createDataFrame(corners, "vec_id long, embedding array<double>")
    s, v = bidiagonalise(Centred(whole_blocks(df, "vec_id", "embedding", 5), 5), 5)
    assert np.allclose(s, [64 * math.sqrt(2)] * 4 + [0], atol=1e-9)
    assert np.allclose(v.T @ v, np.eye(5), atol=1e-12)
    assert set(r.component for r in whiten(df).select("component").distinct().collect()) == {1, 2, 3, 4}


def test_long_vectors_settle_early(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 24)) @ np.diag(0.5 ** np.arange(24) * 1000)
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    a = Centred(whole_blocks(df, "vec_id", "embedding", 24), 24)
    s, v = bidiagonalise(a, 3, full=8)
    assert v.shape[1] < 24
    y = np.floor(x * 64)
    want = np.linalg.svd(y - y.mean(axis=0), compute_uv=False)
    assert np.allclose(s[:3], want[:3], rtol=1e-12)


def test_too_large_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component times 64"):
        whiten(df).count()
