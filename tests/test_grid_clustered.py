"""Top-k for query tables of any size, and the index whose blocks are skipped, against the plain scan."""

import math

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from relq.operators import retrieval as rt
from relq.operators.clustered import clustered_topk, read_summary, write_clustered_index
from relq.operators.grid import grid_topk
from relq.sources.tables import read_embeddings

VEC = "doc_id long, embedding array<double>"


def rows_of(hits):
    return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in hits.collect())


def brute(docs, queries, k, exclude=False):
    unit = lambda v: (np.array(v) / (np.linalg.norm(v) or 1))
    out = []
    for q, a in queries:
        scored = sorted((-round(float(unit(a) @ unit(b)), 9), d) for d, b in docs if not (exclude and d == q))
        out += [(q, r, d, -s + 0.0) for r, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out)


def tables(spark, n=240, dim=5, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in (rng.integers(-1, 2, dim) if ties else rng.normal(size=dim))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, VEC).repartition(5)


def test_grid_matches_the_scan_of_all_vectors(spark):
    emb = read_embeddings(spark, SF_SMALL)
    q = emb.withColumnRenamed("doc_id", "query_id")
    want = rows_of(rt.knn_topk(emb, q, k=3, digits=9))
    assert rows_of(grid_topk(emb, q, k=3, digits=9)) == want
    # small blocks and cells: many lines and columns; and the way that a large query table takes
    assert rows_of(grid_topk(emb, q, k=3, digits=9, block_bytes=4000, cell_bytes=30_000)) == want
    assert rows_of(rt.knn_topk(emb, q, k=3, digits=9, max_query_bytes=8)) == want


def test_grid_ties_and_self(spark):
    rows, df = tables(spark)
    q = df.withColumnRenamed("doc_id", "query_id")
    for kw in ({}, {"block_bytes": 200, "cell_bytes": 900}):
        assert rows_of(grid_topk(df, q, k=4, digits=9, **kw)) == brute(rows, rows, 4)
        assert rows_of(grid_topk(df, q, k=4, digits=9, exclude_self=True, **kw)) == brute(rows, rows, 4, True)


def test_grid_no_collect_no_broadcast(spark):
    rows, df = tables(spark, 40)
    plan = grid_topk(df, df.withColumnRenamed("doc_id", "query_id"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan and "Cartesian" not in plan


def test_grid_odd_tables(spark):
    rows, df = tables(spark, 6)
    q = df.withColumnRenamed("doc_id", "query_id")
    none = df.where("false")
    assert rows_of(grid_topk(none, q)) == [] and rows_of(grid_topk(df, none.withColumnRenamed("doc_id", "query_id"))) == []
    assert len(rows_of(grid_topk(df.limit(2), q, k=5))) == 12
    crowded = df.withColumns({n: F.lit(1) for n in ("block", "ids", "n", "line", "at", "score")})
    assert rows_of(grid_topk(crowded, q, k=2, digits=9)) == brute(rows, rows, 2)
    for bad in ([(1, None)], [(1, [1.0])]):
        with pytest.raises(Exception):
            grid_topk(df.unionByName(spark.createDataFrame(bad, VEC)), q).collect()


def test_cell_scores_few_pairs_in_double_precision(monkeypatch):
    """The best of each query over many blocks, with ties, copies, ids that repeat and a vector that is not finite, against a sort
    of all scores; after some blocks only a small part of the pairs is scored a second time."""
    from relq.operators import grid as G
    rng = np.random.default_rng(5)
    scored = []
    merge = G.Best.merge
    monkeypatch.setattr(G.Best, "merge", lambda self, at, *rest: (scored.append(len(at)), merge(self, at, *rest))[1])
    for ties, self_too, digits in ((False, False, 9), (False, True, None), (True, True, 9), (True, False, 2)):
        x = G.unit_rows((rng.integers(-1, 2, (3000, 6)) if ties else rng.normal(size=(3000, 24))).astype(float))
        ids = rng.permutation(3000)
        ids[1:4] = ids[0]
        q, qids = x[:200].copy(), ids[:200]
        x[7] = np.nan
        best = G.Best(qids, q, 5, digits, self_too)
        scored.clear()
        for a in range(0, 3000, 100):
            best.add(ids[a:a + 100], x[a:a + 100], x[a:a + 100].astype(np.float32))
        assert ties or sum(scored) < 0.1 * 200 * 3000
        s = np.einsum("id,jd->ij", q, x)
        s = s if digits is None else s.round(digits)
        want = []
        for i in range(200):
            ok = np.flatnonzero(~np.isnan(s[i]) & ((qids[i] != ids) | (not self_too)))
            ok = ok[np.lexsort((ids[ok], -s[i, ok]))][:5]
            want += [(int(qids[i]), int(ids[j]), round(float(s[i, j]), 9)) for j in ok]
        got = [(r["query_id"], r["doc_id"], round(r["score"], 9)) for r in best.table().to_pylist()]
        assert got == want


def clusters(spark, n=1500, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.02
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], VEC).repartition(4)


def test_clustered_index_skips_blocks(spark, tmp_path):
    df = clusters(spark)
    q = df.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    write_clustered_index(df, str(tmp_path / "i"), block_rows=64)
    counts: dict = {}
    got = rows_of(clustered_topk(spark, str(tmp_path / "i"), q, k=5, digits=9, page=7, counts=counts))
    assert got == rows_of(rt.knn_topk(df, q, k=5, digits=9))
    assert counts["pairs"] == 30 * counts["blocks"] and counts["read"] < 0.3 * counts["pairs"]
    s = read_summary(spark, str(tmp_path / "i"))
    assert s.agg(F.sum("n")).first()[0] == 1500 and s.agg(F.max("n")).first()[0] <= 64


def test_clustered_index_over_the_given_vectors(spark, tmp_path):
    emb = read_embeddings(spark, SF_SMALL).select("doc_id", "embedding")
    q = emb.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    write_clustered_index(emb, str(tmp_path / "i"), block_rows=40)
    assert rows_of(clustered_topk(spark, str(tmp_path / "i"), q, k=5, digits=9)) == rows_of(rt.knn_topk(emb, q, k=5, digits=9))


def test_clustered_ids_skip_blocks_and_documents(spark, tmp_path):
    rows, df = tables(spark, 200, ties=False)
    q = df.limit(10).withColumnRenamed("doc_id", "query_id")
    write_clustered_index(df, str(tmp_path / "i"), block_rows=16)
    for low, high in ((50, 120), (None, 30), (190, None), (500, None)):
        part = [r for r in rows if (low is None or r[0] >= low) and (high is None or r[0] < high)]
        asked = [(r.query_id, r.embedding) for r in q.collect()]
        assert rows_of(clustered_topk(spark, str(tmp_path / "i"), q, k=3, digits=9, id_range=(low, high))) == brute(part, asked, 3)


def test_clustered_ties_zero_and_hot_vectors(spark, tmp_path):
    """A third of the vectors are one, some are zero: every tie goes to the smaller id."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 1.0, 0.0] if i % 3 == 0 else [0.0] * 3 if i % 10 == 1 else [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(150)]
    df = spark.createDataFrame(rows, VEC)
    q = df.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    write_clustered_index(df, str(tmp_path / "i"), block_rows=8)
    assert rows_of(clustered_topk(spark, str(tmp_path / "i"), q, k=6, digits=9)) == brute(rows, [r for r in rows if r[0] % 7 == 0], 6)


def test_clustered_odd_tables(spark, tmp_path):
    rows, df = tables(spark, 30)
    q = df.withColumnRenamed("doc_id", "query_id")
    write_clustered_index(df.where("false"), str(tmp_path / "none"))
    assert rows_of(clustered_topk(spark, str(tmp_path / "none"), q)) == []
    write_clustered_index(df, str(tmp_path / "i"))
    assert rows_of(clustered_topk(spark, str(tmp_path / "i"), q.where("false"))) == []
    with pytest.raises(ValueError, match="dimensions"):
        clustered_topk(spark, str(tmp_path / "i"), spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"))
    assert not math.isnan(rows_of(clustered_topk(spark, str(tmp_path / "i"), q, k=1))[0][3])
