import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relq.operators import retrieval as rt
from relq.operators.positions import slice_rows, with_position
from relq.sources.tables import read_corpus, read_embeddings


def test_with_position_dense_and_ordered(spark):
    corpus = read_corpus(spark, SF_SMALL).select("doc_id")
    got = [(r["doc_id"], r["pos"]) for r in with_position(corpus.repartition(5), ["doc_id"], num_partitions=7).collect()]
    ids = sorted(d for d, _ in got)
    assert sorted(got, key=lambda x: x[1]) == [(d, i) for i, d in enumerate(ids)]


def test_slice_rows(spark):
    corpus = read_corpus(spark, SF_SMALL)
    ids = sorted(r[0] for r in corpus.select("doc_id").collect())
    assert sorted(r[0] for r in slice_rows(corpus, "doc_id", 10, 25).select("doc_id").collect()) == ids[10:25]
    half = len(ids) * 50 // 100
    assert sorted(r[0] for r in slice_rows(corpus, "doc_id", "50%", None).select("doc_id").collect()) == ids[half:]
    assert slice_rows(corpus, "doc_id", 10_000, 10_500).count() == 0


def _brute(index, queries, k):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    ids = np.array([r[0] for r in index]); x = unit(np.array([r[1] for r in index], dtype=np.float64))
    out = {}
    for qid, qv in queries:
        s = x @ unit(np.array([qv], dtype=np.float64))[0]
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]
        out[qid] = [int(ids[i]) for i in order]
    return out


def test_knn_matches_brute_force(spark):
    emb = read_embeddings(spark, SF_SMALL)
    q = emb.orderBy("doc_id").limit(10).withColumnRenamed("doc_id", "query_id")
    index = emb.where(F.col("doc_id") >= 10)
    hits = rt.knn_topk(index.repartition(3), q, k=5)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    exp = _brute([(r[0], r[1]) for r in index.select("doc_id", "embedding").collect()],
                 [(r[0], r[1]) for r in q.select("query_id", "embedding").collect()], 5)
    assert got == exp


def test_knn_query_tiles_agree(spark, monkeypatch):
    emb = read_embeddings(spark, SF_SMALL)
    q = emb.orderBy("doc_id").limit(10).withColumnRenamed("doc_id", "query_id")
    index = emb.where(F.col("doc_id") >= 10)
    one = sorted(rt.knn_topk(index, q, k=5).collect())
    monkeypatch.setattr(rt, "QUERY_TILE", 3)
    many = sorted(rt.knn_topk(index, q, k=5).collect())
    assert [(r[0], r[1], r[2]) for r in one] == [(r[0], r[1], r[2]) for r in many]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(one, many))


def test_vectors_of_another_length_are_refused(spark):
    vec = "id long, embedding array<float>"
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], vec)
    for odd in ([(3, [1.0])], [(3, None)]):
        mixed = good.unionByName(spark.createDataFrame(odd, vec))
        with pytest.raises(Exception):
            rt.knn_topk(mixed, good, id_col="id", query_id="id").collect()
        with pytest.raises(ValueError):
            rt.knn_topk(good, mixed, id_col="id", query_id="id")


def test_short_index_keeps_k_denominator(spark):
    judged = spark.createDataFrame([(1, 10, True), (1, 11, False)], "query_id long, doc_id long, relevant boolean")
    assert rt.precision_at_k(judged, k=5).first()["p_at_k"] == 0.2


def test_recorded_mean_p_at_5(spark):
    vals = [1.0, 0.8, 1.0, 0.8, 0.8, 1.0, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "query_id long, p_at_k double")
    assert rt.mean_precision_at_k(df).first()["mean_p_at_k"] == 0.94


def test_merge_topk_ties_and_slack():
    rng = np.random.default_rng(0)
    k = 5
    for trial in range(50):
        n, nq = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        sc = rng.integers(0, 4, size=(n, nq)).astype(np.float64)  # many ties
        ids = rng.permutation(1000)[:n].astype(np.int64)
        best_sc, best_id = np.empty((0, nq)), np.empty((0, nq), dtype=np.int64)
        for lo in range(0, n, 7):
            best_sc, best_id = rt._merge_topk(best_sc, best_id, sc[lo:lo + 7], ids[lo:lo + 7], k)
        for j in range(nq):
            exp = sorted(range(n), key=lambda i: (-sc[i, j], ids[i]))[:k]
            assert list(best_id[:, j]) == [ids[i] for i in exp]


def test_knn_ties_go_to_lower_id(spark):
    rows = [(i, [1.0, 0.0], 0) for i in (7, 3, 9)] + [(1, [0.0, 1.0], 0)]
    index = spark.createDataFrame(rows, "doc_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(100, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [r["doc_id"] for r in rt.knn_topk(index, q, k=2).orderBy("rank").collect()]
    assert got == [3, 7]


def test_empty_inputs(spark):
    from relq.operators.positions import grouped_prefix_sum
    assert with_position(spark.range(0).withColumnRenamed("id", "k"), ["k"]).collect() == []
    assert grouped_prefix_sum(spark.createDataFrame([], "g long, t long, v long"), "g", "t", "v", "s").collect() == []
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert rt.knn_topk(spark.createDataFrame([], "doc_id long, embedding array<float>"), q).collect() == []
    assert rt.knn_topk(q.withColumnRenamed("query_id", "doc_id"),
                       spark.createDataFrame([], "query_id long, embedding array<float>")).collect() == []


def test_slices_refuse_negative_bounds(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError):
        slice_rows(df, "doc_id", -3)
    assert slice_rows(df, "doc_id", 7).count() == 3


def test_scan_memory_does_not_follow_batches_and_queries():
    """A batch of 10,000 vectors against 1,024 queries: the scores of a tile are held, not those of the batch (they are 82 MB)."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(10_000, 8)), rt.unit_rows(rng.normal(size=(1024, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float64()))],
                                       names=["doc_id", "embedding"])
    score = rt._scorer(SimpleNamespace(value=(np.arange(1024), q)), 5, "doc_id", "embedding", 8, None)
    tracemalloc.start()
    out = pa.Table.from_batches(list(score([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    s = rt.unit_rows(x) @ q.T
    best = {j: np.argsort(-s[:, j])[:5].tolist() for j in range(1024)}
    got = out.to_pandas().sort_values(["query_id", "score"], ascending=[True, False]).groupby("query_id")["doc_id"].apply(list).to_dict()
    assert got == best
