import zlib

import numpy as np
import pytest
from conftest import SF_CHECK

from relq.llm import sharding as S


def best(sizes, k):
    """The minimax capacity by dynamic programming."""
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    cost = [float("inf")] * n + [0]
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    for _ in range(k):
        cost = np.array([min([cost[i]] + [max(cost[j], total[i] - total[j]) for j in range(i)]) for i in range(n + 1)])
    return int(cost[n])


def test_smallest_capacity_is_optimal():
    rng = np.random.default_rng(0)
    for k in (1, 3, 7):
        for _ in range(5):
            sizes = rng.integers(1, 50, 30)
            assert S.smallest_capacity(sizes, k) == best(sizes, k)


@pytest.mark.parametrize("digits,refine", [(1, 3), (2, 20_000)])
def test_segments_reach_the_optimum(spark, monkeypatch, digits, refine):
    monkeypatch.setattr(S, "START_DIGITS", digits)
    monkeypatch.setattr(S, "REFINE", refine)
    rng = np.random.default_rng(4)
    for hot in (0, 900, 20_000):
        sizes = rng.integers(1, 400, 700)
        sizes[100] += hot
        rows = sorted((f"{rng.integers(0, 1 << 60):032x}"[::-1], int(s)) for s in sizes)
        groups = spark.createDataFrame([(h, s, 1) for h, s in rows], "h string, bytes long, docs long").coalesce(2).persist()
        keys, first, cap = S.minimax_cuts(groups, 16)
        order = np.array([s for _, s in rows])
        assert cap == S.smallest_capacity(order, 16)
        hs = [h for h, _ in rows]
        edges = [0] + [sum(h < k for h in hs) for k in keys] + [len(hs)]
        assert edges[:-1] == first and max(order[a:b].sum() for a, b in zip(edges, edges[1:])) <= cap and len(edges) <= 17
        groups.unpersist()


def check(rows, docs, shards=16):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    by, group = {}, {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        group.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    assert all(len(v) == 1 for v in group.values())
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
    return load


def test_registered_query(spark):
    import __spark_entry__ as E
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()]
    rows = E.queries()["op1_sharding"](spark, SF_CHECK).collect()
    load = check(rows, docs)
    import hashlib
    sizes = {}
    for _, t in docs:
        h = hashlib.md5((t or "").encode()).hexdigest()
        sizes[h] = sizes.get(h, 0) + len((t or "").encode()) + 1
    assert max(load.values()) == S.smallest_capacity(np.array([sizes[h] for h in sorted(sizes)]), 16)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_odd_rows(spark):
    docs = [(1, None), (1, None), (2, ""), (None, "x"), (3, "x"), (4, "é" * 100_000), (4, "é" * 100_000), (5, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'s' shard", "1 h", "2 slot")
    check(S.shard_by_bytes(df).collect(), docs)
    assert S.shard_by_bytes(df.limit(0)).count() == 0
    one = S.shard_by_bytes(df.where("doc_id = 4"), 3).collect()
    assert {r.shard for r in one} == {0} and {r.slot for r in one} == {0, 1}
