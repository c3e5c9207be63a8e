import numpy as np
import pytest
import xxhash
from conftest import SF_SMALL

from relq.llm import simhash as S
from relq.llm.components import components


def brute_fp(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, distance=3):
    fps = np.array(fps, dtype=np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_golay_neighbour_keys_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 2000)
    centre, keys = S.segment_codes(x)
    assert {len(set(k)) for k in keys.tolist()} == {1, 6}
    for bit in range(23):
        other, _ = S.segment_codes(x ^ (1 << bit))
        assert (keys == other[:, None]).any(axis=1).all()


def test_registered_query_matches_brute_force(spark):
    import __spark_entry__ as E
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = E.queries()["op10_simhash"](spark, SF_SMALL).collect()
    ids = sorted(docs)
    fps = [brute_fp(docs[i]) for i in ids]
    want = dict(zip(ids, zip((f"{f:016x}" for f in fps), brute_components(ids, fps))))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want and len(rows) == len(docs)


@pytest.mark.parametrize("block", [8, 4096])
def test_dense_groups_lose_no_link(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = list(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) + list(centres)
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                x ^= np.uint64(1) << np.uint64(b)
            fps.append(x)
    fps = sorted(set(int(f) for f in fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.node: r.root for r in components(S.near_links(df, 3, block)).collect()}
    want = brute_components(list(range(len(fps))), fps)
    groups = {}
    for f, c in zip(signed, want):
        groups.setdefault(c, set()).add(f)
    mine = {}
    for f in signed:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_edge_cases(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (None, "one two three four"), (5, "One TWO three four"), (5, "one two three four"),
            (7, "ÄÖ x"), (8, "äö x"), (9, "w " * 200_000)]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = S.simhash_components(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[5] == {5} and by[None] == {5}
    assert by[7] == {7} and by[8] == {8}
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5, 7, 8, 9]  # the null id's text is that of 5
    assert S.simhash_components(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        S.near_links(df.select("fp"), 4)


def test_one_document_of_each_group_stays(spark):
    """Repeated ids with unrelated texts and null ids: every text has its survivor, no copy stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, c), (None, c), (None, c)]
    df = spark.createDataFrame([(i, t, "x", n, 7) for n, (i, t) in enumerate(rows)], "doc_id long, text string, k1 string, id int, ID_kept int")
    out = S.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (5, b), (9, c)]
    only = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(r.text for r in S.drop_near_duplicates(only).collect()) == [a, b]


def test_survivors_against_brute_force(spark):
    """Near copies, repeated and null ids: components over all pairs of rows, one row of each stays."""
    rng = np.random.default_rng(11)
    base = [[f"w{rng.integers(0, 10_000)}" for _ in range(60)] for _ in range(25)]
    rows = []
    for _ in range(150):
        words = list(base[rng.integers(0, len(base))])
        for _ in range(int(rng.integers(0, 3))):
            words[rng.integers(0, len(words))] = f"v{rng.integers(0, 99)}"
        rows.append((None if rng.random() < 0.1 else int(rng.integers(0, 60)), " ".join(words)))
    fp = [S.simhash(t.encode()) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    want = {}
    for i, (d, _) in enumerate(rows):
        k = (d is None, d)
        want[root(i)] = min(want.get(root(i), k), k) if root(i) in want and d is not None and want[root(i)][1] is not None else min(
            [x for x in (want.get(root(i)), k) if x], key=lambda x: x[0])
    got = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    place = {t: i for i, (_, t) in enumerate(rows)}
    assert len(got) == len(want) and {(root(place[r.text]), r.doc_id) for r in got} == {(g, d) for g, (_, d) in want.items()}


def test_components_long_chain(spark):
    e = spark.range(200).selectExpr("id u", "id + 1 v")
    assert {r.root for r in components(e).collect()} == {0}
