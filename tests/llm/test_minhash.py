import hashlib

import numpy as np
from conftest import SF_SMALL

from relq.llm import minhash as M


def jaccard(a, b, k=5):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(docs):
    docs = sorted(((d is not None, d or 0, d, t or "") for d, t in docs), key=lambda r: (r[0], r[1], r[3].encode()))
    out = []
    for i, (_, _, d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][3]
        e = M.edited(t, nxt)
        f, g = M.fingerprint(t), M.fingerprint(e)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, M.likeness(f, g), M.likeness(f, M.fingerprint(nxt))))
    return sorted(out, key=repr)


def test_registered_query_matches_brute_force(spark):
    import __spark_entry__ as E
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = sorted((tuple(r) for r in E.queries()["op4_fingerprints"](spark, SF_SMALL).collect()), key=repr)
    assert rows == brute(docs)
    text = dict(docs)
    ids = sorted(text)
    err = []
    for r in rows:
        nxt = text[ids[(ids.index(r[0]) + 1) % len(ids)]]
        err.append(abs(r[5] - jaccard(text[r[0]], M.edited(text[r[0]], nxt))))
    assert np.mean(err) < 0.03 and max(err) < 0.2


def test_odd_rows(spark):
    docs = [(5, None), (None, "null id"), (1, ""), (1, "same id"), (1, "same id"), (2, " \n "), (3, "two words"), (9, "w x y z " * 50_000), (7, "Éa😀b" * 9), (8, "x" * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 place", "2 `range`", "'a' fingerprint").repartition(3)
    assert sorted((tuple(r) for r in M.neighbour_fingerprints(df).collect()), key=repr) == brute(docs)
    one = df.where("doc_id = 9")
    assert [r.near_next for r in M.neighbour_fingerprints(one).collect()] == [1.0]
    assert M.neighbour_fingerprints(df.limit(0)).count() == 0
    got = {r.doc_id: r.fp for r in M.with_fingerprint(df.where("doc_id > 1"), out="fp").collect()}
    assert got[2] == got[5] == "" and got[3] == M.fingerprint("TWO words")


def test_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.7, 0.95):
        est, true = [], []
        for _ in range(25):
            a = [f"w{x}" for x in rng.integers(0, 10**9, 400)]
            keep = int(400 * share)
            b = a[:keep] + [f"w{x}" for x in rng.integers(0, 10**9, 400 - keep)]
            a, b = " ".join(a), " ".join(b)
            est.append(M.likeness(M.fingerprint(a), M.fingerprint(b)))
            true.append(jaccard(a, b))
        assert abs(np.mean(est) - np.mean(true)) < 0.02
    assert M.likeness("", "") == 1 and M.likeness("", M.fingerprint("a")) == 0 == M.likeness(M.fingerprint("a"), "")


def test_densification_fills_from_filled_bins():
    filled = np.zeros(512, dtype=bool)
    filled[[7, 300]] = True
    out = M.densify(np.arange(512, dtype=np.uint64), filled)
    assert set(out.tolist()) == {7, 300} and out[7] == 7 and out[300] == 300
