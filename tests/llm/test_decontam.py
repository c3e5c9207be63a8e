import re

import duckdb
import pytest
from conftest import SF_SMALL

from relq.llm import decontam as D


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, bench, window=10):
    split = lambda t: re.findall(D.WORD, lower(t))
    out = {}
    for key, text in docs:
        w = split(text)
        hit, items = set(), set()
        for item, b in bench:
            b = split(b)
            n = min(window, len(b))
            if not n or item is None:
                continue
            wins = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
            at = [p for p in range(len(w) - n + 1) if tuple(w[p:p + n]) in wins]
            if at:
                items.add(str(item))
                hit.update(q for p in at for q in range(p, p + n))
        out.setdefault((key, text), (len(w), len(hit), sorted(items)))
    return out


def run(spark, docs, bench, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 n_words", "'x' fps", "2 h")
    b = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 low", "2 words")
    every, hits = D.benchmark_hits(d, b, **kw)
    h = {(r.doc_id, r.text_hash): (r.n_hit, r["items"], sum(s.end - s.start for s in r.spans)) for r in hits.collect()}
    rows = every.collect()
    return rows, h, d, b


W = [f"w{i}" for i in range(60)]


def test_edge_cases_match_brute_force(spark):
    bench = [(1, " ".join(W[:25])), (2, "short one here"), (3, None), (4, "  ..."), (None, "null id item"), (5, "short one here"),
             (6, "Lone"), (7, " ".join(["a"] * 30)), (8, "ÄB c")]
    docs = [(1, "x " + " ".join(W[3:14]) + " y " + " ".join(W[15:24]) + " z"), (2, " ".join(W[3:12])), (3, None), (4, ""), (5, "SHORT, one; here? lone!"),
            (5, "other text"), (None, "a " * 40), (None, "b"), (6, "äb C"), (7, "ÄB C"), (8, "q " * 50_000 + " ".join(W[5:20]).upper()),
            (9, "null id item"), (10, "x " + " ".join(W[:12])), (10, "x " + " ".join(W[:12]))]
    rows, h, d, b = run(spark, docs, bench)
    want = brute(docs, bench)
    assert len(rows) == len(docs)
    hashes = {(r.doc_id, r.text): r.hash for r in d.selectExpr("doc_id", "text", "xxhash64(text) hash").collect()}
    for key, (n, n_hit, items) in want.items():
        k = (key[0], hashes[key])
        assert [r.n_words for r in rows if (r.doc_id, r.text_hash) == k][0] == n
        got = h.get(k, (0, [], 0))
        assert (got[0], got[1], got[2]) == (n_hit, items, n_hit), key
    kept = D.drop_contaminated(d, b)
    assert kept.columns == d.columns
    clean = [k for k, v in want.items() if not v[1]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, clean))


def test_empty_tables(spark):
    rows, h, *_ = run(spark, [], [(1, "a b")])
    assert not rows and not h
    rows, h, *_ = run(spark, [(1, "a b")], [])
    assert len(rows) == 1 and not h


@pytest.mark.parametrize("k", [1, 4, 10])
def test_other_gram_lengths_find_the_same(spark, k):
    bench = [(1, " ".join(W[:30]))]
    docs = [(i, "p q " + " ".join(W[i:i + 8 + i % 5]) + " r") for i in range(18)]
    _, h, *_ = run(spark, docs, bench, k=k)
    want = brute(docs, bench)
    assert sorted(x[0] for x in h) == sorted(key[0] for key, v in want.items() if v[1])


def test_shuffle_path_equals_broadcast_path(spark, monkeypatch):
    import __spark_entry__ as E
    a = sorted(map(tuple, E.queries()["op9_decontamination"](spark, SF_SMALL).collect()))
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    b = sorted(map(tuple, E.queries()["op9_decontamination"](spark, SF_SMALL).collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    assert a == b == sorted(con.execute(D.OP9_SQL).fetchall())
