"""Operator 11: against brute force, the automaton's matching statistics, hot anchors, odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relq.llm import substrings as S
from relq.llm.substrings import SuffixAutomaton, anchored_passages, op11_substrings, remove_repeats, word_runs

SF = "/root/testdata/sf0.001"


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def run(spark, texts, window, k, **kw):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, k1 int, kept string").repartition(3)
    return [tuple(r)[1:] for r in sorted(remove_repeats(df, window=window, k=k, **kw).collect())]


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (n, g, hashlib.sha256(kept.encode()).hexdigest()) for r, (n, g, kept) in zip(docs, brute([r.text for r in docs], 35))}
    assert sum(g for _, g, _ in want.values()) > 0
    assert {r.doc_id: tuple(r)[1:] for r in op11_substrings(spark, SF).collect()} == want


def texts_of(seed, n=60, kinds=3, size=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefgh"[:kinds]) for _ in range(rng.randrange(size))) for _ in range(n)]


def test_brute_force(spark):
    for seed, kinds, window, k in ((1, 3, 6, 3), (2, 2, 8, 8), (3, 8, 4, 1)):
        texts = texts_of(seed, kinds=kinds)
        assert run(spark, texts, window, k) == brute(texts, window)


def test_hot_anchor_is_cut(spark):
    """One line amid ever new words: its passages do not fit a shard and are dealt as single windows."""
    rng = random.Random(4)
    line = "one two three four five"
    texts = [f"{rng.randrange(9)} {rng.randrange(9)} {line} {rng.randrange(9)} {rng.randrange(9)}" for _ in range(120)]
    assert run(spark, texts, 7, 5, per_shard=8) == brute(texts, 7)
    assert run(spark, texts, 7, 3, per_shard=4) == brute(texts, 7)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    texts = [None, "", " \t\n ", "a b", long, long, f"x y {long}\nz", "q " * 40, long + " end", " ".join(f"v{i}" for i in range(60)), "  " + long]
    assert run(spark, texts, 35, 10) == brute(texts, 35)
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, None)], "doc_id long, text string")
    assert sorted(tuple(r)[1:] for r in remove_repeats(df).collect()) == [(0, 0, ""), *[(50, 50, "")] * 3]
    assert remove_repeats(df.where("false")).count() == 0


def test_alone(spark):
    text = " ".join(f"w{i}" for i in range(100))
    assert run(spark, [text], 35, 10) == [(100, 0, text)]


def test_long_text_in_runs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"{rng.randrange(400)}" for _ in range(6000)]
    words[4000:4100] = words[100:200]
    text = "  ".join(words)
    assert [w for part in word_runs(text.encode(), 100) for w in part] == text.encode().split()
    whole, = S.text_passages([text.encode()], 35, 10)
    parts, _, other, _ = S.text_passages([text.encode(), b"", b"x " * 50, b""], 35, 10, size=500)
    windows = [[(p["start"] + i, p["anchor"]) for p in np.frombuffer(x, dtype=S._PACKED) for i in range(p["n"])] for x in (whole, parts)]
    assert windows[0] == windows[1] and len(windows[0]) == 6000 - 34
    assert sum(p["n"] for p in np.frombuffer(other, dtype=S._PACKED)) == 16
    monkeypatch.setattr(S.word_runs, "__defaults__", (500,))
    assert run(spark, [text], 35, 10) == brute([text], 35)


def test_texts_are_read_together():
    texts = [t.encode() for t in texts_of(9, kinds=4)]
    assert S.text_passages(texts, 6, 3) == [S.text_passages([t], 6, 3)[0] for t in texts]


def test_word_hashes():
    text = " aa b\taa\x0bb \xa0x aa".encode()
    start, h = S.word_hashes(text)
    assert [text[a:].split()[0] for a in start.tolist()] == text.split()
    by = {}
    assert all(by.setdefault(w, x) == x for w, x in zip(text.split(), h.tolist())) and len(set(by.values())) == 3


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 2)), max_size=5), st.lists(st.integers(0, 3), max_size=12))
@settings(max_examples=200, deadline=None)
def test_matching_statistics(sequences, stream):
    a = SuffixAutomaton()
    for s, times in sequences:
        a.add(s, times)
    a.close()

    def occurs(run_):
        return sum(t * sum(s[i:i + len(run_)] == run_ for i in range(len(s) - len(run_) + 1)) for s, t in sequences)

    for words in [stream, *[s for s, _ in sequences]]:
        want = [max((n for n in range(1, i + 2) if occurs(words[i + 1 - n:i + 1]) > 1), default=0) for i in range(len(words))]
        assert a.repeated_runs(words) == want


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_every_window_has_one_passage(words, k, more):
    window = k + more - 1
    h = S._mix(np.array(words, dtype=np.uint64) + np.uint64(1))
    first, n, anchor = anchored_passages(h, np.zeros(len(h), dtype=int), window, k)
    at = [(f + i, a) for f, m, a in zip(first.tolist(), n.tolist(), anchor.tolist()) for i in range(m)]
    assert [p for p, _ in at] == list(range(max(0, len(words) - window + 1))) and (not len(n) or n.max() <= window - k + 1)
    by_words = {}
    for p, a in at:
        assert by_words.setdefault(tuple(words[p:p + window]), a) == a


def test_extra_columns_and_names(spark):
    df = spark.createDataFrame([(1, "a b c", 5), (2, "a b c", 6)], "id long, body string, doc_id long")
    out = remove_repeats(df, "id", "body", window=3, k=2, outcome={"gone": F.col("n_removed")})
    assert sorted(map(tuple, out.collect())) == [(1, 3), (2, 3)]
