import re
import zlib
from collections import Counter

import numpy as np
from conftest import SF_SMALL

from relq.llm import suffixtree as T


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute_base(docs, is_training):
    c = Counter()
    for d, t in docs:
        if is_training(d):
            c.update([*tokens(t), "\n"])
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in docs:
        w = [*tokens(t), "\n"]
        out.append((d, not is_training(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return sorted(out, key=repr), c


def plain(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=repr)


def brute_tree(texts, min_count, min_kl, prior):
    """Contexts as byte strings and a scorer that looks for the longest suffix symbol by symbol."""
    count = {}
    fill = b"\n" * T.DEPTH
    for t in texts:
        s = fill + t + b"\n"
        for i in range(T.DEPTH, len(s)):
            for d in range(T.DEPTH + 1):
                count.setdefault(s[i - d:i], Counter())[s[i]] += 1
    n = sum(count[b""].values())
    frequent = {x for x in count if x and sum(count[x].values()) >= min_count}
    kept = set()
    for x in frequent:
        own, up = count[x], count[x[1:]]
        a, b = sum(own.values()), sum(up.values())
        kl = sum(k / a * np.log(k / a / (up[y] / b)) for y, k in own.items())
        if kl >= min_kl and kl * a >= 0.5 * len(own) * np.log(a):
            kept.update(x[i:] for i in range(len(x)))

    def prob(x, y):
        if not x:
            return (count[b""][y] + 1) / (n + 256)
        return (count[x][y] + prior * prob(x[1:], y)) / (sum(count[x].values()) + prior)

    def score(t):
        s, total = fill + t + b"\n", 0.0
        for i in range(T.DEPTH, len(s)):
            x = next(s[i - d:i] for d in range(T.DEPTH, -1, -1) if d == 0 or s[i - d:i] in kept)
            total += np.log10(prob(x, s[i]))
        return total
    return kept, score


def norm(t):
    return b" ".join(T.tokens_of((t or "").encode()))


def test_registered_query(spark):
    import __spark_entry__ as E
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = E.queries()["op7_suffix_tree"](spark, SF_SMALL).collect()
    train = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    want, _ = brute_base(docs, train)
    assert plain(rows) == want
    kept, score = brute_tree([norm(t) for d, t in docs if train(d)], T.MIN_COUNT, T.MIN_KL, T.PRIOR)
    text = dict(docs)
    for r in rows:
        assert abs(r.score - score(norm(text[r.doc_id]))) < 1e-3 * max(1, -r.score)
    # contexts help on texts that were not learned from: better than the root alone
    _, flat = brute_tree([norm(t) for d, t in docs if train(d)], 10**9, T.MIN_KL, T.PRIOR)
    held = [r for r in rows if r.held_out][:15]
    assert sum(r.score for r in held) > 0.7 * sum(flat(norm(text[r.doc_id])) for r in held)


def test_longest_suffix_search(spark):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abcab "), rng.integers(0, 60))).strip() for _ in range(150)]
    new = [b"", b"abc", b"zz\xff a", b"ab" * 3000]
    kept, score = brute_tree([norm(t.decode()) for t in texts], 3, 0.01, T.PRIOR)
    assert len(kept) > 20
    rows = [(i, t, i < len(texts)) for i, t in enumerate([*texts, *new])]
    df = spark.createDataFrame([(i, bytearray(t), x) for i, t, x in rows], "doc_id long, text binary, t boolean")
    for size in (300, 1 << 20):  # many chunks in several teams, and one
        got = {r.doc_id: r.score for r in T.score_texts(df, T.F.col("t"), chunk_bytes=size, min_kl=0.01).collect()}
        for i, t, _ in rows:
            want = score(b" ".join(T.tokens_of(t)))
            assert abs(got[i] - want) < 1e-4 * max(1, -want)


def test_packed_grams():
    rng = np.random.default_rng(2)
    for n in (1, 5, 1000):
        g = np.unique(rng.integers(0, 1 << 48, n))
        assert (T._unpack_grams(T._pack_grams(g)) == g).all() and (T._unpack(T._pack(g)) == g).all()


def test_gram_counts():
    texts = [b"abc abc", b"", b"x" * 50]
    want = Counter()
    for t in texts:
        s = b"\n" * T.DEPTH + t + b"\n"
        want.update(int.from_bytes(s[i - T.DEPTH:i + 1], "big") for i in range(T.DEPTH, len(s)))
    g, c = T._gram_counts(texts)
    assert dict(zip(g.tolist(), c.tolist())) == want and (np.diff(g) > 0).all()


def test_odd_rows_and_small_chunks(spark):
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "The the THE"), (3, "The the THE"), (None, "x y"), (4, "É é \x00 a\x0bb"), (5, "w " * 40_000), (6, "onlyhere"), (7, "a b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 chunk", "2 training", "3 c").repartition(3)
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    for size in (8, 1 << 20):
        out = T.score_texts(df, T.training_row(T.F.col("doc_id"), 7, 2), chunk_bytes=size).withColumn("held_out", ~T.F.col("training")).collect()
        assert plain(out) == brute_base(docs, train)[0] and all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert T.score_texts(df.limit(0), T.F.lit(True)).count() == 0
    none = T.score_texts(df, T.F.lit(False)).collect()
    assert all(r.train_tokens == 0 == r.n_known for r in none)
    for r in none:
        if r.n_tokens == 1:
            assert abs(r.score + np.log10(256)) < 1e-5


def test_rare_contexts_stay_in_a_large_corpus(spark):
    # 4 occurrences in 600,000 symbols are a share of less than 1e-5
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abc "), 6000).tolist()) for _ in range(100)]
    for i in (3, 30, 60, 90):
        texts[i] += b" qzjxk"
    texts = [norm(t.decode()) for t in texts]
    every = [*texts, b"a qzjxk", b"b qzj a"]
    kept, score = brute_tree(texts, T.MIN_COUNT, T.MIN_KL, T.PRIOR)
    assert b"q" in kept
    df = spark.createDataFrame([(i, t.decode(), i < len(texts)) for i, t in enumerate(every)], "doc_id long, text string, t boolean")
    got = {r.doc_id: r.score for r in T.score_texts(df, T.F.col("t"), chunk_bytes=100_000).collect()}
    for i in (0, 3, 100, 101):
        assert abs(got[i] - score(every[i])) < 1e-5 * -score(every[i])
    _, frequent = brute_tree(texts, 6, T.MIN_KL, T.PRIOR)
    assert got[100] > frequent(every[100]) + 3
