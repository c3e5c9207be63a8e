import zlib

import numpy as np
import pytest
from conftest import SF_SMALL

from relq.llm import packing as P


def reference(text, tok):
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, want, tokens=2048):
    """Every document's ids in order, every sequence gapless and within its size."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        parts = [ids[a:a + tokens] for a in range(0, len(ids), tokens)]
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in got] == [
            (i, i * tokens, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for i, p in enumerate(parts)]
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= tokens
    return len(by_seq)


def test_registered_query(spark):
    import __spark_entry__ as E
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.tokenizer_path())
    want = {r.doc_id: reference(r.text, tok) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    n = check(E.queries()["op6_packing"](spark, SF_SMALL).collect(), want)
    assert n <= -(-sum(map(len, want.values())) // 2048) * 1.02 + 2


def test_odd_texts_and_words(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.tokenizer_path())
    texts = [None, "", "  \n ", "it's I'm a1b2", "<|endoftext|> x<|startoftext|>y", "ÉCOLE ß Σας ﬁ 日本 ___ a_b.. ab__. ½ ª µm ×÷ é  x",
             "don't " * 3000, "x" * 9000, "tab\tnew\nline\r end", "\x00 a\x00b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 length", "2 piece", "3 sequence_id")
    rows = P.pack(P.token_pieces(df, P.tokenizer_path())).collect()
    check(rows, {i: reference(t, tok) for i, t in enumerate(texts)})
    assert P.pack(P.token_pieces(df.limit(0), P.tokenizer_path())).count() == 0


def test_word_store_is_bounded():
    c = P.WordTokenizer(P.tokenizer_path(), known=50)
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(40)) for i in range(30)]
    out = [list(c.encode_batch([t]))[0] for t in texts]
    assert out == [np.array(reference(t, c.library)[:-1], dtype="<u4").tobytes() for t in texts]
    assert len(c.hashes) <= 50 + 41 and len(c.flat) == c.size.sum()


def test_word_ids_in_odd_texts_and_long_ones(monkeypatch):
    """Texts read together, alone (tabs and the like) and part by part have the tokenizer's own ids."""
    c = P.WordTokenizer(P.tokenizer_path())
    texts = [None, "", " \n ", "a b\na", "tab\tnew line\r end", "x \x0b y", "É\xa0x é", "don't stop", "word " * 30, "z" * 300]
    want = [np.array(reference(t, c.library)[:-1], dtype="<u4").tobytes() for t in texts]
    assert list(c.encode_batch(texts)) == want
    monkeypatch.setattr(P, "RUN_BYTES", 40)
    assert list(c.encode_batch(texts)) == want and list(P.WordTokenizer(P.tokenizer_path()).encode_batch(texts[::-1])) == want[::-1]


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2049, 400)
    where, offset = P.best_fit(lengths, 2048, 3, 2048 * 2048 // 2 + 2048 * 1024, rule)
    for b in set(where.tolist()):
        part = lengths[where == b]
        assert part.sum() <= 2048 and len(part) <= 3 and (part.astype(int) ** 2).sum() <= 2048 * 2048 // 2 + 2048 * 1024
    free, _ = P.best_fit(lengths, rule=rule)
    assert len(set(free.tolist())) <= 1.05 * lengths.sum() / 2048 + 2
    tight, _ = P.best_fit(np.full(10, 100), 2048, 3, None, rule)
    assert len(set(tight.tolist())) == 4
    with pytest.raises(ValueError):
        P.best_fit(np.array([3000]))
    assert len(P.best_fit(np.zeros(0, dtype=int))[0]) == 0


def test_blocks_and_repeated_rows(spark):
    df = spark.range(300).selectExpr("id % 7 doc_id", "0 piece", "1 + id * 37 % 2048 length", "'z' extra")
    rows = P.pack(df, block=50).collect()
    assert len(rows) == 300 and {r.extra for r in rows} == {"z"}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 2048


def test_registered_query_has_three_capacities(spark, monkeypatch):
    seen = {}
    plain = P.pack
    monkeypatch.setattr(P, "pack", lambda pieces, **kw: (seen.update(kw), plain(pieces, **kw))[1])
    assert P.op6_packing(spark, SF_SMALL).columns[-2:] == ["sequence_id", "offset"]
    assert seen == {"documents": P.DOCUMENTS, "attention": P.ATTENTION}


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_chosen_bins_against_brute_force(rule):
    """Every piece, in falling size, goes where a search over all open bins puts it."""
    rng = np.random.default_rng(9)
    lengths = rng.integers(1, 200, 400)
    caps = (256, 4, 40_000)
    where, offset = P.best_fit(lengths, caps[0], caps[1], caps[2], rule)
    free = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        need = np.array([n, 1, n * n])
        fits = [f for f in free if (f >= need).all()]
        residual = np.array([caps[0] - offset[i], 0, 0])
        if not fits:
            assert offset[i] == 0
            free.append(np.array(caps) - need)
            continue

        def score(f):
            a, b = f / np.array(caps), need / np.array(caps)
            return float(((a - b) ** 2).sum()) if rule == "norm" else float((a - b).sum() - (a * b).sum() / np.sqrt((a ** 2).sum()))
        best = min(map(score, fits))
        at = next(k for k, f in enumerate(free) if (f >= need).all() and f[0] == residual[0] and abs(score(f) - best) < 1e-9)
        free[at] = free[at] - need
    assert len(free) == where.max() + 1


def test_capacities_cost_no_sequences():
    lengths = np.minimum(np.random.default_rng(10).lognormal(6, 1, 20_000).astype(int) + 1, 2047)
    plain = P.best_fit(lengths)[0].max()
    for rule in ("dot", "norm"):
        assert P.best_fit(lengths, documents=P.DOCUMENTS, attention=P.ATTENTION, rule=rule)[0].max() <= plain * 1.001
