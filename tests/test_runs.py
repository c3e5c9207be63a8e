"""Texts cut into pieces and words in the tasks, against Spark's regular expressions."""

import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from relq.functions.hashing import hash_u32, hash_words
from relq.functions.runs import char_classes, split_pieces, split_words, text_parts
from relq.operators.embedding import embed_counts
from relq.operators.tokens import PIECE_RE, build_vocab, pieces, tokenize
from relq.templates import CHATML

MARKERS = (CHATML["start"], CHATML["end"], CHATML["eos"])
BITS = [*MARKERS, "<", "<<", "<|", "|>", " ", "  ", "\n", "\t ", " \r\n", "a", "Bc", "é", "ß1", "٣", "12", "²", "_", "-", "...", " ", "​", "日本", "😀",
        "𝐀", "é", "\x00", "\x0b", "im_start", "Ⅻ"]


def odd_texts(n=3000, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(n)] + ["", None, "<", " ", " <", "<|im_end|", "a ", " a", "plain words only"]


def test_classes_are_those_of_the_regular_expressions(spark):
    table = char_classes(spark).value
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    plain = spark.range(0x110000).where("id < 55296 or id > 57343").where(~F.col("id").isin(9, 10, 13, 32, 60))
    got = plain.select("id", F.when(char.rlike(r"\p{L}"), 1).when(char.rlike(r"\p{N}"), 2).otherwise(3).alias("k")).toArrow()
    assert (table[got["id"].to_numpy()] == got["k"].to_numpy()).all()
    assert table[[9, 10, 13, 32, 60]].tolist() == [0, 0, 0, 0, 4]


def test_pieces_are_those_of_the_regular_expression(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    want = [r[0] or [] for r in df.select(pieces(F.col("t")).alias("p")).collect()]
    classes = char_classes(spark).value
    assert split_pieces(pa.array(texts), classes, MARKERS).to_pylist() == want
    assert split_pieces(pa.array(texts).slice(700, 900), classes, MARKERS).to_pylist() == want[700:1600]  # an array with an offset
    assert split_pieces(pa.array(["", None, ""], pa.string()), classes, MARKERS).to_pylist() == [[], [], []]
    ascii_only = [t for t in texts if t and t.isascii()]
    assert split_pieces(pa.array(ascii_only), classes, MARKERS).to_pylist() == [w for t, w in zip(texts, want) if t and t.isascii()]


def test_parts_cover_all_rows(monkeypatch):
    from relq.functions import runs
    monkeypatch.setattr(runs, "PART_BYTES", 10)
    for texts in ([], [None, ""], ["x" * 25, "", "y", None, "z" * 9, "w" * 11], ["ab"] * 20):
        parts = list(text_parts(pa.array(texts, pa.string())))
        assert [i for a, b in parts for i in range(a, b)] == list(range(len(texts)))
        assert all(b - a == 1 or sum(len(t or "") for t in texts[a:b]) <= 10 for a, b in parts)


def test_broken_utf8_is_replaced(spark):
    broken = pa.array([b"ab \xff c", b"ok", b"\xe2\x82 x"], pa.binary())
    texts = spark.sql("SELECT i, CAST(b AS STRING) AS t FROM VALUES (0, X'6162FF'), (1, X'20FF20') v(i, b)").coalesce(1)
    want = [r[0] for r in texts.orderBy("i").select(pieces(F.col("t"))).collect()]
    classes = char_classes(spark).value
    assert split_pieces(pa.array([b"ab\xff", b" \xff "], pa.binary()), classes, MARKERS).to_pylist() == want
    assert "".join(split_pieces(broken, classes, MARKERS).to_pylist()[1]) == "ok"


def test_tokens_equal_another_pattern_that_says_the_same(spark):
    """The built-in pattern is cut in the tasks, any other by Spark's regular expression; n_prompt, offsets and ids agree."""
    rows = [(i, (t or "")[:j], t, f"c{i}") for i, t in enumerate(odd_texts(400)) for j in (0, 3)] + [(9, None, "a b", "x"), (9, None, None, "y")]
    df = spark.createDataFrame(rows, "sample_id long, prompt_text string, full_text string, more string").repartition(3)
    other = f"(?:{PIECE_RE})"
    vocab, vocab2 = build_vocab(df), build_vocab(df, pattern=other)
    assert sorted(map(tuple, vocab.collect())) == sorted(map(tuple, vocab2.collect()))
    key = lambda r: (r[0], r[1], str(r))
    got, want = (sorted(map(tuple, tokenize(df, vocab, max_len=6, offsets=True, carry=("more",), chunk_samples=50, **kw).collect()), key=key)
                 for kw in ({}, {"pattern": other}))
    assert got == want and len(got) == len(rows)


def test_words_and_counts(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "k long, t string").coalesce(1)
    low = df.select(F.lower("t").alias("t"), F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0).alias("w")).collect()
    row, words = split_words(pa.array([r.t for r in low], pa.string()), char_classes(spark).value)
    want = [(i, w) for i, r in enumerate(low) for w in r.w]
    assert list(zip(row.tolist(), words.to_pylist())) == want
    distinct = sorted({w for _, w in want})
    by_spark = {r.w: r.h for r in spark.createDataFrame([(w,) for w in distinct], "w string").select("w", hash_u32(42, F.col("w"), "embed").alias("h")).collect()}
    assert dict(zip(distinct, hash_words(42, pa.array(distinct), "embed").tolist())) == by_spark
    got = embed_counts(df, "k", "t", dim=16, seed=42).collect()
    assert len(got) == len(texts)
    for i, r in enumerate(got):
        vec = np.zeros(16)
        np.add.at(vec, [by_spark[w] % 16 for w in low[i].w], 1)
        assert r.k == i // 2 and r.embedding == vec.tolist()


def test_long_texts_are_cut_at_once(spark):
    """Time of a megabyte of words: hashing or matching word by word took some seconds."""
    classes = char_classes(spark).value
    texts = pa.array(["the quick brown fox jumps over the lazy dog 12 times. " * 400] * 50)
    start = time.perf_counter()
    row, words = split_words(texts, classes)
    hash_words(1, words.dictionary_encode().dictionary, "embed")
    assert len(row) == 50 * 400 * 11 and len(split_pieces(texts, classes, MARKERS).flatten()) == 50 * (400 * 12 + 1)
    assert time.perf_counter() - start < 2
