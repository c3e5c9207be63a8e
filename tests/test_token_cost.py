"""What the token queries must not do twice or token by token, and that their results stay the same (round 3, F8, F9, F10, F14)."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relq.functions import masks as M
from relq.operators import batches as B
from relq.operators.chat import answer_key_index
from relq.operators.loss import row_sums
from relq.operators.tokens import build_vocab, cut_texts, tokenize
from relq.plans import registry


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark, n=300):
    rows = [(i % 250, f"w{i % 7}", None if i % 50 == 9 else f"w{i % 7} x{i % 31} é {'long ' * (i % 5)}end<|im_end|>") for i in range(n)]
    return spark.createDataFrame(rows, "sample_id long, prompt_text string, full_text string").repartition(3)


def test_texts_are_cut_once_for_vocabulary_and_ids(spark):
    df, read = texts(spark), spark.sparkContext.accumulator(0)

    @F.arrow_udf("string")
    def seen(t: pa.Array) -> pa.Array:
        read.add(len(t))
        return t

    cut = cut_texts(df.withColumn("full_text", seen("full_text")), max_len=6, chunk_samples=40)
    got = sorted(map(tuple, tokenize(cut, build_vocab(cut), offsets=True).collect()), key=str)
    assert read.value == df.count() == len(got)
    vocab = build_vocab(df)
    assert sorted(map(tuple, build_vocab(cut).collect())) == sorted(map(tuple, vocab.collect()))
    assert got == sorted(map(tuple, tokenize(df, vocab, max_len=6, offsets=True).collect()), key=str)


def test_no_texts(spark):
    for df in (texts(spark).where("false"), texts(spark).withColumn("full_text", F.lit(None).cast("string"))):
        cut = cut_texts(df)
        assert build_vocab(cut).count() == 0
        out = tokenize(cut, build_vocab(cut), offsets=True).collect()
        assert len(out) == df.count() and all(r.input_ids == [] and r.offsets == [] and r.n_full_untruncated == 0 for r in out)


def test_pieces_the_vocabulary_lacks_have_null_ids_and_offsets(spark):
    df = spark.createDataFrame([(1, "a", "a bb c")], "sample_id long, prompt_text string, full_text string")
    vocab = spark.createDataFrame([("a", 1, 0), (" c", 1, 1)], "piece string, count long, id long")
    r = tokenize(df, vocab, offsets=True).first()
    assert r.input_ids == [0, None, 1] and r.offsets == [0, 1, 4] and r.n_prompt == 1


def test_queries_run_no_lambda_over_tokens(spark, tmp_path):
    """Masks, weights and their texts ran a lambda for every token of every sample."""
    docs = spark.createDataFrame([(i, f"some words {i} of a text", "en", "s", 20) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("bucketed_batches", "loss_weights", "label_masks_s2"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        assert "lambda" not in plan(df).lower(), name
        assert df.count() == 24


def test_batches_shuffle_token_rows_once(spark):
    rows = spark.createDataFrame([(k, list(range(n)), list(range(n)), 7) for k, n in [(0, 3), (1, 1), (1, 5), (2, 2), (4, 4), (None, 9)]],
                                 "sample_id long, input_ids array<int>, labels_s1 array<int>, eos_id int")
    keys = rows.select("sample_id", F.size("input_ids").alias("n"))
    a, b = B.padded_batches(rows, 2, keys=keys), B.padded_batches(rows, 2, keys=keys, lengths="n")
    window = "definition(batch_id"  # it sorted and shuffled the token rows again
    assert window in plan(a) and window not in plan(b) and window not in plan(B.bucketed_batches(rows, [2, 4], 2))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == r.max_len for r in b.collect())


def test_masks_with_odd_bounds(spark):
    ids = [5, None, 7, 8]
    for s, found in ((None, True), (0, True), (2, None), (2, False), (9, True), (1, True)):
        df = spark.createDataFrame([(ids, s, found)], "ids array<int>, s int, f boolean")
        r = df.select(M.mask_stage1(F.col("ids"), F.col("s"), F.col("f"), 2).alias("a"), M.mask_stage2(F.col("ids"), F.col("s"), F.col("f"), 2).alias("b"),
                      M.mask_answer(F.col("ids"), F.col("s")).alias("c")).first()
        on = found is True and s is not None
        assert r.a == [x if on and s <= i < s + 2 else -100 for i, x in enumerate(ids)]
        assert r.b == [x if on and i >= s + 2 else -100 for i, x in enumerate(ids)]
        assert r.c == [x if s is not None and i >= s else -100 for i, x in enumerate(ids)]


def test_weights_with_odd_bounds(spark):
    off = [0, 3, None, 40]
    rows = [(s, k) for s in (None, 0, 2, 9) for k in (None, -1, 0, 3)]
    df = spark.createDataFrame([(i, [1, 2, 3, 4], s, off, k) for i, (s, k) in enumerate(rows)], "i int, ids array<int>, s int, off array<int>, k int")
    got = df.select("i", M.loss_weights(F.col("ids"), F.col("s"), F.col("off"), F.col("k"), F.lit(2)).alias("w")).collect()
    for i, w in got:
        s, k = rows[i]
        assert w == [5.0 if k is not None and k >= 0 and o is not None and k + 2 <= o <= k + 32 else 1.0 if s is not None and j >= s else 0.0
                     for j, o in enumerate(off)]
    short = spark.createDataFrame([([1, 2], 0, [0], 0)], "ids array<int>, s int, off array<int>, k int")
    with pytest.raises(Exception, match="fewer offsets"):
        short.select(M.loss_weights(F.col("ids"), F.col("s"), F.col("off"), F.col("k"), F.lit(2))).collect()


def test_texts_of_arrays(spark):
    odd = [[], None, [1.0, 0.0, 5.0], [-0.0, None, 3.0], [0.1, 1.0], [1e7], [float("nan"), float("inf")], [1e-5, 9999999.0]]
    df = spark.createDataFrame([(i, w, None if w is None else [None if x is None or not math.isfinite(x) else int(x) for x in w]) for i, w in enumerate(odd)],
                               "i int, w array<double>, n array<int>")
    for new, arr in ((M.doubles_as_text, "w"), (M.ints_as_text, "n")):
        assert all(a == b for a, b in df.select(new(F.col(arr)), M.as_text(F.col(arr))).collect())


def test_loss_sums_over_unmasked_positions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 8))
        rows.append((i, [int(x) for x in rng.choice([-100, 5, 6], n)], [float(x) for x in rng.choice([0.0, 1.0, 5.0, math.inf], n, p=[.4, .4, .15, .05])]))
    df = spark.createDataFrame(rows, "k int, l array<int>, w array<double>")
    num, den = row_sums(F.col("l"), F.col("w"), lambda i: F.col("k") + i / 4)
    for k, a, b in df.select("k", num, den).collect():
        _, labels, weights = rows[k]
        if not labels:
            assert a is None and b is None
            continue
        terms = [(0.0 if x == -100 else k + t / 4) * w for t, (x, w) in enumerate(zip(labels, weights)) if t]
        assert str(a) == str(float(sum(terms))) and b == sum(weights[1:])


def test_answer_key_is_found_by_bytes(spark):
    rows = [("é😀 ", 'é😀 ß "k": 1', 3), ("a", 'a"k"', 0), ("a", "b none", -1), ("x", 'yé"k"', 1), (None, "k", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, f string")
    got = df.select(answer_key_index(F.col("p"), F.col("f"), '"k"')).collect()
    assert [r[0] for r in got] == [2, 0, -1, 1, None] and len(rows) == len(got)
