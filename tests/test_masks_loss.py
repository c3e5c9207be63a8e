from pyspark.sql import functions as F

from relq.functions import masks as M
from relq.functions.vectors import l2_normalize
from relq.operators.loss import weighted_loss


def _ids(spark, n=10):
    return spark.createDataFrame([(list(range(n)),)], "ids array<int>")


def _kept(arr):
    return [i for i, x in enumerate(arr) if x != M.IGNORE]


def test_stage_masks_literal_rows(spark):
    df = _ids(spark)
    r = df.select(M.mask_stage1(F.col("ids"), F.lit(3), F.lit(True)).alias("a"),
                  M.mask_stage2(F.col("ids"), F.lit(3), F.lit(True)).alias("b"),
                  M.mask_stage1(F.col("ids"), F.lit(3), F.lit(False)).alias("c"),
                  M.mask_stage2(F.col("ids"), F.lit(3), F.lit(False)).alias("d"),
                  M.mask_answer(F.col("ids"), F.lit(3)).alias("e")).first()
    assert _kept(r["a"]) == [3, 4, 5, 6, 7]
    assert _kept(r["b"]) == [8, 9]
    assert _kept(r["c"]) == [] and _kept(r["d"]) == []
    assert _kept(r["e"]) == list(range(3, 10))
    # stage masks are disjoint and together cover the answer
    assert set(_kept(r["a"])) | set(_kept(r["b"])) == set(_kept(r["e"]))


def test_prompt_fills_window(spark):
    df = _ids(spark, 192)
    r = df.select(M.mask_stage1(F.col("ids"), F.lit(192), F.lit(True)).alias("a")).first()
    assert _kept(r["a"]) == []


def test_padding_literal(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4],)], "ids array<int>")
    out = df.select(M.pad(F.col("ids"), F.lit(4), M.IGNORE).alias("l"), M.attention(F.size("ids"), F.lit(4)).alias("a"),
                    M.pad(F.transform("ids", lambda x: x.cast("double")), F.lit(4), 0.0).alias("w")).collect()
    assert out[0]["l"] == [1, 2, -100, -100] and out[0]["a"] == [1, 1, 0, 0] and out[0]["w"] == [1.0, 2.0, 0.0, 0.0]
    assert out[1]["l"] == [1, 2, 3, 4] and out[1]["a"] == [1, 1, 1, 1]


def test_weighted_loss_literal(spark):
    # nll (., 2, 4), weights (5, 1, 1), position 0 dropped by the shift: (2*1 + 4*1) / (1 + 1 + 1e-8)
    df = spark.createDataFrame([(0, [7, 8, 9], [5.0, 1.0, 1.0])], "batch_id long, labels array<int>, loss_weights array<double>")
    nll = lambda i: F.element_at(F.array(F.lit(99.0), F.lit(2.0), F.lit(4.0)), i + 1)
    r = weighted_loss(df, nll).first()
    assert abs(r["loss"] - 6 / (2 + 1e-8)) < 1e-12


def test_masked_label_keeps_weight_in_denominator(spark):
    df = spark.createDataFrame([(0, [7, -100, 9], [1.0, 5.0, 1.0])], "batch_id long, labels array<int>, loss_weights array<double>")
    r = weighted_loss(df, lambda i: F.lit(3.0)).first()
    assert abs(r["loss"] - 3.0 / (6 + 1e-8)) < 1e-12


def test_reference_anchor_weights(spark):
    # prompt 4 tokens ending at char 50, key at answer offset 0: 'reference' boosts tokens starting in [0, 30] of the full text
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [0, 10, 20, 40, 50, 60])], "ids array<int>, off array<int>")
    ref = df.select(M.loss_weights(F.col("ids"), F.lit(4), F.col("off"), F.lit(0), F.lit(50), anchor="reference")).first()[0]
    ans = df.select(M.loss_weights(F.col("ids"), F.lit(4), F.col("off"), F.lit(0), F.lit(50), anchor="answer")).first()[0]
    assert ref == [5.0, 5.0, 5.0, 0.0, 1.0, 1.0]
    assert ans == [0.0, 0.0, 0.0, 0.0, 5.0, 5.0]


def test_zero_vector_stays_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    out = [r[0] for r in df.select(l2_normalize(F.col("v"))).collect()]
    assert out[0] == [0.0, 0.0] and out[1] == [0.6, 0.8]
