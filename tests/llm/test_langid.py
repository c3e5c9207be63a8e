import zlib

import numpy as np

from relq.llm import langid as L

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_calibration(spark):
    import __spark_entry__ as E
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = E.queries()["op8_language"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(want) and len(rows) == len(want)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out]
    right = np.array([r.lang_pred == want[r.doc_id] for r in own])
    assert right.mean() > 0.97
    assert abs(np.mean([r.score for r in own]) - right.mean()) < 0.05


def test_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit_language(docs)
    texts = [None, "", "123 ... !!", "\n", "the", "é", "the and of " * 100_000, "ß", "x" * 3]
    df = spark.createDataFrame([(i if i else None, t, "zz", 0.5) for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang_pred string, score double")
    out = L.predict_language(df, model).collect()
    assert len(out) == 18
    for r in out:
        assert (r.lang_pred == "und") == (r.doc_id in (None, 1, 2, 3)) and 0 <= r.score <= 1
        assert r.lang_pred in {"und", "en", "de", "fr", "es"}
    assert L.predict_language(df.limit(0), model).count() == 0
    for none in (docs.limit(0), docs.withColumn("lang", L.F.lit(None).cast("string")), docs.withColumn("doc_id", L.F.lit(None).cast("long"))):
        assert {r.lang_pred for r in L.predict_language(df, L.fit_language(none)).collect()} == {"und"}


def test_training_ignores_held_out_rows_and_other_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = L.fit_language(docs)
    wrong = docs.withColumn("lang", L.F.when(~L.training_row(L.F.col("doc_id"), 5, 0), "xx").otherwise(L.F.col("lang"))).withColumn("source", L.F.lit("q"))
    b = L.fit_language(wrong.repartition(5))
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_elastic_net_leaves_zeros():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(300):
        k = i % 3
        at = np.unique(np.concatenate([[10 + k], rng.integers(100, 400, 20)]))
        rows.append((at, np.full(len(at), 0.2)))
        y.append(k)
    w = L.ftrl(rows, np.array(y), 3, l1=0.5)
    assert (w == 0).mean() > 0.99 and all(w[10 + k].argmax() == k and w[10 + k, k] > 0 for k in range(3))
    z = rng.normal(size=(500, 3)) * 5
    y = np.array([rng.choice(3, p=np.exp(v / 2.5) / np.exp(v / 2.5).sum()) for v in z])
    assert 1.8 < L.fit_temperature(z, y) < 3.4


def test_idf_and_mix_do_not_move_with_the_cap(spark):
    rows = [(i, f"wort {'abcdefghij'[i % 10] * 3}", "de") for i in range(600)] + [(600 + i, "word " + "xyz"[i % 3] * 4, "en") for i in range(60)]
    rows += [(1000, "", "de"), (1001, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    df, n = np.zeros(L.BUCKETS), 0
    for _, text, _ in train:
        at, _ = L.grams(text)
        df[at] += 1
        n += len(at) > 0
    capped, whole = L.fit_language(docs, max_rows=40), L.fit_language(docs)
    for m in (capped, whole):
        np.testing.assert_allclose(m.idf, np.log((1 + n) / (1 + df)) + 1)
    # a text that says nothing (two equal unknown letters) gets the natural mix, not equal shares
    assert capped.predict("qq")[0] == whole.predict("qq")[0] == "de"
    assert abs(L.fit_temperature(np.array([[3.0, 0], [3.0, 0]]), np.array([0, 1]), np.array([9.0, 1])) - 3 / np.log(9)) < 0.01


def test_letters_and_marks():
    from relq.llm.langid import LanguageModel, grams
    for text in (None, "", "½ ² ①", "Ⅷ", "123 _ -", "\u0301 \u094d"):
        assert not len(grams(text)[0])
    model = LanguageModel(["x"], np.ones(1 << 16), np.ones(((1 << 16) + 1, 1)))
    assert model.predict("½ ² ① Ⅷ") == ("und", 0.0) and model.predict("é")[0] == "x"
    # a word keeps its marks: it is not its bare consonants
    assert set(grams("हिन्दी")[0]) != set(grams("ह न द")[0]) and grams("हिन्दी")[1].sum() > grams("हन द")[1].sum()
    assert set(grams("a1b")[0]) == set(grams("a½b")[0]) == set(grams("a b")[0])
