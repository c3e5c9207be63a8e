"""Extra columns of any name break no operator and no stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relq.llm import chatmask, decontam, hardneg, langid, minhash, packing, quality, sharding, simhash, substrings, suffixtree, toxicity, whitening
from relq.llm.common import training_row, unused

NAMES = ("label __id __hash sequence_id offset length score words fp shard block piece k1 k2 t h m w n c id __doc __text __kept lang_pred "
         "__lang predicted chunk cost training component_id doc found spans items __pos slot").split()


def crowded(df):
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES) if n not in df.columns))


@pytest.fixture(scope="module")
def tables(spark):
    text = ["you are a stupid fool and they know", "a calm and quiet day by the sea", None, "", "the same line of ten words is here for all to see", "½ ² ①"]
    docs = spark.createDataFrame([(i, text[i % len(text)], "en" if i % 2 else "de", "s", 3) for i in range(60)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("i1", "the same line of ten words is here for all"), (None, "x")], "item_id string, text string")
    emb = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(200)], "vec_id long, embedding array<float>, label int")
    conv = spark.createDataFrame([(i // 2, i % 2, ("user", "assistant")[i % 2], "hello") for i in range(10)], "conv_id long, turn int, role string, text string")
    return docs, labels, bench, emb, conv


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_operators(tables):
    docs, labels, bench, emb, conv = tables
    more, known = crowded(docs), crowded(labels)
    train = training_row(F.col("doc_id"), 7, 2)
    path = packing.tokenizer_path()
    calls = [
        lambda d, y: sharding.shard_by_bytes(d, 3),
        lambda d, y: quality.score_quality(d, quality.fit_quality(d, y)),
        lambda d, y: minhash.neighbour_fingerprints(d),
        lambda d, y: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, y)),
        lambda d, y: packing.pack(packing.token_pieces(d, path)).groupBy("doc_id", "piece").count(),
        lambda d, y: suffixtree.score_texts(d, train),
        lambda d, y: langid.predict_language(d, langid.fit_language(d)),
        lambda d, y: decontam.benchmark_hits(d, crowded(bench))[1].select("doc_id", "n_hit", "items"),
        lambda d, y: simhash.simhash_components(d),
        lambda d, y: substrings.remove_repeats(d, window=3, k=2),
    ]
    for call in calls:
        same(call(docs, labels), call(more, known))
    crowd = emb.select("*", *(F.lit(1).alias(n) for n in NAMES if n not in emb.columns))
    same(whitening.whiten(emb).selectExpr("vec_id", "component", "deviation"), whitening.whiten(crowd).selectExpr("vec_id", "component", "deviation"))
    same(hardneg.mine_hard_negatives(emb), hardneg.mine_hard_negatives(crowd))
    talk = conv.select("*", *(F.lit(1).alias(n) for n in NAMES if n not in conv.columns))
    same(chatmask.read_back(chatmask.format_conversations(conv, path)), chatmask.read_back(chatmask.format_conversations(talk, path)))


def test_filters_keep_all_columns(tables):
    docs, labels, bench, _, _ = tables
    more, known = crowded(docs), crowded(labels)
    for keep in (lambda d, y: toxicity.reject_toxic(d, toxicity.fit_toxicity(d, y)),
                 lambda d, y: quality.reject_low_quality(d, quality.fit_quality(d, y)),
                 lambda d, y: simhash.drop_near_duplicates(d),
                 lambda d, y: decontam.drop_contaminated(d, bench)):
        a, b = keep(docs, labels), keep(more, known)
        assert a.columns == docs.columns and b.columns == more.columns
        same(a.select("doc_id", "text"), b)
    pieces = crowded(packing.token_pieces(docs, packing.tokenizer_path()))
    out = packing.pack(pieces)
    assert [c for c in out.columns if c not in ("sequence_id", "offset")] == [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    assert out.columns[-2:] == ["sequence_id", "offset"] and out.count() == pieces.count()


def test_pipeline(spark, tables, tmp_path):
    docs, labels, bench, _, _ = tables
    for name, df in (("documents", crowded(docs)), ("labels", crowded(labels)), ("benchmark", crowded(bench))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/plain/{name}.parquet")
    out, plain = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, f"{tmp_path}/plain")
    same(plain.select("doc_id", "piece", "length", "ids_crc32"), out.select("doc_id", "piece", "length", "ids_crc32"))


def test_unused_names(spark):
    df = spark.createDataFrame([(1, 2)], "A int, a_ int")
    assert unused(df, "a", "a", "b") == ["a__", "a___", "b"]
