from pyspark.sql import functions as F

from conftest import SF_SMALL
from relq.functions.text import document_part, query_part, split_input
from relq.operators.sampling import make_samples
from relq.sources.tables import read_corpus
from relq.templates import LABEL_TO_QUERIES


def test_one_positive_k_negatives_other_labels(spark):
    corpus = read_corpus(spark, SF_SMALL)
    for k in (1, 3):
        s = make_samples(corpus, num_negatives=k)
        per_doc = s.groupBy("doc_id").agg(F.count_if("relevant").alias("p"), F.count_if(~F.col("relevant")).alias("n"),
                                          F.count_if(~F.col("relevant") & (F.col("query_label") == F.col("label"))).alias("bad"),
                                          F.countDistinct("query_label").alias("labels"))
        bad = per_doc.where((F.col("p") != 1) | (F.col("n") != k) | (F.col("bad") > 0) | (F.col("labels") != k + 1))
        assert bad.count() == 0
        assert s.select("sample_id").distinct().count() == s.count() == corpus.count() * (k + 1)


def test_input_round_trip_and_query_template(spark):
    corpus = read_corpus(spark, SF_SMALL)
    s = make_samples(corpus).select("sample_id", "doc_id", "query_label", "input")
    p = s.join(corpus.select("doc_id", "text"), "doc_id").withColumn("_p", split_input(F.col("input")))
    p = p.withColumn("q", query_part(F.col("_p"))).withColumn("d", document_part(F.col("_p")))
    rows = p.select("query_label", "q", "d", "text").collect()
    for r in rows:
        assert r["q"] in LABEL_TO_QUERIES[r["query_label"]]
        assert r["d"] == r["text"].strip()


def test_partition_independent(spark):
    corpus = read_corpus(spark, SF_SMALL)
    ref = sorted(make_samples(corpus).collect())
    for n in (1, 4, 200):
        assert sorted(make_samples(corpus.repartition(n)).collect()) == ref


def test_k_too_large_rejected(spark):
    import pytest
    with pytest.raises(ValueError):
        make_samples(read_corpus(spark, SF_SMALL), num_negatives=4)


def test_v1_outputs_refused_by_v2_loader(spark):
    import pytest
    from relq.operators.gold import gold_rows
    v1 = make_samples(read_corpus(spark, SF_SMALL), version=1)
    assert gold_rows(v1, on_mismatch="drop").count() == 0
    with pytest.raises(Exception):
        gold_rows(v1).collect()
    v2 = make_samples(read_corpus(spark, SF_SMALL), version=2)
    assert gold_rows(v2).count() == v2.count()


def test_gold_is_one_json_value_with_every_key(spark):
    import pytest
    from relq.operators.gold import gold_flag, gold_rows
    good = '{"relevant": true, "reason": {"query_topic": "a", "document_topic": null, "summary": null}}'
    outputs = [good, good + " x", good[:-5], '{"relevant": true, "reason": {"query_topic": "a", "summary": "s"}}',
               '{"relevant": 1, "reason": {"query_topic": "a", "document_topic": "b", "summary": "s"}}', "", None]
    df = spark.createDataFrame([(i, "i", "Query: q\nDocument: d", o) for i, o in enumerate(outputs)] + [(9, "i", "no separator", "junk")],
                               "sample_id long, instruction string, input string, output string")
    kept = gold_rows(df, on_mismatch="drop").collect()
    assert [(r.sample_id, r.gold_query_topic, r.gold_summary) for r in kept] == [(0, "a", None)]
    for i in range(1, len(outputs)):
        with pytest.raises(Exception):
            gold_rows(df.where(f"sample_id = {i}")).collect()
    assert gold_rows(df.where("sample_id in (0, 9)")).count() == 1  # an input that cannot be split is skipped first
    assert [r.sample_id for r in gold_flag(df).orderBy("sample_id").collect()] == [0, 3]


def test_head_rows(spark):
    import pytest
    from relq.operators.positions import head_rows
    corpus = read_corpus(spark, SF_SMALL)
    ids = sorted(r[0] for r in corpus.select("doc_id").collect())
    assert [r[0] for r in head_rows(corpus, "doc_id", 5).select("doc_id").collect()] == ids[:5]
    with pytest.raises(ValueError):
        head_rows(corpus, "doc_id", len(ids) + 1, require_full=True)


def test_draws_are_roughly_uniform(spark):
    from collections import Counter
    s = make_samples(read_corpus(spark, "/root/testdata/sf0.01")).collect()
    neg = Counter((r["label"], r["query_label"]) for r in s if not r["relevant"])
    for lab in range(4):
        others = [neg[(lab, o)] for o in range(4) if o != lab]
        total = sum(others)
        if total >= 100:  # skewed classes still draw each other label about a third of the time
            assert all(0.2 < c / total < 0.47 for c in others), (lab, others)
    instr = Counter(r["instruction"] for r in s)
    assert len(instr) == 4 and all(0.18 < c / len(s) < 0.32 for c in instr.values())


def test_fixed_vocabulary_json_refuses_escapes(spark):
    import pytest
    from pyspark.sql import functions as F
    from relq.functions.jsonfmt import json_fixed
    with pytest.raises(ValueError):
        json_fixed(F.col("x"), ['a "quoted" word'])
    df = spark.createDataFrame([("world",), (None,)], "x string")
    assert [r[0] for r in df.select(json_fixed(F.col("x"), ["world"])).collect()] == ['"world"', "null"]
