from conftest import SF_CHECK
from test_decontam import brute as brute_hits
from test_packing import check, reference
from test_simhash import brute_components, brute_fp

import corpus_pipeline as C
from relq.llm import packing as P


def test_stages_decide_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()]
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality classifier", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, SF_CHECK))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items() and 0.5 < len(after) / len(before) <= 1
        ids = sorted(before)
        if name == "simhash near-dedup":
            comp = brute_components(ids, [brute_fp(before[i]) for i in ids])
            assert set(after) == {i for i, c in zip(ids, comp) if i == c}
        if name == "benchmark decontamination":
            hits = brute_hits(list(before.items()), bench)
            assert set(after) == {i for (i, _), v in hits.items() if not v[1]}
        before = after
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.tokenizer_path())
    out = C.STAGES[-1][1](spark, docs, SF_CHECK).collect()
    check(out, {i: reference(t, tok) for i, t in before.items()})
    again = C.run(spark, SF_CHECK).collect()
    assert {(r.doc_id, r.piece, r.length) for r in again} == {(r.doc_id, r.piece, r.length) for r in out}


def test_odd_documents(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b c d", "en", "s", 7), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    tables = {"documents": docs, "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
              "benchmark": spark.createDataFrame([], "item_id long, text string")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).collect()} == {None, 1, 2}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
