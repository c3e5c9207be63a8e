"""Results do not depend on partitioning; the similarity UDF equals difflib row for row."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from conftest import SF_SMALL
from relq.operators import evaluation as ev
from relq.operators import retrieval as rt
from relq.operators.gold import gold_flag, gold_rows
from relq.operators.sampling import make_samples
from relq.plans.answers import derive_answers
from relq.sources.tables import read_corpus, read_embeddings


def _metrics(corpus):
    s = make_samples(corpus)
    g = gold_rows(s)
    a = derive_answers(g)
    return ev.s1_accuracy(gold_flag(s), a).first(), ev.s2_rates(g, a).first()


def test_metrics_partition_independent(spark):
    corpus = read_corpus(spark, SF_SMALL)
    ref = _metrics(corpus)
    for n in (1, 4, 200):
        assert _metrics(corpus.repartition(n)) == ref


def test_knn_partition_independent(spark):
    emb = read_embeddings(spark, SF_SMALL)
    q = emb.orderBy("doc_id").limit(10).withColumnRenamed("doc_id", "query_id")
    index = emb.where(F.col("doc_id") >= 10)
    ref = sorted((r[0], r[1], r[2]) for r in rt.knn_topk(index, q).collect())
    for n in (1, 7, 50):
        assert sorted((r[0], r[1], r[2]) for r in rt.knn_topk(index.repartition(n), q).collect()) == ref


def test_similarity_udf_equals_difflib(spark):
    s = make_samples(read_corpus(spark, SF_SMALL))
    g = gold_rows(s)
    rows = ev.summary_scores(g, derive_answers(g)).join(
        ev.s2_scored(g, derive_answers(g)).select("sample_id", "gen_summary", "gold_summary"), "sample_id").collect()
    assert rows
    for r in rows:
        if r["gen_summary"] is None:
            assert r["similarity"] is None
        else:
            assert r["similarity"] == SequenceMatcher(None, r["gen_summary"], r["gold_summary"]).ratio()
