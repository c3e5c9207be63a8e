import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from relq.operators import evaluation as ev
from relq.operators.gold import gold_flag, gold_rows
from relq.plans import jobs as JB
from relq.plans.answers import derive_answers
from relq.sources.jsonl import read_samples
from relq.sources.tables import read_corpus


def test_jobs_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="relq-test-jobs-")
    p = lambda n: os.path.join(d, n)
    read_corpus(spark, SF_SMALL).write.parquet(p("corpus"))
    n_docs = spark.read.parquet(p("corpus")).count()

    JB.generate_samples_job(spark, p("corpus"), p("eval.jsonl"), version=2)
    JB.generate_samples_job(spark, p("corpus"), p("v1.jsonl"), version=1, shuffle=True, stop="50%")
    s = read_samples(spark, p("eval.jsonl")).withColumnRenamed("line", "sample_id")
    assert s.count() == 2 * n_docs
    assert read_samples(spark, p("v1.jsonl")).count() == 2 * (n_docs * 50 // 100)

    JB.prepare_training_job(spark, p("eval.jsonl"), p("train_s1"), stage="s1")
    JB.prepare_training_job(spark, p("v1.jsonl"), p("train_v1"), stage="v1")
    b = spark.read.parquet(p("train_s1"))
    assert b.count() == 2 * n_docs
    assert b.where(F.size("input_ids") != F.col("max_len")).count() == 0
    assert "loss_weights" in spark.read.parquet(p("train_v1")).columns

    derive_answers(gold_rows(s)).select("sample_id", "answer").write.parquet(p("answers"))
    JB.evaluate_s1_job(spark, p("eval.jsonl"), p("answers"), p("s1"), head=100)
    head = s.where(F.col("sample_id") < 100)
    exp = ev.s1_accuracy(gold_flag(head), spark.read.parquet(p("answers"))).first()
    assert spark.read.parquet(p("s1")).first() == exp
    JB.evaluate_s2_job(spark, p("eval.jsonl"), p("answers"), p("s2"), head=100)
    assert spark.read.parquet(p("s2")).first()["samples"] == 100

    JB.build_index_job(spark, p("corpus"), p("index"), stop=None)
    JB.retrieval_eval_job(spark, p("index"), p("eval.jsonl"), p("rag"), n_queries=10)
    per_q = spark.read.parquet(p("rag"))
    assert per_q.count() == 10
    assert spark.read.parquet(p("rag_mean")).first()["queries"] == 10


def test_jobs_cli(spark):
    d = tempfile.mkdtemp(prefix="relq-test-cli-")
    read_corpus(spark, SF_SMALL).write.parquet(os.path.join(d, "corpus"))
    JB.main(["generate", os.path.join(d, "corpus"), os.path.join(d, "v1.jsonl"), "--opt", "version=1",
             "--opt", "stop=10"])
    rows = read_samples(spark, os.path.join(d, "v1.jsonl")).collect()
    assert len(rows) == 20 and all('"reason": "' in r["output"] for r in rows)
