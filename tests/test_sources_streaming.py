import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relq.operators.gold import gold_flag, gold_rows
from relq.plans.answers import derive_answers
from relq.plans import registry as R
from relq.sources import jsonl as JL
from relq.streaming import scoring as ST
from relq.operators import evaluation as ev

GOOD = {"instruction": "i", "input": "Query: a\nDocument: b",
        "output": '{"relevant": true, "reason": {"query_topic": "world", "document_topic": "world", "summary": "s"}}'}


def _write_lines(lines):
    d = tempfile.mkdtemp(prefix="relq-test-jsonl-")
    with open(os.path.join(d, "part-00000.json"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_limit_counts_lines_read(spark):
    bad = dict(GOOD, input="Query: a Document: b")  # valid JSON, input cannot be split
    d = _write_lines([json.dumps(GOOD), json.dumps(bad), json.dumps(GOOD)])
    head = JL.read_samples(spark, d, limit=2)
    assert head.count() == 2
    rows = gold_rows(head.withColumnRenamed("line", "sample_id"))
    assert rows.count() == 1


def test_failfast_on_non_json_line(spark):
    d = _write_lines([json.dumps(GOOD), "not json"])
    with pytest.raises(Exception):
        JL.read_samples(spark, d).collect()


@pytest.mark.parametrize("tail", ["", json.dumps(GOOD) + " trailing", json.dumps(GOOD) + "{}", '{"instruction": "i"}', "[1]", '"text"',
                                  json.dumps(dict(GOOD, input=None)), json.dumps(dict(GOOD, output=3))])
def test_every_line_must_be_one_sample(spark, tail):
    d = _write_lines([json.dumps(GOOD), tail, json.dumps(GOOD)])
    with pytest.raises(Exception):
        JL.read_samples(spark, d).collect()
    assert JL.read_samples(spark, d, limit=1).count() == 1  # lines beyond the limit are not read


def test_lines_follow_part_numbers(spark):
    d = tempfile.mkdtemp(prefix="relq-test-parts-")
    for part in ("part-99999-x.txt", "part-100000-x.txt", "part-00002-x.txt"):
        with open(os.path.join(d, part), "w", encoding="utf-8") as f:
            for i in range(3):
                f.write(json.dumps(dict(GOOD, instruction=f"{part[5:-6]} {i}")) + "\n")
    rows = JL.read_samples(spark, d).orderBy("line").collect()
    assert [r.line for r in rows] == list(range(9))
    assert [r.instruction for r in rows] == [f"{p} {i}" for p in ("00002", "99999", "100000") for i in range(3)]
    assert [r.instruction for r in JL.read_samples(spark, d, limit=4).orderBy("line").collect()] == ["00002 0", "00002 1", "00002 2", "99999 0"]


def test_large_files_are_numbered_across_blocks(spark):
    d = _write_lines([json.dumps(dict(GOOD, instruction=str(i))) for i in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = JL.read_samples(spark, d).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20_000 and all(str(r.line) == r.instruction for r in rows)


def test_line_index_is_small_and_serves_later_reads(spark, tmp_path):
    d = _write_lines([json.dumps(dict(GOOD, instruction=str(i), input=GOOD["input"] + "x" * 400)) for i in range(20_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        JL.write_line_index(spark, d, str(tmp_path / "index"))
        index = spark.read.parquet(str(tmp_path / "index"))
        assert index.count() > 10 and index.agg(F.sum("lines")).first()[0] == 20_000
        rows = JL.read_samples(spark, d, index_path=str(tmp_path / "index")).collect()
        assert len(rows) == 20_000 and all(str(r.line) == r.instruction for r in rows)
        head = JL.read_samples(spark, d, limit=30, index_path=str(tmp_path / "index")).collect()
        assert sorted(r.line for r in head) == list(range(30))
        size = lambda p: sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(p) for f in fs)
        assert size(tmp_path / "index") < 0.01 * size(d)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")  # other blocks: refused, not misnumbered
        with pytest.raises(Exception, match="does not fit"):
            JL.read_samples(spark, d, index_path=str(tmp_path / "index")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_lines_are_python_json(spark):
    s = R.samples(spark, SF_SMALL).orderBy("sample_id").limit(20)
    d = tempfile.mkdtemp(prefix="relq-test-out-")
    JL.write_samples(s, os.path.join(d, "s"))
    got = [r["value"] for r in spark.read.text(os.path.join(d, "s")).collect()]
    exp = [json.dumps({"instruction": r["instruction"], "input": r["input"], "output": r["output"]},
                      ensure_ascii=False) for r in s.collect()]
    assert sorted(got) == sorted(exp)


def test_stream_matches_batch(spark):
    s = R.samples(spark, SF_SMALL)
    g = gold_rows(s)
    answers = derive_answers(g)
    d = tempfile.mkdtemp(prefix="relq-test-stream-")
    answers.select("sample_id", "answer").write.json(os.path.join(d, "in"))
    stream = ST.read_answer_stream(spark, os.path.join(d, "in"), max_files_per_trigger=1)
    ST.run_to_table(ST.s1_metrics(stream, gold_flag(s)), os.path.join(d, "out"), os.path.join(d, "ckpt"))
    got = spark.read.parquet(os.path.join(d, "out")).first().asDict()
    exp = ev.s1_accuracy(gold_flag(s), answers).first().asDict()
    assert got == exp


def test_scored_answers_stream_is_stateless(spark):
    s = R.samples(spark, SF_SMALL)
    g = gold_rows(s)
    d = tempfile.mkdtemp(prefix="relq-test-stream2-")
    derive_answers(g).select("sample_id", "answer").write.json(os.path.join(d, "in"))
    stream = ST.read_answer_stream(spark, os.path.join(d, "in"))
    scored = ST.scored_answers(stream, g)
    assert scored.isStreaming
    q = (scored.writeStream.format("memory").queryName("relq_scored_test").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    n = spark.table("relq_scored_test").count()
    assert n == g.count()
