"""Streams with state: distinct queries in first-seen order, answers that come late, twice or never."""

import datetime as dt
import os

import pytest
from conftest import SF_SMALL

from relq.operators import evaluation as ev
from relq.operators import retrieval as rt
from relq.operators.gold import gold_flag
from relq.plans import registry as R
from relq.streaming import arrivals as AR
from relq.streaming import distinct as DS


def write(spark, rows, schema, path, order):
    """One file, made visible after those of a smaller ``order``."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)
    for f in os.listdir(path):
        full = os.path.join(path, f)
        if f.endswith(".json") and os.path.getmtime(full) > 2_000_000:
            os.utime(full, (1_000_000 + order, 1_000_000 + order))


@pytest.mark.parametrize("order", ["as read", "backwards"])
def test_first_queries_however_files_are_cut(spark, tmp_path, order):
    s = R.samples(spark, SF_SMALL)
    want = [tuple(r) for r in rt.first_queries(s, 10).orderBy("query_rank").collect()]
    rows = [(r.sample_id, r.input) for r in s.select("sample_id", "input").orderBy("sample_id").collect()]
    rows = rows if order == "as read" else rows[::-1]
    src = str(tmp_path / "in")
    for i in range(0, len(rows), 150):
        write(spark, rows[i:i + 150], DS.SAMPLE_SCHEMA, src, i)
    DS.run_to_log(DS.first_seen(DS.read_sample_stream(spark, src, max_files_per_trigger=1)), str(tmp_path / "log"), str(tmp_path / "ck"))
    assert [tuple(r) for r in DS.ordered_queries(spark, str(tmp_path / "log"), 10).orderBy("query_rank").collect()] == want
    every = DS.ordered_queries(spark, str(tmp_path / "log")).collect()
    assert len(every) == rt.first_queries(s, None).count()


def test_late_rows_and_restart(spark, tmp_path):
    """A sample that arrives after a restart may come first: state and log are kept."""
    src, log, ck = (str(tmp_path / x) for x in ("in", "log", "ck"))
    line = lambda i, q: (i, f"Query: {q}\nDocument: d")
    write(spark, [line(5, "b"), line(7, "a"), (8, "no separator"), (None, "Query: x\nDocument: d"), (9, None)], DS.SAMPLE_SCHEMA, src, 1)
    run = lambda: DS.run_to_log(DS.first_seen(DS.read_sample_stream(spark, src)), log, ck)
    run()
    assert [r.query for r in DS.ordered_queries(spark, log).orderBy("query_rank").collect()] == ["b", "a"]
    write(spark, [line(2, "a"), line(6, "b"), line(3, "c")], DS.SAMPLE_SCHEMA, src, 2)
    run()
    assert [tuple(r) for r in DS.ordered_queries(spark, log, 2).orderBy("query_rank").collect()] == [("a", 2, 1), ("c", 3, 2)]


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


GOLD, ANSWER = AR.GOLD_SCHEMA, AR.ANSWER_SCHEMA
END = dt.datetime(2030, 1, 1)


@pytest.mark.parametrize("files", [None, 1])
def test_arrivals_equal_batch(spark, tmp_path, files):
    g, a, out = (str(tmp_path / x) for x in ("g", "a", "out"))
    yes, no = '{"relevant": true}', '{"relevant": false}'
    write(spark, [(i, i % 2 == 0, at(i)) for i in range(10)], GOLD, g, 1)
    write(spark, [(0, yes, at(5)), (1, yes, at(6)), (2, "no json", at(7)), (0, no, at(8))], ANSWER, a, 1)  # 0 answers twice
    write(spark, [(i, i % 2 == 0, at(i)) for i in range(10, 20)], GOLD, g, 2)
    write(spark, [(3, no, at(200)), (11, no, at(30)), (12, yes, at(12 + 3599)), (14, yes, at(14 + 3601)), (99, yes, at(40))], ANSWER, a, 2)  # 14 too late, 99 unknown
    write(spark, [(-1, True, END)], GOLD, g, 3)
    write(spark, [(-2, "", END)], ANSWER, a, 3)
    streams = [AR.read_stream(spark, p, s, files) for p, s in ((g, GOLD), (a, ANSWER))]
    AR.run_to_epochs(AR.scored_arrivals(*streams), out, str(tmp_path / "ck"))
    got = {r.sample_id: r.pred for r in spark.read.parquet(out).collect()}
    assert got == {**{i: None for i in range(20)}, 0: True, 1: True, 3: False, 11: False, 12: True}
    assert spark.read.parquet(out).count() == 20
    answers = spark.createDataFrame([(0, yes), (1, yes), (2, "no json"), (3, no), (11, no), (12, yes)], "sample_id long, answer string")
    gold = spark.createDataFrame([(i, i % 2 == 0) for i in range(20)], "sample_id long, gold boolean")
    assert AR.accuracy_of(spark, out).first() == ev.s1_accuracy(gold, answers).first()


def test_registered_arrivals_equal_batch(spark):
    batch = ev.s1_accuracy(gold_flag(R.eval_samples(spark, SF_SMALL)), R.answers(spark, SF_SMALL)).first()
    assert R.QUERIES["s1_accuracy_arrivals"](spark, SF_SMALL).first() == batch and batch.failed > 0
