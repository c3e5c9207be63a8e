from pyspark.sql import functions as F

from relq.functions import jsonparse as J
from truth_table import CASES


def _frame(spark):
    return spark.createDataFrame([(c[0], c[1]) for c in CASES], "case string, answer string")


def test_truth_table_staged_forms(spark):
    df = _frame(spark).withColumn("relevant", F.lit(True))
    df = J.with_lenient_flag(df, "answer", "len")
    df = J.with_judge_flag(df, "answer", "j")
    df = J.with_strict_columns(df, "answer", "relevant")
    got = {r["case"]: (r["len"], int(r["json_valid"]), int(r["relevance_match"]), int(r["reason_complete"]), r["j"])
           for r in df.collect()}
    for case, _t, *exp in CASES:
        assert got[case] == tuple(exp), case


def test_gold_false_equality(spark):
    # 0 == False and false == False hold in Python; "false" == False does not
    rows = [('{"relevant": 0}', True), ('{"relevant": false}', True), ('{"relevant": "false"}', False),
            ('{"relevant": 0.0}', True), ('{"relevant": 1}', False)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "answer string").withColumn("relevant", F.lit(False))
    got = [r["relevance_match"] for r in J.with_strict_columns(df).collect()]
    assert got == [e for _, e in rows]


def test_reason_key_with_null_value_is_present(spark):
    df = spark.createDataFrame([('{"relevant": true, "reason": {"query_topic": null, "document_topic": "a", '
                                 '"summary": "s"}}',)], "answer string").withColumn("relevant", F.lit(True))
    r = J.with_strict_columns(df).first()
    assert r["reason_complete"] is True and r["gen_query_topic"] is None
