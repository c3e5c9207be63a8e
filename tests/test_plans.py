"""Physical-plan properties the design relies on (executed plans, after AQE)."""

from conftest import SF_SMALL


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_query_pairs_all_rows(spark):
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_topk_limits_before_the_exchange(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["knn_topk"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "MapInArrow" in plan
    # the partial limit sits below the exchange on query_id
    assert plan.index("Exchange hashpartitioning(query_id") < plan.rindex("WindowGroupLimit")


def test_slice_filter_reaches_the_scan(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["corpus_slice"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(doc_id" in plan and "LessThanOrEqual(doc_id" in plan


def test_scoring_reads_only_needed_columns(spark):
    import __spark_entry__ as E
    plan = _plan(E.queries()["knn_topk"](spark, SF_SMALL))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
