"""Plan-shape checks for the scale properties the README claims."""
import __spark_entry__ as E
from webloom.plans import QUERIES

from conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "Join Cross")


def _physical(df):
    df.collect()   # run it, so the adaptive plan is final
    return df._jdf.queryExecution().executedPlan().toString()


def _logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_pair_products_anywhere_in_similarity_and_retrieval(spark):
    q = E.queries()
    for name in ("knn_top4", "knn_top4_group", "similar_pairs", "best_answer",
                 "lexical_top4", "ask_context"):
        plan = _physical(q[name](spark, SF001))
        assert not any(f in plan for f in FORBIDDEN), name


def test_first_per_key_is_an_aggregate_not_a_window(spark):
    plan = _logical(E.queries()["first_answer"](spark, SF001))
    assert "Aggregate" in plan and "Window" not in plan


def test_top_k_has_partial_group_limit(spark):
    plan = _physical(E.queries()["lexical_top4"](spark, SF001))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_fresh_split_pushes_the_time_predicate(spark):
    plan = _physical(E.queries()["urls_fresh"](spark, SF001))
    scan = [ln for ln in plan.splitlines() if "events.parquet" in ln][0]
    assert "PushedFilters: [IsNotNull(ts), Great" in scan
    assert "LeftSemi" in plan


def test_scans_read_only_needed_columns(spark):
    plan = _physical(E.queries()["page_hosts"](spark, SF001))
    assert "ReadSchema: struct<url:string>" in plan


def test_no_registered_query_plans_a_cross_join_or_row_python_udf(spark):
    for name in QUERIES:
        plan = _physical(E.queries()[name](spark, SF001))
        for op in FORBIDDEN + ("BatchEvalPython",):
            assert op not in plan, (name, op)
