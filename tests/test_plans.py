"""Plan shapes of the registered queries (what Catalyst actually plans)."""

import re

import pytest

from rulescope.plans import registry
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")
SIDE_EFFECT_QUERIES = {"store_roundtrip", "stack_months", "store_catalogue", "rules_roundtrip", "csv_roundtrip",
                       "stream_rule_eval", "stream_matrix"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def initial_plan(df) -> str:
    # the physical plan with exchanges, before adaptive re-planning runs it
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def built(spark):
    return {name: fn(spark, SF_SMALL) for name, fn in registry.queries().items()}


def test_no_python_udf_and_no_cartesian(built):
    for name, df in built.items():
        p = plan(df)
        assert not any(n in p for n in PYTHON_NODES), name
        assert not any(n in p for n in BAD_JOINS), name


def test_matrix_is_one_exchange(built):
    p = initial_plan(built["matrix_two_key"])
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "partial_count" in p  # map-side pre-aggregation before the exchange


def test_totals_single_global_aggregate(built):
    p = initial_plan(built["kpi_totals"])
    assert "Generate inline" in p and p.count("Exchange SinglePartition") == 1


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_drilldown_filters_pushed_to_scan(built):
    p = formatted(built["drilldown"])
    pushed = re.search(r"PushedFilters: \[(.*)\]", p).group(1)
    assert "EqualTo(o_orderstatus,F)" in pushed and "EqualTo(o_orderpriority,1-URGENT)" in pushed


def test_column_pruning_reaches_scan(built):
    p = plan(built["kpi_by_cluster"])
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    cols = {c.split(":")[0] for c in schema.split(",")}
    assert "o_orderkey" not in cols and "o_orderdate" not in cols and "o_orderpriority" in cols


def test_topn_distribution_is_one_scan(built):
    p = initial_plan(built["distribution_topn"])
    assert "TakeOrderedAndProject(limit=10" in p
    assert p.count("FileScan") == 1 and "BroadcastExchange" not in p
    # pairs, then entities; both combined map-side
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2


def test_semi_join_broadcast_is_bounded(built):
    p = initial_plan(built["failure_long_topn"])
    assert "BroadcastExchange" in p and "TakeOrderedAndProject(limit=10" in p
    assert "LeftSemi" in p


def test_topk_uses_take_ordered(built):
    for name in ("deep_dive_topk", "worst_sites", "preview"):
        assert "TakeOrderedAndProject" in plan(built[name]), name


def test_failure_long_generates_only_failures(built):
    p = initial_plan(built["failure_long"])
    assert "Generate explode" in p and "Expand" not in p


def test_month_pivot_preaggregates_before_each_exchange(built):
    # (ids, period) then ids: two exchanges, each after a map-side partial
    # aggregate, so a hot site id is combined before it is shuffled.
    p = initial_plan(built["month_pivot"])
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2
    assert "partial_max" in p and "partial_pivotfirst" in p


def test_store_read_prunes_partitions(spark):
    df = registry.queries()["store_roundtrip"](spark, SF_SMALL)
    assert "source_year" in df.columns


FILTER_NODE = re.compile(r"(^|- )(\*\(\d+\) )?Filter ")


def _filters_below_aggregate(p: str) -> list[str]:
    lines = p.splitlines()
    first_agg = next(i for i, line in enumerate(lines) if "HashAggregate" in line)
    # filter nodes whose condition holds a rule flag expression (all use coalesce)
    return [line for line in lines[first_agg:] if FILTER_NODE.search(line) and "coalesce(" in line]


def test_grouped_views_evaluate_rules_once(built):
    # no filter on flags under the aggregate (it would re-evaluate the rules)
    for name in ("deficient_by_cluster", "kpi_by_cluster", "fail_count_hist", "clusters_impacted"):
        assert _filters_below_aggregate(initial_plan(built[name])) == [], name


def test_worst_sites_filter_stays_above_limit(built):
    p = initial_plan(built["worst_sites"])
    lines = p.splitlines()
    take = next(i for i, line in enumerate(lines) if "TakeOrderedAndProject" in line)
    assert not any(re.search(r"\+- (\*\(\d+\) )?Filter ", line) for line in lines[take:])
    assert re.search(r"Filter \(fail_count#\d+ > 0\)", lines[0])


def test_materialized_copy_takes_pushed_filters(spark, tmp_dir):
    import os

    from rulescope.operators import views as V
    from rulescope.plans.queries import ev_orders

    ev = V.materialized(ev_orders(spark, SF_SMALL), os.path.join(tmp_dir, "ev"))
    view = V.actionable(ev, "severe", severe_at=2).clean()
    p = formatted(view)
    assert "GreaterThanOrEqual(_TOTAL_FAILS,2)" in re.search(r"PushedFilters: \[(.*)\]", p).group(1)
    direct = V.actionable(ev_orders(spark, SF_SMALL), "severe", severe_at=2).clean()
    assert sorted(view.collect()) == sorted(direct.collect())


def test_semi_join_needs_no_broadcast(spark):
    from rulescope.operators import views as V
    from rulescope.plans.queries import ev_orders

    ev = ev_orders(spark, SF_SMALL)
    detail = V.failure_long(ev, ["o_orderkey", "o_custkey"])
    top = sorted(V.restrict_to_top(detail, ev, "o_custkey", 10).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = V.restrict_to_top(detail, ev, "o_custkey", 10)
        p = initial_plan(shuffled)
        assert "BroadcastExchange" not in p and "LeftSemi" in p
        assert sorted(shuffled.collect()) == top
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranking_and_detail_share_one_evaluation(built):
    # both sides scan the written copy; no rule is left in the plan
    p = initial_plan(built["failure_long_top"])
    assert p.count("FileScan") == 2 and p.count("failing-") == 2 and "5-low" not in p
    assert "LeftSemi" in p and "TakeOrderedAndProject(limit=10" in p


def test_distribution_is_one_scan_without_join(built):
    for name in ("distribution_topn", "distribution_by_dim"):
        p = initial_plan(built[name])
        assert p.count("FileScan") == 1 and "Join" not in p, name
    assert "TakeOrderedAndProject" in initial_plan(built["distribution_topn"])


def test_each_rule_is_evaluated_once_per_scan(built):
    # '5-low' stands for one rule of the pack over orders
    for name in ("failure_long", "distribution_by_dim", "distribution_topn", "kpi_by_cluster", "matrix_two_key"):
        p = initial_plan(built[name])
        assert p.count("5-low") <= p.count("FileScan") == 1, name


def test_clean_export_evaluates_rules_once(built):
    # generated columns are pruned: the plan is a filter on the scan
    p = initial_plan(built["actionable_export"])
    assert "Project" not in p.split("FileScan")[0].replace("ColumnarToRow", "")
    assert len(FILTER_NODE.findall(p)) == 1
