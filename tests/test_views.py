"""Views: properties over the driver tables plus NULL-key / tie fixtures."""

import pytest
from pyspark.sql import functions as F

from rulescope.operators import packs as P
from rulescope.operators import views as V
from rulescope.operators.rules import Rule, evaluate
from rulescope.plans.queries import pack_q
from tests.conftest import SF_MID


@pytest.fixture(scope="module")
def ev(spark):
    return evaluate(spark.read.parquet(f"{SF_MID}/orders.parquet"), pack_q())


@pytest.fixture()
def groups(spark):
    rows = [
        ("c1", "o1", True, False), ("c1", "o1", True, True), ("c2", "o2", False, False),
        (None, "o2", True, False), (None, None, False, True), ("c3", "o1", True, True),
        ("c3", "o1", True, False), ("c2", "o2", False, False),
    ]
    df = spark.createDataFrame(rows, "cluster string, owner string, f1 boolean, f2 boolean")
    return evaluate(df, [Rule(name="f1", fail_col="f1", fail_op="==", fail_val="true"),
                         Rule(name="f2", fail_col="f2", fail_op="==", fail_val="true")])


def test_summary_reconciles(ev):
    s = V.health_summary(ev).first()
    assert s["total_sites"] == s["ok_sites"] + s["deficient_sites"] == 15000
    assert s["severe_sites"] == 311
    assert abs(s["ok_pct"] + s["deficient_pct"] - 100.0) < 1e-9


def test_summary_empty_input(ev):
    s = V.health_summary(ev.where(F.lit(False))).first()
    assert (s["total_sites"], s["ok_pct"], s["ok_pct_text"]) == (0, 0.0, "0.0%")


def test_matrix_sums_match_totals(ev):
    m = V.matrix(ev, ["o_orderstatus", "o_orderpriority"])
    tot = m.agg(F.sum("total_sites"), F.sum("ok_sites"), *[F.sum(n) for n in ev.names]).first()
    kt = {r["failure_type"]: r["fail_count"] for r in V.kpi_totals(ev).collect()}
    assert tot[0] == 15000 and tot[1] == 3228
    assert list(tot[2:]) == [kt[n] for n in ev.names]


def test_long_table_count_is_sum_of_totals(ev):
    n_long = V.failure_long(ev, "o_orderkey").count()
    assert n_long == sum(r["fail_count"] for r in V.kpi_totals(ev).collect())


def test_distribution_aggregate_first_equals_long_then_group(ev):
    a = {(r[0], r[1]): r[2] for r in V.distribution_by_dim(ev, "o_orderpriority").select(
        "o_orderpriority", "failure_type", "failures").collect()}
    b = {(r[0], r[1]): r[2] for r in V.failure_long(ev, "o_orderpriority").groupBy(
        "o_orderpriority", "failure_type").count().collect()}
    assert a == b


def test_distribution_topn_keeps_only_top_entities(ev):
    top = V.distribution_by_dim(ev, "o_custkey", top_n=5)
    keys = {r[0] for r in top.select("o_custkey").distinct().collect()}
    ranked = V.errors_by(ev, "o_custkey").orderBy(F.desc("total_errors"), "o_custkey").limit(5).collect()
    assert keys == {r[0] for r in ranked}


def test_null_keys_kept_in_matrix_dropped_in_counts(groups):
    m = {r["cluster"]: r["total_sites"] for r in V.matrix(groups, "cluster").collect()}
    assert m == {"c1": 2, "c2": 2, "c3": 2, None: 2}
    d = {r["cluster"]: r["deficient_sites"] for r in V.deficient_by(groups, "cluster").collect()}
    assert None not in d and d == {"c1": 2, "c3": 2}
    d2 = {r["cluster"]: r["deficient_sites"] for r in V.deficient_by(groups, "cluster", drop_null_keys=False).collect()}
    assert d2[None] == 2


def test_topk_ties_broken_by_key(groups):
    top = V.deep_dive_topk(groups, "f1", "cluster", n=2).collect()
    assert [(r[0], r[1]) for r in top] == [("c1", 2), ("c3", 2)]


def test_worst_sites_order(groups):
    rows = V.worst_sites(groups, "cluster", n=3).collect()
    assert [r["fail_count"] for r in rows] == [2, 2, 1]
    assert [r["cluster"] for r in rows] == ["c1", "c3", "c1"]


def test_actionable_views(ev):
    assert V.actionable(ev, "all").df.count() == 15000
    assert V.actionable(ev, "deficient").df.count() == 15000 - 3228
    assert V.actionable(ev, "severe").df.count() == 311
    assert V.actionable(ev, "kpi", rule="urgent_f").df.count() == 1000
    with pytest.raises(ValueError):
        V.actionable(ev, "kpi")


def test_drilldown_all_means_no_filter(ev):
    assert V.drilldown(ev.df, {"o_orderstatus": "All", "o_orderpriority": None}).count() == 15000
    assert V.drilldown(ev.df, {"o_custkey": "7"}).count() == ev.df.where("o_custkey = 7").count()


def test_facets_and_unknown_label(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y")], "l1 string, l2 string")
    f = V.facets_cascade(df, ["l1", "l2"], {"l1": "a"}, unknown_label="Unknown").collect()
    assert [(r[0], r[2]) for r in f] == [(1, "a"), (1, "b"), (2, "Unknown"), (2, "x")]
    # choosing the Unknown option selects the NULL rows
    assert V.drilldown(df, {"l2": "Unknown"}, unknown_label="Unknown").count() == 1


def test_search_literal_and_regex(spark):
    df = spark.createDataFrame([("rm count (n+1)", 1), ("abc", 22), (None, 3)], "s string, n int")
    assert V.search_any_column(df, "(N+1)").count() == 1
    assert V.search_any_column(df, "2").count() == 1
    assert V.search_any_column(df, "^a.c$", regex=True).count() == 1
    assert V.search_any_column(df, r"^\D+$", ["s"], regex=True).count() == 1  # "abc"; \D is not \d
    assert V.search_any_column(df, "^ABC$", regex=True).count() == 1


def test_reasons_and_distribution(spark):
    df = spark.createDataFrame(
        [(1, "DG", "Failed", "2.0", "No"), (2, "Non-DG", "Failed", "5", "OK"), (3, "DG", "OK", None, "Degraded")],
        "id int, typ string, dg string, bb string, rm string",
    )
    ev = evaluate(df, P.nested_kpi_pack("typ", "dg", "bb", "rm", generation=5))
    got = {r["id"]: r["Failure_Reasons"] for r in P.with_reasons(ev).collect()}
    assert got == {1: "Low BB (<4.0h); DG Auto Failed; RM (N+1) Failed", 2: "100% OK", 3: "RM (N+1) Failed"}
    dist = {r["reason"]: r["sites"] for r in P.reason_distribution(ev).collect()}
    assert dist == {"Low BB (<4.0h)": 1, "DG Auto Failed": 1, "RM (N+1) Failed": 2}
    # the original substring scope matches Non-DG too
    ev_c = evaluate(df, P.nested_kpi_pack("typ", "dg", "bb", "rm", dg_scope="contains", generation=5))
    assert ev_c.df.where("FAIL_dg").count() == 2


def test_fixed_pack_missing_value_policy(spark):
    df = spark.createDataFrame([(1, None, None, None, None)], "id int, bb string, dg string, snmp string, rm string")
    ev = evaluate(df, P.fixed_kpi_pack("bb", "dg", "snmp", "rm"))
    r = ev.df.first()
    assert (r["FAIL_bb"], r["FAIL_dg"], r["FAIL_snmp"], r["FAIL_rm"]) == (False, True, True, False)


def test_default_pack_resolves_misspelt_scope(spark):
    cols = ["DG/Non-DG", "DG Automation (Yes/No)", "SMPS/IPMS/PIU Faulty (Yes/No)", "BB Low (Yes/No)",
            "High Temperature (Yes/No)", "TCU Status (OK/Not OK)", "Earthing Status (Ok/Not OK)",
            "Owner/Access Issues (Yes/No)"]
    df = spark.createDataFrame([("Non-DG", "No", "No", "No", "No", "OK", "OK", "No")], cols)
    ev = evaluate(df, P.default_pack())
    assert len(ev.names) == 7 and ev.df.first()["_IS_OK"] is True


def test_views_with_no_applied_rule(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "g string, d double")
    ev = evaluate(df, [Rule(name="x", fail_col="missing", fail_op="==", fail_val="1")])
    assert ev.names == [] and ev.skipped
    assert V.health_summary(ev).first()["ok_sites"] == 2
    assert V.kpi_totals(ev).count() == 0 and V.failure_long(ev, "g").count() == 0
    for top in (None, 1):
        d = V.distribution_by_dim(ev, "g", top_n=top)
        assert d.count() == 0 and d.columns == ["g", "total_errors", "failure_type", "failures"]
    assert {r["Failure_Reasons"] for r in P.with_reasons(ev).collect()} == {"100% OK"}
    assert P.reason_distribution(ev).count() == 0


def test_empty_level_and_metric_lists(spark):
    from rulescope.operators import trends as TR

    df = spark.createDataFrame([("a", 2024, 1)], "g string, source_year int, source_month int")
    assert V.facets_cascade(df, []).count() == 0
    assert TR.report_header(df, []).count() == 0
    assert P.status_inference_many(df, "g", {}).count() == 0
    assert TR.month_pivot(df.where("false"), ["g"], ["EB_Run_Avg"]).columns == ["g"]


def test_fixed_pack_switches(spark):
    names = [r.name for r in P.fixed_kpi_pack("b", "d", "s", "r", use_snmp=False, use_bb=False)]
    assert names == ["dg", "rm"]
    assert [r.fail_val for r in P.fixed_kpi_pack("b", "d", "s", "r", bb_threshold=2.5)][:1] == [2.5]


def test_matrix_rejects_clashing_rule_names(spark):
    df = spark.createDataFrame([("a", 1)], "g string, v int")
    ev = evaluate(df, [Rule(name="total_sites", fail_col="v", fail_op=">", fail_val="0")])
    with pytest.raises(ValueError):
        V.matrix(ev, "g")
    assert V.matrix(ev, "g", names={"total": "n"}).first()["total_sites"] == 1


def test_shared_reason_texts_add_up(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    ev = evaluate(df, [Rule(name="r1", fail_col="v", fail_val="x", reason="Bad"),
                       Rule(name="r2", fail_col="v", fail_val="y", reason="Bad")])
    assert [tuple(r) for r in P.reason_distribution(ev).collect()] == [("Bad", 2)]
