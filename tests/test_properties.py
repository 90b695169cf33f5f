"""Property tests: random rows and rules against a plain-Python statement of
the rule semantics (brute force, pandas for numeric coercion)."""

import math

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulescope.operators import views as V
from rulescope.operators.rules import Rule, evaluate

TEXTS = [None, "", " ", "Yes", " yes ", "NO", "no", "OK", "ok ", "4", " 4.5", "1e3", "1d", "x", "Not OK", "-2", "N/A"]
NUMS = [None, float("nan"), -1.0, 0.0, 2.5, 4.0, 10.0]
VALUES = ["yes", " OK", "no", "4", "4.5", "-2", "x", "not ok", "1e3"]
OPS = ["==", "!=", "Contains", ">", "<", ">=", "<=", "in", "not in"]

rows_st = st.lists(st.tuples(st.sampled_from(TEXTS), st.sampled_from(NUMS), st.sampled_from(TEXTS)),
                   min_size=1, max_size=25)
cond_st = st.tuples(st.sampled_from(["s", "d", "t"]), st.sampled_from(OPS), st.sampled_from(VALUES))
rule_st = st.tuples(cond_st, st.booleans(), cond_st, st.booleans(), cond_st)


def _norm(v):
    return None if v is None else str(v).strip().lower()


def _num(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    out = pd.to_numeric(pd.Series([v], dtype=object), errors="coerce").iloc[0]
    return None if pd.isna(out) else float(out)


def _is_number(text):
    try:
        float(text.strip())
        return True
    except ValueError:
        return False


def _cond(row, col, op, val):
    v = {"s": row[0], "d": row[1], "t": row[2]}[col]
    numeric_col = col == "d"
    if op in ("==", "!="):
        if numeric_col and _is_number(val):
            x = _num(v)
            eq = x is not None and x == float(val)
            if op == "==":
                return eq
            return not (x == float(val)) if x is not None else True
        n = _norm(v)
        if op == "==":
            return n is not None and n == _norm(val)
        return n is None or n != _norm(val)
    if op == "Contains":
        n = _norm(v)
        return n is not None and _norm(val) in n
    if op in (">", "<", ">=", "<="):
        if not _is_number(val):
            return None  # invalid threshold: the rule is rejected
        x, t = _num(v), float(val)
        if x is None:
            return False
        return {">": x > t, "<": x < t, ">=": x >= t, "<=": x <= t}[op]
    tokens = {_norm(t) for t in val.split(",") if t.strip()}
    member = _norm(v) in tokens if v is not None else False
    return member if op == "in" else not member


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_st, rule=rule_st)
def test_rule_flags_match_brute_force(spark, rows, rule):
    fail, use_pre, pre, use_nest, nest = rule
    for c in [fail] + ([pre] if use_pre else []) + ([nest] if use_nest else []):
        if c[1] in (">", "<", ">=", "<=") and not _is_number(c[2]):
            return  # invalid thresholds are rejected at compile time (tested elsewhere)
    r = Rule(name="r", fail_col=fail[0], fail_op=fail[1], fail_val=fail[2],
             use_pre=use_pre, pre_col=pre[0], pre_op=pre[1], pre_val=pre[2],
             use_nested=use_nest, nest_col=nest[0], nest_op=nest[1], nest_val=nest[2])
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id int, s string, d double, t string")
    got = {row["id"]: row["FAIL_r"] for row in evaluate(df, [r]).df.select("id", "FAIL_r").collect()}
    for i, row in enumerate(rows):
        want = _cond(row, *fail)
        if use_pre:
            want = want and _cond(row, *pre)
        if use_nest:
            want = want and _cond(row, *nest)
        assert got[i] == bool(want), (row, r)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(TEXTS), st.sampled_from(NUMS)),
                     min_size=0, max_size=30))
def test_views_reconcile(spark, rows):
    df = spark.createDataFrame(rows, "g string, s string, d double")
    ev = evaluate(df, [Rule(name="yes", fail_col="s", fail_op="==", fail_val="yes"),
                       Rule(name="low", fail_col="d", fail_op="<", fail_val="4"),
                       Rule(name="t", fail_col="s", fail_op="Contains", fail_val="o")])
    s = V.health_summary(ev).first()
    assert s["total_sites"] == len(rows) == s["ok_sites"] + s["deficient_sites"]
    m = V.matrix(ev, "g").agg(F.sum("total_sites").alias("t"), F.sum("ok_sites").alias("k")).first()
    assert (m["t"] or 0, m["k"] or 0) == (len(rows), s["ok_sites"])
    totals = {r["failure_type"]: r["fail_count"] for r in V.kpi_totals(ev).collect()}
    assert V.failure_long(ev, "g").count() == sum(totals.values())
    dist = V.distribution_by_dim(ev, "g").agg(F.sum("failures").alias("f")).first()["f"] or 0
    assert dist == sum(totals.values())
    hist = {r["fail_count"]: r["sites"] for r in V.fail_count_hist(ev).collect()}
    assert sum(hist.values()) == len(rows) and hist.get(0, 0) == s["ok_sites"]
