"""Rule compiler: operator semantics, layers, policies and properties."""

import pytest
from pyspark.sql import functions as F

from rulescope.operators import views as V
from rulescope.operators.rules import (
    WORD_BITS,
    Rule,
    RuleError,
    compile_condition,
    evaluate,
    evaluate_packed,
    parse_threshold,
    resolve_column,
)
from rulescope.plans.queries import pack_q
from tests.conftest import SF_SMALL

COMPARE = [
    (1, "OK", 5.0),
    (2, " ok ", float("nan")),
    (3, None, None),
    (4, "Not OK", 3.0),
    (5, " OK", 4.0),
    (6, "4", 4.0),
]


@pytest.fixture()
def cmp_df(spark):
    return spark.createDataFrame(COMPARE, "id int, s string, d double")


def _flags(df, col, op, val, **kw):
    c = compile_condition(col, op, val, df.schema[col].dataType, **kw)
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_eq_is_case_and_space_insensitive_null_false(cmp_df):
    assert _flags(cmp_df, "s", "==", "ok") == [True, True, False, False, True, False]


def test_ne_counts_missing_as_not_equal(cmp_df):
    assert _flags(cmp_df, "s", "!=", "OK") == [False, False, True, True, False, True]


def test_contains_literal_vs_regex(spark):
    df = spark.createDataFrame([(1, "rm count (n+1)"), (2, "a.b"), (3, "axb"), (4, None)], "id int, s string")
    assert _flags(df, "s", "Contains", "(n+1)") == [True, False, False, False]
    assert _flags(df, "s", "Contains", "(n+1)", regex=True) == [False, False, False, False]
    assert _flags(df, "s", "Contains", "a.b") == [False, True, False, False]
    assert _flags(df, "s", "Contains", "a.b", regex=True) == [False, True, True, False]
    # escapes keep their meaning (\D: a non-digit), matching is case-insensitive
    assert _flags(df, "s", "Contains", r"^\D\.B$", regex=True) == [False, True, False, False]


def test_numeric_ops_nan_null_false(cmp_df):
    assert _flags(cmp_df, "d", ">", "3") == [True, False, False, False, True, True]
    assert _flags(cmp_df, "d", "<=", "4") == [False, False, False, True, True, True]


def test_numeric_ops_on_text_column(cmp_df):
    # only "4" parses; everything else is missing -> false
    assert _flags(cmp_df, "s", ">=", "4") == [False, False, False, False, False, True]


def test_eq_on_numeric_column_compares_numbers(cmp_df):
    assert _flags(cmp_df, "d", "==", "4") == [False, False, False, False, True, True]
    assert _flags(cmp_df, "d", "==", "4.0") == [False, False, False, False, True, True]


def test_set_ops(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, " no "), (3, None), (4, "Failed")], "id int, s string")
    assert _flags(df, "s", "in", ["yes", "y"]) == [True, False, False, False]
    assert _flags(df, "s", "not in", ["yes", "y"]) == [False, True, True, True]
    assert _flags(df, "s", "in_exact", ["Failed", "no"]) == [False, False, False, True]
    assert _flags(df, "s", "in_ci", ["failed", "no"]) == [False, False, False, True]
    assert _flags(df, "s", "contains_any", ["fail", "no"]) == [False, True, False, True]
    assert _flags(df, "s", "in", "Yes, n") == [True, False, False, False]


def test_unknown_operator(cmp_df):
    with pytest.raises(RuleError):
        compile_condition("s", "~=", "x")
    assert _flags(cmp_df, "s", "~=", "x", strict_ops=False) == [False] * 6


def test_threshold_parse():
    assert parse_threshold("4") == 4.0
    assert parse_threshold(" -5 ") == -5.0
    assert parse_threshold("1e3") == 1000.0
    for bad in ["", "N/A", "4h", None, "inf"]:
        with pytest.raises(RuleError):
            parse_threshold(bad)
    # compat mode reproduces the dashboards: anything but digits/one dot -> 0
    assert parse_threshold("-5", "compat") == 0.0
    assert parse_threshold("1e3", "compat") == 0.0
    assert parse_threshold("2.5", "compat") == 2.5
    assert parse_threshold("N/A", "compat") == 0.0


def test_resolve_column_loose():
    cols = ["DG/Non-DG", "DG/Non-DG ULS", "Cluster"]
    assert resolve_column(cols, "DG/ Non-DG") == "DG/Non-DG"
    assert resolve_column(cols, "cluster") == "Cluster"
    assert resolve_column(cols, "nope") is None
    assert resolve_column(["a b", "A B"], "ab") is None  # ambiguous


def test_rule_from_dict_both_generations():
    old = Rule.from_dict({"name": "x", "use_precond": True, "pre_col": "a", "pre_op": "==", "pre_val": "1",
                          "fail_col": "b", "fail_op": "==", "fail_val": "2"})
    assert old.use_pre and old.pre_col == "a" and not old.use_nested
    new = Rule.from_dict({"name": "y", "use_pre": False, "fail_col": "b", "fail_op": "<", "fail_val": "3",
                          "use_severe": True, "sev_col": "b", "sev_op": "<", "sev_val": "1", "make_dash": True})
    assert new.use_severe and new.make_dash


def _df4(spark):
    return spark.createDataFrame(
        [(1, "DG", "No", 1.0), (2, "DG", "Yes", 5.0), (3, "Non-DG", "No", 2.0), (4, None, "No", None)],
        "id int, typ string, auto string, bb double",
    )


def test_four_layers(spark):
    rules = [
        Rule(name="auto", use_pre=True, pre_col="typ", pre_op="==", pre_val="dg", fail_col="auto",
             fail_op="==", fail_val="no", use_nested=True, nest_col="bb", nest_op="<", nest_val="3",
             use_severe=True, sev_col="bb", sev_op="<", sev_val="1.5"),
        Rule(name="bb", fail_col="bb", fail_op="<", fail_val="4"),
    ]
    ev = evaluate(_df4(spark), rules)
    rows = ev.df.orderBy("id").select("FAIL_auto", "CRIT_auto", "FAIL_bb", "CRIT_bb", "_TOTAL_FAILS", "_IS_OK").collect()
    assert [tuple(r) for r in rows] == [
        (True, True, True, False, 2, False),
        (False, False, False, False, 0, True),
        (False, False, True, False, 1, False),
        (False, False, False, False, 0, True),
    ]
    assert ev.clean().columns == ["id", "typ", "auto", "bb"]


def test_missing_columns_policy(spark):
    df = _df4(spark)
    missing_fail = Rule(name="m", fail_col="absent", fail_op="==", fail_val="x")
    ev = evaluate(df, [missing_fail, Rule(name="bb", fail_col="bb", fail_op="<", fail_val="4")])
    assert ev.names == ["bb"] and ev.skipped[0][0] == "m"
    scoped = Rule(name="s", use_pre=True, pre_col="absent", pre_val="x", fail_col="bb", fail_op="<", fail_val="4")
    with pytest.raises(RuleError):
        evaluate(df, [scoped])
    lenient = evaluate(df, [scoped], on_missing="ignore_layer")
    assert lenient.df.where("FAIL_s").count() == 2  # scope ignored -> applies to all rows
    skip = evaluate(df, [scoped], on_missing="skip_rule")
    assert skip.names == [] and skip.df.where("_IS_OK").count() == 4


def test_duplicate_rule_names_rejected(spark):
    r = Rule(name="a", fail_col="bb", fail_op="<", fail_val="4")
    with pytest.raises(RuleError):
        evaluate(_df4(spark), [r, r])


def test_properties_on_orders(spark):
    from tests.conftest import SF_MID

    orders = spark.read.parquet(f"{SF_MID}/orders.parquet")
    ev = evaluate(orders, pack_q())
    agg = ev.df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ev.ok).alias("ok"),
        F.sum(ev.total).alias("tot"),
        *[F.count_if(ev.fail(n)).alias(n) for n in ev.names],
        *[F.count_if(ev.crit(n) & ~ev.fail(n)).alias("bad_" + n) for n in ev.names],
    ).first()
    assert agg["tot"] == sum(agg[n] for n in ev.names)  # total = sum of flags
    assert all(agg["bad_" + n] == 0 for n in ev.names)  # CRIT implies FAIL
    # hand-checked counts of this pack at sf0.01
    assert (agg["urgent_f"], agg["low_value"], agg["low_prio"], agg["closed_mid"]) == (1000, 2957, 2996, 9034)
    assert agg["ok"] == 3228
    assert ev.df.where(ev.total >= 3).count() == 311
    # filter-then-evaluate == evaluate-then-filter
    a = evaluate(orders.where(F.col("o_orderstatus") == "F"), pack_q()).df.where("_IS_OK").count()
    b = ev.df.where((F.col("o_orderstatus") == "F") & ev.ok).count()
    assert a == b


def test_rule_text_cannot_escape_into_sql(spark):
    nasty = "x') OR true OR ('"
    df = spark.createDataFrame([(1, nasty), (2, "y"), (3, "a\\b"), (4, "it's")], "id int, `we``ird` string")
    rules = [
        Rule(name="eq", fail_col="we`ird", fail_op="==", fail_val=nasty),
        Rule(name="bs", fail_col="we`ird", fail_op="Contains", fail_val="a\\b"),
        Rule(name="q", fail_col="we`ird", fail_op="in", fail_val=["it's"]),
        Rule(name="n`a'me -- x", fail_col="we`ird", fail_op="!=", fail_val="y"),
    ]
    ev = evaluate(df, rules)
    rows = {r["id"]: tuple(r[c] for c in ev.fail_cols) for r in ev.df.collect()}
    assert rows == {
        1: (True, False, False, True),
        2: (False, False, False, False),
        3: (False, True, False, True),
        4: (False, False, True, True),
    }


def test_validate_rules_reports_every_problem(spark):
    from rulescope.operators.rules import validate_rules

    schema = _df4(spark).schema
    bad = [
        {"name": "a", "fail_col": "bb", "fail_op": "<", "fail_val": "4h"},
        {"name": "a", "fail_col": "bb", "fail_op": "~", "fail_val": "1"},
        {"name": "c", "fail_col": "nope", "fail_op": "==", "fail_val": "x"},
        {"name": "d", "use_pre": True, "pre_col": "gone", "pre_val": "x", "fail_col": "auto", "fail_val": "No"},
        {"fail_col": "bb"},
        {"name": "ok", "fail_col": "BB", "fail_op": ">=", "fail_val": "2"},
    ]
    problems = validate_rules(bad, schema)
    assert len(problems) == 6
    assert any("not a number" in p for p in problems) and any("duplicate" in p for p in problems)
    assert any("unknown operator" in p for p in problems) and any("'nope'" in p for p in problems)
    assert any("'gone'" in p for p in problems) and any("rule #5" in p for p in problems)
    assert validate_rules(bad[-1:], schema) == []


def test_compat_thresholds_through_evaluate(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.5), (3, None)], "id int, v double")
    rule = Rule(name="neg", fail_col="v", fail_op="<", fail_val="-5")
    strict = evaluate(df, [rule])  # -5 is a number: nothing is below it
    assert [r["FAIL_neg"] for r in strict.df.orderBy("id").collect()] == [False, False, False]
    compat = evaluate(df, [rule], threshold_mode="compat")  # the old parse reads "-5" as 0
    assert [r["FAIL_neg"] for r in compat.df.orderBy("id").collect()] == [True, False, False]
    bad = Rule(name="h", fail_col="v", fail_op="<", fail_val="4h")
    with pytest.raises(RuleError):
        evaluate(df, [bad])
    assert evaluate(df, [bad], threshold_mode="compat").df.where("FAIL_h").count() == 1


def test_names_clash_ignoring_case(spark):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    with pytest.raises(RuleError):
        evaluate(df, [Rule(name="A", fail_col="v", fail_val="x"), Rule(name="a", fail_col="v", fail_val="y")])
    with pytest.raises(RuleError):
        evaluate(spark.createDataFrame([(1, "x")], "fail_a int, v string"), [Rule(name="a", fail_col="v", fail_val="x")])
    with pytest.raises(RuleError):
        evaluate(spark.createDataFrame([(1, "x")], "_total_fails int, v string"), [Rule(name="a", fail_col="v")])


# --- flags as bits ---


def _many(n: int) -> list[Rule]:
    return [
        Rule(name=f"r {i}", fail_col="o_totalprice", fail_op=">", fail_val=str(1000 + i * 3000), use_pre=i % 2 == 0,
             pre_col="o_orderstatus", pre_op="==", pre_val="F", use_severe=i % 3 == 0, sev_col="o_custkey",
             sev_op=">=", sev_val=str(i))
        for i in range(n)
    ]


@pytest.mark.parametrize("n", [0, 1, 62, 63, 64, 130])
def test_packed_flags_equal_the_columns(spark, n):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    odd = spark.createDataFrame([(-1, None, None, None), (-2, float("nan"), " f ", 5)], o.schema)
    o = o.unionByName(odd)
    rules = [*_many(n), Rule(name="absent", fail_col="nowhere", fail_op="==", fail_val="1")]
    wide, packed = evaluate(o, rules), evaluate_packed(o, rules)
    assert packed.skipped == wide.skipped and len(packed.fail_cols) == -(-n // WORD_BITS)
    back = packed.unpacked()
    assert back.df.columns == wide.df.columns and back.df.dtypes == wide.df.dtypes
    key = lambda r: repr(tuple(r))  # noqa: E731 - NaN is not equal to itself
    assert sorted(map(key, back.df.collect())) == sorted(map(key, wide.df.collect()))


def test_views_take_packed_flags(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    wide, packed = evaluate(o, _many(70)), evaluate_packed(o, _many(70))
    views = [
        V.health_summary,
        V.kpi_totals,
        lambda ev: V.failure_long(ev, "o_orderkey"),
        lambda ev: V.distribution_by_dim(ev, "o_orderpriority", 2),
        lambda ev: V.deep_dive_card(ev, "r 65"),
        lambda ev: V.actionable(ev, "kpi_severe", rule="r 69").clean(),
        lambda ev: V.actionable(V.materialized(ev), "severe").clean(),
    ]
    for view in views:
        assert sorted(map(tuple, view(packed).collect())) == sorted(map(tuple, view(wide).collect()))
    with pytest.raises(RuleError):
        packed.fail("nowhere")
    with pytest.raises(RuleError, match="FAIL_BITS_0"):
        evaluate_packed(o.withColumn("fail_bits_0", F.lit(1)), _many(2))
