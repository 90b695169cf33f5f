"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the given
tables, with a DuckDB oracle SQL where the computation is expressible in SQL.

The rule engine takes any row-per-entity table, so the driver tables play
the site table.  ``orders`` is the default site table: ``o_orderkey`` is the
site id, ``o_orderpriority`` the cluster, ``o_orderstatus`` the owner and
``o_totalprice`` the metric.  Stand-in inputs (e.g. a column re-typed as text
or re-labelled) are built with plain projections and repeated verbatim in the
oracle; the job itself always runs through the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulescope.operators import views as V
from rulescope.operators.rules import Evaluation, Rule, evaluate, evaluate_packed
from rulescope.plans.oracle import (
    d_cmp,
    d_contains,
    d_eq,
    d_int_sum,
    d_ne,
    d_norm,
    d_num_text,
    d_pct,
    d_pct_card_text,
    d_pct_text,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --------------------------------------------------------------------------
# Rule pack Q over orders and its SQL twin
# --------------------------------------------------------------------------


def pack_q() -> list[Rule]:
    """Four rules that use every layer: scope, fail, nested, severity."""
    return [
        Rule(
            name="urgent_f",
            use_pre=True,
            pre_col="o_orderstatus",
            pre_op="==",
            pre_val="F",
            fail_col="o_orderpriority",
            fail_op="Contains",
            fail_val="urgent",
            use_severe=True,
            sev_col="o_totalprice",
            sev_op=">",
            sev_val="200000",
            make_dash=True,
        ),
        Rule(name="low_value", fail_col="o_totalprice", fail_op="<", fail_val="100000"),
        Rule(name="low_prio", fail_col="o_orderpriority", fail_op="==", fail_val="5-LOW"),
        Rule(
            name="closed_mid",
            fail_col="o_totalprice",
            fail_op=">=",
            fail_val="50000",
            use_nested=True,
            nest_col="o_orderstatus",
            nest_op="!=",
            nest_val="O",
        ),
    ]


Q_NAMES = ["urgent_f", "low_value", "low_prio", "closed_mid"]
Q_FAILS = [f"FAIL_{n}" for n in Q_NAMES]
Q_CRITS = [f"CRIT_{n}" for n in Q_NAMES]

EV_ORDERS = f"""
q_flags AS (
  SELECT *,
    ({d_eq('o_orderstatus', 'F')} AND {d_contains('o_orderpriority', 'urgent')}) AS FAIL_urgent_f,
    {d_cmp('o_totalprice', '<', 100000.0)} AS FAIL_low_value,
    {d_eq('o_orderpriority', '5-LOW')} AS FAIL_low_prio,
    ({d_cmp('o_totalprice', '>=', 50000.0)} AND {d_ne('o_orderstatus', 'O')}) AS FAIL_closed_mid
  FROM orders
),
ev AS (
  SELECT *,
    (FAIL_urgent_f AND {d_cmp('o_totalprice', '>', 200000.0)}) AS CRIT_urgent_f,
    false AS CRIT_low_value, false AS CRIT_low_prio, false AS CRIT_closed_mid,
    {d_int_sum(Q_FAILS)} AS _TOTAL_FAILS,
    {d_int_sum(Q_FAILS)} = 0 AS _IS_OK
  FROM q_flags
)"""


def ev_orders(spark: SparkSession, sf_dir: str) -> Evaluation:
    return evaluate(table(spark, sf_dir, "orders"), pack_q())


# --------------------------------------------------------------------------
# Rule evaluation
# --------------------------------------------------------------------------


@register(
    "rule_eval_two_layer",
    f"""
WITH {EV_ORDERS}
SELECT o_orderkey, FAIL_urgent_f, FAIL_low_value, FAIL_low_prio,
       CAST(FAIL_urgent_f AS INTEGER) + CAST(FAIL_low_value AS INTEGER) + CAST(FAIL_low_prio AS INTEGER) AS _TOTAL_FAILS,
       CAST(FAIL_urgent_f AS INTEGER) + CAST(FAIL_low_value AS INTEGER) + CAST(FAIL_low_prio AS INTEGER) = 0 AS _IS_OK
FROM ev""",
)
def rule_eval_two_layer(spark, sf_dir):
    """Scope + failure rules only (the older rule-file generation, 8 keys)."""
    rules = [
        {
            "name": r.name,
            "use_precond": r.use_pre,
            "pre_col": r.pre_col or "",
            "pre_op": r.pre_op,
            "pre_val": r.pre_val or "",
            "fail_col": r.fail_col,
            "fail_op": r.fail_op,
            "fail_val": r.fail_val,
        }
        for r in pack_q()[:3]
    ]
    ev = evaluate(table(spark, sf_dir, "orders"), rules)
    return ev.df.select("o_orderkey", *ev.fail_cols, ev.total_col, ev.ok_col)


@register(
    "rule_eval_four_layer",
    f"""
WITH {EV_ORDERS}
SELECT o_orderkey, {', '.join(Q_FAILS)}, {', '.join(Q_CRITS)}, _TOTAL_FAILS, _IS_OK FROM ev""",
)
def rule_eval_four_layer(spark, sf_dir):
    """All four layers: scope, failure, nested condition and severity."""
    ev = ev_orders(spark, sf_dir)
    return ev.df.select("o_orderkey", *ev.fail_cols, *ev.crit_cols, ev.total_col, ev.ok_col)


_STEPS = range(70)  # more rules than a word has flags


def _step_rules() -> list[Rule]:
    """Price limits, every second one for one status, every third severe."""
    return [
        Rule(
            name=f"step_{k}", fail_col="o_totalprice", fail_op=">", fail_val=str(5000 * k),
            use_pre=k % 2 == 1, pre_col="o_orderstatus", pre_op="==", pre_val="F",
            use_severe=k % 3 == 0, sev_col="o_custkey", sev_op="<", sev_val=str(10 * k),
        )
        for k in _STEPS
    ]


def _step_word(first: int, severe: bool) -> str:
    bits = ["CAST(0 AS BIGINT)"]
    for k in _STEPS:
        if first <= k < first + 63 and (k % 3 == 0 or not severe):
            cond = f"o_totalprice > {5000 * k}" + (" AND o_orderstatus = 'F'" if k % 2 else "")
            cond += f" AND o_custkey < {10 * k}" if severe else ""
            bits.append(f"CASE WHEN {cond} THEN {1 << (k - first)} ELSE 0 END")
    return " + ".join(bits)


@register(
    "rule_eval_packed",
    f"""WITH w AS (SELECT o_orderkey, ({_step_word(0, False)})::BIGINT AS "FAIL_BITS_0", ({_step_word(63, False)})::BIGINT AS "FAIL_BITS_1",
  ({_step_word(0, True)})::BIGINT AS "CRIT_BITS_0", ({_step_word(63, True)})::BIGINT AS "CRIT_BITS_1" FROM orders)
SELECT *, CAST(bit_count("FAIL_BITS_0") + bit_count("FAIL_BITS_1") AS INTEGER) AS _TOTAL_FAILS,
  "FAIL_BITS_0" = 0 AND "FAIL_BITS_1" = 0 AS _IS_OK FROM w""",
)
def rule_eval_packed(spark, sf_dir):
    """Seventy rules whose flags are bits of two words."""
    ev = evaluate_packed(table(spark, sf_dir, "orders"), _step_rules())
    return ev.df.select("o_orderkey", *ev.generated)


# --------------------------------------------------------------------------
# Operators one by one, with NULLs
# --------------------------------------------------------------------------

NULLED = "(SELECT o_orderkey, o_totalprice, o_custkey, nullif(o_orderpriority, '5-LOW') AS prio FROM orders)"


def _nulled(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        "o_totalprice",
        "o_custkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("prio"),
    )


def _single_rule(df, name, col, op, val, regex=False):
    ev = evaluate(df, [Rule(name=name, fail_col=col, fail_op=op, fail_val=val, regex=regex)])
    return ev.df.select("o_orderkey", *ev.fail_cols)


@register("rule_op_eq", f"SELECT o_orderkey, {d_eq('prio', ' 1-Urgent ')} AS FAIL_eq FROM {NULLED}")
def rule_op_eq(spark, sf_dir):
    """``==`` ignores case and surrounding whitespace; NULL is not equal."""
    return _single_rule(_nulled(spark, sf_dir), "eq", "prio", "==", " 1-Urgent ")


@register("rule_op_ne_null", f"SELECT o_orderkey, {d_ne('prio', '1-URGENT')} AS FAIL_ne FROM {NULLED}")
def rule_op_ne_null(spark, sf_dir):
    """``!=`` counts a missing value as not equal."""
    return _single_rule(_nulled(spark, sf_dir), "ne", "prio", "!=", "1-URGENT")


@register(
    "rule_op_contains_literal",
    f"SELECT o_orderkey, {d_contains('prio', 'NOT SPEC')} AS FAIL_has FROM {NULLED}",
)
def rule_op_contains_literal(spark, sf_dir):
    """``Contains`` as a literal, case-insensitive substring; NULL is false."""
    return _single_rule(_nulled(spark, sf_dir), "has", "prio", "Contains", "NOT SPEC")


@register(
    "rule_op_contains_regex",
    f"SELECT o_orderkey, coalesce(regexp_matches({d_norm('prio')}, '^[12]-(urg|hi)'), false) AS FAIL_rx FROM {NULLED}",
)
def rule_op_contains_regex(spark, sf_dir):
    """``Contains`` with ``regex=True``: the pattern is a regular expression."""
    return _single_rule(_nulled(spark, sf_dir), "rx", "prio", "Contains", "^[12]-(URG|HI)", regex=True)


@register(
    "rule_op_compare",
    f"""
SELECT o_orderkey,
  {d_cmp('o_totalprice', '>', 250000.0)} AS FAIL_gt,
  {d_cmp('o_totalprice', '<=', 30000.5)} AS FAIL_le,
  coalesce({d_num_text("CAST(o_custkey AS VARCHAR)")} >= 700.0, false) AS FAIL_ge_text,
  coalesce({d_num_text('prio')} < 1.0, false) AS FAIL_lt_nonnum
FROM {NULLED}""",
)
def rule_op_compare(spark, sf_dir):
    """Numeric operators on a number, a number stored as text and a text
    column that never parses (always false)."""
    df = _nulled(spark, sf_dir).withColumn("cust_text", F.col("o_custkey").cast("string"))
    ev = evaluate(
        df,
        [
            Rule(name="gt", fail_col="o_totalprice", fail_op=">", fail_val="250000"),
            Rule(name="le", fail_col="o_totalprice", fail_op="<=", fail_val="30000.5"),
            Rule(name="ge_text", fail_col="cust_text", fail_op=">=", fail_val="700"),
            Rule(name="lt_nonnum", fail_col="prio", fail_op="<", fail_val="1"),
        ],
    )
    return ev.df.select("o_orderkey", *ev.fail_cols)


# --------------------------------------------------------------------------
# Summaries and grouped counts
# --------------------------------------------------------------------------


@register(
    "health_summary",
    f"""
WITH {EV_ORDERS}, c AS (
  SELECT count(*)::BIGINT AS total_sites,
         count_if(_IS_OK)::BIGINT AS ok_sites,
         count_if(NOT _IS_OK)::BIGINT AS deficient_sites,
         count_if(_TOTAL_FAILS >= 3)::BIGINT AS severe_sites
  FROM ev)
SELECT total_sites, ok_sites, deficient_sites, severe_sites,
       {d_pct('ok_sites', 'total_sites')} AS ok_pct,
       {d_pct('deficient_sites', 'total_sites')} AS deficient_pct,
       {d_pct_card_text('ok_sites', 'total_sites')} AS ok_pct_text,
       {d_pct_card_text('deficient_sites', 'total_sites')} AS deficient_pct_text
FROM c""",
)
def health_summary(spark, sf_dir):
    """Total, OK, deficient and severely degraded counts with percentages."""
    return V.health_summary(ev_orders(spark, sf_dir), severe_at=3)


@register(
    "kpi_totals",
    f"WITH {EV_ORDERS} "
    + " UNION ALL ".join(
        f"SELECT {i + 1} AS rule_no, '{n}' AS failure_type, count_if(FAIL_{n})::BIGINT AS fail_count, "
        f"count_if(CRIT_{n})::BIGINT AS crit_count FROM ev"
        for i, n in enumerate(Q_NAMES)
    ),
)
def kpi_totals(spark, sf_dir):
    """Failures and critical failures per rule, in rule order."""
    return V.kpi_totals(ev_orders(spark, sf_dir))


@register(
    "deficient_by_cluster",
    f"""WITH {EV_ORDERS}
SELECT o_orderpriority, count(*)::BIGINT AS deficient_sites FROM ev
WHERE NOT _IS_OK AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority""",
)
def deficient_by_cluster(spark, sf_dir):
    """Deficient orders per priority (NULL keys dropped)."""
    return V.deficient_by(ev_orders(spark, sf_dir), "o_orderpriority")


@register(
    "deficient_by_owner",
    f"""WITH {EV_ORDERS}
SELECT o_orderstatus, count(*)::BIGINT AS deficient_sites FROM ev
WHERE NOT _IS_OK AND o_orderstatus IS NOT NULL GROUP BY o_orderstatus""",
)
def deficient_by_owner(spark, sf_dir):
    """Deficient orders per status (NULL keys dropped)."""
    return V.deficient_by(ev_orders(spark, sf_dir), "o_orderstatus")


@register(
    "kpi_by_cluster",
    f"""WITH {EV_ORDERS}
SELECT o_orderpriority, count(*)::BIGINT AS fail_count FROM ev
WHERE FAIL_closed_mid AND o_orderpriority IS NOT NULL GROUP BY o_orderpriority""",
)
def kpi_by_cluster(spark, sf_dir):
    """Orders failing one rule per priority."""
    return V.kpi_by(ev_orders(spark, sf_dir), "closed_mid", "o_orderpriority")


@register(
    "fail_count_hist",
    f"""WITH {EV_ORDERS}
SELECT _TOTAL_FAILS AS fail_count, count(*)::BIGINT AS sites FROM ev
WHERE FAIL_low_value GROUP BY _TOTAL_FAILS""",
)
def fail_count_hist(spark, sf_dir):
    """Orders per total failure count among the orders failing one rule."""
    return V.fail_count_hist(ev_orders(spark, sf_dir), "low_value")


@register(
    "clusters_impacted",
    f"""WITH {EV_ORDERS}
SELECT count(DISTINCT o_custkey)::BIGINT AS impacted FROM ev WHERE FAIL_urgent_f""",
)
def clusters_impacted(spark, sf_dir):
    """Distinct customers among orders failing the scoped urgent rule (exact count)."""
    return V.clusters_impacted(ev_orders(spark, sf_dir), "urgent_f", "o_custkey")


@register(
    "deep_dive_card",
    f"""WITH {EV_ORDERS}
SELECT count_if(FAIL_urgent_f)::BIGINT AS failed_sites,
       count_if(CRIT_urgent_f)::BIGINT AS critical_sites,
       count_if(FAIL_urgent_f AND _TOTAL_FAILS >= 3)::BIGINT AS severe_sites
FROM ev""",
)
def deep_dive_card(spark, sf_dir):
    """KPI card of one rule: failing, critical and severely degraded (>= 3 failures) orders."""
    return V.deep_dive_card(ev_orders(spark, sf_dir), "urgent_f", severe_at=3)


@register(
    "deep_dive_topk",
    f"""WITH {EV_ORDERS}
SELECT o_custkey, count(*)::BIGINT AS fail_count FROM ev WHERE FAIL_low_value
GROUP BY o_custkey ORDER BY fail_count DESC, o_custkey ASC LIMIT 10""",
)
def deep_dive_topk(spark, sf_dir):
    """Top 10 customers by orders failing one rule, ties by key."""
    return V.deep_dive_topk(ev_orders(spark, sf_dir), "low_value", "o_custkey", n=10)


# --------------------------------------------------------------------------
# Matrices (A9, A10, J2, P12, H7)
# --------------------------------------------------------------------------


@register(
    "matrix_two_key",
    f"""WITH {EV_ORDERS}, g AS (
  SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS t, count_if(_IS_OK)::BIGINT AS k,
         {', '.join(f'count_if(FAIL_{n})::BIGINT AS {n}' for n in Q_NAMES)}
  FROM ev GROUP BY o_orderstatus, o_orderpriority)
SELECT o_orderstatus, o_orderpriority, t AS total_sites, k AS ok_sites,
       {d_pct_text('k', 't')} AS ok_pct, t - k AS deficient_sites,
       {d_pct_text('t - k', 't')} AS deficient_pct, {', '.join(Q_NAMES)}
FROM g""",
)
def matrix_two_key(spark, sf_dir):
    """Deficiency matrix by status and priority: totals, percentages, per-rule counts."""
    return V.matrix(ev_orders(spark, sf_dir), ["o_orderstatus", "o_orderpriority"])


@register("matrix_packed", ORACLE["matrix_two_key"])
def matrix_packed(spark, sf_dir):
    """The two-key matrix from flags that are bits."""
    ev = evaluate_packed(table(spark, sf_dir, "orders"), pack_q())
    return V.matrix(ev, ["o_orderstatus", "o_orderpriority"])


def pack_lineitem() -> list[Rule]:
    return [
        Rule(name="big_qty", fail_col="l_quantity", fail_op=">", fail_val="40"),
        Rule(name="deep_disc", fail_col="l_discount", fail_op=">=", fail_val="0.08"),
        Rule(
            name="returned_taxed",
            use_pre=True,
            pre_col="l_returnflag",
            pre_op="==",
            pre_val="r",
            fail_col="l_tax",
            fail_op=">",
            fail_val="0.04",
        ),
    ]


@register(
    "matrix_hierarchy",
    f"""WITH f AS (
  SELECT l_returnflag, l_linestatus,
         {d_cmp('l_quantity', '>', 40.0)} AS big_qty,
         {d_cmp('l_discount', '>=', 0.08)} AS deep_disc,
         ({d_eq('l_returnflag', 'r')} AND {d_cmp('l_tax', '>', 0.04)}) AS returned_taxed
  FROM lineitem),
g AS (
  SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS t,
         count_if(NOT (big_qty OR deep_disc OR returned_taxed))::BIGINT AS k,
         count_if(big_qty)::BIGINT AS big_qty, count_if(deep_disc)::BIGINT AS deep_disc,
         count_if(returned_taxed)::BIGINT AS returned_taxed
  FROM f GROUP BY l_returnflag, l_linestatus)
SELECT l_returnflag, l_linestatus, t AS "Total Sites", k AS "Sites with no infra issue",
       {d_pct_text('k', 't')} AS "% OK", t - k AS "Sites with Deficiencies",
       {d_pct_text('t - k', 't')} AS "% Deficient", big_qty, deep_disc, returned_taxed
FROM g""",
)
def matrix_hierarchy(spark, sf_dir):
    """Hierarchical matrix over the keys present (display column names)."""
    li = table(spark, sf_dir, "lineitem")
    ev = evaluate(li, pack_lineitem())
    keys = V.hierarchy_keys(li.columns, ["l_returnflag", "l_shipmode", "l_linestatus"])
    return V.matrix(ev, keys, names=V.MATRIX_NAMES_HIERARCHY)


# --------------------------------------------------------------------------
# Long table and distributions
# --------------------------------------------------------------------------


@register(
    "failure_long",
    f"WITH {EV_ORDERS} "
    + " UNION ALL ".join(
        f"SELECT o_orderkey, o_orderpriority, '{n}' AS failure_type FROM ev WHERE FAIL_{n}" for n in Q_NAMES
    ),
)
def failure_long(spark, sf_dir):
    """One row per failing (order, rule)."""
    return V.failure_long(ev_orders(spark, sf_dir), ["o_orderkey", "o_orderpriority"])


_DIST_BASE = f"""WITH {EV_ORDERS}, w AS (
  SELECT o_custkey, sum(_TOTAL_FAILS)::BIGINT AS total_errors,
         {', '.join(f'count_if(FAIL_{n})::BIGINT AS {n}' for n in Q_NAMES)}
  FROM ev GROUP BY o_custkey HAVING sum(_TOTAL_FAILS) > 0)"""

_DIST_LONG = " UNION ALL ".join(
    f"SELECT o_custkey, total_errors, '{n}' AS failure_type, {n} AS failures FROM w2 WHERE {n} > 0"
    for n in Q_NAMES
)


@register("distribution_by_dim", f"{_DIST_BASE}, w2 AS (SELECT * FROM w) {_DIST_LONG}")
def distribution_by_dim(spark, sf_dir):
    """Failures per (customer, rule) for every customer with a failure."""
    return V.distribution_by_dim(ev_orders(spark, sf_dir), "o_custkey", top_n=None)


@register(
    "distribution_topn",
    f"""{_DIST_BASE}, w2 AS (
  SELECT * FROM w WHERE o_custkey IN (
    SELECT o_custkey FROM w ORDER BY total_errors DESC, o_custkey ASC LIMIT 10))
{_DIST_LONG}""",
)
def distribution_topn(spark, sf_dir):
    """Failures per (customer, rule) for the 10 customers with the most failures."""
    return V.distribution_by_dim(ev_orders(spark, sf_dir), "o_custkey", top_n=10)


@register(
    "failure_long_topn",
    f"""WITH {EV_ORDERS}, top AS (
  SELECT o_custkey FROM ev GROUP BY o_custkey HAVING sum(_TOTAL_FAILS) > 0
  ORDER BY sum(_TOTAL_FAILS) DESC, o_custkey ASC LIMIT 10)
"""
    + " UNION ALL ".join(
        f"SELECT o_orderkey, o_custkey, '{n}' AS failure_type FROM ev WHERE FAIL_{n} "
        f"AND o_custkey IN (SELECT o_custkey FROM top)"
        for n in Q_NAMES
    ),
)
def failure_long_topn(spark, sf_dir):
    """Long failure rows of the 10 entities with the most failures (the
    detail behind a top-N chart): semi-join with the bounded key list."""
    ev = ev_orders(spark, sf_dir)
    return V.restrict_to_top(V.failure_long(ev, ["o_orderkey", "o_custkey"]), ev, "o_custkey", 10)


@register("failure_long_top", ORACLE["failure_long_topn"])
def failure_long_top(spark, sf_dir):
    """The same rows with the rules evaluated once: ranking and detail read
    one written copy."""
    return V.failure_long_top(ev_orders(spark, sf_dir), ["o_orderkey", "o_custkey"], "o_custkey", 10)


@register("distribution_long", ORACLE["distribution_by_dim"])
def distribution_long(spark, sf_dir):
    """Failures per (customer, rule) for every customer with a failure."""
    return V.distribution_by_dim(ev_orders(spark, sf_dir), "o_custkey")


@register("distribution_topn_long", ORACLE["distribution_topn"])
def distribution_topn_long(spark, sf_dir):
    """Distribution of the ten customers with the most failures."""
    return V.distribution_by_dim(ev_orders(spark, sf_dir), "o_custkey", top_n=10)


@register(
    "errors_by_entity",
    f"""WITH {EV_ORDERS}
SELECT o_custkey, sum(_TOTAL_FAILS)::BIGINT AS total_errors FROM ev
GROUP BY o_custkey HAVING sum(_TOTAL_FAILS) > 0""",
)
def errors_by_entity(spark, sf_dir):
    """Total failures per customer (customers without a failure left out)."""
    return V.errors_by(ev_orders(spark, sf_dir), "o_custkey")


# --------------------------------------------------------------------------
# Row-level outputs
# --------------------------------------------------------------------------

_ORDERS_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@register(
    "worst_sites",
    f"""WITH {EV_ORDERS}
SELECT {_ORDERS_COLS}, _TOTAL_FAILS AS fail_count FROM ev WHERE NOT _IS_OK
ORDER BY _TOTAL_FAILS DESC, o_orderkey ASC LIMIT 20""",
)
def worst_sites(spark, sf_dir):
    """The 20 worst deficient orders (most failures first, ties by key)."""
    return V.worst_sites(ev_orders(spark, sf_dir), "o_orderkey", n=20)


@register(
    "actionable_export",
    f"""WITH {EV_ORDERS}
SELECT {_ORDERS_COLS} FROM ev WHERE FAIL_low_prio AND _TOTAL_FAILS >= 2""",
)
def actionable_export(spark, sf_dir):
    """A KPI drill-down view with the generated columns removed."""
    ev = V.actionable(ev_orders(spark, sf_dir), "kpi_severe", rule="low_prio", severe_at=2)
    return ev.clean()


@register(
    "preview",
    f"""WITH {EV_ORDERS}
SELECT {_ORDERS_COLS}, _TOTAL_FAILS AS fail_count FROM ev WHERE NOT _IS_OK
ORDER BY _TOTAL_FAILS DESC, o_orderkey ASC LIMIT 1000""",
)
def preview(spark, sf_dir):
    """The 1,000-row display cap of the deficient-sites table, worst first."""
    return V.worst_sites(ev_orders(spark, sf_dir), "o_orderkey", n=1000)


# --------------------------------------------------------------------------
# Drill-down, facets and search
# --------------------------------------------------------------------------


@register(
    "drilldown",
    f"""WITH {EV_ORDERS}, d AS (SELECT * FROM ev WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT count(*)::BIGINT AS total_sites, count_if(_IS_OK)::BIGINT AS ok_sites,
       count_if(NOT _IS_OK)::BIGINT AS deficient_sites, count_if(_TOTAL_FAILS >= 3)::BIGINT AS severe_sites,
       {d_pct('count_if(_IS_OK)', 'count(*)')} AS ok_pct,
       {d_pct('count_if(NOT _IS_OK)', 'count(*)')} AS deficient_pct,
       {d_pct_card_text('count_if(_IS_OK)', 'count(*)')} AS ok_pct_text,
       {d_pct_card_text('count_if(NOT _IS_OK)', 'count(*)')} AS deficient_pct_text
FROM d""",
)
def drilldown(spark, sf_dir):
    """Summary after chained drill-down filters ("All" = no filter); the
    equality filters reach the Parquet scan."""
    ev = V.drilldown_eval(
        ev_orders(spark, sf_dir),
        {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": "All"},
    )
    return V.health_summary(ev)


@register(
    "facets_cascade",
    """
SELECT DISTINCT 1 AS level, 'o_orderstatus' AS facet, o_orderstatus AS value FROM orders
UNION ALL
SELECT DISTINCT 2, 'o_orderpriority', o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT DISTINCT 3, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""",
)
def facets_cascade(spark, sf_dir):
    """Options of three cascading facet levels under two selections, in one scan."""
    return V.facets_cascade(
        table(spark, sf_dir, "orders"),
        ["o_orderstatus", "o_orderpriority", "o_custkey"],
        {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"},
    )


@register(
    "facet_options",
    f"SELECT DISTINCT coalesce(prio, 'Unknown') AS value FROM {NULLED}",
)
def facet_options(spark, sf_dir):
    """Sorted distinct values of a facet column, missing shown as Unknown."""
    return V.distinct_values(_nulled(spark, sf_dir), "prio", unknown_label="Unknown")


@register(
    "search_regex",
    """
SELECT * FROM part WHERE
  coalesce(regexp_matches(lower(CAST(p_partkey AS VARCHAR)), '^(red|blue) |7$'), false)
  OR coalesce(regexp_matches(lower(p_name), '^(red|blue) |7$'), false)
  OR coalesce(regexp_matches(lower(p_type), '^(red|blue) |7$'), false)""",
)
def search_regex(spark, sf_dir):
    """Search in regular-expression mode over chosen columns."""
    part = table(spark, sf_dir, "part")
    return V.search_any_column(part, "^(RED|BLUE) |7$", ["p_partkey", "p_name", "p_type"], regex=True)


@register(
    "search_any_column",
    """
SELECT * FROM part WHERE
  coalesce(contains(lower(CAST(p_partkey AS VARCHAR)), 'ring'), false)
  OR coalesce(contains(lower(p_name), 'ring'), false)
  OR coalesce(contains(lower(p_brand), 'ring'), false)
  OR coalesce(contains(lower(p_type), 'ring'), false)
  OR coalesce(contains(lower(CAST(p_size AS VARCHAR)), 'ring'), false)""",
)
def search_any_column(spark, sf_dir):
    """Case-insensitive literal search over every text and integer column."""
    part = table(spark, sf_dir, "part")
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    return V.search_any_column(part, "RING", cols)


@register(
    "deficient_by_nullable",
    f"""WITH f AS (SELECT prio, {d_cmp('o_totalprice', '<', 100000.0)} AS a, {d_contains('prio', 'urgent')} AS b
  FROM {NULLED})
SELECT prio, count_if(a OR b)::BIGINT AS deficient_sites FROM f GROUP BY prio HAVING count_if(a OR b) > 0""",
)
def deficient_by_nullable(spark, sf_dir):
    """Deficient orders per priority where the priority may be missing: the
    missing group is kept (``drop_null_keys=False``)."""
    ev = evaluate(
        _nulled(spark, sf_dir),
        [Rule(name="low_value", fail_col="o_totalprice", fail_op="<", fail_val="100000"),
         Rule(name="urgent", fail_col="prio", fail_op="Contains", fail_val="urgent")],
    )
    return V.deficient_by(ev, "prio", drop_null_keys=False)


@register(
    "drilldown_unknown",
    f"SELECT * FROM {NULLED} WHERE prio IS NULL OR prio = 'Unknown'",
)
def drilldown_unknown(spark, sf_dir):
    """Choosing the "Unknown" facet option selects the missing values it
    stands for."""
    return V.drilldown(_nulled(spark, sf_dir), {"prio": "Unknown"}, unknown_label="Unknown")
