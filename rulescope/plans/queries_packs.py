"""Queries for rule packs, token tests, coercion, reasons and status lists.

Site-like stand-in tables are projections of ``orders`` that give rows in
the schema a pack expects (telecom-style column names, yes/no text, numbers
stored as text, missing values); the oracle repeats the same projection.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rulescope.functions.columns import (
    CIRCLE_DEFAULT,
    CIRCLE_PREFIXES,
    is_no,
    is_ok_token,
    is_yes,
    num,
    prefix_label,
)
from rulescope.operators import packs as P
from rulescope.operators import views as V
from rulescope.operators.rules import Rule, evaluate
from rulescope.plans.oracle import d_int_sum, d_norm, d_num_text
from rulescope.plans.queries import register, table

# --------------------------------------------------------------------------
# Tokens and coercion
# --------------------------------------------------------------------------

LABELS_TEXT = """(SELECT doc_id,
  CASE WHEN quality = 1 THEN 'Yes' ELSE ' no ' END AS q_text,
  CASE WHEN toxic = 0 THEN NULL ELSE 'Y' END AS t_text
FROM labels)"""


def _labels_text(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        "doc_id",
        F.when(F.col("quality") == 1, F.lit("Yes")).otherwise(F.lit(" no ")).alias("q_text"),
        F.when(F.col("toxic") == 0, F.lit(None).cast("string")).otherwise(F.lit("Y")).alias("t_text"),
    )


def _d_in(x, toks):
    return f"coalesce({d_norm(x)} IN ({', '.join(repr(t) for t in toks)}), false)"


@register(
    "token_flags",
    f"""SELECT doc_id,
  {_d_in('q_text', ['yes', 'y', 'true', 'ok'])} AS q_yes,
  {_d_in('q_text', ['no', 'n', 'false'])} AS q_no,
  {_d_in('t_text', ['yes', 'y', 'true', 'ok'])} AS t_yes,
  {_d_in('t_text', ['no', 'n', 'false'])} AS t_no,
  {_d_in('t_text', ['ok', 'y', 'true'])} AS t_ok
FROM {LABELS_TEXT}""",
)
def token_flags(spark, sf_dir):
    """Yes / no / ok token tests on padded, mixed-case and missing text."""
    df = _labels_text(spark, sf_dir)
    return df.select(
        "doc_id",
        is_yes("q_text").alias("q_yes"),
        is_no("q_text").alias("q_no"),
        is_yes("t_text").alias("t_yes"),
        is_no("t_text").alias("t_no"),
        is_ok_token("t_text").alias("t_ok"),
    )


CODED = """(SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN '1d' WHEN 1 THEN ' 4 ' WHEN 2 THEN 'N/A' WHEN 3 THEN '1e3'
       ELSE CAST(o_custkey AS VARCHAR) END AS v
FROM orders)"""


@register(
    "numeric_coerce",
    f"""SELECT o_orderkey, {d_num_text('v')} AS v_num, coalesce({d_num_text('v')} < 500.0, false) AS FAIL_small
FROM {CODED}""",
)
def numeric_coerce(spark, sf_dir):
    """Text numbers as pandas reads them: ``'1d'`` and ``'N/A'`` are missing,
    ``' 4 '`` and ``'1e3'`` are numbers."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    df = o.select(
        "o_orderkey",
        F.when(k == 0, "1d").when(k == 1, " 4 ").when(k == 2, "N/A").when(k == 3, "1e3")
        .otherwise(F.col("o_custkey").cast("string")).alias("v"),
    )
    ev = evaluate(df, [Rule(name="small", fail_col="v", fail_op="<", fail_val="500")])
    return ev.df.select("o_orderkey", num("v").alias("v_num"), *ev.fail_cols)


@register(
    "prefix_class",
    f"""SELECT c_custkey, c_mktsegment,
  CASE WHEN upper(c_mktsegment) LIKE 'B%' THEN 'Bihar' WHEN upper(c_mktsegment) LIKE 'J%' THEN 'Jharkhand'
       ELSE 'Other' END AS Auto_Circle,
  CASE WHEN upper(c_mktsegment) LIKE 'A%' THEN 'Auto' WHEN upper(c_mktsegment) LIKE 'MA%' THEN 'Machines'
       ELSE 'Rest' END AS segment_class
FROM customer""",
)
def prefix_class(spark, sf_dir):
    """Region label from an id prefix (case-insensitive, first match wins)."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        "c_mktsegment",
        prefix_label("c_mktsegment", CIRCLE_PREFIXES, CIRCLE_DEFAULT).alias("Auto_Circle"),
        prefix_label("c_mktsegment", [("a", "Auto"), ("Ma", "Machines")], "Rest").alias("segment_class"),
    )


# --------------------------------------------------------------------------
# Fixed four-KPI pack
# --------------------------------------------------------------------------

SITES_V1 = """(SELECT o_orderkey AS "SITE ID", o_orderpriority AS "Cluster",
  CAST(o_totalprice / 60000.0 AS VARCHAR) AS "Battery Backup (Hrs)",
  CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN ' no ' ELSE NULL END AS "DG Automation Status",
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Y' WHEN o_orderpriority = '3-MEDIUM' THEN 'true'
       ELSE 'N' END AS "SNMP Communicated",
  CASE o_custkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'OK' ELSE NULL END AS "RM Count (N+1)"
FROM orders)"""


def sites_v1(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st, pr, ck = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey") % 3
    return o.select(
        F.col("o_orderkey").alias("SITE ID"),
        pr.alias("Cluster"),
        (F.col("o_totalprice") / 60000.0).cast("string").alias("Battery Backup (Hrs)"),
        F.when(st == "F", "Yes").when(st == "O", " no ").alias("DG Automation Status"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), "Y").when(pr == "3-MEDIUM", "true").otherwise("N")
        .alias("SNMP Communicated"),
        F.when(ck == 0, "No").when(ck == 1, "OK").alias("RM Count (N+1)"),
    )


_V1_FLAGS = {
    "FAIL_bb": f"coalesce({d_num_text('\"Battery Backup (Hrs)\"')} < 4.0, false)",
    "FAIL_dg": f"NOT {_d_in('\"DG Automation Status\"', ['yes', 'y', 'true', 'ok'])}",
    "FAIL_snmp": f"NOT {_d_in('\"SNMP Communicated\"', ['yes', 'y', 'true', 'ok'])}",
    "FAIL_rm": _d_in('"RM Count (N+1)"', ["no", "n", "false"]),
}


@register(
    "fixed_kpi_pack",
    f"""WITH f AS (SELECT "SITE ID", {', '.join(f'{v} AS {k}' for k, v in _V1_FLAGS.items())} FROM {SITES_V1})
SELECT *, {d_int_sum(list(_V1_FLAGS))} AS _TOTAL_FAILS, {d_int_sum(list(_V1_FLAGS))} = 0 AS _IS_OK FROM f""",
)
def fixed_kpi_pack(spark, sf_dir):
    """The fixed four-KPI pack with its per-KPI missing-value policy."""
    df = sites_v1(spark, sf_dir)
    rules = P.fixed_kpi_pack(
        "Battery Backup (Hrs)", "DG Automation Status", "SNMP Communicated", "RM Count (N+1)"
    )
    ev = evaluate(df, rules)
    return ev.df.select("`SITE ID`", *[f"`{c}`" for c in ev.fail_cols], ev.total_col, ev.ok_col)


# --------------------------------------------------------------------------
# Scoped pack with reasons
# --------------------------------------------------------------------------

SITES_V5 = """(SELECT o_orderkey AS "SITE ID", o_orderpriority AS "Cluster",
  CASE WHEN o_orderstatus = 'O' THEN 'Non-DG' ELSE 'DG' END AS "DG/Non-DG",
  CAST(o_totalprice / 60000.0 AS VARCHAR) AS "Battery Backup (Hrs)",
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Failed' WHEN '2-HIGH' THEN 'Not Reachable' WHEN '5-LOW' THEN 'No'
       WHEN '4-NOT SPECIFIED' THEN 'Normal' ELSE 'OK' END AS "DG Automation Status",
  CASE WHEN o_custkey % 4 = 0 THEN 'No' ELSE 'Yes' END AS "SNMP Communicated (Y/N)",
  CASE o_custkey % 3 WHEN 0 THEN 'Degraded' WHEN 1 THEN 'OK' ELSE NULL END AS "RM Count (N+1)"
FROM orders)"""


def sites_v5(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    ck3, ck4 = F.col("o_custkey") % 3, F.col("o_custkey") % 4
    return o.select(
        F.col("o_orderkey").alias("SITE ID"),
        pr.alias("Cluster"),
        F.when(st == "O", "Non-DG").otherwise("DG").alias("DG/Non-DG"),
        (F.col("o_totalprice") / 60000.0).cast("string").alias("Battery Backup (Hrs)"),
        F.when(pr == "1-URGENT", "Failed").when(pr == "2-HIGH", "Not Reachable").when(pr == "5-LOW", "No")
        .when(pr == "4-NOT SPECIFIED", "Normal").otherwise("OK").alias("DG Automation Status"),
        F.when(ck4 == 0, "No").otherwise("Yes").alias("SNMP Communicated (Y/N)"),
        F.when(ck3 == 0, "Degraded").when(ck3 == 1, "OK").alias("RM Count (N+1)"),
    )


def ev_v5(spark, sf_dir):
    rules = P.nested_kpi_pack(
        "DG/Non-DG",
        "DG Automation Status",
        "Battery Backup (Hrs)",
        "RM Count (N+1)",
        snmp_col="SNMP Communicated (Y/N)",
        bb_threshold=4.0,
        generation=5,
    )
    return evaluate(sites_v5(spark, sf_dir), rules)


def _d_contains_any(x, toks):
    return "coalesce(" + " OR ".join(f"contains(lower({x}), '{t}')" for t in toks) + ", false)"


_V5_FLAGS = {
    "FAIL_bb": f"coalesce({d_num_text('\"Battery Backup (Hrs)\"')} < 4.0, false)",
    "FAIL_dg": f"(coalesce({d_norm('\"DG/Non-DG\"')} = 'dg', false) AND "
    f"{_d_contains_any('\"DG Automation Status\"', ['fail', 'no', 'not'])})",
    "FAIL_snmp": _d_contains_any('"SNMP Communicated (Y/N)"', ["fail", "no"]),
    "FAIL_rm": _d_contains_any('"RM Count (N+1)"', ["fail", "no", "degrade"]),
}
_V5_REASONS = {
    "FAIL_bb": "Low BB (<4.0h)",
    "FAIL_dg": "DG Auto Failed",
    "FAIL_snmp": "SNMP Failed",
    "FAIL_rm": "RM (N+1) Failed",
}
_V5_EV = f"""f5 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _V5_FLAGS.items())} FROM {SITES_V5}),
ev5 AS (SELECT *, {d_int_sum(list(_V5_FLAGS))} AS _TOTAL_FAILS FROM f5)"""


@register(
    "failure_reasons",
    f"""WITH {_V5_EV}
SELECT "SITE ID", _TOTAL_FAILS,
  coalesce(nullif(concat_ws('; ', {', '.join(f"CASE WHEN {k} THEN '{v}' END" for k, v in _V5_REASONS.items())}), ''),
           '100% OK') AS Failure_Reasons
FROM ev5""",
)
def failure_reasons(spark, sf_dir):
    """Failure reasons per site with the scoped pack ('100% OK' when none)."""
    ev = ev_v5(spark, sf_dir)
    return P.with_reasons(ev, empty_label=P.NO_REASON_V5).select("`SITE ID`", ev.total_col, "Failure_Reasons")


@register(
    "reason_distribution",
    f"WITH {_V5_EV} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS reason, count(*)::BIGINT AS sites FROM ev5 WHERE {k} HAVING count(*) > 0"
        for k, v in _V5_REASONS.items()
    ),
)
def reason_distribution(spark, sf_dir):
    """Deficient sites per failure reason."""
    return P.reason_distribution(ev_v5(spark, sf_dir))


@register(
    "status_inference",
    f"""SELECT DISTINCT 'substring' AS mode, "DG Automation Status" AS value FROM {SITES_V5}
WHERE {_d_contains_any('"DG Automation Status"', ['fail', 'no', 'not'])}
UNION ALL
SELECT DISTINCT 'exact', "DG Automation Status" FROM {SITES_V5}
WHERE lower("DG Automation Status") IN ('failed', 'not reachable', 'timeout', 'no')""",
)
def status_inference(spark, sf_dir):
    """Default failure statuses inferred from a status column, both ways."""
    df = sites_v5(spark, sf_dir)
    specs = {
        "substring": (P.DG_FAIL_SUBSTRINGS, "substring"),
        "exact": (P.DG_FAIL_STATUSES, "exact"),
    }
    return P.status_inference_many(df, "DG Automation Status", specs).withColumnRenamed("label", "mode")


# --------------------------------------------------------------------------
# Default pack
# --------------------------------------------------------------------------

SITES_DEFAULT = """(SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 'DG' ELSE 'Non-DG' END AS "DG/Non-DG",
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN 'No' ELSE 'Yes' END AS "DG Automation (Yes/No)",
  CASE WHEN o_totalprice > 400000 THEN 'Yes' ELSE 'No' END AS "SMPS/IPMS/PIU Faulty (Yes/No)",
  CASE WHEN o_totalprice < 60000 THEN 'Yes' ELSE 'No' END AS "BB Low (Yes/No)",
  CASE WHEN o_custkey % 7 = 0 THEN 'Yes' ELSE 'No' END AS "High Temperature (Yes/No)",
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Not OK' ELSE 'OK' END AS "TCU Status (OK/Not OK)",
  CASE WHEN o_orderstatus = 'P' THEN 'NOT OK' ELSE 'Ok' END AS "Earthing Status (Ok/Not OK)",
  CASE WHEN o_orderkey % 11 = 0 THEN ' yes ' ELSE 'no' END AS "Owner/Access Issues (Yes/No)"
FROM orders)"""


def sites_default(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    st, pr, tp = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    return o.select(
        "o_orderkey",
        F.when(st == "F", "DG").otherwise("Non-DG").alias("DG/Non-DG"),
        F.when(pr.isin("1-URGENT", "3-MEDIUM"), "No").otherwise("Yes").alias("DG Automation (Yes/No)"),
        F.when(tp > 400000, "Yes").otherwise("No").alias("SMPS/IPMS/PIU Faulty (Yes/No)"),
        F.when(tp < 60000, "Yes").otherwise("No").alias("BB Low (Yes/No)"),
        F.when(F.col("o_custkey") % 7 == 0, "Yes").otherwise("No").alias("High Temperature (Yes/No)"),
        F.when(pr == "5-LOW", "Not OK").otherwise("OK").alias("TCU Status (OK/Not OK)"),
        F.when(st == "P", "NOT OK").otherwise("Ok").alias("Earthing Status (Ok/Not OK)"),
        F.when(F.col("o_orderkey") % 11 == 0, " yes ").otherwise("no").alias("Owner/Access Issues (Yes/No)"),
    )


def _d_eq(x, v):
    return f"coalesce({d_norm(x)} = '{v.strip().lower()}', false)"


_DEFAULT_FLAGS = {
    '"FAIL_Automation Issue"': f"({_d_eq(chr(34) + 'DG/Non-DG' + chr(34), 'DG')} AND "
    f"{_d_eq(chr(34) + 'DG Automation (Yes/No)' + chr(34), 'No')})",
    '"FAIL_SMPS/IPMS Fault"': _d_eq('"SMPS/IPMS/PIU Faulty (Yes/No)"', "Yes"),
    '"FAIL_Low BB"': _d_eq('"BB Low (Yes/No)"', "Yes"),
    '"FAIL_High Temp"': _d_eq('"High Temperature (Yes/No)"', "Yes"),
    '"FAIL_TCU Fault"': _d_eq('"TCU Status (OK/Not OK)"', "Not OK"),
    '"FAIL_Earthing Issue"': _d_eq('"Earthing Status (Ok/Not OK)"', "Not OK"),
    '"FAIL_Access Issue"': _d_eq('"Owner/Access Issues (Yes/No)"', "Yes"),
}


@register(
    "default_pack",
    f"""WITH f AS (SELECT o_orderkey, {', '.join(f'{v} AS {k}' for k, v in _DEFAULT_FLAGS.items())}
  FROM {SITES_DEFAULT})
SELECT *, {d_int_sum(list(_DEFAULT_FLAGS))} AS _TOTAL_FAILS, {d_int_sum(list(_DEFAULT_FLAGS))} = 0 AS _IS_OK
FROM f""",
)
def default_pack(spark, sf_dir):
    """The shipped seven-rule pack; its misspelt scope column still resolves."""
    ev = evaluate(sites_default(spark, sf_dir), P.default_pack())
    return ev.df.select("o_orderkey", *[f"`{c}`" for c in ev.fail_cols], ev.total_col, ev.ok_col)


# --------------------------------------------------------------------------
# Older scoped pack: exact status lists, custom rule, substring scope
# (R6, F7, F8, F10, P9, P18)
# --------------------------------------------------------------------------

_V4_FLAGS = {
    "FAIL_dg": f"(coalesce(contains({d_norm(chr(34) + 'DG/Non-DG' + chr(34))}, 'dg'), false) AND "
    "coalesce(lower(\"DG Automation Status\") IN ('failed', 'not reachable', 'timeout', 'no'), false))",
    "FAIL_bb": f"coalesce({d_num_text('\"Battery Backup (Hrs)\"')} < 4.0, false)",
    "FAIL_rm": "coalesce(lower(\"RM Count (N+1)\") IN ('failed', 'no', 'not ok', '0'), false)",
    "FAIL_custom": f"coalesce({d_norm(chr(34) + 'Cluster' + chr(34))} = '3-medium', false)",
}
_V4_REASONS = {
    "FAIL_dg": "DG Auto Failed",
    "FAIL_bb": "Low Battery (<4.0h)",
    "FAIL_rm": "RM Failed",
    "FAIL_custom": "Custom Rule (Cluster)",
}


def ev_v4(spark, sf_dir):
    rules = P.nested_kpi_pack(
        "DG/Non-DG",
        "DG Automation Status",
        "Battery Backup (Hrs)",
        "RM Count (N+1)",
        bb_threshold=4.0,
        custom=("Cluster", "3-MEDIUM"),
        dg_scope="contains",
        generation=4,
    )
    return evaluate(sites_v5(spark, sf_dir), rules)


@register(
    "failure_reasons_v4",
    f"""WITH f4 AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _V4_FLAGS.items())} FROM {SITES_V5})
SELECT "SITE ID", {d_int_sum(list(_V4_FLAGS))} AS _TOTAL_FAILS,
  coalesce(nullif(concat_ws('; ', {', '.join(f"CASE WHEN {k} THEN '{v}' END" for k, v in _V4_REASONS.items())}), ''),
           'None') AS Failure_Reasons
FROM f4""",
)
def failure_reasons_v4(spark, sf_dir):
    """Exact (case-insensitive) failure-status lists, a custom exact-value
    rule and the substring generator scope (which also matches Non-DG)."""
    ev = ev_v4(spark, sf_dir)
    return P.with_reasons(ev, empty_label=P.NO_REASON_V4).select("`SITE ID`", ev.total_col, "Failure_Reasons")


@register(
    "actionable_sites",
    f"""WITH {_V5_EV}
SELECT "SITE ID", "Cluster",
  coalesce(nullif(concat_ws('; ', {', '.join(f"CASE WHEN {k} THEN '{v}' END" for k, v in _V5_REASONS.items())}), ''),
           '100% OK') AS Failure_Reasons,
  _TOTAL_FAILS, "DG/Non-DG", "DG Automation Status", "Battery Backup (Hrs)", "RM Count (N+1)"
FROM ev5 WHERE _TOTAL_FAILS > 0""",
)
def actionable_sites(spark, sf_dir):
    """Sites needing action, worst first, in the fixed display columns that
    exist ("Site Type" is not a column here and is left out)."""
    # One evaluation, written: the filter and the sort (which samples its
    # input first) then read the copy instead of running the rules again.
    ev = V.materialized(ev_v5(spark, sf_dir))
    df = P.with_reasons(ev).where(~ev.ok).orderBy(F.col(ev.total_col).desc(), F.col("`SITE ID`"))
    return V.display_columns(
        df,
        ["SITE ID", "Cluster", "Failure_Reasons", ev.total_col, "DG/Non-DG", "Site Type",
         "DG Automation Status", "Battery Backup (Hrs)", "RM Count (N+1)"],
    )


_STATES_FLAGS = {
    "FAIL_bb": f"coalesce({d_num_text('\"Battery Backup (Hrs)\"')} < 4.0, false)",
    "FAIL_dg": f"(coalesce({d_norm('\"DG/Non-DG\"')} = 'dg', false) AND "
    "coalesce(\"DG Automation Status\" IN ('Failed', 'No'), false))",
    "FAIL_snmp": "coalesce(\"SNMP Communicated (Y/N)\" IN ('No'), false)",
    "FAIL_rm": "coalesce(\"RM Count (N+1)\" IN ('Degraded'), false)",
}


@register(
    "explicit_status_pack",
    f"""WITH f AS (SELECT "SITE ID", {', '.join(f'{v} AS {k}' for k, v in _STATES_FLAGS.items())} FROM {SITES_V5})
SELECT *, {d_int_sum(list(_STATES_FLAGS))} AS _TOTAL_FAILS FROM f""",
)
def explicit_status_pack(spark, sf_dir):
    """Scoped pack with explicitly chosen failure statuses (exact,
    case-sensitive text) instead of inferred ones."""
    rules = P.nested_kpi_pack(
        "DG/Non-DG",
        "DG Automation Status",
        "Battery Backup (Hrs)",
        "RM Count (N+1)",
        snmp_col="SNMP Communicated (Y/N)",
        dg_states=["Failed", "No"],
        rm_states=["Degraded"],
        snmp_states=["No"],
        generation=5,
    )
    ev = evaluate(sites_v5(spark, sf_dir), rules)
    return ev.df.select("`SITE ID`", *[f"`{c}`" for c in ev.fail_cols], ev.total_col)
