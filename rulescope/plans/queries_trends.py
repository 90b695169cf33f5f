"""Queries for the trend store, trend views, ingest and rule files.

The trend rows are a projection of ``orders``: the order month is the
upload month, ``o_custkey`` the site, ``o_totalprice`` the EB run average
and a text copy of it / 1000 the DG run average (so coercion runs).  Writes
go to fresh folders under the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from rulescope.operators import packs as P
from rulescope.operators import trends as TR
from rulescope.operators.rules import Rule, evaluate
from rulescope.plans.oracle import d_num_text
from rulescope.plans.queries import EV_ORDERS, ORACLE, Q_CRITS, Q_FAILS, Q_NAMES, pack_q, register, table
from rulescope.plans.queries_packs import sites_v1, sites_v5
from rulescope.session import shared_path
from rulescope.sources import files as FL
from rulescope.sources import headers as H
from rulescope.sources.rules_io import read_rules, write_rules
from rulescope.sources.store import TrendStore
from rulescope.sources.table_store import TableStore

TREND_SQL = f"""(SELECT o_custkey AS "Site ID", o_orderstatus AS "Circle", o_orderpriority AS "MIB Name",
  year(o_orderdate)::INTEGER AS source_year, month(o_orderdate)::INTEGER AS source_month,
  o_totalprice AS EB_Run_Avg,
  CAST(o_totalprice / 1000.0 AS VARCHAR) AS DG_Run_Avg,
  CASE WHEN o_orderstatus = 'F' THEN 'n/a' ELSE CAST(o_totalprice / 10000.0 AS VARCHAR) END AS Solar_Run_Avg
FROM orders)"""


def trend_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("Site ID"),
        F.col("o_orderstatus").alias("Circle"),
        F.col("o_orderpriority").alias("MIB Name"),
        F.year("o_orderdate").alias(TR.YEAR_COL),
        F.month("o_orderdate").alias(TR.MONTH_COL),
        F.col("o_totalprice").alias("EB_Run_Avg"),
        (F.col("o_totalprice") / 1000.0).cast("string").alias("DG_Run_Avg"),
        F.when(F.col("o_orderstatus") == "F", F.lit("n/a"))
        .otherwise((F.col("o_totalprice") / 10000.0).cast("string"))
        .alias("Solar_Run_Avg"),
    )


def _r4(df, cols):
    return df.select(*[F.round(F.col(f"`{c}`"), 4).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


_DG = d_num_text("DG_Run_Avg")
_SOLAR = d_num_text("Solar_Run_Avg")
_MEAN_COLS = ["EB Avg (h)", "DG Avg (h)", "BB Avg (h)", "Solar Avg (h)"]


@register(
    "monthly_means",
    f"""SELECT source_year, source_month, printf('%04d-%02d', source_year, source_month) AS period,
  round(avg(EB_Run_Avg), 4) AS "EB Avg (h)", round(avg({_DG}), 4) AS "DG Avg (h)",
  0.0::DOUBLE AS "BB Avg (h)", round(avg({_SOLAR}), 4) AS "Solar Avg (h)"
FROM {TREND_SQL} GROUP BY source_year, source_month""",
)
def monthly_means(spark, sf_dir):
    """Mean run hours per month; the absent BB column reads as 0 (values
    rounded to 4 decimals: sums of doubles depend on summation order)."""
    return _r4(TR.monthly_means(trend_rows(spark, sf_dir)), _MEAN_COLS)


@register(
    "period_means",
    f"""SELECT round(avg(EB_Run_Avg), 4) AS "EB Avg (h)", round(avg({_DG}), 4) AS "DG Avg (h)",
  round(avg({_SOLAR}), 4) AS "Solar Avg (h)" FROM {TREND_SQL}""",
)
def period_means(spark, sf_dir):
    """Single-period means of the EB, DG and Solar run hours."""
    return _r4(TR.period_means(trend_rows(spark, sf_dir)), _MEAN_COLS)


# Every month of the driver's orders; DuckDB cannot keep a PIVOT without a list
# of values as a view, so each cell is its own conditional aggregate.
_PERIODS = [f"{y:04d}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]
_PIVOT_ROWS = f"""(SELECT "Site ID", printf('%04d-%02d', source_year, source_month) AS period,
                  EB_Run_Avg, {_DG} AS DG_Run_Avg FROM {TREND_SQL})"""


def _pivot_sql(metrics: list[str], periods: list[str], absent: tuple[str, ...] = ()) -> str:
    cells = [
        f'NULL::DOUBLE AS "{m}_{p}"' if m in absent else f"max(CASE WHEN period = '{p}' THEN {m} END) AS \"{m}_{p}\""
        for m in metrics
        for p in periods
    ]
    kept = ", ".join(f"'{p}'" for p in periods)
    return f'SELECT "Site ID", {", ".join(cells)} FROM {_PIVOT_ROWS} WHERE period IN ({kept}) GROUP BY "Site ID"'


@register("month_pivot", _pivot_sql(["EB_Run_Avg", "DG_Run_Avg"], _PERIODS))
def month_pivot(spark, sf_dir):
    """Site x (metric, month) report over every month present."""
    return TR.month_pivot(trend_rows(spark, sf_dir), ["Site ID"], ["EB_Run_Avg", "DG_Run_Avg"])


_SELECTED = ["1996-01", "1997-06", "2000-12"]


@register("month_pivot_selected", _pivot_sql(["EB_Run_Avg", "BB_Run_Avg", "DG_Run_Avg"], _SELECTED, ("BB_Run_Avg",)))
def month_pivot_selected(spark, sf_dir):
    """The report over three chosen months; a metric that the table lacks
    gives empty columns in its place."""
    metrics = ["EB_Run_Avg", "BB_Run_Avg", "DG_Run_Avg"]
    return TR.month_pivot(trend_rows(spark, sf_dir), ["Site ID"], metrics, periods=_SELECTED)


@register(
    "report_header",
    f"""WITH p AS (SELECT DISTINCT source_year, source_month FROM {TREND_SQL}),
m(metric_no, metric) AS (VALUES (1, 'EB_Run_Avg'), (2, 'DG_Run_Avg'), (3, 'BB_Run_Avg'), (4, 'Solar_Run_Avg'),
                              (5, 'Total_Run_Avg'))
SELECT metric_no, metric, replace(metric, '_', ' ') AS metric_label, split_part(metric, '_', 1) AS metric_family,
  printf('%04d-%02d', source_year, source_month) AS period,
  strftime(make_date(source_year, source_month, 1), '%b') AS month_short,
  metric || '_' || printf('%04d-%02d', source_year, source_month) AS "column"
FROM p, m""",
)
def report_header(spark, sf_dir):
    """Two-level report header: one row per (metric, month present)."""
    return TR.report_header(trend_rows(spark, sf_dir))


@register(
    "dataset_catalogue",
    f"""SELECT source_year AS year, source_month AS month,
  monthname(make_date(source_year, source_month, 1)) AS month_name, count(*)::BIGINT AS rows
FROM {TREND_SQL} GROUP BY source_year, source_month""",
)
def dataset_catalogue(spark, sf_dir):
    """Rows per (year, month) of the trend rows with the month name, chronological."""
    return TR.catalogue(trend_rows(spark, sf_dir))


@register(
    "trend_ingest",
    """SELECT o_orderkey AS "Site ID", o_orderstatus AS "Circle", o_orderpriority AS "MIB Name",
  o_totalprice AS EB_Run_Avg, 2024 AS source_year, 1 AS source_month FROM orders""",
)
def trend_ingest(spark, sf_dir):
    """Map uploaded columns to the canonical trend columns and tag the month."""
    o = table(spark, sf_dir, "orders")
    mapped = TR.map_columns(
        o,
        {"Site ID": "o_orderkey", "Circle": "o_orderstatus", "MIB Name": "o_orderpriority",
         "EB_Run_Avg": "o_totalprice"},
        required=["Site ID", "Circle"],
        numeric=["EB_Run_Avg"],
    )
    return TR.tag_period(mapped, 2024, 1)


_ORD = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@register(
    "stack_frames",
    f"""SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
  'January' AS Source_Month, 2024 AS Source_Year FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, CAST(o_custkey AS VARCHAR), o_orderstatus, o_totalprice, o_orderpriority,
  'February', 2024 FROM orders WHERE o_orderstatus <> 'F'""",
)
def stack_frames(spark, sf_dir):
    """Two uploads whose ``o_custkey`` types differ (number vs text) stacked
    by name; the conflicting column is widened to text."""
    o = table(spark, sf_dir, "orders").select(*_ORD.split(", "))
    a = o.where(F.col("o_orderstatus") == "F")
    b = o.where(F.col("o_orderstatus") != "F").withColumn("o_custkey", F.col("o_custkey").cast("string"))
    return TR.stack([(a, {"Source_Month": "January", "Source_Year": 2024}),
                     (b, {"Source_Month": "February", "Source_Year": 2024})])


def _store_with_orders(spark, sf_dir) -> TrendStore:
    store = TrendStore(spark, shared_path(spark, "trend-store"))
    o = table(spark, sf_dir, "orders").select(*_ORD.split(", "), "o_orderdate")
    store.save_tagged(
        o.withColumns({TR.YEAR_COL: F.year("o_orderdate"), TR.MONTH_COL: F.month("o_orderdate")}).drop("o_orderdate")
    )
    return store


@register(
    "store_roundtrip",
    f"""SELECT {_ORD}, year(o_orderdate)::INTEGER AS source_year, month(o_orderdate)::INTEGER AS source_month
FROM orders
WHERE NOT (year(o_orderdate) = 1999 AND month(o_orderdate) = 1)
  AND NOT (year(o_orderdate) = 1998 AND month(o_orderdate) = 6 AND o_orderstatus <> 'F')""",
)
def store_roundtrip(spark, sf_dir):
    """Save every month, replace June 1998 with its F-status rows, delete
    January 1999, read the store back."""
    store = _store_with_orders(spark, sf_dir)
    june = store.load_month(1998, 6).where(F.col("o_orderstatus") == "F")
    store.save_month(_materialize(spark, june), 1998, 6)
    store.delete_month(1999, 1)
    return store.load_all().select(*_ORD.split(", "), TR.YEAR_COL, TR.MONTH_COL)


def _materialize(spark, df):
    """Write ``df`` to a fresh shared folder and read it back: replacing a
    month with rows derived from that same month must not read files the
    overwrite is deleting."""
    path = shared_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.parquet(path)


@register(
    "stack_months",
    f"""SELECT {_ORD}, monthname(o_orderdate) AS Source_Month, year(o_orderdate)::INTEGER AS Source_Year
FROM orders WHERE (year(o_orderdate), month(o_orderdate)) IN ((1996, 1), (1997, 6), (2000, 12))""",
)
def stack_months(spark, sf_dir):
    """Three months chosen from a store of all (a fourth choice is absent),
    stacked: only their folders are read, and each row is tagged with its
    month name and year."""
    store = _store_with_orders(spark, sf_dir)
    chosen = store.load_months([(1996, 1), (1997, 6), (2000, 12), (1901, 1)])
    return chosen.select(*_ORD.split(", "), "Source_Month", "Source_Year")


@register(
    "store_schema_drift",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN 'x' || CAST(o_custkey AS VARCHAR)
    ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey,
  CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice END AS o_totalprice,
  year(o_orderdate)::INTEGER AS source_year, 1 AS source_month
FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) AND month(o_orderdate) = 1""",
)
def store_schema_drift(spark, sf_dir):
    """Three uploads of one store: the second has a column as text that is a
    number elsewhere, the third a metric that the others lack."""
    store = TrendStore(spark, shared_path(spark, "trend-store"))
    o = table(spark, sf_dir, "orders").where(F.month("o_orderdate") == 1)
    for year in (1995, 1996, 1997):
        part = o.where(F.year("o_orderdate") == year)
        custkey = F.concat(F.lit("x"), F.col("o_custkey").cast("string")) if year == 1996 else F.col("o_custkey")
        cols = [F.col("o_orderkey"), custkey.alias("o_custkey")] + ([F.col("o_totalprice")] if year == 1997 else [])
        store.save_month(part.select(*cols), year, 1)
    return store.load_all().select("o_orderkey", "o_custkey", "o_totalprice", TR.YEAR_COL, TR.MONTH_COL)


@register(
    "store_numeric_drift",
    """SELECT o_orderkey, CASE year(o_orderdate) WHEN 1995 THEN CAST(o_custkey AS DOUBLE)
    WHEN 1996 THEN o_totalprice ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 1)) AS DOUBLE) END AS amount,
  strftime(CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE
    ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END, '%Y-%m-%d %H:%M') AS seen,
  CASE year(o_orderdate) WHEN 1995 THEN CAST(o_orderkey % 2 AS BIGINT) WHEN 1996 THEN CAST(o_custkey % 100 AS BIGINT)
    ELSE CAST(o_custkey AS BIGINT) END AS n,
  CASE WHEN year(o_orderdate) = 1997 THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) END AS code,
  year(o_orderdate)::INTEGER AS source_year, 1 AS source_month
FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) AND month(o_orderdate) = 1""",
)
def store_numeric_drift(spark, sf_dir):
    """Three uploads of one store whose column types drift: whole numbers,
    fractions and decimals become DOUBLE, dates and timestamps TIMESTAMP,
    flags and whole numbers of two sizes BIGINT, numbers and text TEXT."""
    store = TrendStore(spark, shared_path(spark, "trend-store"))
    o = table(spark, sf_dir, "orders").where(F.month("o_orderdate") == 1)
    price, cust, day = F.col("o_totalprice"), F.col("o_custkey"), F.col("o_orderdate").cast("date")
    uploads = {
        1995: [cust.cast("bigint"), day, F.col("o_orderkey") % 2 == 1, cust.cast("int")],
        1996: [price, day.cast("timestamp") + F.expr("INTERVAL 90 MINUTES"), (cust % 100).cast("int"), cust.cast("bigint")],
        1997: [price.cast("decimal(12,1)"), day, cust.cast("bigint"), F.concat(F.lit("c"), cust.cast("string"))],
    }
    for year, values in uploads.items():
        names = ("amount", "seen", "n", "code")
        cols = [v.alias(name) for v, name in zip(values, names, strict=True)]
        store.save_month(o.where(F.year("o_orderdate") == year).select("o_orderkey", *cols), year, 1)
    seen = F.date_format("seen", "yyyy-MM-dd HH:mm").alias("seen")
    return store.load_all().select("o_orderkey", "amount", seen, "n", "code", TR.YEAR_COL, TR.MONTH_COL)


@register(
    "store_empty_replace",
    f"""SELECT {_ORD}, year(o_orderdate)::INTEGER AS source_year, month(o_orderdate)::INTEGER AS source_month
FROM orders WHERE NOT (year(o_orderdate) = 1997 AND month(o_orderdate) = 6)""",
)
def store_empty_replace(spark, sf_dir):
    """An upload without rows replaces the month that was there."""
    store = _store_with_orders(spark, sf_dir)
    store.save_month(table(spark, sf_dir, "orders").select(*_ORD.split(", ")).where("false"), 1997, 6)
    return store.load_all().select(*_ORD.split(", "), TR.YEAR_COL, TR.MONTH_COL)


@register(
    "store_catalogue",
    """SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month,
  monthname(o_orderdate) AS month_name, count(*)::BIGINT AS rows FROM orders GROUP BY ALL""",
)
def store_catalogue(spark, sf_dir):
    """Catalogue of a store written from orders: rows per month, chronological."""
    return _store_with_orders(spark, sf_dir).list_months()


@register("table_store_roundtrip", ORACLE["store_roundtrip"])
def table_store_roundtrip(spark, sf_dir):
    """The store round trip on a table of the catalogue: save every month,
    replace one, delete one, read the rest."""
    store = TableStore(spark, f"months_{uuid.uuid4().hex[:12]}")
    o = table(spark, sf_dir, "orders").select(*_ORD.split(", "), "o_orderdate")
    day = F.col("o_orderdate")
    store.save_tagged(o.withColumns({TR.YEAR_COL: F.year(day), TR.MONTH_COL: F.month(day)}).drop("o_orderdate"))
    june = store.load_month(1998, 6).where(F.col("o_orderstatus") == "F")
    store.save_month(_materialize(spark, june), 1998, 6)
    store.delete_month(1999, 1)
    return store.load_all().select(*_ORD.split(", "), TR.YEAR_COL, TR.MONTH_COL)


@register(
    "table_store_drift",
    """SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice ELSE CAST(o_custkey AS DOUBLE) END AS amount,
  CASE WHEN year(o_orderdate) = 1997 THEN o_orderpriority END AS note,
  year(o_orderdate)::INTEGER AS source_year, 1 AS source_month
FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) AND month(o_orderdate) = 1""",
)
def table_store_drift(spark, sf_dir):
    """Uploads into a table of the catalogue: the second needs a wider type,
    so the table is widened into a new one; the third adds a metric and
    brings a smaller type, which is cast."""
    names = [f"months_{uuid.uuid4().hex[:12]}" for _ in range(2)]
    o = table(spark, sf_dir, "orders").where(F.month("o_orderdate") == 1)

    def upload(year, *cols):
        return o.where(F.year("o_orderdate") == year).select("o_orderkey", *cols)

    store = TableStore(spark, names[0])
    store.save_month(upload(1995, F.col("o_custkey").cast("bigint").alias("amount")), 1995, 1)
    second = upload(1996, F.col("o_totalprice").alias("amount"))
    store = store.widened(second.schema, names[1])
    store.save_month(second, 1996, 1)
    store.save_month(upload(1997, F.col("o_custkey").cast("int").alias("amount"), F.col("o_orderpriority").alias("note")), 1997, 1)
    return store.load_all().select("o_orderkey", "amount", "note", TR.YEAR_COL, TR.MONTH_COL)


_LISTED = ["1-URGENT", "5-LOW, padded", " 2-HIGH", "3-MEDIUM"]


@register(
    "rules_roundtrip",
    f"""WITH {EV_ORDERS} SELECT o_orderkey, {', '.join(Q_FAILS)}, {', '.join(Q_CRITS)},
  o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS FAIL_listed, false AS CRIT_listed,
  CAST(_TOTAL_FAILS + CAST(o_orderpriority IN ('1-URGENT', '3-MEDIUM') AS INTEGER) AS INTEGER) AS _TOTAL_FAILS,
  _IS_OK AND NOT (o_orderpriority IN ('1-URGENT', '3-MEDIUM')) AS _IS_OK FROM ev""",
)
def rules_roundtrip(spark, sf_dir):
    """Rule set -> JSON file -> rule set -> evaluation; one rule holds a list
    with a comma and with padding inside its items."""
    path = shared_path(spark, "rules")
    listed = Rule(name="listed", fail_col="o_orderpriority", fail_op="in_exact", fail_val=_LISTED)
    write_rules(spark, [*pack_q(), listed], path)
    ev = evaluate(table(spark, sf_dir, "orders"), read_rules(spark, path))
    return ev.df.select("o_orderkey", *ev.fail_cols, *ev.crit_cols, ev.total_col, ev.ok_col)


@register("rules_roundtrip_fixed", ORACLE["fixed_kpi_pack"])
def rules_roundtrip_fixed(spark, sf_dir):
    """The fixed pack, whose values are lists, through a rule file."""
    path = shared_path(spark, "rules")
    write_rules(
        spark,
        P.fixed_kpi_pack("Battery Backup (Hrs)", "DG Automation Status", "SNMP Communicated", "RM Count (N+1)"),
        path,
    )
    ev = evaluate(sites_v1(spark, sf_dir), read_rules(spark, path))
    return ev.df.select("`SITE ID`", *[f"`{c}`" for c in ev.fail_cols], ev.total_col, ev.ok_col)


@register("rules_roundtrip_scoped", ORACLE["explicit_status_pack"])
def rules_roundtrip_scoped(spark, sf_dir):
    """The scoped pack with chosen status lists through a rule file."""
    path = shared_path(spark, "rules")
    write_rules(
        spark,
        P.nested_kpi_pack(
            "DG/Non-DG", "DG Automation Status", "Battery Backup (Hrs)", "RM Count (N+1)",
            snmp_col="SNMP Communicated (Y/N)", dg_states=["Failed", "No"], rm_states=["Degraded"],
            snmp_states=["No"], generation=5,
        ),
        path,
    )
    ev = evaluate(sites_v5(spark, sf_dir), read_rules(spark, path))
    return ev.df.select("`SITE ID`", *[f"`{c}`" for c in ev.fail_cols], ev.total_col)


@register(
    "rules_lenient",
    """WITH f AS (SELECT o_orderkey, coalesce(o_totalprice > 0.0, false) AS FAIL_compat,
  o_orderstatus = 'F' AS FAIL_no_scope, false AS FAIL_unknown_op FROM orders)
SELECT o_orderkey, FAIL_compat, FAIL_no_scope, FAIL_unknown_op,
  CAST(CAST(FAIL_compat AS INTEGER) + CAST(FAIL_no_scope AS INTEGER) AS INTEGER) AS _TOTAL_FAILS,
  NOT FAIL_compat AND NOT FAIL_no_scope AS _IS_OK, 'absent' AS skipped FROM f""",
)
def rules_lenient(spark, sf_dir):
    """The lenient modes of the first dashboards: a threshold that is no
    number counts as 0, a scope on an absent column is ignored, an unknown
    operator fails nothing, a rule on an absent column is skipped."""
    rules = [
        Rule(name="compat", fail_col="o_totalprice", fail_op=">", fail_val="n/a"),
        Rule(name="no_scope", use_pre=True, pre_col="nowhere", pre_op="==", pre_val="x",
             fail_col="o_orderstatus", fail_op="==", fail_val="F"),
        Rule(name="unknown_op", fail_col="o_orderstatus", fail_op="~", fail_val="F"),
        Rule(name="absent", fail_col="nowhere", fail_op="==", fail_val="x"),
    ]
    ev = evaluate(
        table(spark, sf_dir, "orders"), rules, on_missing="ignore_layer", threshold_mode="compat", strict_ops=False
    )
    skipped = ",".join(name for name, _ in ev.skipped)
    return ev.df.select("o_orderkey", *ev.fail_cols, ev.total_col, ev.ok_col, F.lit(skipped).alias("skipped"))


@register(
    "rules_skip_missing",
    """SELECT o_orderkey, o_orderstatus = 'F' AS FAIL_status, CAST(o_orderstatus = 'F' AS INTEGER) AS _TOTAL_FAILS
FROM orders""",
)
def rules_skip_missing(spark, sf_dir):
    """A rule whose scope names an absent column is left out."""
    rules = [
        Rule(name="scoped", use_pre=True, pre_col="nowhere", pre_op="==", pre_val="x",
             fail_col="o_orderstatus", fail_op="==", fail_val="F"),
        Rule(name="status", fail_col="o_orderstatus", fail_op="==", fail_val="F"),
    ]
    ev = evaluate(table(spark, sf_dir, "orders"), rules, on_missing="skip_rule")
    return ev.df.select("o_orderkey", *ev.fail_cols, ev.total_col)


@register(
    "csv_roundtrip",
    """SELECT c_custkey::BIGINT AS "Cust Key", '  ' || c_name || ' ' AS "Name",
  CASE WHEN c_nationkey IN (0, 1) THEN NULL ELSE c_nationkey::BIGINT END AS "Nation Key",
  c_mktsegment AS "name__1", CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS "Balance" FROM customer""",
)
def csv_roundtrip(spark, sf_dir):
    """Two uploads with multi-line, padded and case-duplicate headers, their
    columns in another order and one with a column more, in several files,
    with padded values and missing tokens -> one cleaned, typed frame."""
    c = table(spark, sf_dir, "customer")
    nk = F.col("c_nationkey")
    messy = [
        F.col("c_custkey").alias("Cust\nKey"),
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("  Name "),
        F.when(nk == 0, "None").when(nk == 1, "N/A").otherwise(nk.cast("string")).alias("Nation   Key"),
        F.col("c_mktsegment").alias("name"),
    ]
    paths = [shared_path(spark, "csv"), shared_path(spark, "csv")]
    even = F.col("c_custkey") % 2 == 0
    FL.write_csv(c.where(~even).repartition(3).select(*messy), paths[0])
    # The second upload's first duplicate is still "Name": its order is kept.
    other = [messy[2], F.col("c_acctbal").alias("Balance"), messy[1], messy[0], messy[3]]
    FL.write_csv(c.where(even).repartition(2).select(*other), paths[1])
    return FL.read_csv(spark, paths)


_PARTS = 3  # files of an upload


@register(
    "csv_quoted_breaks",
    """SELECT o_orderkey::BIGINT AS "Order Key",
  CASE o_orderkey % 3 WHEN 0 THEN 'line one,' || chr(10) || '"' || o_orderstatus || '"' || chr(10)
    WHEN 1 THEN '5" pipe, ' || o_orderpriority ELSE o_orderpriority END AS "Note",
  o_custkey::BIGINT AS "Cust", 'broken' AS upload FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey::BIGINT, CASE o_orderkey % 3 WHEN 1 THEN '5" pipe, ' || o_orderpriority ELSE o_orderpriority END,
  o_custkey::BIGINT, 'plain' FROM orders WHERE o_orderkey % 3 <> 0""",
)
def csv_quoted_breaks(spark, sf_dir):
    """An upload whose quoted cells hold line breaks, commas and quotes, and
    one that is plain but for quotes and commas, read without saying which is
    which: records that span lines are found by a survey of the raw lines."""
    o = table(spark, sf_dir, "orders")
    third = F.col("o_orderkey") % 3
    note = (
        F.when(third == 0, F.concat(F.lit('line one,\n"'), F.col("o_orderstatus"), F.lit('"\n')))
        .when(third == 1, F.concat(F.lit('5" pipe, '), F.col("o_orderpriority")))
        .otherwise(F.col("o_orderpriority"))
    )
    paths = [shared_path(spark, "csv"), shared_path(spark, "csv")]
    for path, name, mine in ((paths[0], "broken", third == 0), (paths[1], "plain", third != 0)):
        cols = [F.col("o_orderkey").alias("Order Key"), note.alias("Note"), F.col("o_custkey").alias("Cust")]
        FL.write_csv(o.where(mine).select(*cols, F.lit(name).alias("upload")).repartition(_PARTS), path)
    return FL.read_csv(spark, paths)


@register(
    "csv_ragged",
    """SELECT CAST(o_orderkey AS VARCHAR) AS "key", CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderstatus END AS status,
  NULL::INTEGER AS cells, NULL::INTEGER AS header_cells FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 3 = 0 THEN ',,' ELSE ',"F,x",,LOST' END, NULL,
  CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 4 END, 2 FROM orders WHERE o_orderkey % 7 = 0""",
)
def csv_ragged(spark, sf_dir):
    """Rows with fewer cells than the header are filled up; rows with more,
    empty ones included, are refused and listed with their cells."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    text = key.cast("string")
    fitting = F.when(key % 3 == 0, text).otherwise(F.concat_ws(",", text, F.col("o_orderstatus")))
    wide = F.concat(text, F.when(key % 3 == 0, F.lit(",,")).otherwise(F.lit(',"F,x",,LOST')))
    paths = [shared_path(spark, "csv"), shared_path(spark, "csv")]
    for path, record, mine in ((paths[0], fitting, key % 7 != 0), (paths[1], wide, key % 7 == 0)):
        # One line a record; each file starts with the header line.
        lines = o.where(mine).repartition(_PARTS).select(record.alias("key,status"))
        writer = lines.write.option("header", True).option("quote", "").option("sep", "\u0001").option("escapeQuotes", False)
        writer.csv(path)
    read = FL.read_csv(spark, paths[0], detect_types=False)
    refused = FL.wide_rows(spark, paths[1])
    none = F.lit(None)
    return read.select("key", "status", none.cast("int").alias("cells"), none.cast("int").alias("header_cells")).unionByName(
        refused.select(F.col("row").alias("key"), none.cast("string").alias("status"), "cells", "header_cells")
    )


@register(
    "stacked_export",
    f"""SELECT o_orderkey::BIGINT AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus, o_totalprice,
  o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'January' ELSE 'February' END AS Source_Month,
  2024::BIGINT AS Source_Year FROM orders""",
)
def stacked_export(spark, sf_dir):
    """Two uploads stacked, exported as CSV and read back."""
    path = shared_path(spark, "stacked")
    FL.write_csv(stack_frames(spark, sf_dir), path)
    return FL.read_csv(spark, path)


SITES_ID_SQL = """(SELECT
  CASE o_orderstatus WHEN 'F' THEN 'BHR-' WHEN 'O' THEN 'jhk-' ELSE 'WBL-' END || CAST(o_orderkey AS VARCHAR)
    AS "SITE ID",
  o_orderpriority AS "Cluster", o_orderstatus AS "DG/Non-DG", o_totalprice AS "Battery Backup (Hrs)",
  o_orderpriority AS "DG Automation Status", o_orderstatus AS "SNMP Communicated (Y/N)",
  o_custkey AS "RM Count (N+1)"
FROM orders)"""


@register(
    "column_resolve",
    f"""SELECT "SITE ID" AS "Site ID", "Cluster" AS "Cluster", "DG/Non-DG" AS "Site Type (DG/Non-DG)",
  "Battery Backup (Hrs)" AS "Battery Backup (Hrs)", "DG Automation Status" AS "DG Automation",
  "SNMP Communicated (Y/N)" AS "SNMP Communicated", "RM Count (N+1)" AS "RM Count",
  CASE WHEN upper("SITE ID") LIKE 'B%' THEN 'Bihar' WHEN upper("SITE ID") LIKE 'J%' THEN 'Jharkhand'
       ELSE 'Other' END AS Auto_Circle
FROM {SITES_ID_SQL}""",
)
def column_resolve(spark, sf_dir):
    """Role columns found by name patterns, projected under role names, plus
    the region label derived from the site-id prefix."""
    o = table(spark, sf_dir, "orders")
    st = F.col("o_orderstatus")
    sites = o.select(
        F.concat(F.when(st == "F", "BHR-").when(st == "O", "jhk-").otherwise("WBL-"), F.col("o_orderkey").cast("string"))
        .alias("SITE ID"),
        F.col("o_orderpriority").alias("Cluster"),
        st.alias("DG/Non-DG"),
        F.col("o_totalprice").alias("Battery Backup (Hrs)"),
        F.col("o_orderpriority").alias("DG Automation Status"),
        st.alias("SNMP Communicated (Y/N)"),
        F.col("o_custkey").alias("RM Count (N+1)"),
    )
    roles, _ = H.resolve_roles(sites.columns, H.ROLE_PATTERNS_V5)
    return H.with_circle(H.select_roles(sites, roles))


@register(
    "kpi_exports",
    f"""WITH {EV_ORDERS}
SELECT o_orderkey, 'actionable' AS export FROM ev WHERE FAIL_low_prio
UNION ALL
SELECT o_orderkey, 'severe' FROM ev WHERE FAIL_low_prio AND _TOTAL_FAILS >= 3""",
)
def kpi_exports(spark, sf_dir):
    """Both deep-dive exports of one KPI (all failing sites, severely
    degraded ones) from a single evaluation; read back from the CSV files."""
    from rulescope.operators.exports import export_kpi
    from rulescope.plans.queries import ev_orders

    paths = export_kpi(ev_orders(spark, sf_dir), "low_prio", shared_path(spark, "exports"))
    parts = [FL.read_csv(spark, p).select("o_orderkey", F.lit(name).alias("export")) for name, p in paths.items()]
    return parts[0].unionByName(parts[1])


@register(
    "report_job",
    f"""SELECT 'summary' AS output, NULL::VARCHAR AS key1, NULL::VARCHAR AS key2, total_sites AS n1, ok_sites AS n2
FROM ({ORACLE["health_summary"]})
UNION ALL SELECT 'kpi_totals', failure_type, NULL, fail_count, crit_count FROM ({ORACLE["kpi_totals"]})
UNION ALL SELECT 'matrix', o_orderstatus, o_orderpriority, total_sites, deficient_sites FROM ({ORACLE["matrix_two_key"]})
UNION ALL (WITH {EV_ORDERS}, d AS ({" UNION ALL ".join(
    f"SELECT o_orderpriority AS k, '{n}' AS t FROM ev WHERE FAIL_{n}" for n in Q_NAMES)})
  SELECT 'distribution', k, t, count(*)::BIGINT, (sum(count(*)) OVER (PARTITION BY k))::BIGINT FROM d GROUP BY k, t)
UNION ALL (WITH {EV_ORDERS}
  SELECT 'export_actionable', NULL, NULL, count(*)::BIGINT, sum(o_orderkey)::BIGINT FROM ev WHERE FAIL_urgent_f)
UNION ALL (WITH {EV_ORDERS}
  SELECT 'export_severe', NULL, NULL, count(*)::BIGINT, coalesce(sum(o_orderkey), 0)::BIGINT
  FROM ev WHERE FAIL_urgent_f AND _TOTAL_FAILS >= 3)""",
)
def report_job(spark, sf_dir):
    """The batch report (rule file -> evaluated copy -> every view and the
    exports of rules flagged for a deep dive), read back: all its outputs."""
    from rulescope.report import run_report

    rules_path = shared_path(spark, "report-rules")
    rules = [replace(r, make_dash=r.name == "urgent_f") for r in pack_q()]
    write_rules(spark, rules, rules_path)
    written = run_report(
        spark,
        table(spark, sf_dir, "orders"),
        rules_path,
        shared_path(spark, "report"),
        matrix_keys=["o_orderstatus", "o_orderpriority"],
        dims=["o_orderpriority"],
    )

    def part(name: str, output: str, key1: str | None, key2: str | None, n1: str, n2: str):
        df = spark.read.parquet(written[name]) if not name.startswith("export") else FL.read_csv(spark, written[name])
        key = lambda k: F.lit(None).cast("string") if k is None else F.col(k).cast("string")
        return df.select(
            F.lit(output).alias("output"), key(key1).alias("key1"), key(key2).alias("key2"),
            F.expr(n1).cast("long").alias("n1"), F.expr(n2).cast("long").alias("n2"),
        )

    parts = [
        part("summary", "summary", None, None, "total_sites", "ok_sites"),
        part("kpi_totals", "kpi_totals", "failure_type", None, "fail_count", "crit_count"),
        part("matrix", "matrix", "o_orderstatus", "o_orderpriority", "total_sites", "deficient_sites"),
        part("distribution_o_orderpriority", "distribution", "o_orderpriority", "failure_type", "failures", "total_errors"),
        part("export_urgent_f_actionable", "export_actionable", None, None, "count(1)", "coalesce(sum(o_orderkey), 0)"),
        part("export_urgent_f_severe", "export_severe", None, None, "count(1)", "coalesce(sum(o_orderkey), 0)"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register(
    "header_clean",
    """SELECT o_orderkey AS "Order Key", o_orderstatus AS "Name", o_orderpriority AS "name__1",
  o_custkey AS "Cust Key (N+1)" FROM orders""",
)
def header_clean(spark, sf_dir):
    """Header names with line breaks, runs of whitespace and a duplicate that
    differs only in case: normalised and made unique (a rename, no data
    work)."""
    o = table(spark, sf_dir, "orders")
    messy = o.select(
        F.col("o_orderkey").alias("Order\nKey"),
        F.col("o_orderstatus").alias("  Name "),
        F.col("o_orderpriority").alias("name"),
        F.col("o_custkey").alias("Cust\t\tKey\n(N+1)"),
    )
    return H.clean_headers(messy)


@register(
    "column_keywords",
    """SELECT CAST(o_orderkey AS VARCHAR) AS "Site ID", o_orderpriority AS "Cluster", o_orderstatus AS "DG Type (Macro/ULS)",
  o_clerkish AS "DG Automation Status", o_totalprice AS "Battery Backup (Hrs)"
FROM (SELECT *, 'c' || CAST(o_custkey AS VARCHAR) AS o_clerkish FROM orders)""",
)
def column_keywords(spark, sf_dir):
    """Role columns found by the second dashboard's keywords; the role that no
    column matches is left out."""
    o = table(spark, sf_dir, "orders")
    sites = o.select(
        F.col("o_totalprice").alias("Battery Backup (Hrs)"),
        F.col("o_orderpriority").alias("Zone"),
        F.col("o_orderstatus").alias("Macro/ULS"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("DG Automation"),
        F.col("o_orderkey").cast("string").alias("My SITE_ID"),
    )
    roles, _ = H.resolve_roles(sites.columns, H.ROLE_KEYWORDS_V4)
    return H.select_roles(sites, roles)


@register(
    "optional_dimensions",
    """SELECT o_orderpriority AS "Cluster", count(*)::BIGINT AS sites FROM orders GROUP BY 1""",
)
def optional_dimensions(spark, sf_dir):
    """Rows per value of the first optional dimension that the table has (of
    four, three are absent)."""
    sites = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("Cluster"), "o_orderkey")
    present = H.present_dimensions(sites.columns, ["Town", "Circle", "Cluster", "Owner"])
    return sites.groupBy(*present).agg(F.count(F.lit(1)).alias("sites"))
