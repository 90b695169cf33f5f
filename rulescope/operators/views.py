"""Views over an evaluated table.

Each view is a function ``Evaluation -> DataFrame`` (lazy).  Plan shapes are
chosen for large inputs:

* every aggregate is algebraic (count / count_if / sum), so it combines
  map-side before the single exchange and a hot group key costs one row per
  map task, not one task holding a third of the data;
* multi-rule outputs aggregate first and unpivot the small aggregate
  (``inline`` of an array of structs) instead of multiplying detail rows;
* top-N uses ``orderBy().limit()`` (``TakeOrderedAndProject``: per-partition
  top-N, then a merge of N rows per partition) with a unique tie-break key;
* the only broadcast is a top-N key list, bounded by N;
* rules run once per row: grouped views count conditionally instead of
  filtering on a flag (a pushed-down flag filter would re-evaluate rules).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulescope.functions.columns import (
    all_of,
    any_of,
    is_numeric_type,
    pct,
    pct_card_text,
    pct_text,
    qcol,
)
from rulescope.operators.rules import Evaluation, _as_number, resolve_column

# The site table's drill-down levels (in cascade order), the
# default hierarchy of the deficiency matrix and the two-key matrix defaults.
DRILLDOWN_LEVELS = ["Auto_Circle", "Site- Principal Owner", "Macro/ULS", "District", "Town", "Cluster"]
MATRIX_HIERARCHY = ["Macro/ULS", "DG/ Non-DG", "Site- Principal Owner"]
MATRIX_TWO_KEYS = ["DG/Non-DG ULS", "Site- Principal Owner"]


def _keys(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _drop_null(df: DataFrame, keys: list[str], drop: bool) -> DataFrame:
    return df.where(all_of([qcol(k).isNotNull() for k in keys])) if drop else df


# --------------------------------------------------------------------------
# Summaries
# --------------------------------------------------------------------------


def health_summary(ev: Evaluation, severe_at: int = 3) -> DataFrame:
    """One row: total / OK / deficient / severely degraded (>= ``severe_at``
    failures) counts and OK / deficient percentages (0 for an empty input);
    the ``*_pct_text`` card labels are formatted like Python's ``.1f``."""
    counts = ev.df.agg(
        F.count(F.lit(1)).alias("total_sites"),
        F.count_if(ev.ok).alias("ok_sites"),
        F.count_if(~ev.ok).alias("deficient_sites"),
        F.count_if(ev.total >= F.lit(severe_at)).alias("severe_sites"),
    )
    total = F.col("total_sites")
    return counts.select(
        "total_sites",
        "ok_sites",
        "deficient_sites",
        "severe_sites",
        pct(F.col("ok_sites"), total).alias("ok_pct"),
        pct(F.col("deficient_sites"), total).alias("deficient_pct"),
        pct_card_text("ok_sites", "total_sites").alias("ok_pct_text"),
        pct_card_text("deficient_sites", "total_sites").alias("deficient_pct_text"),
    )


def _unpivot_counts(agg_row: DataFrame, entries: list[tuple[str, ...]], extra: list[str]) -> DataFrame:
    """Turn one wide aggregate row into one row per rule (tiny input)."""
    structs = [
        F.struct(
            F.lit(i + 1).alias("rule_no"),
            F.lit(label).alias("failure_type"),
            *[F.col(c).alias(n) for c, n in zip(cols, extra)],
        )
        for i, (label, *cols) in enumerate(entries)
    ]
    return agg_row.select(F.inline(F.array(*structs)))


def kpi_totals(ev: Evaluation) -> DataFrame:
    """Failures and critical failures per rule, one row per rule, in rule order
    (``rule_no``, ``failure_type``, ``fail_count``, ``crit_count``)."""
    if not ev.rules:
        return ev.df.sparkSession.createDataFrame(
            [], "rule_no int, failure_type string, fail_count bigint, crit_count bigint"
        )
    aggs = []
    entries = []
    for i, r in enumerate(ev.rules):
        aggs += [F.count_if(ev.fail(r.name)).alias(f"f{i}"), F.count_if(ev.crit(r.name)).alias(f"c{i}")]
        entries.append((r.name, f"f{i}", f"c{i}"))
    return _unpivot_counts(ev.df.agg(*aggs), entries, ["fail_count", "crit_count"])


def deep_dive_card(ev: Evaluation, rule: str, severe_at: int = 3) -> DataFrame:
    """KPI card: sites failing ``rule``, of those the critical ones, and of
    those the severely degraded ones (>= ``severe_at`` failures in total)."""
    fail = ev.fail(rule)
    return ev.df.agg(
        F.count_if(fail).alias("failed_sites"),
        F.count_if(ev.crit(rule)).alias("critical_sites"),
        F.count_if(fail & (ev.total >= F.lit(severe_at))).alias("severe_sites"),
    )


# --------------------------------------------------------------------------
# Grouped counts
# --------------------------------------------------------------------------


def deficient_by(ev: Evaluation, dim: str, *, drop_null_keys: bool = True) -> DataFrame:
    """Deficient (not all-OK) sites per value of ``dim`` (groups without a
    deficient site are left out).

    Conditional aggregation rather than ``where(~ok)``: Catalyst would push
    such a filter below the rule projection and evaluate every rule twice.
    """
    return (
        _drop_null(ev.df, [dim], drop_null_keys)
        .groupBy(qcol(dim))
        .agg(F.count_if(~ev.ok).alias("deficient_sites"))
        .where(F.col("deficient_sites") > 0)
    )


def kpi_by(ev: Evaluation, rule: str, dim: str, *, drop_null_keys: bool = True) -> DataFrame:
    """Sites failing ``rule`` per value of ``dim`` (conditional aggregation)."""
    return (
        _drop_null(ev.df, [dim], drop_null_keys)
        .groupBy(qcol(dim))
        .agg(F.count_if(ev.fail(rule)).alias("fail_count"))
        .where(F.col("fail_count") > 0)
    )


def fail_count_hist(ev: Evaluation, rule: str | None = None) -> DataFrame:
    """Number of sites per total failure count (optionally among the sites
    failing ``rule``)."""
    counted = F.count(F.lit(1)) if rule is None else F.count_if(ev.fail(rule))
    out = ev.df.groupBy(ev.total.alias("fail_count")).agg(counted.alias("sites"))
    return out if rule is None else out.where(F.col("sites") > 0)


def clusters_impacted(ev: Evaluation, rule: str, dim: str) -> DataFrame:
    """Exact number of distinct non-NULL ``dim`` values among sites failing
    ``rule``."""
    return ev.df.agg(F.count_distinct(F.when(ev.fail(rule), qcol(dim))).alias("impacted"))


def errors_by(ev: Evaluation, dim: str) -> DataFrame:
    """Total failures (sum over rules) per value of ``dim``; entities without
    any failure are left out.  NULL keys form their own group."""
    return (
        ev.df.groupBy(qcol(dim))
        .agg(F.sum(ev.total).cast("bigint").alias("total_errors"))
        .where(F.col("total_errors") > 0)
    )


def top_groups(
    counts: DataFrame, key: str, count_col: str, n: int | None
) -> DataFrame:
    """Largest ``n`` groups of a grouped count (ties broken by key ascending).
    ``n=None`` keeps all groups, ordered."""
    ordered = counts.orderBy(F.col(count_col).desc(), qcol(key).asc_nulls_last())
    return ordered if n is None else ordered.limit(n)


def deep_dive_topk(ev: Evaluation, rule: str, dim: str, n: int | None = 10) -> DataFrame:
    """Top ``n`` values of ``dim`` by number of sites failing ``rule``."""
    return top_groups(kpi_by(ev, rule, dim, drop_null_keys=False), dim, "fail_count", n)


# --------------------------------------------------------------------------
# Matrices (A9, A10, J2)
# --------------------------------------------------------------------------

MATRIX_NAMES = {
    "total": "total_sites",
    "ok": "ok_sites",
    "ok_pct": "ok_pct",
    "deficient": "deficient_sites",
    "deficient_pct": "deficient_pct",
}

# The display column names of the two dashboard matrices
# (the two-key matrix and the hierarchical matrix).
MATRIX_NAMES_TWO_KEY = {
    "total": "Total Sites",
    "ok": "Sites with no infra issue",
    "ok_pct": "%age OK",
    "deficient": "Sites having infra deficiency",
    "deficient_pct": "%age Deficient",
}
MATRIX_NAMES_HIERARCHY = {
    "total": "Total Sites",
    "ok": "Sites with no infra issue",
    "ok_pct": "% OK",
    "deficient": "Sites with Deficiencies",
    "deficient_pct": "% Deficient",
}


def matrix(
    ev: Evaluation,
    keys: str | Sequence[str],
    *,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Deficiency matrix over one or more group keys (no subtotals).

    Per group: total, OK, OK % (text, half-even to one decimal), deficient,
    deficient % and one failure count per rule (column named after the rule).
    One ``groupBy().agg()``: a single exchange whatever the number of rules.
    """
    ks = _keys(keys)
    nm = {**MATRIX_NAMES, **(names or {})}
    taken = {c.lower() for c in ks} | {v.lower() for v in nm.values()}
    clash = [r.name for r in ev.rules if r.name.lower() in taken]
    if clash:
        raise ValueError(f"rule names {clash} clash with matrix keys or columns; rename them or pass names=")
    per_rule = [F.count_if(ev.fail(r.name)).alias(f"__r{i}") for i, r in enumerate(ev.rules)]
    agg = ev.df.groupBy(*[qcol(k) for k in ks]).agg(
        F.count(F.lit(1)).alias("__total"), F.count_if(ev.ok).alias("__ok"), *per_rule
    )
    total, ok = F.col("__total"), F.col("__ok")
    deficient = total - ok
    return agg.select(
        *[qcol(k) for k in ks],
        total.alias(nm["total"]),
        ok.alias(nm["ok"]),
        pct_text(pct(ok, total)).alias(nm["ok_pct"]),
        deficient.alias(nm["deficient"]),
        pct_text(pct(deficient, total)).alias(nm["deficient_pct"]),
        *[F.col(f"__r{i}").alias(r.name) for i, r in enumerate(ev.rules)],
    )


def hierarchy_keys(columns: Sequence[str], preferred: Sequence[str] = MATRIX_HIERARCHY) -> list[str]:
    """Keys of a hierarchical matrix: the preferred keys that exist (name
    lookup ignores case and whitespace), else the first column."""
    present = []
    for c in preferred:
        hit = resolve_column(columns, c)
        if hit is not None and hit not in present:
            present.append(hit)
    return present or [columns[0]]


def matrix_keys(columns: Sequence[str], preferred: Sequence[str] = MATRIX_TWO_KEYS) -> list[str]:
    """Keys of the two-key matrix: each preferred key if it exists (loose
    name lookup), else the first column, key by key."""
    return [resolve_column(columns, c) or columns[0] for c in preferred]


# --------------------------------------------------------------------------
# Long failure table and distributions
# --------------------------------------------------------------------------


def failure_long(ev: Evaluation, ids: str | Sequence[str]) -> DataFrame:
    """One row per failing (row, rule): ``ids`` + ``failure_type``.

    Generates rows only for failing flags (an array of the failing rule
    names, exploded), never a row per (row, rule) pair.  The outer explode
    keeps Catalyst from testing the array's size before it, which would
    evaluate every rule a second time.
    """
    return (
        ev.df.select(*[qcol(i) for i in _keys(ids)], ev.failing().alias("__f"))
        .select(*[qcol(i) for i in _keys(ids)], F.explode_outer("__f").alias("failure_type"))
        .where("failure_type IS NOT NULL")
    )


def distribution_by_dim(ev: Evaluation, dim: str, top_n: int | None = None) -> DataFrame:
    """Failures per (``dim`` value, rule) for the ``top_n`` entities with the
    most failures (all entities when ``None``); ties by key ascending.

    One scan and no join: failing (entity, rule) pairs are counted, combined
    map-side; an entity's counts (at most one per rule) are gathered in one
    row with their total; the best rows are taken and unpivoted.
    """
    counts = failure_long(ev, dim).groupBy(qcol(dim), "failure_type").agg(F.count(F.lit(1)).alias("failures"))
    wide = counts.groupBy(qcol(dim)).agg(
        F.sum("failures").alias("total_errors"),
        F.sort_array(F.collect_list(F.struct("failure_type", "failures"))).alias("__by_rule"),
    )
    if top_n is not None:
        wide = top_groups(wide, dim, "total_errors", top_n)
    return wide.select(qcol(dim), "total_errors", F.inline("__by_rule"))


def restrict_to_top(
    detail: DataFrame, ev: Evaluation, dim: str, top_n: int
) -> DataFrame:
    """Detail rows (e.g. the long failure table) of the ``top_n`` entities
    with the most failures: a left-semi join with the top-N key list.

    The key list has at most ``top_n`` rows; adaptive execution broadcasts it
    if it is small in bytes.
    """
    keys = top_groups(errors_by(ev, dim), dim, "total_errors", top_n).select(qcol(dim).alias("__k"))
    return detail.join(keys, on=qcol(dim).eqNullSafe(F.col("__k")), how="left_semi")


def failure_long_top(ev: Evaluation, ids: str | Sequence[str], dim: str, top_n: int) -> DataFrame:
    """The long failure table of the ``top_n`` entities with the most
    failures, with the rules evaluated once.

    The failing rows, each with its ids, its entity and the names of its
    failing rules, are written to the shared folder; the ranking and the detail
    both read that copy.  :func:`restrict_to_top` needs no copy and scans and
    evaluates the source twice: better for few rules over few columns.
    """
    from rulescope.session import shared_path

    keys = _keys(ids)
    cols = [qcol(c) for c in dict.fromkeys([*keys, dim])]
    spark = ev.df.sparkSession
    target = shared_path(spark, "failing")
    # An outer explode would test the array's size before it, and so
    # evaluate the rules a second time; here the array is written as it is.
    ev.df.select(*cols, ev.failing().alias("__f")).write.parquet(target)
    failing = spark.read.parquet(target)
    errors = failing.groupBy(qcol(dim)).agg(F.sum(F.size("__f")).alias("total_errors")).where("total_errors > 0")
    top = top_groups(errors, dim, "total_errors", top_n).select(qcol(dim).alias("__k"))
    detail = failing.join(top, on=qcol(dim).eqNullSafe(F.col("__k")), how="left_semi")
    return detail.select(*[qcol(k) for k in keys], F.explode("__f").alias("failure_type"))


# --------------------------------------------------------------------------
# Rankings and row-level outputs
# --------------------------------------------------------------------------


def actionable(
    ev: Evaluation,
    view: str = "deficient",
    *,
    rule: str | None = None,
    severe_at: int = 3,
) -> Evaluation:
    """Rows of a drill-down view: ``all``, ``deficient`` (not OK), ``severe``
    (>= ``severe_at`` failures), ``kpi`` (failing ``rule``) or ``kpi_severe``
    (failing ``rule`` and severe).

    For a clean export (``.clean()``) Catalyst prunes the flag projection
    and the rules run once, inside the pushed-down filter.  An output that
    also keeps generated columns evaluates the rules the filter references
    twice (in the filter, then for the surviving rows); a job deriving
    several such outputs should start from :func:`materialized`.
    """
    conds = {
        "all": None,
        "deficient": ~ev.ok,
        "severe": ev.total >= F.lit(severe_at),
    }
    if view in ("kpi", "kpi_severe"):
        if rule is None:
            raise ValueError("view 'kpi' needs a rule")
        conds["kpi"] = ev.fail(rule)
        conds["kpi_severe"] = ev.fail(rule) & (ev.total >= F.lit(severe_at))
    if view not in conds:
        raise ValueError(f"unknown view {view!r}")
    cond = conds[view]
    return ev if cond is None else ev.where(cond)


def worst_first(ev: Evaluation, site_col: str) -> DataFrame:
    """Clean columns plus the failure count, worst first (ties by site id).

    The composite sort key keeps the range partitioning balanced: a failure
    count alone has only a handful of distinct values.
    """
    cols = [qcol(c) for c in ev.source_columns]
    return ev.df.select(*cols, ev.total.alias("fail_count")).orderBy(
        F.col("fail_count").desc(), qcol(site_col).asc_nulls_last()
    )


def worst_sites(ev: Evaluation, site_col: str, n: int = 10, *, deficient_only: bool = True) -> DataFrame:
    """Top ``n`` rows by failure count (``TakeOrderedAndProject``).

    Deficient rows rank above OK rows, so the deficient-only filter is
    applied after the limit: the same rows, and no filter that Catalyst
    could push below the rule projection (which would evaluate the rules
    twice)."""
    top = worst_first(ev, site_col).limit(n)
    return top.where(F.col("fail_count") > 0) if deficient_only else top


def materialized(ev: Evaluation, path: str | None = None, keep: Sequence[str] | None = None) -> Evaluation:
    """Write the evaluated table (``keep`` + generated columns; all input
    columns by default) as Parquet in the shared folder and continue from
    the written copy.

    For jobs that derive several row-level outputs (exports by status,
    severity, rule): the rules run once, filters on flags and counts reach
    the Parquet scan of the copy, and the lineage is cut, so a lost executor
    re-reads the copy instead of re-running the whole evaluation.
    """
    from rulescope.session import shared_path

    spark = ev.df.sparkSession
    target = path or shared_path(spark, "evaluated")
    cols = list(keep) if keep is not None else list(ev.source_columns)
    ev.df.select(*[qcol(c) for c in cols + ev.generated]).write.parquet(target)
    return replace(ev, df=spark.read.parquet(target), source_columns=cols)


def display_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Fixed display projection: the ``wanted`` columns that exist, in order."""
    present = set(df.columns)
    return df.select(*[qcol(c) for c in wanted if c in present])


def preview(df: DataFrame, order: str | Sequence[str], n: int = 1000) -> DataFrame:
    """First ``n`` rows in a stated order (a display cap, not a sample)."""
    return df.orderBy(*[qcol(c).asc_nulls_last() for c in _keys(order)]).limit(n)


# --------------------------------------------------------------------------
# Drill-down, facets and search
# --------------------------------------------------------------------------


def _equals(df: DataFrame, col: str, value: Any) -> Column:
    """Typed equality that still reaches the Parquet scan as a pushed filter."""
    dtype = df.schema[col].dataType
    c = qcol(col)
    if isinstance(dtype, T.StringType):
        return c == F.lit(str(value))
    if is_numeric_type(dtype):
        number = _as_number(value)
        if number is not None:
            return c == F.lit(value if isinstance(value, (int, float)) else number)
    return c.cast("string") == F.lit(str(value))


def drilldown(df: DataFrame, filters: Mapping[str, Any], unknown_label: str | None = None) -> DataFrame:
    """Chained equality filters; a value of ``None`` or ``"All"`` means no
    filter.  With ``unknown_label``, choosing that label selects NULLs (the
    same mapping the facet options use)."""
    out = df
    for col, value in filters.items():
        if value is None or value == "All":
            continue
        if unknown_label is not None and value == unknown_label:
            out = out.where(qcol(col).isNull() | (_equals(df, col, value)))
        else:
            out = out.where(_equals(df, col, value))
    return out


def drilldown_eval(ev: Evaluation, filters: Mapping[str, Any], unknown_label: str | None = None) -> Evaluation:
    return ev.with_df(drilldown(ev.df, filters, unknown_label))


def facets_cascade(
    df: DataFrame,
    levels: Sequence[str],
    selections: Mapping[str, Any] | None = None,
    *,
    unknown_label: str | None = None,
) -> DataFrame:
    """Options of every facet level in one scan: the distinct combinations of
    the levels' columns first (combined map-side), then a row per level of
    each.

    The options of level *n* are the distinct values of that column among
    the rows matching the selections made at levels < *n* (``None``/``All``
    = no selection).  Output: ``level`` (1-based), ``facet``, ``value``
    (text; NULL shown as ``unknown_label`` when given), sorted.
    """
    if not levels:
        return df.sparkSession.createDataFrame([], "level int, facet string, value string")
    selections = dict(selections or {})
    prefix: list[Column] = []
    structs = []
    for i, col in enumerate(levels):
        value = qcol(col).cast("string")
        if unknown_label is not None:
            value = F.coalesce(value, F.lit(unknown_label))
        structs.append(
            F.struct(
                F.lit(i + 1).alias("level"),
                F.lit(col).alias("facet"),
                value.alias("value"),
                all_of(list(prefix)).alias("keep"),
            )
        )
        chosen = selections.get(col)
        if chosen is not None and chosen != "All":
            if unknown_label is not None and chosen == unknown_label:
                prefix.append(qcol(col).isNull() | _equals(df, col, chosen))
            else:
                prefix.append(_equals(df, col, chosen))
    combinations = df.select(*[qcol(c) for c in dict.fromkeys(levels)]).distinct()
    return (
        combinations.select(F.inline(F.array(*structs)))
        .where("keep")
        .select("level", "facet", "value")
        .distinct()
        .orderBy("level", F.col("value").asc_nulls_last())
    )


def distinct_values(df: DataFrame, col: str, unknown_label: str | None = None) -> DataFrame:
    """Sorted distinct values of one column (missing -> ``unknown_label``)."""
    value = qcol(col).cast("string")
    if unknown_label is not None:
        value = F.coalesce(value, F.lit(unknown_label))
    return df.select(value.alias("value")).distinct().orderBy(F.col("value").asc_nulls_last())


def search_any_column(
    df: DataFrame,
    query: str,
    columns: Sequence[str] | None = None,
    *,
    regex: bool = False,
) -> DataFrame:
    """Rows where any column's text contains ``query`` (case-insensitive).
    ``regex=True`` treats ``query`` as a (Java) regular expression, matched
    case-insensitively; the pattern itself is not lower-cased, so escapes
    such as ``\\D`` keep their meaning.  Non-text columns are searched in
    Spark's text form (large or small doubles print as e.g. ``1.0E7``)."""
    cols = list(columns) if columns is not None else df.columns
    tests = []
    for c in cols:
        text = qcol(c).cast("string")
        test = text.rlike("(?iu)" + query) if regex else F.lower(text).contains(query.lower())
        tests.append(F.coalesce(test, F.lit(False)))
    return df.where(any_of(tests))
