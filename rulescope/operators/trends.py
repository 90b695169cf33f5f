"""Month-on-month trend views over a table tagged with (year, month).

The period key is the pair (year, month) — never the month name alone, so
the same month of two years stays apart — and periods sort chronologically.
Periods are labelled ``yyyy-MM``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulescope.functions.columns import num, qcol
from rulescope.functions.types import common_types

# Metric columns, base columns and labels of the trend report.
TREND_METRICS = ["EB_Run_Avg", "DG_Run_Avg", "BB_Run_Avg", "Solar_Run_Avg", "Total_Run_Avg"]
MONTHLY_MEAN_METRICS = ["EB_Run_Avg", "DG_Run_Avg", "BB_Run_Avg", "Solar_Run_Avg"]
SINGLE_PERIOD_METRICS = ["EB_Run_Avg", "DG_Run_Avg", "Solar_Run_Avg"]
TREND_BASE_COLS = ["Site ID", "Circle", "MIB Name", "Status"]
MEAN_LABELS = {
    "EB_Run_Avg": "EB Avg (h)",
    "DG_Run_Avg": "DG Avg (h)",
    "BB_Run_Avg": "BB Avg (h)",
    "Solar_Run_Avg": "Solar Avg (h)",
    "Total_Run_Avg": "Total Avg (h)",
}

YEAR_COL = "source_year"
MONTH_COL = "source_month"


def period_label(year: Column, month: Column) -> Column:
    """``yyyy-MM`` text of a (year, month) pair."""
    return F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))


def month_name(year: Column, month: Column) -> Column:
    return F.date_format(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)), "MMMM")


def month_short(year: Column, month: Column) -> Column:
    return F.date_format(F.make_date(year.cast("int"), month.cast("int"), F.lit(1)), "MMM")


def tag_period(df: DataFrame, year: int, month: int) -> DataFrame:
    """Add the literal (year, month) tag of one uploaded month."""
    if not 1 <= int(month) <= 12:
        raise ValueError(f"month {month} out of range")
    return df.withColumns({YEAR_COL: F.lit(int(year)), MONTH_COL: F.lit(int(month))})


def map_columns(
    df: DataFrame,
    mapping: Mapping[str, str],
    *,
    required: Sequence[str] = (),
    numeric: Sequence[str] = (),
) -> DataFrame:
    """Rename source columns to canonical names (``{canonical: source}``).

    Fails when a required canonical column is unmapped or its source is
    missing; canonical columns listed in ``numeric`` are coerced to DOUBLE.
    """
    missing = [c for c in required if c not in mapping]
    absent = [src for src in mapping.values() if src not in df.columns]
    if missing or absent:
        raise ValueError(f"unmapped required columns {missing}; unknown source columns {absent}")
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for dst, src in mapping.items():
        c = num(src, types[src]) if dst in numeric else qcol(src)
        cols.append(c.alias(dst))
    return df.select(*cols)


def _metric(df: DataFrame, m: str, absent: float | None) -> Column:
    if m in df.columns:
        return F.avg(num(m, df.schema[m].dataType))
    return F.lit(absent).cast("double")


def monthly_means(
    df: DataFrame,
    metrics: Sequence[str] = MONTHLY_MEAN_METRICS,
    *,
    labels: Mapping[str, str] | None = None,
    year_col: str = YEAR_COL,
    month_col: str = MONTH_COL,
    absent_as: float | None = 0.0,
) -> DataFrame:
    """Mean of each metric per period over coerced numbers.

    A metric column that is absent gives ``absent_as`` (0); a period whose
    values are all missing gives NULL.  One partial/final aggregate.
    """
    lab = {**MEAN_LABELS, **(labels or {})}
    y, m = qcol(year_col), qcol(month_col)
    out = df.groupBy(y.alias(year_col), m.alias(month_col)).agg(
        *[_metric(df, x, absent_as).alias(lab.get(x, x)) for x in metrics]
    )
    return out.select(
        year_col,
        month_col,
        period_label(F.col(year_col), F.col(month_col)).alias("period"),
        *[qcol(lab.get(x, x)) for x in metrics],
    )


def period_means(
    df: DataFrame,
    metrics: Sequence[str] = SINGLE_PERIOD_METRICS,
    *,
    labels: Mapping[str, str] | None = None,
    absent_as: float | None = 0.0,
) -> DataFrame:
    """Single-period fallback: one row with the mean of each metric."""
    lab = {**MEAN_LABELS, **(labels or {})}
    return df.agg(*[_metric(df, x, absent_as).alias(lab.get(x, x)) for x in metrics])


def periods_of(df: DataFrame, year_col: str = YEAR_COL, month_col: str = MONTH_COL) -> list[str]:
    """Sorted period labels present in ``df`` (bounded by the calendar: one
    per month).  Same job Spark runs for a pivot without explicit values."""
    rows = (
        df.select(period_label(qcol(year_col), qcol(month_col)).alias("p"))
        .distinct()
        .orderBy("p")
        .collect()
    )
    return [r["p"] for r in rows]


def month_pivot(
    df: DataFrame,
    ids: Sequence[str],
    metrics: Sequence[str] = TREND_METRICS,
    *,
    periods: Sequence[str] | None = None,
    year_col: str = YEAR_COL,
    month_col: str = MONTH_COL,
) -> DataFrame:
    """Metric x period report: one row per ``ids`` value, one column
    ``<metric>_<yyyy-MM>`` per metric and kept period, metric-major, periods
    chronological.  Metrics absent from ``df`` are NULL columns.

    ``periods`` selects the kept periods (default: all present).  Each cell
    is the *max* of the coerced metric over the rows of that (ids, period):
    deterministic even when (ids, period) repeats.  ``groupBy(ids).pivot``
    with explicit values: Spark aggregates by (ids, period) and then by ids,
    two exchanges, each after a map-side partial aggregate.  Without
    ``periods`` one small distinct job over the period columns finds them
    first (pass ``TrendStore.period_labels()``, read from the partition
    folder names, to skip it).
    """
    plist = list(periods) if periods is not None else periods_of(df, year_col, month_col)
    present = [m for m in metrics if m in df.columns]
    types = {f.name: f.dataType for f in df.schema.fields}
    src = df.select(
        *[qcol(i) for i in ids],
        period_label(qcol(year_col), qcol(month_col)).alias("__period"),
        *[num(m, types[m]).alias(m) for m in present],
    ).where(F.col("__period").isin(plist))
    out_cols = [qcol(i) for i in ids]
    if present and plist:
        aggs = [F.max(qcol(m)).alias(m) for m in present]
        pv = src.groupBy(*[qcol(i) for i in ids]).pivot("__period", plist).agg(*aggs)
        single = len(aggs) == 1
    else:
        pv = src.select(*[qcol(i) for i in ids]).distinct()
        single = False
    for m in metrics:
        for p in plist:
            if m in present:
                name = p if single else f"{p}_{m}"
                out_cols.append(qcol(name).alias(f"{m}_{p}"))
            else:
                out_cols.append(F.lit(None).cast("double").alias(f"{m}_{p}"))
    return pv.select(*out_cols)


def report_header(
    df: DataFrame,
    metrics: Sequence[str] = TREND_METRICS,
    *,
    year_col: str = YEAR_COL,
    month_col: str = MONTH_COL,
) -> DataFrame:
    """Two-level header of the pivot report for the periods present: one row
    per (metric, period) with the metric label (underscores as spaces), the
    metric family (text before the first underscore), the short month name
    and the pivot column name."""
    if not metrics:
        return df.sparkSession.createDataFrame(
            [],
            "metric_no int, metric string, metric_label string, metric_family string, "
            "period string, month_short string, column string",
        )
    structs = [
        F.struct(
            F.lit(i + 1).alias("metric_no"),
            F.lit(m).alias("metric"),
            F.lit(m.replace("_", " ")).alias("metric_label"),
            F.lit(m.split("_")[0]).alias("metric_family"),
        )
        for i, m in enumerate(metrics)
    ]
    periods = df.select(qcol(year_col).alias("y"), qcol(month_col).alias("m")).distinct()
    return periods.select(
        period_label(F.col("y"), F.col("m")).alias("period"),
        month_short(F.col("y"), F.col("m")).alias("month_short"),
        F.inline(F.array(*structs)),
    ).select(
        "metric_no",
        "metric",
        "metric_label",
        "metric_family",
        "period",
        "month_short",
        F.concat_ws("_", F.col("metric"), F.col("period")).alias("column"),
    )


def catalogue(
    df: DataFrame, year_col: str = YEAR_COL, month_col: str = MONTH_COL, rows: Column | None = None
) -> DataFrame:
    """Dataset catalogue: one row per (year, month) with its month name and
    row count, chronological.  ``rows`` is the aggregate that counts them
    where ``df`` holds counts already."""
    y, m = qcol(year_col), qcol(month_col)
    return (
        df.groupBy(y.cast("int").alias("year"), m.cast("int").alias("month"))
        .agg((F.count(F.lit(1)) if rows is None else rows).alias("rows"))
        .select("year", "month", month_name(F.col("year"), F.col("month")).alias("month_name"), "rows")
        .orderBy("year", "month")
    )


def stack(
    frames: Sequence[tuple[DataFrame, Mapping[str, object]]],
    *,
    allow_missing: bool = False,
) -> DataFrame:
    """UNION ALL of several datasets by column name, each tagged with
    literal columns (e.g. ``{"Source_Month": "January", "Source_Year": 2024}``).

    A column whose type differs between frames is widened in every frame to
    the least common type (:mod:`rulescope.functions.types`): whole numbers and
    fractions to DOUBLE, dates to timestamps, anything next to text to text.
    Under ANSI rules Spark would widen ``bigint`` and ``string`` to ``bigint``
    and fail at run time on text values.
    """
    if not frames:
        raise ValueError("nothing to stack")
    common = common_types(df.schema for df, _ in frames)
    out = None
    for df, tags in frames:
        cols = [
            qcol(f.name) if f.dataType == common[f.name.lower()] else qcol(f.name).cast(common[f.name.lower()]).alias(f.name)
            for f in df.schema.fields
        ]
        tagged = df.select(*cols, *[F.lit(v).alias(k) for k, v in tags.items()])
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=allow_missing)
    return out
