"""Trend views on the hand-written months fixture."""

import pytest
from pyspark.sql import functions as F

from rulescope.operators import trends as TR


@pytest.fixture()
def months(spark):
    rows = [
        ("s1", 2024, 1, "1.5", "2"), ("s1", 2025, 1, "2.5", "x"), ("s2", 2024, 1, "3.5", None),
        ("s2", 2024, 2, "bad", "1"), ("s1", 2024, 1, "9.0", "4"),  # repeated (site, month)
    ]
    return spark.createDataFrame(rows, "site string, source_year int, source_month int, EB_Run_Avg string, DG_Run_Avg string")


def test_monthly_means_same_month_two_years(months):
    out = {(r[0], r[1]): r for r in TR.monthly_means(months).collect()}
    assert set(out) == {(2024, 1), (2024, 2), (2025, 1)}
    assert out[(2024, 1)]["EB Avg (h)"] == pytest.approx((1.5 + 3.5 + 9.0) / 3)
    assert out[(2024, 2)]["EB Avg (h)"] is None  # all missing -> missing
    assert out[(2024, 1)]["BB Avg (h)"] == 0.0  # absent metric -> 0
    assert out[(2025, 1)]["DG Avg (h)"] is None
    assert out[(2024, 1)]["period"] == "2024-01"


def test_period_means(months):
    r = TR.period_means(months).first()
    assert r["EB Avg (h)"] == pytest.approx((1.5 + 2.5 + 3.5 + 9.0) / 4)
    assert r["Solar Avg (h)"] == 0.0


def test_month_pivot_max_padding_order(months):
    pv = TR.month_pivot(months, ["site"], ["EB_Run_Avg", "BB_Run_Avg"])
    assert pv.columns == ["site", "EB_Run_Avg_2024-01", "EB_Run_Avg_2024-02", "EB_Run_Avg_2025-01",
                          "BB_Run_Avg_2024-01", "BB_Run_Avg_2024-02", "BB_Run_Avg_2025-01"]
    rows = {r["site"]: r for r in pv.collect()}
    assert rows["s1"]["EB_Run_Avg_2024-01"] == 9.0  # max, deterministic
    assert rows["s1"]["EB_Run_Avg_2025-01"] == 2.5
    assert rows["s2"]["EB_Run_Avg_2024-02"] is None
    assert rows["s1"]["BB_Run_Avg_2024-01"] is None


def test_month_pivot_selected_periods(months):
    pv = TR.month_pivot(months, ["site"], ["EB_Run_Avg"], periods=["2025-01"])
    assert pv.columns == ["site", "EB_Run_Avg_2025-01"]
    assert pv.where(F.col("`EB_Run_Avg_2025-01`").isNotNull()).count() == 1


def test_unpivot_pivot_roundtrip(spark):
    rows = [("a", 2024, m, float(m), float(10 * m)) for m in (1, 2, 3)] + [("b", 2024, 2, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "site string, source_year int, source_month int, EB_Run_Avg double, DG_Run_Avg double")
    pv = TR.month_pivot(df, ["site"], ["EB_Run_Avg", "DG_Run_Avg"])
    back = pv.unpivot("site", [c for c in pv.columns if c != "site"], "k", "v").where("v IS NOT NULL")
    got = sorted((r["site"], r["k"], r["v"]) for r in back.collect())
    want = sorted([(s, f"EB_Run_Avg_{y}-{m:02d}", e) for s, y, m, e, _ in rows]
                  + [(s, f"DG_Run_Avg_{y}-{m:02d}", d) for s, y, m, _, d in rows])
    assert got == want


def test_stack_widens_conflicting_types(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([("two", "y")], "k string, v string")
    out = TR.stack([(a, {"Source_Month": "January", "Source_Year": 2024}),
                    (b, {"Source_Month": "February", "Source_Year": 2024})])
    assert dict(out.dtypes)["k"] == "string"
    assert sorted(r["k"] for r in out.collect()) == ["1", "two"]


def test_catalogue_and_header(months):
    cat = TR.catalogue(months).collect()
    assert [(r.year, r.month, r.month_name, r.rows) for r in cat] == [
        (2024, 1, "January", 3), (2024, 2, "February", 1), (2025, 1, "January", 1)]
    hdr = TR.report_header(months, ["EB_Run_Avg"]).orderBy("period").collect()
    assert [(r.metric_label, r.metric_family, r.month_short, r.column) for r in hdr][0] == (
        "EB Run Avg", "EB", "Jan", "EB_Run_Avg_2024-01")


def test_map_columns_validation(months):
    with pytest.raises(ValueError):
        TR.map_columns(months, {"Site ID": "nope"}, required=["Site ID"])
    with pytest.raises(ValueError):
        TR.map_columns(months, {"Circle": "site"}, required=["Site ID"])
    out = TR.map_columns(months, {"Site ID": "site", "EB_Run_Avg": "EB_Run_Avg"}, numeric=["EB_Run_Avg"])
    assert dict(out.dtypes)["EB_Run_Avg"] == "double"


def test_stack_export_csv(spark, tmp_dir):
    import os

    from rulescope.sources import files as FL

    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([("3", "z")], "k string, v string")
    out = TR.stack([(a, {"Source_Month": "January", "Source_Year": 2024}),
                    (b, {"Source_Month": "February", "Source_Year": 2025})])
    path = os.path.join(tmp_dir, "stacked")
    FL.write_csv(out, path, single_file=True)
    back = FL.read_csv(spark, path)
    assert back.count() == 3 and back.columns == ["k", "v", "Source_Month", "Source_Year"]
    assert dict(back.dtypes)["k"] == "bigint"  # all values are integers again after the text round trip
