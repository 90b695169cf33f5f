"""End to end on a hand-written site table with the real column names:
CSV (multi-line headers, 'None' tokens) -> ingest -> default pack ->
matrix / summary / deep dive / facets / export.  Expected values are
computed by plain Python over the same rows (brute force)."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from rulescope.operators import packs as P
from rulescope.operators import views as V
from rulescope.operators.rules import Rule, evaluate
from rulescope.sources import files as FL
from rulescope.sources import headers as H
from rulescope.sources.store import TrendStore

HEADER = [
    "Sl No.", "SITE ID", "Cluster", "District", "Site- Principal Owner", "DG/Non-DG ULS", "DG/Non-DG",
    "Macro/ULS", "Town", "DG Automation\n(Yes/No)", "SMPS/IPMS/PIU Faulty\n(Yes/No)", "BB Low\n(Yes/No)",
    "High Temperature\n(Yes/No)", "TCU Status\n(OK/Not OK)", "Earthing Status\n(Ok/Not OK)",
    "Owner/Access Issues\n(Yes/No)", "Battery Backup\n(Hrs)", "Infra actions identifed",
]
OWNERS = ["Indus", "ATC", "Summit"]
TOWNS = ["Patna", "Ranchi", "Gaya"]


def _rows():
    rows = []
    for i in range(1, 41):
        district = ["PAT", "RAN", "GAY", "JAM"][i % 4]
        prefix = "B" if district in ("PAT", "GAY") else "J"
        rows.append([
            i, f"{prefix}{district}-{i:04d}", f"C{i % 5}", f"D{i % 5}", OWNERS[i % 3],
            "DG" if i % 2 else "Non-DG", "DG" if i % 3 else "Non-DG", "Macro" if i % 4 else "ULS", TOWNS[i % 3],
            "No" if i % 5 == 0 else "Yes", "Yes" if i % 7 == 0 else "No", "Yes" if i % 4 == 1 else "No",
            "Yes" if i % 9 == 0 else "No", "Not OK" if i % 6 == 0 else "OK", "not ok" if i % 8 == 0 else "OK",
            "Yes" if i % 11 == 0 else "No", f"{(i % 6) + 0.5:.2f}", ["None", "BB Replace", "DG Service"][i % 3],
        ])
    return rows


def _expected_flags(r):
    d = dict(zip([h.replace("\n", " ") for h in HEADER], r))
    return {
        "Automation Issue": d["DG/Non-DG"].lower() == "dg" and d["DG Automation (Yes/No)"].lower() == "no",
        "SMPS/IPMS Fault": d["SMPS/IPMS/PIU Faulty (Yes/No)"].lower() == "yes",
        "Low BB": d["BB Low (Yes/No)"].lower() == "yes",
        "High Temp": d["High Temperature (Yes/No)"].lower() == "yes",
        "TCU Fault": d["TCU Status (OK/Not OK)"].lower() == "not ok",
        "Earthing Issue": d["Earthing Status (Ok/Not OK)"].lower() == "not ok",
        "Access Issue": d["Owner/Access Issues (Yes/No)"].lower() == "yes",
    }, d


@pytest.fixture(scope="module")
def site_csv(tmp_path_factory):
    path = os.path.join(tmp_path_factory.mktemp("sites"), "sites.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(HEADER)
        w.writerows(_rows())
    return path


@pytest.fixture(scope="module")
def ev(spark, site_csv):
    sites = H.with_circle(FL.read_csv(spark, site_csv))
    return evaluate(sites, P.default_pack())


def test_ingest_shape(ev):
    cols = ev.source_columns
    assert "DG Automation (Yes/No)" in cols and "Auto_Circle" in cols
    types = dict(ev.df.dtypes)
    assert types["Sl No."] == "bigint" and types["Battery Backup (Hrs)"] == "double"
    # the text 'None' is read as missing
    assert ev.df.where(F.col("`Infra actions identifed`").isNull()).count() == sum(1 for r in _rows() if r[-1] == "None")


def test_flags_and_summary_match_brute_force(ev):
    want = {r[1]: _expected_flags(r)[0] for r in _rows()}
    got = {row["SITE ID"]: {n: row["FAIL_" + n] for n in ev.names} for row in ev.df.collect()}
    assert got == want
    s = V.health_summary(ev).first()
    ok = sum(1 for f in want.values() if not any(f.values()))
    severe = sum(1 for f in want.values() if sum(f.values()) >= 3)
    assert (s["total_sites"], s["ok_sites"], s["severe_sites"]) == (40, ok, severe)


def test_hierarchy_matrix_brute_force(ev):
    keys = V.hierarchy_keys(ev.df.columns)
    assert keys == ["Macro/ULS", "DG/Non-DG", "Site- Principal Owner"]  # "DG/ Non-DG" resolved
    m = {tuple(r[k] for k in keys): r for r in V.matrix(ev, keys).collect()}
    groups: dict = {}
    for r in _rows():
        flags, d = _expected_flags(r)
        g = groups.setdefault((d["Macro/ULS"], d["DG/Non-DG"], d["Site- Principal Owner"]), [0, 0, 0])
        g[0] += 1
        g[1] += not any(flags.values())
        g[2] += flags["Low BB"]
    assert set(m) == set(groups)
    for k, (t, ok, low) in groups.items():
        assert (m[k]["total_sites"], m[k]["ok_sites"], m[k]["Low BB"]) == (t, ok, low)


def test_deep_dive_and_export(spark, ev, tmp_path):
    card = V.deep_dive_card(ev, "Low BB").first()
    rows = [(r, _expected_flags(r)[0]) for r in _rows()]
    assert card["failed_sites"] == sum(f["Low BB"] for _, f in rows)
    towns = {r["Town"]: r["fail_count"] for r in V.deep_dive_topk(ev, "Low BB", "Town").collect()}
    want: dict = {}
    for r, f in rows:
        if f["Low BB"]:
            want[r[8]] = want.get(r[8], 0) + 1
    assert towns == want
    out = str(tmp_path / "export")
    FL.write_csv(V.actionable(ev, "kpi", rule="Low BB").clean(), out)
    back = FL.read_csv(spark, out)
    assert back.count() == card["failed_sites"]
    assert not any(c.startswith("FAIL_") or c.startswith("CRIT_") or c.startswith("_") for c in back.columns)


def test_cascading_facets_over_present_levels(ev):
    levels = H.present_dimensions(ev.df.columns, V.DRILLDOWN_LEVELS)
    assert levels == ["Auto_Circle", "Site- Principal Owner", "Macro/ULS", "District", "Town", "Cluster"]
    f = V.facets_cascade(ev.df, levels, {"Auto_Circle": "Bihar", "Site- Principal Owner": "ATC"})
    circles = {r["value"] for r in f.where("level = 1").collect()}
    assert circles == {"Bihar", "Jharkhand"}
    districts = {r["value"] for r in f.where("facet = 'District'").collect()}
    want = {r[3] for r in _rows() if r[1][0] == "B" and r[4] == "ATC"}
    assert districts == want


def test_store_salted_bulk_save(spark, ev, tmp_path):
    store = TrendStore(spark, str(tmp_path / "store"))
    tagged = ev.clean().withColumns({"source_year": F.lit(2024), "source_month": (F.col("`Sl No.`") % 3 + 1).cast("int")})
    store.save_tagged(tagged)
    files = [f for _, _, fs in os.walk(str(tmp_path / "store")) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 3 * 2  # rebalanced by month
    assert [r.rows for r in store.list_months().collect()] == [13, 14, 13]


def test_report_job_writes_every_output(spark, site_csv, tmp_path):
    import json

    from rulescope.report import load_table, run_report

    rules = [dict(r, make_dash=(r["name"] == "Low BB")) for r in P.DEFAULT_PACK]
    rules_path = str(tmp_path / "rules.json")
    with open(rules_path, "w") as f:
        json.dump(rules, f)
    written = run_report(spark, load_table(spark, site_csv), rules_path, str(tmp_path / "report"))
    assert {"summary", "kpi_totals", "matrix", "distribution_Cluster", "distribution_Site-_Principal_Owner",
            "export_Low_BB_actionable", "export_Low_BB_severe"} <= set(written)
    summary = spark.read.parquet(written["summary"]).first()
    assert summary["total_sites"] == 40
    want_low = sum(_expected_flags(r)[0]["Low BB"] for r in _rows())
    assert FL.read_csv(spark, written["export_Low_BB_actionable"]).count() == want_low
    totals = {r["failure_type"]: r["fail_count"] for r in spark.read.parquet(written["kpi_totals"]).collect()}
    assert totals["Low BB"] == want_low
    keys = spark.read.parquet(written["matrix"]).columns[:3]
    assert keys == ["Macro/ULS", "DG/Non-DG", "Site- Principal Owner"]


def test_report_command_line(site_csv, tmp_path):
    import json
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    rules_path = str(tmp_path / "rules.json")
    with open(rules_path, "w") as f:
        json.dump([dict(r, make_dash=(r["name"] == "High Temp")) for r in P.DEFAULT_PACK], f)
    out = subprocess.run(
        [sys.executable, "-m", "rulescope", "report", "--input", site_csv, "--rules", rules_path,
         "--out", str(tmp_path / "rep")],
        cwd=root, capture_output=True, text=True, timeout=600,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    names = {line.split("\t")[0] for line in out.stdout.splitlines() if "\t" in line}
    assert {"summary", "matrix", "export_High_Temp_actionable", "export_High_Temp_severe"} <= names


def test_exports_of_similar_names_do_not_share_a_file(spark, tmp_dir):
    from rulescope.operators.exports import export_kpi, file_name

    rules = [Rule(name=n, fail_col="v", fail_op="==", fail_val=str(k)) for k, n in enumerate(["A/B", "A B", "a_b", "C D"])]
    ev = evaluate(spark.createDataFrame([(0,), (1,), (1,), (2,)], "v int"), rules)
    paths = {n: export_kpi(ev, n, os.path.join(tmp_dir, "similar"))["actionable"] for n in ev.names}
    assert len({p.lower() for p in paths.values()}) == 4 and paths["C D"].endswith("/C_D_actionable")
    assert [FL.read_csv(spark, paths[n]).count() for n in ev.names] == [1, 2, 1, 0]
    assert file_name("Low BB", ["Low BB", "x"]) == "Low_BB"
