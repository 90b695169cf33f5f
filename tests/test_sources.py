"""Headers, CSV ingest, rule files and the month store."""

import os
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulescope.functions.types import common_type
from rulescope.operators.rules import Rule
from rulescope.plans.queries import pack_q
from rulescope.sources import csv_survey
from rulescope.sources import files as FL
from rulescope.sources import headers as H
from rulescope.sources.rules_io import read_rules, rules_from_json, rules_to_json, write_rules
from rulescope.sources.store import TrendStore, footer_counts
from rulescope.sources.table_store import TableStore
from tests.conftest import SF_SMALL


def test_normalize_and_unique():
    names = [H.normalize_header(n) for n in ["DG Automation\n(Yes/No)", "  a   b ", "X", "x", "X__1", "X"]]
    assert names[:2] == ["DG Automation (Yes/No)", "a b"]
    uniq = H.make_unique(names)
    assert len({u.lower() for u in uniq}) == len(uniq)
    assert uniq[2:] == ["X", "x__2", "X__1", "X__3"]


def test_find_column_first_in_table_order():
    cols = ["DG Automation Status (As per SNMP)", "SNMP Communicated (Y/N)"]
    assert H.find_column(cols, r"snmp") == "DG Automation Status (As per SNMP)"
    assert H.find_column(cols, r"nothing") is None
    roles, ambiguous = H.resolve_roles(cols, {"SNMP": r"snmp"}, overrides={})
    assert ambiguous == {"SNMP": cols}
    roles, _ = H.resolve_roles(cols, {"SNMP": r"snmp"}, overrides={"SNMP": cols[1]})
    assert roles["SNMP"] == cols[1]
    assert H.find_by_keywords(cols, ["communicated"]) == cols[1]


def test_csv_ingest_headers_na_types(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sites.csv")
    with open(path, "w") as f:
        f.write('"SITE\nID","Battery Backup\n(Hrs)",Note,note,Count\n')
        f.write("BHR-0001,3.5,None,a,1\n")
        f.write("JHK-0002,N/A,ok,b,2\n")
        f.write("WBL-0003,,NA,c,\n")
    df = FL.read_csv(spark, path)
    assert df.columns == ["SITE ID", "Battery Backup (Hrs)", "Note", "note__1", "Count"]
    types = dict(df.dtypes)
    assert types["Battery Backup (Hrs)"] == "double" and types["Count"] == "bigint" and types["SITE ID"] == "string"
    rows = df.orderBy("`SITE ID`").collect()
    assert [r["Note"] for r in rows] == [None, "ok", None]
    assert [r["Battery Backup (Hrs)"] for r in rows] == [3.5, None, None]
    circ = H.with_circle(df)
    assert [r["Auto_Circle"] for r in circ.orderBy("`SITE ID`").collect()] == ["Bihar", "Jharkhand", "Other"]
    out = os.path.join(tmp_dir, "pq")
    back = FL.ingest_csv(spark, path, out)
    assert back.count() == 3
    assert dict(back.dtypes)["Count"] == "bigint" and dict(back.dtypes)["Battery Backup (Hrs)"] == "double"
    assert back.columns == df.columns


def test_csv_export_roundtrip(spark, tmp_dir):
    n = spark.read.parquet(f"{SF_SMALL}/nation.parquet")
    out = os.path.join(tmp_dir, "export")
    FL.write_csv(n, out)
    back = FL.read_csv(spark, out)
    assert back.count() == n.count() and back.columns == n.columns


def test_rules_json_roundtrip(spark, tmp_dir):
    rules = pack_q() + [Rule(name="toks", fail_col="x", fail_op="in", fail_val=["yes", "y"])]
    path = os.path.join(tmp_dir, "rules")
    write_rules(spark, rules, path)
    back = read_rules(spark, path)
    assert [r.name for r in back] == [r.name for r in rules]
    assert back[0].use_severe and back[0].sev_op == ">" and back[-1].fail_val == ["yes", "y"]
    assert rules_from_json(rules_to_json(pack_q())) == pack_q()


def test_rules_read_old_generation_file(spark, tmp_dir):
    path = os.path.join(tmp_dir, "old.json")
    with open(path, "w") as f:
        f.write('[{"name": "a", "use_precond": true, "pre_col": "p", "pre_op": "==", "pre_val": "DG",'
                ' "fail_col": "f", "fail_op": "==", "fail_val": "No"},'
                ' {"name": "b", "use_precond": false, "pre_col": "", "pre_op": "==", "pre_val": "",'
                ' "fail_col": "g", "fail_op": "==", "fail_val": "Yes"}]')
    back = read_rules(spark, path)
    assert [(r.name, r.use_pre) for r in back] == [("a", True), ("b", False)]


def test_store_save_replace_delete(spark, tmp_dir):
    store = TrendStore(spark, os.path.join(tmp_dir, "store"))
    a = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "site string, v double")
    store.save_month(a, 2024, 1)
    store.save_month(a, 2024, 2)
    store.save_month(a.where("site = 's1'"), 2024, 2)  # replace February only
    cat = [(r.year, r.month, r.rows) for r in store.list_months().collect()]
    assert cat == [(2024, 1, 2), (2024, 2, 1)]
    assert store.months() == [(2024, 1), (2024, 2)] and store.period_labels() == ["2024-01", "2024-02"]
    assert store.delete_month(2024, 1) is True and store.delete_month(2024, 1) is False
    assert store.load_all().count() == 1
    labelled = store.load_months([(2024, 2)]).first()
    assert (labelled["Source_Month"], labelled["Source_Year"]) == ("February", 2024)
    # reading one month prunes partitions
    plan = store.load_month(2024, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "source_month" in plan
    assert store.load_month(2024, 2).where(F.col("v") > 0).count() == 1


def test_absent_dimensions_left_out():
    from rulescope.operators import views as V

    cols = ["SITE ID", "Town", "Cluster"]
    assert H.present_dimensions(cols, V.DRILLDOWN_LEVELS) == ["Town", "Cluster"]
    assert V.hierarchy_keys(cols) == ["SITE ID"]  # none of the hierarchy present -> first column
    assert V.hierarchy_keys(["Macro/ULS", "x"]) == ["Macro/ULS"]
    assert V.matrix_keys(["x", "Site- Principal Owner", "DG/Non-DG ULS"]) == ["DG/Non-DG ULS", "Site- Principal Owner"]
    assert V.matrix_keys(["x", "Site- Principal Owner"]) == ["x", "Site- Principal Owner"]


def test_csv_single_line_mode_splits_large_files(spark, tmp_dir):
    path = os.path.join(tmp_dir, "big.csv")
    with open(path, "w", newline="") as f:
        f.write("id,name,val\r\n")
        for i in range(20000):
            f.write(f"{i},n{i % 7},{'None' if i % 5 == 0 else i / 4}\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = FL.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 1  # byte ranges of one file, read in parallel
        assert df.count() == 20000 and df.columns == ["id", "name", "val"]
        assert dict(df.dtypes)["val"] == "double" and df.where("val IS NULL").count() == 4000
        assert FL.read_csv(spark, path, multi_line=True).rdd.getNumPartitions() == 1  # multi-line: one task per file
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_type_detection_overflow_and_infinity(spark):
    df = spark.createDataFrame(
        [("1", "12345678901234567890123", "1e400", "2.5"), ("2", "7", "3", None)], "a string, b string, c string, d string"
    )
    types = dict(FL.detect_column_types(df).dtypes)
    assert types == {"a": "bigint", "b": "double", "c": "string", "d": "double"}


def test_csv_empty_and_header_only(spark, tmp_dir):
    empty, header_only = os.path.join(tmp_dir, "e.csv"), os.path.join(tmp_dir, "h.csv")
    open(empty, "w").close()
    with open(header_only, "w") as f:
        f.write("a,b\n")
    e = FL.read_csv(spark, empty)
    assert e.columns == [] and e.count() == 0
    h = FL.read_csv(spark, header_only)
    assert h.columns == ["a", "b"] and h.count() == 0


def test_rules_read_lines_and_pretty_arrays(spark, tmp_dir):
    import json

    recs = [{"name": "a", "fail_col": "x", "fail_op": "==", "fail_val": "1"},
            {"name": "b", "fail_col": "y", "fail_op": "<", "fail_val": 2}]
    lines, pretty = os.path.join(tmp_dir, "r.jsonl"), os.path.join(tmp_dir, "p.json")
    with open(lines, "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs) + "\n")
    with open(pretty, "w") as f:
        json.dump(recs, f, indent=2)
    for path in (lines, pretty):
        back = read_rules(spark, path)
        assert [(r.name, r.fail_val) for r in back] == [("a", "1"), ("b", 2)], path


def test_empty_export_has_header(spark, tmp_dir):
    import glob

    df = spark.createDataFrame([(1, "x")], "id int, v string").where("false")
    out = os.path.join(tmp_dir, "empty")
    FL.write_csv(df, out)
    parts = [p for p in glob.glob(os.path.join(out, "*.csv"))]
    assert parts and open(parts[0]).read() == "id,v\n"
    back = FL.read_csv(spark, out)
    assert back.columns == ["id", "v"] and back.count() == 0


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


def test_csv_files_are_united_by_name(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "many")
    os.mkdir(folder)
    write(os.path.join(folder, "a.csv"), "id,dg\n1,yes\n")
    write(os.path.join(folder, "b.csv"), "dg,id,more\nno,2,x\n")
    write(os.path.join(folder, "c.csv"), "id,dg\n3\n")  # a short row
    rows = {r["id"]: (r["dg"], r["more"]) for r in FL.read_csv(spark, folder).collect()}
    assert rows == {1: ("yes", None), 2: ("no", "x"), 3: (None, None)}


def test_csv_row_wider_than_the_header_is_an_error(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "w.csv"), "id,dg\n1,yes,EXTRA\n2,no\n")
    with pytest.raises(Exception, match="more than the 2 cells"):
        FL.read_csv(spark, path).collect()


def test_csv_values_keep_padding_and_line_ends(spark, tmp_dir):
    df = spark.createDataFrame([(1, " a "), (2, "b\r"), (3, 'q"uo,te')], "id int, v string")
    out = os.path.join(tmp_dir, "pad")
    FL.write_csv(df, out)
    back = {r["id"]: r["v"] for r in FL.read_csv(spark, out, multi_line=True).collect()}
    assert back[1] == " a " and back[3] == 'q"uo,te'
    for text, mode in (("id,v\r\n1,x\r\n2,y\r\n", None), ('id,v\r\n1,x\r\n2,"two\r\nlines"\r\n', True)):
        path = write(os.path.join(tmp_dir, f"crlf{mode}.csv"), text)
        df = FL.read_csv(spark, path, multi_line=mode)
        rows = df.orderBy("id").collect()
        assert df.columns == ["id", "v"] and rows[0]["v"] == "x"
        assert rows[1]["v"].splitlines() == (["two", "lines"] if mode else ["y"])


def test_csv_missing_path_is_an_error(spark, tmp_dir):
    with pytest.raises(FileNotFoundError):
        FL.read_csv(spark, os.path.join(tmp_dir, "nowhere"))


def test_rule_lists_survive_every_way(spark, tmp_dir):
    from rulescope.operators.packs import fixed_kpi_pack

    tokens = ["Failed, hard", " No ", "x"]
    rules = [Rule(name="t", fail_col="s", fail_op="in_exact", fail_val=tokens), *fixed_kpi_pack("a", "b", "c", "d")]
    folder = os.path.join(tmp_dir, "rules")
    write_rules(spark, rules, folder)
    text = write(os.path.join(tmp_dir, "rules.json"), rules_to_json(rules))
    for back in (read_rules(spark, folder), read_rules(spark, text), rules_from_json(rules_to_json(rules))):
        assert [r.to_dict() for r in back] == [r.to_dict() for r in rules]
    quoted = write(os.path.join(tmp_dir, "quoted.json"), '[{"name": "t", "fail_col": "s", "fail_op": "in_exact", "fail_val": "[\\"a, b\\", \\"c\\"]"}]')
    assert read_rules(spark, quoted)[0].fail_val == ["a, b", "c"]


def test_rule_file_errors_are_told(spark, tmp_dir):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_rules(spark, os.path.join(tmp_dir, "nowhere.json"))
    with pytest.raises(ValueError):
        read_rules(spark, write(os.path.join(tmp_dir, "bad.json"), '[{"name": "a",'))


def test_contains_with_regex_marks_warns(spark, tmp_dir):
    path = write(os.path.join(tmp_dir, "r.json"), '[{"name": "a", "fail_col": "s", "fail_op": "Contains", "fail_val": "no|fail"}]')
    with pytest.warns(UserWarning, match="regular expression"):
        assert read_rules(spark, path)[0].regex is False


def test_store_keeps_new_columns_and_changed_types(spark, tmp_dir):
    store = TrendStore(spark, os.path.join(tmp_dir, "drift"))
    assert store.months() == [] and store.list_months().collect() == [] and not store.exists()
    store.save_month(spark.createDataFrame([("a", 1.0)], "`Site ID` string, EB double"), 2024, 1)
    store.save_month(spark.createDataFrame([("a", 1.5, 2.0)], "`Site ID` string, EB double, DG double"), 2024, 2)
    assert "DG" in store.load_all().columns and "DG" in store.load_month(2024, 2).columns
    assert "DG" not in store.load_month(2024, 1).columns
    store.save_month(spark.createDataFrame([("a", "n/a")], "`Site ID` string, EB string"), 2024, 3)
    got = {r["source_month"]: (r["EB"], r["DG"]) for r in store.load_all().collect()}
    assert got == {1: ("1.0", None), 2: ("1.5", 2.0), 3: ("n/a", None)}
    assert store.load_month(2024, 3).first()["EB"] == "n/a"


def test_store_empty_month_replaces(spark, tmp_dir):
    store = TrendStore(spark, os.path.join(tmp_dir, "empty"))
    df = spark.createDataFrame([("a",), ("b",)], "site string")
    store.save_month(df, 2024, 1)
    store.save_month(df.where("false"), 2024, 1)
    assert store.load_month(2024, 1).count() == 0 and store.load_all().count() == 0
    assert store.list_months().collect() == []


def test_keyword_roles_and_compat_threshold():
    from rulescope.operators.rules import parse_threshold

    roles, _ = H.resolve_roles(["Zone", "My SITE_ID", "RM Status"], H.ROLE_KEYWORDS_V4)
    assert (roles["Cluster"], roles["Site ID"], roles["RM Count"], roles["Battery Backup (Hrs)"]) == ("Zone", "My SITE_ID", "RM Status", None)
    values = {"4": 4.0, "2.5": 2.5, "5.": 5.0, ".5": 0.5, "": 0.0, ".": 0.0, "-5": 0.0, "1e3": 0.0, "1.2.3": 0.0, " 4": 0.0}
    assert {k: parse_threshold(k, "compat") for k in values} == values


# --- CSV files as they come ---


def upload(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding=encoding) as f:
        f.write(text)
    return path


@pytest.mark.parametrize("extra", [",,LOST", ",", ",x", ',"a,b"', ",,,"])
def test_csv_row_wider_than_its_header(spark, tmp_dir, extra):
    path = upload(tmp_dir, "wide/x.csv", f'id,dg\n"0 ""q"", z",no\n1,yes{extra}\n2,no\n')
    for read in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("id").collect()):
        with pytest.raises(Exception, match="more than the 2 cells.*1,yes"):
            read(FL.read_csv(spark, path, detect_types=False))
    found = FL.wide_rows(spark, path).collect()
    assert [(r.line, r.cells > 2, r.header_cells, r.row) for r in found] == [(3, True, 2, f"1,yes{extra}")]


def test_csv_wide_rows_are_numbered_by_line(spark, tmp_dir):
    text = "id,v\n" + "".join(f"{i},x{',,' if i in (7, 33333) else ''}\n" for i in range(50_000)) + "\n7,x,,\n"
    path = upload(tmp_dir, "numbered/x.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        found = sorted((r.line, r.cells, r.row) for r in FL.wide_rows(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [(9, 4, "7,x,,"), (33335, 4, "33333,x,,"), (50003, 4, "7,x,,")]
    spanning = upload(tmp_dir, "spanning/x.csv", 'id,v\n1,"a\nb"\n2,c,,\n')
    assert [(r.line, r.cells) for r in FL.wide_rows(spark, spanning).collect()] == [(None, 4)]


def test_csv_short_rows_are_filled(spark, tmp_dir):
    path = upload(tmp_dir, "short/x.csv", 'id,dg,c\n1,yes\n2\n3,"a,b",x\n')
    rows = FL.read_csv(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "yes", None), (2, None, None), (3, "a,b", "x")]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_quoted_line_breaks_without_being_told(spark, tmp_dir, end):
    path = upload(tmp_dir, f"breaks{len(end)}/x.csv", end.join(["id,v", '1,"a\nb"', "2,c", '3,"5"" pipe, ""x"""', '4,5" pipe', ""]))
    df = FL.read_csv(spark, path)
    assert dict(df.dtypes)["id"] == "bigint"
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a\nb"), (2, "c"), (3, '5" pipe, "x"'), (4, '5" pipe')]


def test_csv_quotes_without_line_breaks_stay_splittable(spark, tmp_dir):
    marks = ['5" pipe', '"a ""b"", c"', '""', "x", '"q"']
    text = "id,v,w\n" + "".join(f"{i},{marks[i % 5]},{marks[i % 3]}\n" for i in range(20_000))
    path = upload(tmp_dir, "marks/x.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = FL.read_csv(spark, path, detect_types=False)
        assert df.rdd.getNumPartitions() > 1 and df.count() == 20_000
        # An empty cell is missing, quoted or not.
        assert {r.v for r in df.select("v").distinct().collect()} == {'5" pipe', 'a "b", c', None, "x", "q"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_survey_composes_ranges(spark, tmp_dir):
    """Quoted cells that go on over the edges of byte ranges."""
    long = "\n".join(f"line {i}, with a comma" for i in range(3000))
    good = upload(tmp_dir, "ranges/a.csv", f'id,v\n1,"{long}"\n2,"{long}"\n3,x\n')
    bad = upload(tmp_dir, "ranges2/b.csv", f'id,v\n1,"{long}"\n2,"{long}\n3,x\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [f.spans for f in csv_survey.survey(spark, good)] == [True]
        rows = FL.read_csv(spark, good).orderBy("id").collect()
        assert [r.v for r in rows] == [long, long, "x"]
        with pytest.raises(ValueError, match="no end in .*b.csv"):
            FL.read_csv(spark, bad)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_cells_without_end_are_refused(spark, tmp_dir):
    for k, text in enumerate(['id,v\n1,"abc\n2,d\n', '"id,v\n1,abc\n2,d\n']):
        with pytest.raises(ValueError, match="has no end"):
            FL.read_csv(spark, upload(tmp_dir, f"open{k}/x.csv", text))


def test_csv_headers_of_many_files_in_one_job(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "many")
    for i in range(1000):
        head = "id,v" if i % 2 else 'v,id,"w\n(hrs)"'
        upload(folder, f"p{i % 7}/f {i}%20.csv", f"{head}\n" + (f"{i},x\n" if i % 2 else f"x,{i},1.5\n"))
    upload(folder, "empty.csv", "")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("survey", "headers")
    try:
        found = csv_survey.survey(spark, folder)
        jobs = tracker.getJobIdsForGroup("survey")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Listing a thousand files may be a job of its own; adaptive execution
    # submits the shuffle's map side and its result apart.
    assert len(found) == 1000 and len(jobs) <= 3
    df = FL.read_csv(spark, folder)
    assert sorted(df.columns) == ["id", "v", "w (hrs)"] and df.count() == 1000
    assert df.selectExpr("sum(id)", "sum(`w (hrs)`)", "min(v)", "max(v)").first() == (499500, 750.0, "x", "x")


def test_csv_in_another_encoding(spark, tmp_dir):
    path = upload(tmp_dir, "latin/x.csv", 'n\xe9,b\n"\xe9t\xe9, x",1\n', "latin-1")
    df = FL.read_csv(spark, path, encoding="ISO-8859-1")
    assert df.columns == ["n\xe9", "b"] and tuple(df.first()) == ("\xe9t\xe9, x", 1)
    with pytest.raises(FileNotFoundError):
        FL.read_csv(spark, os.path.join(tmp_dir, "nowhere"))
    assert FL.read_csv(spark, upload(tmp_dir, "none/x.csv", "")).columns == []


# --- types that drift between months ---


def test_common_types():
    def of(a, b):
        x, y = (T._parse_datatype_string(t) for t in (a, b))
        both = common_type(x, y)
        assert both == common_type(y, x) or both.simpleString() == common_type(y, x).simpleString()
        return both.simpleString()

    assert of("int", "bigint") == "bigint" and of("tinyint", "smallint") == "smallint"
    assert of("bigint", "double") == "double" and of("float", "int") == "double" and of("float", "decimal(5,2)") == "double"
    assert of("decimal(10,2)", "decimal(8,4)") == "decimal(12,4)" and of("decimal(38,10)", "decimal(38,0)") == "double"
    assert of("int", "decimal(5,2)") == "decimal(12,2)" and of("bigint", "decimal(38,0)") == "decimal(38,0)"
    assert of("boolean", "int") == "int" and of("boolean", "double") == "double"
    assert of("date", "timestamp") == "timestamp" and of("date", "timestamp_ntz") == "timestamp_ntz"
    assert of("string", "int") == "string" and of("date", "int") == "string" and of("boolean", "date") == "string"
    assert of("array<int>", "array<double>") == "array<double>" and of("map<string,int>", "map<string,bigint>") == "map<string,bigint>"
    assert of("struct<a:int,b:date>", "struct<a:bigint,b:timestamp>") == "struct<a:bigint,b:timestamp>"
    assert of("struct<a:int>", "struct<b:int>") == "string" and of("void", "int") == "int"


def test_store_numbers_that_drift_stay_numbers(spark, tmp_dir):
    store = TrendStore(spark, os.path.join(tmp_dir, "drift"))
    store.save_month(spark.createDataFrame([(10_000_000, True, 1)], "v bigint, f boolean, k int"), 2024, 1)
    store.save_month(spark.createDataFrame([(12345678.5, 7, None)], "V double, f int, k int"), 2024, 2)
    df = store.load_all()
    assert dict(df.dtypes)["v"] == "double" and dict(df.dtypes)["f"] == "int"
    assert sorted((r.v, r.f) for r in df.collect()) == [(10_000_000.0, 1), (12345678.5, 7)]
    store.save_month(spark.createDataFrame([("n/a", 7, None)], "v string, f int, k int"), 2024, 3)
    assert dict(store.load_all().dtypes)["v"] == "string" and store.load_all().count() == 3


# --- the store as a table of the catalogue, and its counts ---


@pytest.fixture
def table_store(spark):
    name = f"months_{uuid.uuid4().hex[:8]}"
    yield TableStore(spark, name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_table_store_save_replace_delete(spark, table_store):
    store = table_store
    a = spark.createDataFrame([("s1", 1.0), ("s2", 2.0)], "site string, v double")
    assert store.months() == [] and store.delete_month(2024, 1) is False
    store.save_month(a, 2024, 1)
    store.save_month(a, 2024, 2)
    store.save_month(a.where("site = 's1'"), 2024, 2)  # replace February only
    assert [(r.year, r.month, r.rows) for r in store.list_months().collect()] == [(2024, 1, 2), (2024, 2, 1)]
    plan = store.load_month(2024, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "InMemoryFileIndex(1 paths)" in plan
    labelled = store.load_months([(2024, 2), (1901, 1)]).collect()
    assert [(r["Source_Month"], r["Source_Year"], r.site) for r in labelled] == [("February", 2024, "s1")]
    files = {r.path for r in spark.read.format("binaryFile").load(store.load_all().inputFiles()).select("path").collect()}
    assert store.delete_month(2024, 1) is True and store.delete_month(2024, 1) is False
    assert store.months() == [(2024, 2)] and store.load_all().count() == 1
    assert not any(os.path.exists(f.removeprefix("file:")) for f in files if "source_month=1" in f)
    store.save_month(a.limit(0), 2024, 2)  # an empty upload replaces too
    assert store.load_all().count() == 0
    with pytest.raises(ValueError):
        store.save_month(a, 2024, 13)


def test_table_store_schema_changes(spark, table_store):
    store = table_store
    store.save_month(spark.createDataFrame([(1, "a")], "v bigint, `odd ``name` string"), 2024, 1)
    # Other order and case, a smaller type, a new column, a missing column.
    store.save_month(spark.createDataFrame([(0.5, 2)], "w double, V int"), 2024, 2)
    rows = sorted(tuple(r) for r in store.load_all().select("v", "`odd ``name`", "w", "source_month").collect())
    assert rows == [(1, "a", None, 1), (2, None, 0.5, 2)]
    wide = spark.createDataFrame([(1.5,)], "v double")
    with pytest.raises(ValueError, match=r"\['v'\]"):
        store.save_month(wide, 2024, 3)
    other = store.widened(wide.schema, f"{store.name}_wide")
    try:
        other.save_month(wide, 2024, 3)
        assert sorted(r.v for r in other.load_all().collect()) == [1.0, 1.5, 2.0] and store.load_all().count() == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {other.name}")


def test_store_counts_come_from_footers(spark, tmp_dir):
    root = os.path.join(tmp_dir, "counted")
    store = TrendStore(spark, root)
    assert store.list_months().count() == 0
    for month, rows in ((1, 500), (2, 1), (11, 20)):
        store.save_month(spark.range(rows).withColumn("v", F.lit("x" if month == 1 else None)), 2024, month)
    store.save_month(spark.range(7).withColumn("id", F.col("id").cast("string")), 2023, 5)  # a type that drifts
    listed = store.list_months()
    assert [tuple(r) for r in listed.collect()] == [
        (2023, 5, "May", 7), (2024, 1, "January", 500), (2024, 2, "February", 1), (2024, 11, "November", 20),
    ]
    plan = footer_counts(spark, root, ("source_year", "source_month"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [source_year, source_month]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
