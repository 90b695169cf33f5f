"""Text / number semantics (coercion, trimming, rounding) against pandas and
numpy, which define the behaviour the rule engines were written for."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulescope.functions.columns import (
    is_no,
    is_ok_token,
    is_yes,
    norm,
    num,
    pct,
    pct_text,
    prefix_label,
    qcol,
)

COERCE = [
    "4", " 4 ", "4.", ".5", "+3", "-5", "1e3", "1E-2", "1d", "1f", "0x10", "1,000", "1_000", "1e400",
    "inf", "-Infinity", " inf", "nan", "\t7\n", "", ".", "1e", "text", None, " 4", "12abc", "--1",
]


def _pandas_num(v):
    out = pd.to_numeric(pd.Series([v], dtype=object), errors="coerce").iloc[0]
    return None if out is None or (isinstance(out, float) and math.isnan(out)) else float(out)


def test_num_matches_pandas_on_text(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(COERCE)], "id int, v string")
    got = {r["id"]: r["n"] for r in df.select("id", num("v").alias("n")).collect()}
    for i, v in enumerate(COERCE):
        want = _pandas_num(v)
        assert got[i] == want or (want is not None and got[i] is not None and math.isclose(got[i], want)), (v, got[i], want)


def test_num_numeric_column_nan_is_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "d double")
    got = [r[0] for r in df.select(num("d", df.schema["d"].dataType)).collect()]
    assert got == [1.0, None, None]
    # NaN must never compare greater than a threshold (Spark orders NaN highest).
    assert df.where(F.coalesce(num("d", df.schema["d"].dataType) > 0, F.lit(False))).count() == 1


def test_norm_matches_python_strip_lower(spark):
    vals = [" Yes ", "\tNO\n", " Ok ", "MiXeD", "", None, "a b", "\x1cyes\x1f", "\u3000ok", "é ", " ÅB"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(norm("v")).collect()]
    assert got == [None if v is None else v.strip().lower() for v in vals]


def test_tokens(spark):
    vals = ["Yes", " y ", "TRUE", "ok", "OK", "no", "N", "False", None, "maybe"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    rows = df.select(is_yes("v"), is_no("v"), is_ok_token("v")).collect()
    assert [r[0] for r in rows] == [True, True, True, True, True, False, False, False, False, False]
    assert [r[1] for r in rows] == [False, False, False, False, False, True, True, True, False, False]
    assert [r[2] for r in rows] == [False, True, True, True, True, False, False, False, False, False]


def test_percent_rounding_is_half_even_like_numpy(spark):
    pairs = [(k, n) for n in range(1, 121) for k in range(0, n + 1)]
    df = spark.createDataFrame(pairs, "k int, n int")
    got = df.select("k", "n", pct_text(pct(F.col("k"), F.col("n"))).alias("t")).collect()
    for r in got:
        want = f"{np.round(r['k'] / r['n'] * 100, 1)}%"
        assert r["t"] == want, (r, want)
    assert df.sparkSession.range(1).select(pct(F.lit(3), F.lit(0)).alias("p")).first()["p"] == 0.0


def test_percent_known_tie(spark):
    # 49/400 = 12.25 % -> numpy rounds half to even: 12.2
    row = spark.range(1).select(pct_text(pct(F.lit(49), F.lit(400))).alias("t")).first()
    assert row["t"] == "12.2%"


def test_qcol_handles_awkward_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["DG.x (N+1)", "a`b", "SMPS/IPMS"])
    assert df.select(qcol("DG.x (N+1)"), qcol("a`b"), qcol("SMPS/IPMS")).first() == (1, 2, 3)


def test_prefix_label(spark):
    df = spark.createDataFrame([("bHR-1",), ("JHK-2",), ("WBL-3",), (None,)], "s string")
    got = [r[0] for r in df.select(prefix_label("s", [("B", "Bihar"), ("J", "Jharkhand")], "Other")).collect()]
    assert got == ["Bihar", "Jharkhand", "Other", "Other"]


def test_card_text_matches_python_format(spark):
    from rulescope.functions.columns import pct_card_text

    pairs = [(k, n) for n in list(range(1, 60)) + [1999, 2000, 2001, 4000] for k in range(0, n + 1, max(1, n // 200))]
    pairs += [(1, 2000), (3, 2000), (7, 2000), (1999, 2000), (0, 0)]
    df = spark.createDataFrame(pairs, "k int, n int")
    rows = df.select("k", "n", pct_card_text("k", "n").alias("card"), pct_text(pct(F.col("k"), F.col("n"))).alias("table")).collect()
    for r in rows:
        x = r["k"] / r["n"] * 100 if r["n"] else 0.0
        assert r["card"] == f"{x:.1f}%", (r, x)
    by = {(r["k"], r["n"]): r for r in rows}
    # 1/2000 and 3/2000: the cards (binary value) and the tables (half-even) differ
    assert (by[(1, 2000)]["card"], by[(1, 2000)]["table"]) == ("0.1%", "0.0%")
    assert (by[(3, 2000)]["card"], by[(3, 2000)]["table"]) == ("0.1%", "0.2%")


def test_fixed1_at_every_tie_neighbour(spark):
    import math

    from rulescope.functions.columns import fixed1_sql

    vals = []
    for k in range(1, 2000, 2):  # every decimal tie k/20 in [0, 100]
        t = k / 20
        vals += [math.nextafter(t, 0), t, math.nextafter(t, 200)]
    vals += [0.0, 100.0, 5e-324, 1e-9, 0.004]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(F.expr(fixed1_sql("x"))).collect()]
    assert got == [f"{v:.1f}" for v in vals]
