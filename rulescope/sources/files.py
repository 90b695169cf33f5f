"""CSV ingest and the CSV sink.

CSV is read once, cleaned (header names, missing-value tokens, optional
type detection) and written to Parquet; every later job reads the Parquet
copy (columnar, splittable, filter pushdown).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulescope.functions.columns import ASCII_WHITESPACE, NUMBER_TEXT, qcol
from rulescope.sources import csv_survey
from rulescope.sources.headers import clean_headers

# Text read as missing (pandas' default NA tokens).
NA_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

_INT_TEXT = r"^[+-]?[0-9]+$"


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    na_tokens: Sequence[str] = NA_TOKENS,
    detect_types: bool = True,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
) -> DataFrame:
    """Read CSV files that each have a header row, united by column name.

    Columns are read as text, header names are normalised and made unique,
    the ``na_tokens`` become NULL, and (``detect_types``) a column whose
    non-missing values are all integers becomes BIGINT, all numbers DOUBLE.
    Type detection is one aggregate over the data, not a driver loop.

    Every file is read by its own header: files with the same columns in
    another order, or with a column more, are united by name.  The headers of
    all files come from one job (:func:`csv_survey.survey`).  A row with fewer
    cells than its header is filled with NULL; one with more, empty ones
    included, raises an error when it is read (:func:`wide_rows` lists them).

    A file is read line by line, so that Spark splits it into byte ranges,
    unless the survey finds quoted cells with line breaks: then its records
    are parsed by one task.  ``multi_line`` sets one way for all files.
    """
    df = None
    for (header, spans), files in _groups(spark, path, encoding, multi_line).items():
        rows = _parsed(spark, files, len(header), encoding, spans)
        part = clean_headers(_checked(rows, len(header)).toDF(*header))
        df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    if df is None:  # empty input: no columns, no rows
        return spark.createDataFrame([], T.StructType([]))
    tokens = list(na_tokens)
    df = df.select(
        *[F.when(qcol(c).isin(tokens), F.lit(None)).otherwise(qcol(c)).alias(c) for c in df.columns]
    )
    return detect_column_types(df) if detect_types else df


def wide_rows(
    spark: SparkSession, path: str | Sequence[str], *, encoding: str = "UTF-8", multi_line: bool | None = None
) -> DataFrame:
    """(file, line, cells, header_cells, row): the rows that ``read_csv``
    refuses because they have more cells than their file's header.

    ``line`` counts the lines of the file from 1.  It is NULL for files whose
    records span lines.
    """
    out = spark.createDataFrame([], "file string, header_cells int, cells int, row string, spans boolean")
    for (header, spans), files in _groups(spark, path, encoding, multi_line).items():
        rows = _parsed(spark, files, len(header), encoding, spans).withColumn("cells", _cells(F.col("row")))
        found = rows.where(F.col("cells") > len(header)).select(
            "file", F.lit(len(header)).alias("header_cells"), "cells", "row", F.lit(spans).alias("spans")
        )
        out = out.unionByName(found)
    # Number the lines of a part of a file within their task, and add the
    # lines of the parts before it: one row per part is shuffled.
    lines = csv_survey.raw_lines(spark, path, encoding).withColumn("at", F.monotonically_increasing_id())
    parts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("from"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    texts = out.where(~F.col("spans")).select("file", F.col("row").alias("value")).distinct()
    placed = lines.join(texts, ["file", "value"], "left_semi").join(parts, ["file", "block"])
    placed = placed.select("file", F.col("value").alias("row"), (F.col("at") - F.col("from") + F.col("before") + 1).alias("line"))
    columns = ["file", "line", "cells", "header_cells", "row"]
    spanning = out.where("spans").withColumn("line", F.lit(None).cast("long")).select(*columns)
    single = out.where(~F.col("spans")).distinct().join(placed, ["file", "row"]).select(*columns)
    return single.unionByName(spanning)


def _groups(
    spark: SparkSession, path: str | Sequence[str], encoding: str, multi_line: bool | None
) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """Files by header and by whether their records span lines."""
    out: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for f in csv_survey.survey(spark, path, encoding):
        spans = f.spans if multi_line is None else multi_line
        out.setdefault((f.header, spans), []).append(f.path)
    return out


def _cells(record: Column) -> Column:
    """Cells of a record, which start at its start or behind a comma and are
    quoted, with what follows up to the next comma, or bare."""
    pairs_removed = F.replace(record, F.lit('""'), F.lit(""))
    return F.regexp_count(pairs_removed, F.lit('(?:^|,)(?:"[^"]*"[^,]*|[^,]*)')).cast("int")


def _parsed(spark: SparkSession, files: list[str], n: int, encoding: str, spans: bool) -> DataFrame:
    """Rows of files whose headers have ``n`` cells: the cells as text columns
    ``_c0`` to ``_c<n - 1>``, ``file``, and ``row``, the record itself if its
    number of cells is another (NULL otherwise)."""
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(n)]
    raw = (
        spark.read.schema(T.StructType([*fields, T.StructField("row", T.StringType())]))
        .option("columnNameOfCorruptRecord", "row")
        # A parser that skips cells would not see that a row is too wide.
        .option("columnPruning", False)
        .option("header", True)
        .option("multiLine", spans)
        .option("escape", '"')
        .option("encoding", encoding)
        .csv(files)
    )
    # The reader refuses plans that need ``row`` alone.
    row = F.when(F.col("_c0").isNotNull() | F.col("row").isNotNull(), F.col("row"))
    rows = raw.withColumns({"row": row, "file": F.col("_metadata.file_path")})
    if spans:
        # Record parsing keeps the CR of CRLF line ends on the last cell.
        rows = rows.withColumns({f"_c{n - 1}": F.regexp_replace(f"_c{n - 1}", "\r$", "")})
    return rows


def _checked(rows: DataFrame, n: int) -> DataFrame:
    """The cells of rows that have ``n`` of them at most; others raise."""
    wide = F.col("row").isNotNull() & (_cells(F.col("row")) > n)
    message = F.concat(
        F.lit(f"CSV row with more than the {n} cells of its header in "), F.col("file"), F.lit(": "), F.substring("row", 1, 500)
    )
    problem = F.raise_error(message).cast("boolean")
    return rows.where(F.when(wide, problem).otherwise(F.lit(True))).drop("row", "file")


def detect_column_types(df: DataFrame) -> DataFrame:
    """Cast text columns whose every non-NULL value is an integer that fits
    BIGINT (to BIGINT) or a finite number (to DOUBLE).  One global aggregate
    of two flags and a count per column."""
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return df
    aggs = []
    for i, c in enumerate(text_cols):
        v = F.btrim(qcol(c), F.lit(ASCII_WHITESPACE))
        # integers must also fit BIGINT, numbers must stay finite: a cast
        # that fails would abort the job under ANSI rules
        fits_long = v.rlike(_INT_TEXT) & v.try_cast("bigint").isNotNull()
        as_double = v.try_cast("double")
        finite = v.rlike(NUMBER_TEXT) & as_double.isNotNull() & (F.abs(as_double) != F.lit(float("inf")))
        aggs.append(F.bool_and(F.when(v.isNull(), F.lit(True)).otherwise(fits_long)).alias(f"i{i}"))
        aggs.append(F.bool_and(F.when(v.isNull(), F.lit(True)).otherwise(finite)).alias(f"n{i}"))
        aggs.append(F.count(qcol(c)).alias(f"c{i}"))
    row = df.agg(*aggs).collect()[0]
    cols = []
    for i, f in enumerate(df.schema.fields):
        c = f.name
        if c in text_cols:
            j = text_cols.index(c)
            if row[f"c{j}"] and row[f"i{j}"]:
                cols.append(F.btrim(qcol(c), F.lit(ASCII_WHITESPACE)).cast("bigint").alias(c))
                continue
            if row[f"c{j}"] and row[f"n{j}"]:
                cols.append(F.btrim(qcol(c), F.lit(ASCII_WHITESPACE)).cast("double").alias(c))
                continue
        cols.append(qcol(c))
    return df.select(*cols)


def ingest_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    out: str,
    *,
    detect_types: bool = True,
    **kw,
) -> DataFrame:
    """CSV -> cleaned Parquet at ``out``; returns the Parquet-backed frame.

    The CSV is parsed once: the cleaned text columns are written to a stage
    in the shared folder, type detection scans that columnar stage (not the
    CSV again), and the typed copy is written to ``out``.
    """
    text = read_csv(spark, path, detect_types=False, **kw)
    if not detect_types:
        text.write.mode("overwrite").parquet(out)
        return spark.read.parquet(out)
    from rulescope.session import shared_path

    stage = shared_path(spark, "ingest-text")
    text.write.parquet(stage)
    detect_column_types(spark.read.parquet(stage)).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def write_csv(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """CSV export with a header row.  By default one part file per task (a
    directory); ``single_file`` funnels everything through one task, which
    only suits small exports."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite").option("header", True).option("escape", '"')
    # Spark's writer would trim values.
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.csv(path)
