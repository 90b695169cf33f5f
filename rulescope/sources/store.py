"""Month-partitioned trend store on Parquet.

Layout: ``<root>/source_year=YYYY/source_month=M/part-*.parquet``.  A month
is read by its own path with its own schema, so a metric that appears in one
month or changes its type is neither lost nor an error: months are united by
column name, and a column whose type differs is widened to the least common
type (the rule of :func:`trends.stack`).  Saving a month replaces only that month (dynamic
partition overwrite), an empty upload included; deleting a month removes its
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulescope.functions.columns import qcol
from rulescope.operators.trends import MONTH_COL, YEAR_COL, catalogue, month_name, stack, tag_period
from rulescope.sources import folders


class TrendStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- write ---------------------------------------------------------------

    def save_month(self, df: DataFrame, year: int, month: int) -> None:
        """Save (or replace) one month; other months are untouched.  An empty
        upload leaves the month without rows."""
        tagged = tag_period(df.drop(YEAR_COL, MONTH_COL), year, month)
        if df.isEmpty():  # an overwrite by partition would replace nothing
            self.delete_month(year, month)
        else:
            self._write(tagged)

    def save_tagged(self, df: DataFrame) -> None:
        """Save rows that already carry ``source_year`` / ``source_month``;
        every month present is replaced, the others are untouched."""
        self._write(df)

    def _write(self, df: DataFrame) -> None:
        """Rebalanced by month: adaptive execution splits large months over
        several tasks and merges small ones, so neither one task nor a file
        per task and month results."""
        (
            df.hint("rebalance", YEAR_COL, MONTH_COL)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(YEAR_COL, MONTH_COL)
            .parquet(self.root)
        )

    def delete_month(self, year: int, month: int) -> bool:
        """Remove one month; returns whether it existed."""
        return folders.delete(self.spark, self._path(year, month))

    # -- read ----------------------------------------------------------------

    def _path(self, year: int, month: int) -> str:
        return f"{self.root}/{YEAR_COL}={int(year)}/{MONTH_COL}={int(month)}"

    def exists(self) -> bool:
        """Any month is present."""
        return bool(self.months())

    def load_all(self) -> DataFrame:
        """All months; the tags come from the partition columns."""
        return self._read(self.months())

    def load_month(self, year: int, month: int) -> DataFrame:
        """One month with its own columns and types, read by its own path;
        without rows (and with the store's columns) if it is absent."""
        if (int(year), int(month)) in self.months():
            return self._read([(int(year), int(month))])
        return self.load_all().limit(0)

    def load_months(self, periods: list[tuple[int, int]]) -> DataFrame:
        """Chosen months stacked, each row tagged with its month name and
        year; only their folders are read."""
        wanted = {(int(y), int(m)) for y, m in periods}
        return self.with_labels(self._read([p for p in self.months() if p in wanted]))

    def _read(self, periods: list[tuple[int, int]]) -> DataFrame:
        if not periods:
            return self.spark.createDataFrame([], f"{YEAR_COL} int, {MONTH_COL} int")
        reader = self.spark.read.option("basePath", self.root)
        paths = [self._path(*p) for p in periods]
        try:  # one scan; Spark unites the files' columns by name
            return reader.option("mergeSchema", True).parquet(*paths)
        except Exception as e:  # Spark's own exception class is not mapped to Python's
            if "CANNOT_MERGE" not in str(e):
                raise
        # A type changed between months: read the months of one schema
        # together and widen where the groups differ.
        groups: dict[str, list[str]] = {}
        for path in paths:
            groups.setdefault(reader.parquet(path).schema.json(), []).append(path)
        frames = [reader.parquet(*group) for group in groups.values()]
        return stack([(f, {}) for f in frames], allow_missing=True)

    @staticmethod
    def with_labels(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "Source_Month": month_name(F.col(YEAR_COL), F.col(MONTH_COL)),
                "Source_Year": F.col(YEAR_COL).cast("int"),
            }
        )

    def months(self) -> list[tuple[int, int]]:
        """(year, month) pairs present, by the names of the two partition
        levels; no data file is opened."""
        names = folders.partition_values(self.spark, self.root, (YEAR_COL, MONTH_COL))
        return sorted((int(y), int(m)) for y, m in names)

    def period_labels(self) -> list[str]:
        """``yyyy-MM`` labels of :meth:`months` (for ``trends.month_pivot``)."""
        return [f"{y:04d}-{m:02d}" for y, m in self.months()]

    def list_months(self) -> DataFrame:
        """Catalogue: year, month, month_name, rows; chronological.  The rows
        are counted from the footers of the data files."""
        if not self.exists():
            return catalogue(self.load_all())
        counts = footer_counts(self.spark, self.root, (YEAR_COL, MONTH_COL))
        return catalogue(counts, rows=F.sum("rows"))


def footer_counts(spark: SparkSession, root: str, levels: tuple[str, ...]) -> DataFrame:
    """(levels..., rows): the rows of every partition of a Parquet folder.

    The count is pushed to the reader, which gives one row per file from its
    footer.  Only Spark's newer Parquet reader does so, and only where it is
    allowed to: both are settings of a session of its own, so that the
    caller's session keeps its settings.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    files = own.read.schema(", ".join(f"{c} INT" for c in levels)).parquet(root)
    return files.groupBy(*map(qcol, levels)).agg(F.count(F.lit(1)).alias("rows"))
