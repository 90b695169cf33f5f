"""Month store as a partitioned table of the session's catalogue.

Everything is SQL, so it works in classic and remote sessions alike: a month
is replaced by a static partition overwrite (an empty upload included), deleted
by ``ALTER TABLE ... DROP PARTITION`` and listed by ``SHOW PARTITIONS``; the
catalogue deletes the files.  The table is managed: its files lie in the
warehouse folder.

The table has one schema.  A new metric becomes a new column, NULL in older
months; an upload whose types fit the table's (:mod:`rulescope.functions.types`)
is cast to them.  A type that the table cannot hold is an error that names the
columns; :meth:`TableStore.widened` makes a table that can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulescope.functions.columns import any_of, qcol, sql_ident
from rulescope.functions.types import common_type, common_types
from rulescope.operators.trends import MONTH_COL, YEAR_COL, catalogue
from rulescope.sources.store import TrendStore


class TableStore:
    """Months in the table ``name`` (``table`` or ``database.table``)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        self.ident = ".".join(sql_ident(part) for part in name.split("."))

    # -- write ---------------------------------------------------------------

    def save_month(self, df: DataFrame, year: int, month: int) -> None:
        """Save (or replace) one month; other months are untouched."""
        if not 1 <= int(month) <= 12:
            raise ValueError(f"month {month} out of range")
        df = df.drop(YEAR_COL, MONTH_COL)
        self._prepare(df.schema)
        where = f"PARTITION ({YEAR_COL} = {int(year)}, {MONTH_COL} = {int(month)})"
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.ident} {where} SELECT * FROM {{rows}}", rows=self._fitted(df))

    def save_tagged(self, df: DataFrame) -> None:
        """Save rows that already carry ``source_year`` / ``source_month``;
        every month present is replaced, the others are untouched."""
        self._prepare(T.StructType([f for f in df.schema.fields if f.name not in (YEAR_COL, MONTH_COL)]))
        rows = self._fitted(df.drop(YEAR_COL, MONTH_COL), df).hint("rebalance", YEAR_COL, MONTH_COL)
        rows.write.option("partitionOverwriteMode", "dynamic").insertInto(self.name, overwrite=True)

    def delete_month(self, year: int, month: int) -> bool:
        """Remove one month; returns whether it existed."""
        if (int(year), int(month)) not in self.months():
            return False
        where = f"PARTITION ({YEAR_COL} = {int(year)}, {MONTH_COL} = {int(month)})"
        self.spark.sql(f"ALTER TABLE {self.ident} DROP IF EXISTS {where}")
        return True

    def widened(self, schema: T.StructType, name: str) -> TableStore:
        """A new table ``name`` with all months, whose columns also hold
        values of ``schema``; this table stays as it is."""
        held = self.load_all()
        types = common_types([held.schema, schema])
        cols = [qcol(f.name).cast(types[f.name.lower()]).alias(f.name) for f in held.schema.fields]
        other = TableStore(self.spark, name)
        other.save_tagged(held.select(*cols))
        return other

    def _prepare(self, schema: T.StructType) -> None:
        """Creates the table, or adds the columns that it lacks."""
        if not self._there():
            cols = [f"{sql_ident(f.name)} {f.dataType.simpleString()}" for f in schema.fields]
            cols += [f"{YEAR_COL} INT", f"{MONTH_COL} INT"]
            parts = f"USING parquet PARTITIONED BY ({YEAR_COL}, {MONTH_COL})"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.ident} ({', '.join(cols)}) {parts}")
        held = {f.name.lower(): f.dataType for f in self.spark.table(self.ident).schema.fields}
        both = [(f, held.get(f.name.lower(), f.dataType)) for f in schema.fields]
        unfit = [f.name for f, mine in both if common_type(mine, f.dataType) != mine]
        if unfit:
            raise ValueError(f"{self.name} cannot hold the types of {unfit}; see TableStore.widened")
        new = [f for f in schema.fields if f.name.lower() not in held]
        if new:
            cols = ", ".join(f"{sql_ident(f.name)} {f.dataType.simpleString()}" for f in new)
            self.spark.sql(f"ALTER TABLE {self.ident} ADD COLUMNS ({cols})")

    def _fitted(self, df: DataFrame, tags: DataFrame | None = None) -> DataFrame:
        """Columns in the table's order and types; those absent are NULL."""
        mine = {c.lower(): c for c in df.columns}
        cols = []
        for f in self.spark.table(self.ident).schema.fields:
            if f.name in (YEAR_COL, MONTH_COL):
                if tags is not None:
                    cols.append(qcol(f.name).cast("int").alias(f.name))
                continue
            have = mine.get(f.name.lower())
            value = F.lit(None) if have is None else qcol(have)
            cols.append(value.cast(f.dataType).alias(f.name))
        return (df if tags is None else tags).select(*cols)

    # -- read ----------------------------------------------------------------

    def _there(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def months(self) -> list[tuple[int, int]]:
        """(year, month) pairs present, from the catalogue alone."""
        if not self._there():
            return []
        rows = self.spark.sql(f"SHOW PARTITIONS {self.ident}").collect()
        return sorted(tuple(int(level.split("=")[1]) for level in r["partition"].split("/")) for r in rows)

    def load_all(self) -> DataFrame:
        return self.spark.table(self.ident)

    def load_month(self, year: int, month: int) -> DataFrame:
        """One month; only its files are read."""
        return self.load_all().where(self._in(year, month))

    def load_months(self, periods: list[tuple[int, int]]) -> DataFrame:
        """Chosen months, each row tagged with its month name and year; only
        their files are read."""
        chosen = any_of([self._in(y, m) for y, m in periods])
        return TrendStore.with_labels(self.load_all().where(chosen))

    @staticmethod
    def _in(year: int, month: int) -> Column:
        return (qcol(YEAR_COL) == int(year)) & (qcol(MONTH_COL) == int(month))

    def list_months(self) -> DataFrame:
        """Catalogue: year, month, month_name, rows; chronological."""
        return catalogue(self.load_all().select(qcol(YEAR_COL), qcol(MONTH_COL)))
