"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulescope.session import shared_path

#: Rows that leave a Python task are sent in groups of about this many bytes.
EMIT_BYTES = 2 << 20
#: Rows of an Arrow batch that enters a Python task.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole documents are wide rows: lowers the session's Arrow batches from
    Spark's default of 10,000 rows, unless another number was set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def docs_of(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id long, text string) with a NULL text as the empty text; no
    other column is read, so extra or clashing names do not matter."""
    small_batches(df.sparkSession)
    return df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a number behind it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return [next(f"{n}{k}" for k in range(len(taken) + 1) if f"{n}{k}" not in taken) for n in names]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, read back.

    Cuts the lineage: a lost executor costs one task's rows, not the jobs
    that led here.  What a lazy result still reads is left in
    ``spark.checkpoint.dir`` for that folder's own clean-up.
    """
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the folder, for tables that are dropped again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Emitter:
    """Collects rows and gives them back as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.cols: list[list] = [[] for _ in schema]
        self.size = 0

    def add(self, size: int, *values) -> None:
        for c, v in zip(self.cols, values, strict=True):
            c.append(v)
        self.size += size + 16

    def full(self) -> bool:
        return self.size >= EMIT_BYTES

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, type=f.type) for c, f in zip(self.cols, self.schema, strict=True)]
        self.cols, self.size = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def row_stream(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns as Python values, a slice at a time, so that
    very long texts are not all unpacked at once."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            cols = [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
            yield from zip(*cols, strict=True)
    # What this task's batches held is not kept for the worker's next task.
    pa.default_memory_pool().release_unused()


def per_row(
    df: DataFrame, schema: pa.Schema, ddl: str, names: tuple[str, ...], make: Callable[[], Callable[..., tuple[int, tuple]]]
) -> DataFrame:
    """One output row for each input row, computed by ``make()``'s function.

    ``make`` runs once a task (it loads vocabularies and the like); the
    function returns (approximate bytes, values).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = make(), Emitter(schema)
        for row in row_stream(batches, *names):
            size, values = fn(*row)
            out.add(size, *values)
            if out.full():
                yield out.batch()
        yield out.batch()

    return df.select(*names).mapInArrow(run, ddl)


def rewritten(df: DataFrame, text: str, change: Callable[[], Callable[..., str | None]], using: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``df`` with a new text each, or without those whose new text is
    None; every other column is passed through as it is.

    ``change`` runs once a task; its function gets the text (NULL as "") and
    the columns ``using``, which are left out of the result.  A row whose text
    does not change keeps it, NULL included.  A column ``n_chars`` follows.
    """
    small_batches(df.sparkSession)
    left = [c for c in df.columns if c not in using]
    # Numbered names on the way: a Python task takes no names with points.
    number = {c: f"c{i}" for i, c in enumerate(df.columns)}
    numbered = df.toDF(*number.values())
    kept = [number[c] for c in left]
    result = numbered.select(*kept).schema
    body, given = number[text], [number[c] for c in using]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = change()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                col = {f.name: part.column(i) for i, f in enumerate(part.schema)}
                old = col[body].to_pylist()
                rows = zip(old, *[col[c].to_pylist() for c in given], strict=True)
                new = [fn(t or "", *rest) for t, *rest in rows]
                same = [n if n is None or (o or "") != n else o for o, n in zip(old, new, strict=True)]
                keep = pa.array([n is not None for n in new])
                cols = [pa.array(same, col[c].type) if c == body else col[c] for c in kept]
                yield pa.RecordBatch.from_arrays(cols, names=kept).filter(keep)

    out = numbered.mapInArrow(run, result).toDF(*left)
    types = {f.name: f.dataType for f in df.schema.fields}
    if "n_chars" in out.columns and text != "n_chars":
        size = F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast(types["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(size))
    return out
