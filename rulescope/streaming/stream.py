"""Rule evaluation over arriving uploads (Structured Streaming).

``evaluate`` is a stateless projection, so the same compiled rule set runs
on a streaming DataFrame: each new file in the landing folder is evaluated
once and appended to a Parquet sink (exactly-once through the sink's log and
the checkpoint).  The running matrix is a streaming aggregate whose state is
one row per group key; each micro-batch writes the small result to a folder
of its own, and readers take the newest complete one.
Checkpoints live in the shared folder, so a lost executor or a restarted
driver resumes where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rulescope.operators import views as V
from rulescope.operators.rules import Evaluation, Rule, evaluate
from rulescope.sources import folders


def read_uploads(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    *,
    glob: str | None = None,
    max_files_per_trigger: int | None = None,
    recursive: bool = False,
) -> DataFrame:
    """Parquet files landing in ``folder`` as a stream (schema is required
    for file streams; ``glob`` selects file names; ``recursive`` also reads
    files in sub-folders, e.g. one folder per upload)."""
    reader = spark.readStream.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(folder)


def evaluate_stream(stream: DataFrame, rules: Iterable[Rule | Mapping[str, Any]], **kw) -> Evaluation:
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return evaluate(stream, rules, **kw)


def append_evaluated(
    ev: Evaluation,
    sink: str,
    checkpoint: str,
    *,
    columns: Sequence[str] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append evaluated rows to a Parquet folder."""
    df = ev.df if columns is None else ev.df.select(*[f"`{c}`" for c in columns])
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(sink)


def running_matrix(
    ev: Evaluation,
    keys: str | Sequence[str],
    sink: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    names: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Keep the deficiency matrix of everything received so far in ``sink``;
    read it with :func:`latest_matrix`.

    Every micro-batch writes the complete result, one row per group, by its
    own tasks into a folder of its own, and then a mark that the folder is
    complete, so a reader or a crash in between never sees a result half gone;
    the folder before the last one is removed.
    """
    result = V.matrix(ev, keys, names=names)

    def write_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")
        spark.range(1).write.mode("overwrite").parquet(f"{sink}/done={epoch}")
        for part in ("done", "epoch"):
            folders.discard(spark, f"{sink}/{part}={epoch - 2}")

    writer = (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_batch)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_matrix(spark: SparkSession, sink: str) -> DataFrame:
    """The newest complete result of :func:`running_matrix`."""
    epochs = [int(e) for (e,) in folders.partition_values(spark, sink, ["done"])]
    if not epochs:
        raise ValueError(f"no result in {sink} yet")
    return spark.read.parquet(f"{sink}/epoch={max(epochs)}")
