"""The corpus pipeline: from raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read back as the next
one's ``docs``.  All but the last return the columns of ``documents``.

1. ``quality``: line rules clean the texts; documents that fail go.
2. ``near_dedup``: one document of each near-duplicate group stays.
3. ``substring_dedup``: 100-byte strings that came earlier are cut out; a
   document with no word left goes.
4. ``pii``: personal data is replaced by its kind in brackets.
5. ``packing``: token pieces in sequences of up to 2,048 tokens.

Extra columns are carried along.  Rows with a NULL or empty text fail the
quality rules; rows without id are kept by the later stages but take no part
in finding duplicates.  An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulescope.llm import near_dedup, packing, pii, quality_rules, substring_dedup
from rulescope.llm.common import table, written
from rulescope.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.stripped(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_strings),
    ("pii", personal_data),
    ("packing", sequences),
]

#: The stages are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
