"""What the raw lines of CSV files say before they are parsed.

One job reads the files as lines, split into byte ranges like any text.  Every
task reports, for each range, whether a quoted cell is still open at the end
of a line, and what the range does to the state "inside a quoted cell": where
it leads to from inside and from outside.  The ranges of a file are composed in
order, which tells whether its last quoted cell has an end.  The task that has
the start of a file also reports its first record.  The driver gets one row
per file: what is needed to group the files by header and to choose between
line and record parsing.  The lines are looked at as Arrow columns.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a first record whose quoted cells may hold line breaks.
HEADER_CHARS = 1 << 20

_SCHEMA = "file string, block long, first string, opens boolean, outside boolean, inside boolean"


@dataclass(frozen=True)
class CsvFile:
    """One file: its path, header cells, and whether records span lines."""

    path: str
    header: tuple[str, ...]
    spans: bool


def raw_lines(spark: SparkSession, path: str | Sequence[str], encoding: str) -> DataFrame:
    """(file, block, value): every line with its file and the byte at which
    its part of the file starts.  FileNotFoundError if there is no such path."""
    reader = spark.read.option("recursiveFileLookup", True)
    try:
        if encoding.upper().replace("-", "") in ("UTF8", "ASCII", "USASCII"):
            lines = reader.text(path)
        else:  # the text reader knows UTF-8 only; without quotes and with a mark that no file holds, this one gives lines
            plain = reader.option("encoding", encoding).option("quote", "").option("sep", "\u0001").option("header", False)
            lines = plain.schema("value string").csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no such path: {path}") from e
        raise
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def left_open(lines: pa.Array) -> pa.Array:
    """Whether each text ends inside a quoted cell: without doubled quotes
    and then without complete quoted cells, a cell still starts with a quote."""
    rest = pc.replace_substring(lines, pattern='""', replacement="")
    rest = pc.replace_substring_regex(rest, pattern='(^|,)"[^"]*"', replacement="\\1")
    return pc.match_substring_regex(rest, pattern='(^|,)"')


def _is_open(text: str) -> bool:
    return left_open(pa.array([text], pa.string()))[0].as_py()


def _after(outside: np.ndarray, inside: np.ndarray, start: bool) -> bool:
    """The state behind lines that lead from outside and inside to these
    states: that of the last line that leads both to one state, turned around
    by each line behind it that swaps them."""
    fixed = np.flatnonzero(outside == inside)
    state, behind = (bool(outside[fixed[-1]]), fixed[-1] + 1) if len(fixed) else (start, 0)
    return state ^ bool((outside[behind:] & ~inside[behind:]).sum() % 2)


class _Range:
    """One range of a file: its first record, if the file starts here."""

    def __init__(self):
        self.first: str | None = None
        self.waits = self.opens = False
        self.ends = [False, True]  # the state behind it, from outside and from inside

    def add(self, lines: pa.Array, starts: bool) -> None:
        opened = left_open(lines)
        outside = opened.to_numpy(zero_copy_only=False)
        # Inside a cell, a line goes on like one that starts with a quote.
        closed = left_open(pc.binary_join_element_wise(pa.scalar('"'), lines, ""))
        inside = closed.to_numpy(zero_copy_only=False)
        self.opens |= bool(outside.any())
        self.ends = [_after(outside, inside, s) for s in self.ends]
        at = 0
        if starts and self.first is None:
            self.first, at = lines[0].as_py(), 1
            self.waits = _is_open(self.first)
        while self.waits and at < len(lines) and len(self.first) < HEADER_CHARS:
            self.first += "\n" + lines[at].as_py()
            self.waits, at = _is_open(self.first), at + 1


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges: dict[tuple[str, int], _Range] = {}
    for b in batches:
        b = b.filter(pc.not_equal(pc.utf8_trim(b.column("value"), characters=" \t\r\n"), ""))
        if not b.num_rows:
            continue
        # The rows of one range follow each other.
        files, blocks = (b.column(c).dictionary_encode() for c in ("file", "block"))
        keys = files.indices.to_numpy().astype(np.int64) * b.num_rows + blocks.indices.to_numpy()
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        for lo, hi in zip(heads, [*heads[1:], b.num_rows], strict=True):
            key = b.column("file")[lo].as_py(), b.column("block")[lo].as_py()
            ranges.setdefault(key, _Range()).add(b.column("value").slice(lo, hi - lo), key[1] == 0)
    rows = [(*k, r.first, r.opens, *r.ends) for k, r in ranges.items()]
    types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
    yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "first", "opens", "outside", "inside"])


def survey(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> list[CsvFile]:
    """Every file that holds a line, by path.  A quoted cell that never ends
    raises a ValueError: parsing would take all rows behind it for its text."""
    lines = raw_lines(spark, path, encoding).where(F.col("value").isNotNull())
    ranges = lines.mapInArrow(_report, _SCHEMA)
    in_order = F.sort_array(F.collect_list(F.struct("block", "outside", "inside")))
    files = ranges.groupBy("file").agg(
        F.max("first").alias("first"),
        F.bool_or("opens").alias("opens"),
        F.aggregate(in_order, F.lit(False), lambda s, r: F.when(s, r["inside"]).otherwise(r["outside"])).alias("open"),
    )
    out = []
    for r in sorted(files.collect(), key=lambda r: r["file"]):
        name = unquote(r["file"])
        if r["open"] or _is_open(r["first"]):
            raise ValueError(f"a quoted cell has no end in {name}")
        cells = next(csv.reader(io.StringIO(r["first"], newline="")))
        out.append(CsvFile(name, tuple(cells), r["opens"]))
    return out
