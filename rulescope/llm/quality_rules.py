"""Line-first quality rules.

A text is cleaned line by line: lines that fail a punctuation, navigation or
boilerplate rule are removed.  A document is rejected if it fails a rule of
its own (too few words, too many words in repeated 5-word windows) or if the
line rules leave too little of it.

Line rules (a line without words stays and is not counted):

* ``symbols``: at least ``SYMBOLS_PER_WORD`` marks of ``#*$%&<>`` or doubled
  exclamation marks per word (decoration and shouting);
* ``table``: at least ``BARS_PER_WORD`` ``|`` per word (navigation bars);
* ``single_word``: ``REPEATED_WORD`` or more words, of which one word makes up
  at least ``REPEATED_SHARE`` (spam);
* ``repeated``: the same line came earlier in the document;
* ``recurring``: the line is page furniture (menus, banners, notices) by the
  company it keeps: at most ``FURNITURE_CHARS`` long, and found with
  ``RECUR_DOCS`` or more different bodies in its source that make up
  ``RECUR_SHARE`` of the source's different texts or more.  No list of phrases
  is needed, so it holds in every language; lists, verse and titles are ordinary
  lines.

A *body* is a group of near duplicates (:mod:`near_dedup`, on the full texts)
among the documents with a line that enough documents have.  A line that comes
with fewer than ``RECUR_SPREAD`` bodies per document recurs because its
documents are copies, and stays.  Lines removed as furniture do not count as
lost text, but ``MIN_WORDS`` must be left beside them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import Emitter, docs_of, free_names, rewritten, row_stream, written
from rulescope.llm.near_dedup import near_duplicates

SYMBOLS_PER_WORD = 0.5
BARS_PER_WORD = 0.4
REPEATED_WORD, REPEATED_SHARE = 20, 0.4
#: Code points of a line that can be furniture, at most; bodies of its source
#: that it comes with, at least, and their share of the source's texts.
FURNITURE_CHARS, RECUR_DOCS, RECUR_SHARE = 160, 10, 0.05
#: Bodies per document with the line, at least.
RECUR_SPREAD = 0.5
#: Least share of a document's words that the line rules must leave.
KEEP_SHARE = 0.5
#: Base rules of a document.
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_DECORATION = re.compile(r"[#*$%&<>]|!!")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Spark's seed of ``xxhash64``.
_SEED = 42


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in 5-word windows which occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) == n:
        return 0
    m = n - WINDOW + 1
    base = len(number)
    if base**WINDOW < 1 << 62:
        key = ids[:m].copy()
        for k in range(1, WINDOW):
            key *= base
            key += ids[k : k + m]
    else:  # ranks of pairs, of pairs of pairs, and with the last word: exact
        two = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        four = np.unique(two[:-2] * (n + 1) + two[2:], return_inverse=True)[1]
        key = four[:m] * base + ids[WINDOW - 1 :]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(m + 1, dtype=bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice[:-1])
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def line_fails(line: str, words: list[str]) -> bool:
    """A rule that needs this line only."""
    n = len(words)
    if len(_DECORATION.findall(line)) >= SYMBOLS_PER_WORD * n or line.count("|") >= BARS_PER_WORD * n:
        return True
    return n >= REPEATED_WORD and Counter(words).most_common(1)[0][1] >= REPEATED_SHARE * n


def line_hash(line: str) -> int:
    """Spark's ``xxhash64`` of a string."""
    h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), seed=_SEED)
    return h - (1 << 64) if h >> 63 else h


def clean_lines(text: str, recurring: frozenset[int] = frozenset()) -> tuple[str, int, int, int]:
    """(lines that pass, their words, lines removed, words of those that
    recur); ``recurring`` holds the hashes of the recurring lines."""
    kept: list[str] = []
    kept_words = removed = furniture = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if not words:
            kept.append(line)
        elif recurring and len(line) <= FURNITURE_CHARS and line_hash(line) in recurring:
            removed += 1
            furniture += len(words)
        elif line in seen or line_fails(line, words):
            removed += 1
        else:
            seen.add(line)
            kept.append(line)
            kept_words += len(words)
    return "\n".join(kept) if removed else text, kept_words, removed, furniture


DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines_removed long, cleaned string"
)


def judge(text: str, recurring: frozenset[int] = frozenset()) -> tuple:
    """The values of ``DDL`` but the first."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the ASCII white space
    n = len(words)
    blank = sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
    cleaned, left, removed, furniture = clean_lines(text, recurring)
    kept = not failed and left >= KEEP_SHARE * (n - furniture) and (left >= MIN_WORDS or not furniture)
    return n, len(text) - blank, symbols, dup, repeat, failed, kept, removed, cleaned


def recurring_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source") -> DataFrame:
    """(doc_id, recurring): the hashes of the recurring lines of every document
    that has some.

    Lines are counted by source (a table without such a column is one source).
    Only documents with a line that enough documents have are compared with
    each other.  All steps combine map-side; a line that a third of all
    documents have is counted by (source, line, body), so no task holds its
    documents.
    """
    of = F.col(f"`{source}`").cast("string") if source in df.columns else F.lit(None)
    docs = df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(of, F.lit("")).alias("source"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) <= FURNITURE_CHARS) & x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    # Written once: it is read to count the texts and the lines, and to find these.
    listed = written(docs.select("doc_id", "source", F.xxhash64("text").alias("whole"), hashes.alias("lines")), "quality-lines")
    texts = listed.select("source", "whole").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    short = listed.select("doc_id", "source", F.explode("lines").alias("line"))
    # No line has more bodies than documents, so this loses none that recurs.
    often = short.groupBy("source", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= RECUR_DOCS)
    often = often.join(texts, "source").where(F.col("docs") >= RECUR_SHARE * F.col("texts"))
    # At most 1 / RECUR_SHARE times the lines of an average document a source.
    held = written(short.join(often, ["source", "line"]), "quality-held")
    if held.isEmpty():
        return held.select("doc_id", F.array("line").alias("recurring"))
    compared = written(docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi"), "quality-compared")
    bodies = near_duplicates(compared).select("doc_id", F.col("component_id").alias("body")).distinct()
    line = ["source", "line", "docs", "texts"]
    seen = held.join(bodies, "doc_id").select(*line, "body").distinct().groupBy(*line).agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(RECUR_DOCS), RECUR_SPREAD * F.col("docs"), RECUR_SHARE * F.col("texts"))
    found = held.join(seen.where(F.col("n") >= least).select("source", "line"), ["source", "line"])
    # Written, so that it is known to be small where the texts are joined to it.
    return written(found.groupBy("doc_id").agg(F.collect_set("line").alias("recurring")), "quality-recurring")


def assess(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source") -> DataFrame:
    """One row per input row (columns: ``DDL``); ``cleaned`` is the text of
    the lines that passed (the text itself if all did).

    A NULL or empty text has no words, so it fails.  Very long texts are
    judged whole, by the task that has the row.  Repeated rows each give a
    row; rows without an id are judged without the rule on recurring lines; an
    empty table gives no rows.  Other columns than the text, the id and the
    source are not read.
    """
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines_removed", pa.int64()), ("cleaned", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for d, t, r in row_stream(batches, "doc_id", "text", "recurring"):
            values = judge(t, frozenset(r or ()))
            out.add(len(values[-1]) + 64, d, *values)
            if out.full():
                yield out.batch()
        yield out.batch()

    found = recurring_lines(df, text, doc_id, source)
    rows = docs_of(df, text, doc_id).join(found, "doc_id", "left")
    return rows.select("doc_id", "text", "recurring").mapInArrow(run, DDL)


def cleaned(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str | None = "source") -> DataFrame:
    """The rows of ``df`` whose documents are kept, with the lines that passed
    as their text; all columns stay.  NULL, empty and very long texts, repeated
    rows, rows without an id and empty tables as in :func:`assess`."""

    def change() -> Callable[..., str | None]:
        def one(t: str, recurring: list[int] | None) -> str | None:
            values = judge(t, frozenset(recurring or ()))
            return values[-1] if values[6] else None

        return one

    key, lines = free_names(df, "_id", "_lines")
    found = recurring_lines(df, text, doc_id, source).toDF(key, lines)
    rows = df.join(found, F.col(f"`{doc_id}`").cast("long") == F.col(key), "left").drop(key)
    return rewritten(rows, text, change, (lines,))
