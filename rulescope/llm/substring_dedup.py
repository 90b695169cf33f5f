"""Removal of repeated byte strings by suffix arrays.

A byte is removed if some 100-byte string over it also starts earlier: in a
document of smaller id, or earlier in the same one.

1. Texts are cut into stretches by content (``anchors``): equal windows lie in
   stretches of one class, at equal offsets.  Stretches with equal bytes are
   merged on the way, within a task and then over all: the first keeps its
   windows, those of the others repeat.
2. A class that holds different stretches may still share windows.  The first
   of each is fetched from its document, and classes are gathered into
   shards.  A shard goes through batches of whole classes, as equal windows are
   of one class.  Every batch's suffix array is built by Larsson-Sadakane
   refinement; Kasai's common prefixes of 100 bytes or more make its runs of
   equal windows, of which all but the first repeat.
3. A class too large for one shard is spread over several.  Each of these
   gives its distinct windows in suffix order, and the lists are merged by
   binary search of one in the other.
4. The repeated windows of each document are united into spans of bytes.

Only the stretches' hashes, the candidate stretches and, twice, the documents
are shuffled; no task holds more than a shard or one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.llm.anchors import BUFFER, WINDOW, Hasher, stretches
from rulescope.llm.common import EMIT_BYTES, Emitter, docs_of, free_names, rewritten, row_stream, written, written_at
from rulescope.llm.suffix_arrays import common_prefixes, index_type, suffix_array
from rulescope.sources.folders import discard

#: Stretches that a task merges before it sends them on.
MERGE_ROWS = 200_000
#: Bytes of a shard; a class with more is spread over several shards.
SHARD_BYTES = 2 << 20
#: Bytes of a shard that are sorted at a time, or one larger class.
BATCH_BYTES = 1 << 18

COVER, FIRST, REP = 1, 2, 3
_DDL = "kind int, cls long, key long, doc_id long, at int, n int"
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("cls", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]
)


def _rows(kind: int, cls, key, doc, at, n) -> pa.RecordBatch:
    cols = [np.full(len(cls), kind, np.int32), cls, key, doc, at.astype(np.int32), n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_SCHEMA)


def _joined(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Window ranges, neighbouring ones of a document united."""
    by = np.lexsort((at, doc))
    doc, at, n = doc[by], at[by], n[by]
    if not len(doc):
        return doc, at, n
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1])])
    start = np.flatnonzero(head)
    return doc[start], at[start], np.add.reduceat(n, start)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The first of each distinct stretch; windows of the others as covered."""
    cls, key, doc, at, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    by = np.lexsort((at, doc, key, cls))
    cls, key, doc, at, n = cls[by], key[by], doc[by], at[by], n[by]
    again = np.zeros(len(cls), dtype=bool)
    again[1:] = (cls[1:] == cls[:-1]) & (key[1:] == key[:-1])
    head = np.flatnonzero(~again)
    first = np.repeat(head, np.diff(np.append(head, len(cls))))
    same_place = again & (doc == doc[first]) & (at == at[first])
    yield _rows(FIRST, cls[head], key[head], doc[head], at[head], n[head])
    rest = again & ~same_place
    d, a, m = _joined(doc[rest], at[rest], n[rest])
    yield _rows(COVER, d, d, d, a, m)


def _cut(docs: DataFrame) -> DataFrame:
    """Stretches of every text, merged within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        parts: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        owners: list[tuple[int, int]] = []  # (doc_id, offset of the piece)
        size = rows = 0

        def hashed() -> None:
            nonlocal texts, owners, size, rows
            raw = np.frombuffer(b"".join(texts), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
            cls, key, at, n = stretches(hasher, raw, starts)
            own = np.searchsorted(starts, at, side="right") - 1
            ids = np.array([o[0] for o in owners], dtype=np.int64)
            offs = np.array([o[1] for o in owners], dtype=np.int64)
            if len(cls):
                parts.append((cls, key, ids[own], at - starts[own] + offs[own], n))
            rows += len(cls)
            texts, owners, size = [], [], 0

        for d, t in row_stream(batches, "doc_id", "text"):
            raw = t.encode()
            if len(raw) < WINDOW:
                continue
            for lo in range(0, max(1, len(raw) - WINDOW + 1), BUFFER - WINDOW + 1):
                piece = raw[lo : lo + BUFFER]
                if size + len(piece) > BUFFER:
                    hashed()
                texts.append(piece)
                owners.append((d, lo))
                size += len(piece)
            if rows >= MERGE_ROWS:
                yield from _merged(parts)
                parts, rows = [], 0
        if texts:
            hashed()
        if parts:
            yield from _merged(parts)

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, _DDL)


def _settled(cut: DataFrame) -> DataFrame:
    """Merges over all tasks.  Keeps the firsts of classes with two or more
    distinct stretches, and covered windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def close(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            for b in _merged(parts):
                if b.column(0)[0].as_py() == COVER if b.num_rows else True:
                    yield b
                    continue
                cls = b.column(1).to_numpy()
                same = cls[1:] == cls[:-1]
                several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
                yield b.filter(pa.array(several))

        for b in batches:
            kind = b.column(0).to_numpy()
            if (kind == COVER).any():
                yield b.filter(pa.array(kind == COVER))
                b = b.filter(pa.array(kind == FIRST))
            if not b.num_rows:
                continue
            cols = tuple(b.column(k).to_numpy() for k in range(1, 6))
            cut_at = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if cut_at:  # all classes but the last are complete
                yield from close([*held, tuple(c[:cut_at] for c in cols)])
                held = []
            held.append(tuple(c[cut_at:] for c in cols))
        if held:
            yield from close(held)

    return cut.repartition("cls").sortWithinPartitions("kind", "cls").mapInArrow(run, _DDL)


def _fetched(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(cls, doc_id, at, bytes): the stretches cut out of their documents."""
    wanted = firsts.groupBy("doc_id").agg(F.collect_list(F.struct("cls", "at", "n")).alias("wanted"))
    schema = pa.schema([("cls", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for d, t, rows in row_stream(batches, "doc_id", "text", "wanted"):
            raw = t.encode()
            for r in rows:
                out.add(150, r["cls"], d, r["at"], raw[r["at"] : r["at"] + r["n"] + WINDOW - 1])
            if out.full():
                yield out.batch()
        yield out.batch()

    return docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(
        run, "cls long, doc_id long, at int, bytes binary"
    )


_FOUND = "kind int, cls long, doc_id long, at int, n int, window binary"
_FOUND_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("cls", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("window", pa.binary())]
)


def repeats_in(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(stretch, offset, is a repeat, is the first of its kind) of every
    window of the stretches, equal ones together."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    kind = index_type(len(raw))
    sizes = np.array([len(t) for t in texts], dtype=kind)
    starts = np.cumsum(sizes, dtype=kind) - sizes
    order, rank = suffix_array(raw)
    shared = common_prefixes(raw, order, rank, starts, WINDOW)
    run = np.cumsum(shared < WINDOW, dtype=kind)
    del rank, shared
    own = np.repeat(np.arange(len(sizes), dtype=kind), sizes)[order]
    offset = order - starts[own]
    del order
    window = offset + WINDOW <= sizes[own]
    own, offset, run = own[window], offset[window], run[window]
    head = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    # Runs of two or more: the first is the window that starts earliest.
    several = np.flatnonzero(~head | ~np.append(head[1:], True)) if len(run) else np.zeros(0, np.int64)
    o, f = own[several], offset[several]
    place, owner = at[o] + f, doc[o]
    by = np.lexsort((place, owner, run[several]))
    place, owner = place[by], owner[by]
    own[several], offset[several] = o[by], f[by]
    start = np.flatnonzero(head[several])
    first = np.repeat(start, np.diff(np.append(start, len(several))))
    # A repeated row of one document brings the first's own windows again.
    again = np.zeros(len(run), dtype=bool)
    again[several] = (owner != owner[first]) | (place != place[first])
    return own, offset, again, head


def class_batches(cls: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows, sorted by class: whole classes of ``BATCH_BYTES``
    together at most, or one larger class."""
    ends = np.append(np.flatnonzero(cls[1:] != cls[:-1]) + 1, len(cls))
    upto = np.cumsum(sizes)
    lo = done = 0
    while lo < len(cls):
        fits = int(np.searchsorted(upto[ends - 1], done + BATCH_BYTES, side="right")) - 1
        hi = int(ends[max(fits, int(np.searchsorted(ends, lo, side="right")))])
        yield lo, hi
        lo, done = hi, int(upto[hi - 1])


def shard_repeats(shard: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of ``_FOUND`` of one shard, a batch of its classes at a time."""
    spread = shard["shard"][0].as_py() < 0
    shard = shard.take(pa.array(np.argsort(shard["cls"].to_numpy(), kind="stable")))
    sizes = pc.binary_length(shard["bytes"]).to_numpy().astype(np.int64)
    for lo, hi in class_batches(shard["cls"].to_numpy(), sizes):
        part = shard.slice(lo, hi - lo)
        texts, doc = part["bytes"].to_pylist(), part["doc_id"].to_numpy()
        at, cls = part["at"].to_numpy().astype(np.int64), part["cls"].to_numpy()
        own, offset, repeat, first = repeats_in(texts, doc, at)
        o, f = own[repeat], offset[repeat]
        d, a, n = _joined(doc[o], at[o] + f, np.ones(len(o), np.int64))
        cols = [np.full(len(d), COVER, np.int32), d, d, a.astype(np.int32), n.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.nulls(len(d), pa.binary())], schema=_FOUND_SCHEMA)
        if not spread:
            continue
        firsts, step = np.flatnonzero(first), max(1, EMIT_BYTES // WINDOW)
        for k in range(0, len(firsts), step):
            o, f = own[firsts[k : k + step]], offset[firsts[k : k + step]]
            cols = [np.full(len(o), REP, np.int32), cls[o], doc[o], (at[o] + f).astype(np.int32), np.ones(len(o), np.int32)]
            windows = [texts[i][j : j + WINDOW] for i, j in zip(o.tolist(), f.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(windows, pa.binary())], schema=_FOUND_SCHEMA)


def _sharded(pieces: DataFrame, shards: int) -> DataFrame:
    """Covered windows of every shard; of spread classes also the first of
    each distinct window, to be merged with the other shards'."""
    sizes = pieces.groupBy("cls").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > SHARD_BYTES)
    spread = sizes.select("cls", F.ceil(F.col("size") / SHARD_BYTES).cast("long").alias("over"))
    rows = pieces.join(spread, "cls", "left").withColumn(
        "shard",
        F.when(F.col("over").isNull(), F.pmod(F.xxhash64("cls"), F.lit(shards))).otherwise(
            # Numbers below zero: a spread class has shards of its own.
            -1 - F.pmod(F.xxhash64("cls", F.pmod(F.xxhash64("doc_id", "at"), F.col("over"))), F.lit(1 << 40))
        ),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from shard_repeats(pa.Table.from_batches(list(batches)))
        # What this group's arrays held is not kept for the worker's next one.
        pa.default_memory_pool().release_unused()

    cols = ["shard", "cls", "doc_id", "at", "bytes"]
    return rows.select(*cols).groupBy("shard").applyInArrow(run, _FOUND)


def merge_sorted(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Merges sorted lists of distinct windows (windows, doc, at) one into
    the other by binary search; gives (doc, at) of windows that are repeats."""
    windows, doc, at = lists[0]
    losers = []
    for w, d, a in lists[1:]:
        place = np.searchsorted(windows, w)
        hit = np.minimum(place, len(windows) - 1)
        same = windows[hit] == w
        mine, theirs = np.flatnonzero(same), hit[same]
        earlier = (d[mine] < doc[theirs]) | ((d[mine] == doc[theirs]) & (a[mine] < at[theirs]))
        equal = (d[mine] == doc[theirs]) & (a[mine] == at[theirs])
        lost = ~earlier & ~equal
        losers.append((d[mine][lost], a[mine][lost]))
        losers.append((doc[theirs][earlier], at[theirs][earlier]))
        doc, at = doc.copy(), at.copy()
        doc[theirs[earlier]], at[theirs[earlier]] = d[mine][earlier], a[mine][earlier]
        new = np.flatnonzero(~same)
        windows = np.insert(windows, place[new], w[new])
        doc, at = np.insert(doc, place[new], d[new]), np.insert(at, place[new], a[new])
    return losers


def _cross_shard(reps: DataFrame, parts: int) -> DataFrame:
    """Merges the shards' distinct windows, by ranges of the windows' hash."""
    slot = F.pmod(F.xxhash64("window"), F.lit(parts)).alias("slot")

    def run(table: pa.Table) -> pa.Table:
        # A closing byte keeps trailing zeros, which numpy's strings drop.
        w = np.array([x + b"\x01" for x in table["window"].to_pylist()], dtype=f"S{WINDOW + 1}")
        d, a = table["doc_id"].to_numpy(), table["at"].to_numpy().astype(np.int64)
        # Lists of distinct windows: the k-th occurrence of each goes to list k.
        by = np.lexsort((a, d, w))
        w, d, a = w[by], d[by], a[by]
        head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        nth = np.arange(len(w)) - np.repeat(head, np.diff(np.append(head, len(w))))
        lost = merge_sorted([(w[nth == k], d[nth == k], a[nth == k]) for k in range(int(nth.max()) + 1)])
        doc = np.concatenate([x[0] for x in lost]) if lost else d[:0]
        at = np.concatenate([x[1] for x in lost]) if lost else a[:0]
        doc, at, n = _joined(doc, at, np.ones(len(doc), np.int64))
        return pa.table({"doc_id": doc, "at": at.astype(np.int32), "n": n.astype(np.int32)})

    return reps.select("window", "doc_id", "at", slot).groupBy("slot").applyInArrow(run, "doc_id long, at int, n int")


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, at, n): ranges of window starts whose windows repeat."""
    found = written(_settled(_cut(docs)), "repeat-stretches")
    firsts = found.where(F.col("kind") == FIRST)
    covered = found.where(F.col("kind") == COVER).select("doc_id", "at", "n")
    total = firsts.agg(F.sum(F.col("n") + WINDOW - 1).alias("b")).first()["b"] or 0
    if not total:
        return covered
    shards = -(-total // SHARD_BYTES)
    pieces, pieces_at = written_at(_fetched(docs, firsts), "repeat-pieces")
    shard = written(_sharded(pieces, shards), "repeat-shards")
    discard(docs.sparkSession, pieces_at)
    more = shard.where(F.col("kind") == COVER).select("doc_id", "at", "n")
    reps = shard.where(F.col("kind") == REP)
    # A byte of the shards gives a window, so a slot has a shard's bytes too.
    crossed = _cross_shard(reps, shards * WINDOW)
    return covered.unionByName(more).unionByName(crossed)


def ranges_of(docs: DataFrame) -> DataFrame:
    """(doc_id, ranges): the repeated windows of every document with any."""
    return find_repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))


def spans_of(size: int, ranges) -> list[list[int]]:
    """The byte spans that ranges of windows cover, united."""
    spans: list[list[int]] = []
    for lo, hi in sorted((r["at"], r["at"] + r["n"] + WINDOW - 1) for r in ranges or ()):
        hi = min(hi, size)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        elif lo < hi:
            spans.append([lo, hi])
    return spans


def without(raw: bytes, spans: list[list[int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in spans:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return b"".join(kept)


DDL = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def remove_repeats(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row (columns: ``DDL``): the removed byte spans and
    the remaining bytes.

    NULL and empty texts have no bytes.  Rows of one id with the same text
    are one document.  Rows without id are left whole and do not count for
    others.
    """
    docs = docs_of(df, text, doc_id)
    ranges = ranges_of(docs)
    joined = docs.join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for d, t, rows in row_stream(batches, "doc_id", "text", "ranges"):
            raw = t.encode()
            spans = spans_of(len(raw), rows)
            left = without(raw, spans)
            out.add(len(left) + 64, d, len(raw), len(raw) - len(left), [{"start": a, "end": b} for a, b in spans], left)
            if out.full():
                yield out.batch()
        yield out.batch()

    return joined.mapInArrow(run, DDL)


def stripped(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without their repeated bytes; all columns stay.

    What is left of a character that was cut goes too.  A document of which
    no word is left is dropped, unless it had none before.  Repeated rows of
    one id and text are cut alike; rows without an id, NULL and empty texts
    stay as they are; very long texts are cut whole; an empty table stays empty.
    """
    key, cuts = free_names(df, "_id", "_cuts")
    ranges = ranges_of(docs_of(df, text, doc_id)).select(F.col("doc_id").alias(key), F.col("ranges").alias(cuts))
    joined = df.join(ranges, F.col(f"`{doc_id}`").cast("long") == F.col(key), "left").drop(key)

    def change() -> Callable[..., str | None]:
        def one(t: str, rows: list | None) -> str | None:
            if not rows:
                return t
            raw = t.encode()
            left = without(raw, spans_of(len(raw), rows)).decode(errors="ignore")
            return left if left.strip() or not t.strip() else None

        return one

    return rewritten(joined, text, change, using=(cuts,))
