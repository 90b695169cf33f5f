"""Product codes of vectors, by k-means with Drake and Hamerly's adaptive bounds.

Components become integers, vectors are cut into ``parts`` equal parts, and
every part position has its own codebook.  A round assigns every part to its
codebook's nearest entry and moves each entry to the floored mean of its parts.

What a round learns about a part is kept for the next: its ``b`` closest
entries in order of distance, each but the first with a lower bound that holds
for it and all entries behind it, and one outer bound for the entries beyond
the ``b``.  When entries move, a bound shrinks by the entry's move (the outer
one by the largest move).  In the next round the distance to the first entry
is computed, and only the entries whose bound does not exceed it are looked
at: none for most parts, some of the ``b``, or all entries if the outer bound
is passed too.  How far the looks went is counted, and ``b`` adapts to it: the
next round keeps as many entries as all but ``BEYOND`` of the parts needed, or
twice as many if too many parts needed all entries.

Bounds are doubles rounded to the safe side; whatever they leave open is
decided by integer distances, ties by the lower index.  So the result is that
of the plain algorithm.

The vectors with their bounds are a table in the shared folder, written anew
each round and dealt by rows, so no group is ever formed.  The driver sees the
codebooks, and for every entry its sums, summed up by each task and then by
Spark: parts * entries rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import written_at
from rulescope.sources import folders

#: Entries kept in the first round, as a share of the codebook; the least.
FIRST_SHARE, LEAST = 8, 2
#: Share of the parts that may need all entries when fewer are kept.
BEYOND = 0.02
#: Labels with at least one in this many of the rows are joined apart.
HOT_SHARE = 1024
#: Relative slack of a bound: far more than the error of a few roundings.
SLACK = 1e-12
#: Vectors of an Arrow batch worked on at a time.
BATCH = 2048

STATE = "vec_id long, label string, v array<long>, near binary, bounds binary, looked binary"


def integers(df: DataFrame, scale: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label as text, v): floor(scale * x) of every component.  Rows
    whose vector is NULL, empty, or holds NULL or non-finite components are
    left out; other columns are not read."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    v = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    rows = df.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), v.alias("v")
    )
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    # Components too large for exact work are refused by `compress`, not by the cast.
    limit = float(1 << 31)

    def whole(x: Column) -> Column:
        return F.least(F.greatest(F.floor(x * scale).cast("double"), F.lit(-limit)), F.lit(limit)).cast("long")

    return rows.withColumn("v", F.transform("v", whole))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows of a matrix."""
    return batch.column("v").flatten().to_numpy().reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def unpacked(batch: pa.RecordBatch, column: str, dtype: type, *shape: int) -> np.ndarray:
    values = batch.column(column).to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), *shape)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances of rows (n, d) to entries (m, d)."""
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


def lower(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


def upper(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


class Bounds:
    """What is known of n parts of one position: ``near`` (n, b), the closest
    entries in order; ``low`` (n, b), where ``low[:, j]`` for j < b - 1 bounds
    the distances of ``near[:, j + 1]`` and all entries behind it, and
    ``low[:, b - 1]`` those of the entries that are not kept."""

    def __init__(self, near: np.ndarray, low: np.ndarray):
        self.near, self.low = near, low

    @classmethod
    def fresh(cls, x: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """From all distances; also the least squared distance."""
        k = len(entries)
        keys = squared(x, entries) * k + np.arange(k)  # ties: the lower index first
        keys.sort(axis=1)
        at, d2 = keys % k, keys // k
        low = np.full((len(x), b), np.inf)
        low[:, : min(b, k - 1)] = lower(np.sqrt(d2[:, 1 : b + 1]))
        near = np.zeros((len(x), b), dtype=np.int64)
        near[:, :k] = at[:, :b]
        return cls(near, low), d2[:, 0]

    def moved(self, moves: np.ndarray) -> None:
        """Shrinks the bounds by the entries' moves; then each bound holds
        for everything behind it as well."""
        self.low[:, :-1] -= upper(moves[self.near[:, 1:]])
        self.low[:, -1] -= upper(moves.max())
        self.low = np.minimum.accumulate(self.low[:, ::-1], axis=1)[:, ::-1]

    def assign(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry to each part now, decided by as few distances as the
        bounds allow.  Returns its squared distance and, for each part, how
        many kept entries were looked at (b + 1: all entries)."""
        b, k = self.near.shape[1], len(entries)
        best = ((x - entries[self.near[:, 0]]) ** 2).sum(axis=1)
        # Not larger than the first distance: not decided by the bound.
        looked = 1 + (lower(self.low) <= upper(np.sqrt(best))[:, None]).sum(axis=1)
        some = np.flatnonzero((looked > 1) & (looked <= b))
        if len(some):
            near, reach = self.near[some], looked[some, None]
            d2 = np.zeros(near.shape, dtype=np.int64)
            for c in range(x.shape[1]):
                d2 += (x[some, c, None] - entries[near, c]) ** 2
            seen = np.arange(b) < reach
            # The entries looked at are ordered anew, the others keep their places.
            keys = np.where(seen, d2 * k + near, np.iinfo(np.int64).max - b + np.arange(b))
            order = np.argsort(keys, axis=1)
            self.near[some] = np.take_along_axis(near, order, axis=1)
            d2 = np.take_along_axis(d2, order, axis=1)
            best[some] = d2[:, 0]
            # Those ordered anew have exact distances as bounds, but never
            # more than the bound of what comes behind them.
            exact = lower(np.sqrt(d2[:, 1:]))
            low = self.low[some]
            low[:, :-1] = np.where(seen[:, 1:], exact, low[:, :-1])
            self.low[some] = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        every = np.flatnonzero(looked > b)
        if len(every):
            found, best[every] = Bounds.fresh(x[every], entries, b)
            self.near[every], self.low[every] = found.near, found.low
        return best, looked

    def resized(self, b: int) -> Bounds:
        """With fewer entries, the bound behind the last one becomes the
        outer one; places for more are empty and bounded by the outer one."""
        more = max(0, b - self.near.shape[1])
        near = np.pad(self.near[:, :b], ((0, 0), (0, more)))
        return Bounds(near, np.pad(self.low[:, :b], ((0, 0), (0, more)), mode="edge"))


class Round:
    """One assignment of all parts.

    ``codebooks`` is (parts, entries, d); ``moves`` (parts, entries), how far
    the entries went since the bounds were made (None: no bounds yet);
    ``stored`` entries are in the bounds that are read, ``b`` are used and kept.
    """

    def __init__(self, codebooks: np.ndarray, moves: np.ndarray | None, stored: int, b: int):
        self.codebooks, self.moves, self.stored, self.b = codebooks, moves, stored, b

    def positions(self, batch: pa.RecordBatch) -> Iterator[tuple[Bounds, np.ndarray, np.ndarray]]:
        """For every part position: bounds, squared distances, looks."""
        parts, _, d = self.codebooks.shape
        v = matrix(batch, parts * d).reshape(-1, parts, d)
        if self.moves is not None:
            near = unpacked(batch, "near", np.uint8, parts, self.stored).astype(np.int64)
            low = unpacked(batch, "bounds", np.float32, parts, self.stored).astype(np.float64)
        for p in range(parts):
            x = v[:, p]
            if self.moves is None:
                bounds, best = Bounds.fresh(x, self.codebooks[p], self.b)
                looked = np.ones(len(x), dtype=np.int64)
            else:
                bounds = Bounds(near[:, p], low[:, p]).resized(self.b)
                bounds.moved(self.moves[p])
                best, looked = bounds.assign(x, self.codebooks[p])
            yield bounds, best, looked

    def state(self, rows: DataFrame) -> DataFrame:
        """The rows with bounds for the next round, and how far was looked."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _sliced(batches):
                near, low, looked = zip(*((x.near, x.low, k) for x, _, k in self.positions(b)), strict=True)
                # Rounded to four bytes, and one step down.
                low = np.nextafter(np.stack(low, axis=1).astype(np.float32), np.float32(-np.inf))
                new = [packed(np.stack(near, axis=1).astype(np.uint8)), packed(low)]
                new.append(packed(np.stack(looked, axis=1).astype(np.uint8)))
                columns = [b.column(c) for c in ("vec_id", "label", "v")]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=["vec_id", "label", "v", "near", "bounds", "looked"])

        return rows.mapInArrow(run, STATE)

    def codes(self, rows: DataFrame) -> DataFrame:
        """(vec_id, label, code, error): two hex digits for each part."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _sliced(batches):
                error, first = np.zeros(b.num_rows, dtype=np.int64), []
                for bounds, best, _ in self.positions(b):
                    error += best
                    first.append(bounds.near[:, 0])
                code = [r.tobytes().hex() for r in np.stack(first, axis=1).astype(np.uint8)]
                columns = [b.column("vec_id"), b.column("label"), pa.array(code), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

        return rows.mapInArrow(run, "vec_id long, label string, code string, error long")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            yield b.slice(lo, BATCH)


def _sums(state: DataFrame, shape: tuple[int, int, int], b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry (parts * entries, 1 + d) the number of its parts and the
    sums of their components; and the parts by how far was looked."""
    parts, entries, d = shape
    slots = parts * entries
    names = ["slot", "n", *(f"s{k}" for k in range(d))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The looks are counted behind the entries.
        total = np.zeros((slots + b + 2, 1 + d), dtype=np.int64)
        for batch in _sliced(batches):
            v = matrix(batch, parts * d).reshape(-1, d)
            slot = unpacked(batch, "near", np.uint8, parts, b)[:, :, 0] + np.arange(parts) * entries
            order = np.argsort(slot.ravel(), kind="stable")
            slot, v = slot.ravel()[order], v[order]
            heads = np.flatnonzero(np.diff(slot, prepend=-1))
            if len(heads):
                total[slot[heads], 0] += np.diff(np.append(heads, len(slot)))
                total[slot[heads], 1:] += np.add.reduceat(v, heads, axis=0)
            total[slots:, 0] += np.bincount(unpacked(batch, "looked", np.uint8, parts).ravel(), minlength=b + 2)
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c) for c in total[used].T)], names=names)

    rows = state.select("v", "near", "looked").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    out = np.zeros((slots + b + 2, 1 + d), dtype=np.int64)
    for r in rows.groupBy("slot").agg(*(F.sum(c).alias(c) for c in names[1:])).collect():
        out[r["slot"]] = [r[c] for c in names[1:]]
    return out[:slots], out[slots:, 0]


def adapted(b: int, looks: np.ndarray, entries: int) -> int:
    """Entries to keep next: as many as all but ``BEYOND`` of the parts
    looked at; twice as many if more parts than that needed all entries."""
    beyond = looks.sum() - np.cumsum(looks)  # parts that looked further than each number
    few = BEYOND * looks.sum()
    if beyond[b] > few:
        return min(2 * b, max(LEAST, entries // 2))
    return max(LEAST, int(np.argmax(beyond <= few)))


def compress(
    df: DataFrame,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error), one row for each vector that takes part,
    and the codebooks (parts, entries, components of a part).

    ``code`` holds the index of each part's entry in two hex digits, so there
    are at most 256 entries; ``error`` is the vector's squared distance to its
    entries.  The first entries are the parts of the vectors of smallest id
    (without an id: last; ties: smaller vector); with fewer vectors, there are
    fewer entries.

    Rows whose vector is NULL, empty or holds NULL or non-finite components
    take no part.  Repeated rows and rows that share an id each count and give
    a row.  An empty table gives no rows and no codebooks.  Extra columns are
    not read.  Vectors of several lengths, a length that the parts do not
    divide, or components too large for exact 64-bit work raise a ValueError.
    """
    spark = df.sparkSession
    rows = integers(df, scale, vec_id, embedding, label)
    size = F.size("v")
    big = F.array_max(F.transform("v", F.abs))
    seen = rows.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.max(big).alias("big")).first()
    if seen["high"] is None:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    if seen["low"] != seen["high"] or seen["high"] % parts:
        raise ValueError(f"vectors of {seen['low']} to {seen['high']} components cannot be cut into {parts} equal parts")
    d = seen["high"] // parts
    if 4 * seen["big"] ** 2 * d * entries >= 1 << 62:
        raise ValueError("components too large for exact distances")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    codebooks = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, parts, d).transpose(1, 0, 2)
    shape = codebooks.shape
    moves, stored, path = None, 0, None
    b = min(max(LEAST, shape[1] // FIRST_SHARE), 254)
    for _ in range(rounds):
        rows, new = written_at(Round(codebooks, moves, stored, b).state(rows), "vector-bounds")
        if path:
            folders.discard(spark, path)
        path, stored = new, b
        sums, looks = _sums(rows, shape, b)
        used = sums[:, 0] > 0
        after = codebooks.reshape(-1, d).copy()
        after[used] = sums[used, 1:] // sums[used, :1]  # floors
        moved = after.reshape(shape)
        if moves is not None:
            b = adapted(b, looks, shape[1])
        moves = np.sqrt(((moved - codebooks) ** 2).sum(axis=2))
        codebooks = moved
    codes, _ = written_at(Round(codebooks, moves, stored, b).codes(rows), "vector-codes")
    if path:
        folders.discard(spark, path)
    return codes, codebooks


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over equal labels
    (NULLs are equal).  Labels that hold one in ``HOT_SHARE`` of the rows or
    more, at most ``HOT_SHARE`` of them, are sent to the rows; the rows of the
    others are dealt by label."""
    n = codes.count()
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    totals, _ = written_at(totals, "label-errors")
    totals = totals.withColumnRenamed("label", "of")
    is_hot = F.col("n") * HOT_SHARE >= n
    hot, cold = (totals.where(c).drop("n") for c in (is_hot, ~is_hot))
    same = F.col("label").eqNullSafe(F.col("of"))
    frequent = codes.join(F.broadcast(hot), same)
    others = codes.join(F.broadcast(hot.select("of")), same, "left_anti").join(cold, same)
    return frequent.unionByName(others).drop("of")


def codebooks_hash(codebooks: np.ndarray) -> str:
    """sha256 of all components, by part, entry and position, with commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
