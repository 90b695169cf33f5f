"""Exact top-k inner-product search by distributed histogram selection.

Vectors are scaled to integers, so scores are exact integers.  Queries are
taken a block at a time; a block's vectors, at most ``BLOCK`` of them, are
sent to all tasks.  For each block:

1. every candidate is scored by every query, and each task counts its scores
   in ``BINS`` equal bins of the query's score range; the counts are summed over
   all tasks;
2. the bin that holds the k-th score becomes the query's new range, and step 1
   repeats within it until bins are one score wide: then the k-th score is
   known exactly;
3. the candidates above it are taken, and of those equal to it the ones of
   smallest id that fill up the k.  Per task and query only the k smallest
   ids of the ties can be needed; the others are not sent.

Nothing is approximated, and no task holds more than a block of queries, a
batch of candidates and the block's histograms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries of a block.
BLOCK = 4096
BINS = 256
#: Candidates scored at a time.
BATCH = 1024


def scaled(df: DataFrame, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component.  Rows without an id
    or whose vector is NULL, empty, or holds NULL or non-finite components
    are left out."""
    v = F.col(f"`{embedding}`")

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", bad))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as doubles) of the candidates of that dimension."""
    for b in batches:
        for lo in range(0, b.num_rows, BATCH):
            part = b.slice(lo, BATCH)
            ids, lists = part.column(0).to_numpy(), part.column(1)
            sizes = pa.compute.list_value_length(lists).to_numpy()
            flat = lists.flatten().to_numpy().astype(np.float64)
            if (sizes == dim).all():
                yield ids, flat.reshape(-1, dim)
            elif (sizes == dim).any():
                ends = np.cumsum(sizes)
                rows = np.flatnonzero(sizes == dim)
                yield ids[rows], np.stack([flat[ends[i] - dim : ends[i]] for i in rows])


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer scores (query, candidate).  Doubles hold them exactly while
    |score| < 2 ** 53, which ``top_k`` has checked."""
    return (queries @ vectors.T).astype(np.int64)


def _histogram(
    vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, high: np.ndarray, width: np.ndarray
) -> DataFrame:
    """(query, bin, n): scores of [low, high) in bins of a width, BINS at most."""
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids) * (BINS + 1), dtype=np.int64)
        base = (np.arange(len(ids)) * (BINS + 1))[:, None]
        for cand, matrix in _matrices(batches, dim):
            scores = _scores(queries, matrix)
            bins = (scores - low[:, None]) // width[:, None]
            bins[(bins < 0) | (scores >= high[:, None]) | (ids[:, None] == cand)] = BINS
            total += np.bincount((bins + base).ravel(), minlength=len(total))
        total = total.reshape(len(ids), BINS + 1)[:, :BINS]
        q, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q, k, total[q, k])], names=["q", "bin", "n"])

    counts = vectors.mapInArrow(run, "q long, bin long, n long")
    return counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _selected(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) with score above the k-th, and ties that may
    be among the k."""
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: list[np.ndarray] = []  # rows (query, vec_id)

        def fewest() -> np.ndarray:
            rows = np.concatenate(ties) if ties else np.zeros((0, 2), np.int64)
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            head = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else rows[:0, 0]
            nth = np.arange(len(rows)) - np.repeat(head, np.diff(np.append(head, len(rows))))
            return rows[nth < k]

        for cand, matrix in _matrices(batches, dim):
            scores = _scores(queries, matrix)
            scores[ids[:, None] == cand] = np.iinfo(np.int64).min
            q, c = np.nonzero(scores > kth[:, None])
            if len(q):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[q], cand[c], scores[q, c])], names=["query_id", "vec_id", "score"]
                )
            q, c = np.nonzero(scores == kth[:, None])
            ties.append(np.stack([q, cand[c]], axis=1))
            if sum(map(len, ties)) > 4 * k * len(ids):
                ties = [fewest()]
        rows = fewest()
        q = rows[:, 0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[q], rows[:, 1], kth[q])], names=["query_id", "vec_id", "score"]
        )

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int,
    scale: int = 64,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k best candidates
    (all, if there are fewer), ties to the smaller id.

    Candidates are all vectors but those of the query's own id; only vectors
    of the query's dimension are comparable.  Rows that share an id take part
    one by one; of a query's id, the vector of smallest value is the query.
    An empty table or one without queries gives no rows.
    """
    spark = df.sparkSession
    vectors = scaled(df, scale, vec_id, embedding)
    queries = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    # Scores lie within dimension * largest component squared.
    bound = vectors.agg(
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("big"), F.max(F.size("v")).alias("dim")
    ).first()
    ddl = "query_id long, rank int, vec_id long, score long"
    if bound["dim"] is None:
        return spark.createDataFrame([], ddl)
    limit = int(bound["big"]) ** 2 * int(bound["dim"]) + 1
    if limit >= 1 << 53:
        raise ValueError("scores would not be exact")
    out, after = None, None
    while True:
        rest = queries if after is None else queries.where(F.col("vec_id") > after)
        rows = rest.orderBy("vec_id").limit(block).collect()  # at most a block
        if not rows:
            break
        after = rows[-1]["vec_id"]
        for dim in sorted({len(r["v"]) for r in rows}):
            mine = [r for r in rows if len(r["v"]) == dim]
            ids = np.array([r["vec_id"] for r in mine], dtype=np.int64)
            matrix = np.array([r["v"] for r in mine], dtype=np.float64)
            kth = _kth_scores(vectors, ids, matrix, k, limit)
            found = _selected(vectors, ids, matrix, kth, k)
            out = found if out is None else out.unionByName(found)
        if len(rows) < block:
            break
    if out is None:
        return spark.createDataFrame([], ddl)
    best = out.groupBy("query_id").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("c"))
    ranked = best.select("query_id", F.posexplode(F.slice(F.array_sort("c"), 1, k)).alias("rank", "c"))
    return ranked.select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "c.vec_id", (-F.col("c.s")).alias("score")
    )


def _kth_scores(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, limit: int) -> np.ndarray:
    """Each query's k-th best score; below all scores if there are fewer."""
    n = len(ids)
    low = np.full(n, -limit, dtype=np.int64)
    width = np.full(n, -(-(2 * limit + 1) // BINS), dtype=np.int64)
    high = low + BINS * width
    above = np.zeros(n, dtype=np.int64)  # scores beyond the present range
    few = np.zeros(n, dtype=bool)
    first = True
    while True:
        counts = np.zeros((n, BINS), dtype=np.int64)
        table = _histogram(vectors, ids, queries, low, high, width).toPandas()  # BINS rows a query at most
        counts[table["q"].to_numpy(dtype=np.int64), table["bin"].to_numpy(dtype=np.int64)] = table["n"].to_numpy()
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] + above[:, None]
        if first:
            few = from_top[:, 0] < k
            first = False
        # The highest bin at or above which there are k scores.
        enough = from_top >= k
        at = BINS - 1 - np.argmax(enough[:, ::-1], axis=1)
        at[few] = 0
        above = np.where(at + 1 < BINS, from_top[np.arange(n), np.minimum(at + 1, BINS - 1)], above)
        low = low + at * width
        high = low + width
        if (width == 1).all():
            return np.where(few, -limit - 1, low)
        width = np.maximum(-(-width // BINS), 1)
