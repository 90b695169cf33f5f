"""Toxicity scores by logistic regression, fitted online by FTRL-proximal.

Features of a text are the words, word pairs and triples that occur in it and
the skip-grams (two words with one or two words between), each hashed to one
of ``2 ** BITS`` coordinates; a coordinate counts once.  A word stands for
itself and for its beginnings of ``STEMS`` letters, so inflected forms share
features.

Every coordinate has its own learning rate, which falls with the squared
gradients it has seen, and an L1 penalty that keeps coordinates without
evidence at exactly zero: the model is the short list of the others.

The labelled rows are dealt to up to ``SHARDS`` tasks by a hash of their ids.  In
each of ``EPOCHS`` rounds every task runs FTRL over its rows from the common
state, in an order fixed by the hash; then each coordinate takes the mean
change of the tasks that touched it.  A state has at most ``2 ** BITS``
coordinates, so what travels to the driver is bounded by ``SHARDS`` states,
whatever the corpus.  The weights go to all tasks, which score whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import docs_of, per_row, row_stream, written_at
from rulescope.sources import folders

#: Coordinates are hashes of this many bits.
BITS = 18
#: Letters of the word beginnings that count as words too.
STEMS = (4, 6)
#: Labelled rows that the model is fitted on: all of them up to this number,
#: of more a share by hash that makes about this number.
SAMPLE_ROWS = 24_000
#: Rows that make another shard worth its averaging, shards at most, rounds.
SHARD_ROWS, SHARDS, EPOCHS = 4_000, 6, 3
#: Learning rate, its smoothing, and the penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.01
#: A score from which a text is predicted toxic.
THRESHOLD = 0.7
#: Words whose hashes a task remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"\w+")
#: Odd multipliers that keep the places of a gram's words apart.
_PLACES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class _Words(dict):
    """Number of every word seen, with its hashes in a table."""

    def __init__(self):
        self.hashes = np.zeros((4096, 1 + len(STEMS)), dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        # 0 for a beginning that is the word itself
        self.hashes[at] = [_word_hash(word), *(_word_hash(f"{k} {word[:k]}") if len(word) > k else 0 for k in STEMS)]
        self[word] = at
        return at


class Features:
    """Coordinates of texts."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.words = _Words()

    def __call__(self, text: str) -> np.ndarray:
        """Coordinates of all grams of a text, some of them repeated."""
        if len(self.words) > REMEMBERED:
            self.words = _Words()
        words = _WORD.findall(text.lower())
        ids = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        table = self.words.hashes[ids]
        stems = table[:, 1:].ravel()
        a, b, c, d = (table[:, 0] * p for p in _PLACES)
        grams = [a, stems[stems != 0] * _PLACES[0]]
        grams += [a[:-1] ^ b[1:], a[:-2] ^ b[1:-1] ^ c[2:]]  # pairs and triples
        grams += [a[:-2] ^ d[2:], a[:-3] ^ d[3:] * _PLACES[1]]  # words with one and two between
        every = np.concatenate(grams)
        every ^= every >> np.uint64(32)
        return (every * _PLACES[0] >> self.shift).astype(np.int32)


def probability(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Ftrl:
    """FTRL-proximal state: ``z`` and ``n`` of every coordinate; the last one
    is the intercept, which has no L1 penalty."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n, self.bias = z.astype(np.float64), n.astype(np.float64), len(z) - 1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = np.zeros(len(at))
        on = np.flatnonzero((np.abs(z) > L1) | (at == self.bias))
        z, at = z[on], at[on]
        l1 = np.where(at == self.bias, 0.0, L1)
        w[on] = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return w

    def learn(self, coordinates: np.ndarray, toxic: bool) -> None:
        """One step; the coordinates are distinct."""
        at = np.append(coordinates, self.bias)
        w = self.weights(at)
        # All features of a text have the value 1: the gradient is the error.
        g = probability(w.sum()) - toxic
        on = np.flatnonzero(w)
        n = self.n[at[on]]
        self.z[at] += g
        self.z[at[on]] -= (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w[on]
        self.n[at] += g * g


class Model:
    """Coordinates with a weight, their weights, and the intercept."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float, bits: int):
        self.at, self.weights, self.bias, self.bits = at, weights, bias, bits

    def scorer(self) -> Callable[[str], float]:
        features = Features(self.bits)
        dense = np.zeros(1 << self.bits)
        dense[self.at] = self.weights

        def score(text: str) -> float:
            found = features(text)
            # A coordinate counts once; few have a weight.
            return probability(dense[np.unique(found[dense[found] != 0])].sum() + self.bias)

        return score


def held_out(doc_id: Column) -> Column:
    """The third of the documents whose labels are never learned from; rows
    without an id are not held out, and have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, toxic: str) -> DataFrame:
    """(doc_id, toxic, text) of about ``SAMPLE_ROWS`` labelled documents that
    are not held out, chosen by a hash of the id."""
    key = F.col(f"`{doc_id}`").cast("long")
    rows = labels.select(key.alias("doc_id"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = rows.count()
    if n > SAMPLE_ROWS:
        scale = 1 << 30
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * SAMPLE_ROWS / n))
    # About SAMPLE_ROWS ids at most, so they can go to every task; of rows
    # that share an id, one text stands, so the sample stays that small.
    texts = docs.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return texts


def _round(sample: DataFrame, shards: int, z: np.ndarray, n: np.ndarray) -> DataFrame:
    """(shard, at, dz, dn): what each shard's rows change in the common state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features((len(z) - 1).bit_length() - 1)
        mine: Ftrl | None = None
        shard = None
        for k, toxic, text in row_stream(batches, "shard", "toxic", "text"):
            if mine is not None and k != shard:
                yield _changes(shard, mine, z, n)
                mine = None
            if mine is None:
                mine, shard = Ftrl(z, n), k
            mine.learn(np.unique(features(text)), toxic)
        if mine is not None:
            yield _changes(shard, mine, z, n)

    key = F.xxhash64("doc_id", F.lit("order"))
    dealt = sample.withColumn("shard", F.pmod(key, F.lit(shards)).cast("int")).withColumn("key", key)
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "key", "doc_id")
    return dealt.select("shard", "toxic", "text").mapInArrow(run, "shard int, at binary, dz binary, dn binary")


def _changes(shard: int, mine: Ftrl, z: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(mine.n != n)
    parts = at.astype(np.int32), (mine.z[at] - z[at]).astype(np.float32), (mine.n[at] - n[at]).astype(np.float32)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
        names=["shard", "at", "dz", "dn"],
    )


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", toxic: str = "toxic", bits: int = BITS) -> Model:
    """The model learned from the labelled rows of ``docs`` (doc_id, text)
    that are not held out.  Without such rows every score is 0.5."""
    sample, path = written_at(_sample(docs, labels, doc_id, toxic), "toxicity-sample")
    shards = max(1, min(SHARDS, -(-sample.count() // SHARD_ROWS)))
    z, n = (np.zeros((1 << bits) + 1, dtype=np.float32) for _ in range(2))
    for _ in range(EPOCHS):
        # At most SHARDS rows; in the order of the shards, so that sums of
        # doubles come out the same each time.
        changes = sorted(_round(sample, shards, z, n).collect(), key=lambda r: r["shard"])
        dz, dn, touched = np.zeros_like(z), np.zeros_like(n), np.zeros_like(n)
        for row in changes:
            at = np.frombuffer(row["at"], dtype=np.int32)
            dz[at] += np.frombuffer(row["dz"], dtype=np.float32)
            dn[at] += np.frombuffer(row["dn"], dtype=np.float32)
            touched[at] += 1
        touched = np.maximum(touched, 1)
        z, n = z + dz / touched, n + dn / touched
    folders.discard(docs.sparkSession, path)
    weights = Ftrl(z, n).weights(np.arange(len(z)))
    at = np.flatnonzero(weights[:-1])
    return Model(at, weights[at], float(weights[-1]), bits)


def score(df: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row.

    The score depends on the text alone.  NULL and empty texts and texts
    without a word have the score of the intercept.  Very long texts are
    scored whole.  Repeated rows each give a row; an empty table gives none.
    Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def make() -> Callable[..., tuple[int, tuple]]:
        scorer = model.scorer()
        return lambda d, t: (16, (d, scorer(t)))

    scored = per_row(docs_of(df, text, doc_id), schema, "doc_id long, score double", ("doc_id", "text"), make)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fits on the labels (doc_id, toxic) and scores every row of ``df``.

    A document with several label rows is toxic if one of them says so; label
    rows without an id or a label, or of unknown documents, are not used.
    """
    return score(df, fit(docs_of(df, text, doc_id), labels), text, doc_id)
