"""Packing of documents into training sequences of several lengths.

Every document is routed to the smallest tier (a power of two up to the
window) that holds it; longer ones go to the longest.  In a tier, documents
follow each other in one stream that is cut at every tier length, so each of
its sequences is full and needs no padding.  Only the last stretch of each
tier's stream is left over: these gaps of the long windows are filled from
the shorter tiers' rests, and what then remains is cut into powers of two.
A sequence is therefore full whatever the lengths are.  Step groups take an
even share of every tier's sequences, so all steps hold about as many tokens
of each length.

Positions in a tier's stream are prefix sums: within a task while ids are
made, and over one row per task and tier (counted on the driver).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import Emitter, row_stream, written
from rulescope.llm.token_files import encode_ids, id_width

#: Context lengths, each a power of two; the last is the window.
TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group.
STEP_TOKENS = 1 << 19

PIECES_DDL = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_group long, ids binary"
)


class Layout:
    """Where each position of each tier's stream lies; from the tiers' totals."""

    def __init__(self, totals: list[int], tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.totals = tiers, totals
        self.full = [n // t for n, t in zip(totals, tiers, strict=True)]
        self.base = np.concatenate([[0], np.cumsum(self.full)]).astype(int).tolist()
        # Rests: the longest tier's first, then what the shorter ones add.
        self.rest_at, rest = [0] * len(tiers), 0
        for k in reversed(range(len(tiers))):
            self.rest_at[k] = rest
            rest += totals[k] - self.full[k] * tiers[k]
        self.rest_starts, self.rest_sizes, at = [], [], 0
        while at < rest:
            size = min(tiers[-1], 1 << (rest - at).bit_length() - 1)
            self.rest_starts.append(at)
            self.rest_sizes.append(size)
            at += size
        self.steps = max(1, -(-sum(totals) // step_tokens))

    def pieces(self, tier: int, at: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(sequence, offset in it, length, sequence length, step group) of
        the ``n`` positions from ``at`` of a tier's stream."""
        width, whole = self.tiers[tier], self.full[tier] * self.tiers[tier]
        end = at + n
        while at < min(end, whole):
            k, off = divmod(at, width)
            m = min(width - off, end - at)
            yield self.base[tier] + k, off, m, width, k * self.steps // self.full[tier]
            at += m
        while at < end:
            p = self.rest_at[tier] + at - whole
            j = int(np.searchsorted(self.rest_starts, p, side="right")) - 1
            off, size = p - self.rest_starts[j], self.rest_sizes[j]
            m = min(size - off, end - at)
            yield self.base[-1] + j, off, m, size, j % self.steps
            at += m


def pack(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    text: str = "text",
    doc_id: str = "doc_id",
) -> DataFrame:
    """One row per piece (columns: ``PIECES_DDL``; ``ids`` are little-endian
    unsigned 32-bit integers).

    A NULL or empty text is its end id alone.  Rows of one ``doc_id`` are
    packed as documents of their own; a NULL ``doc_id`` stays NULL.  An empty
    table gives no pieces.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be growing powers of two")
    width = id_width(tokenizer_path, end_id)
    placed = written(encode_ids(df, tokenizer_path, end_id, text, doc_id, tiers), "pack-ids")
    # One row per task and tier, whatever the number of documents.
    rows = placed.groupBy("task", "tier").agg(F.sum("n").alias("n")).collect()
    before: dict[tuple[int, int], int] = {}
    totals = [0] * len(tiers)
    for r in sorted(rows, key=lambda r: r["task"]):
        before[r["task"], r["tier"]] = totals[r["tier"]]
        totals[r["tier"]] += r["n"]
    layout = Layout(totals, tiers, step_tokens)
    names = [f.split()[0] for f in PIECES_DDL.split(", ")]
    schema = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for d, raw, task, t, pos in row_stream(batches, "doc_id", "ids", "task", "tier", "pos"):
            ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
            n_doc = len(ids) // 4
            start = 0
            for seq, off, m, size, step in layout.pieces(t, before[task, t] + pos, n_doc):
                out.add(4 * m, d, start, m, n_doc, seq, off, size, step, ids[4 * start : 4 * (start + m)])
                start += m
            if out.full():
                yield out.batch()
        yield out.batch()

    return placed.select("doc_id", "ids", "task", "tier", "pos").mapInArrow(cut, PIECES_DDL)
