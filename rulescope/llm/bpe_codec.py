"""Byte-level BPE: texts to ids by a rank file, and ids back to bytes.

A text is cut into chunks that overlap their successors.  Each chunk is
pre-tokenised by itself, starting at an arbitrary character; from the first
position that both neighbours take as the start of a pre-token, their
pre-tokens agree, so the two are stitched there (the pattern looks ahead, but
never behind).  The pieces are then encoded, each remembered while frequent.
Decoding concatenates the byte strings of the ids.

The chunks of a long document are rows of their own, dealt to tasks apart.
Each is encoded whole and reports the pre-tokens that start in the overlaps
with the number of ids before them; the stitches are found from these short
lists, and a document's ids are cut together from its chunks'.  If a
pre-token is longer than an overlap, no stitch may be found there; such a
document is put together again and pre-tokenised from its start.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulescope.llm.common import Emitter, docs_of, row_stream

#: Code points of a chunk, and by how many it reaches into the next.
CHUNK, OVERLAP = 32_768, 256
#: Pieces that a worker remembers; cleared beyond it.
MAX_PIECES = 400_000
#: How far a pre-token's match may look: an apostrophe and two letters, or
#: one character after white space.
LOOK = 4


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        ids = self[piece] = np.array(self.encode(piece), dtype="<u4").tobytes()
        return ids


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import regex
    import tiktoken

    ranks = ranks_of(path)
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return regex.compile(pattern).findall, _Pieces(enc.encode_ordinary), table


class Chunk(NamedTuple):
    """What a task knows of one chunk: the ids of all its pre-tokens, and of
    those that start in the overlap with the chunk before (``head``) or behind
    (``tail``) the position in the text and the ids before it."""

    ids: bytes
    head: list[tuple[int, int]]
    tail: list[tuple[int, int]]


def encoded_chunk(text: str, lo: int, findall, pieces, chunk: int, overlap: int) -> Chunk:
    """``text`` is the part of a document from ``lo`` on, ``chunk + overlap``
    code points or up to the document's end."""
    found = findall(text)
    ids = [pieces[p] for p in found]
    starts = accumulate(map(len, found), initial=lo)
    before = accumulate((len(i) // 4 for i in ids), initial=0)
    marks = list(zip(starts, before, strict=True))
    # Near the end of the part, a match might have gone on.
    head = [m for m in marks if m[0] <= lo + overlap - LOOK]
    tail = [m for m in marks if lo + chunk <= m[0] <= lo + chunk + overlap - LOOK]
    return Chunk(b"".join(ids), head, tail)


def stitched(chunks: list[Chunk]) -> bytes | None:
    """The ids of a document from its chunks in order; None if two neighbours
    share no start of a pre-token."""
    out, start = [], 0
    for this, after in zip(chunks, chunks[1:], strict=False):
        ahead = dict(after.head)
        seam = next(((n, ahead[s]) for s, n in this.tail if s in ahead), None)
        if seam is None:
            return None
        out.append(this.ids[4 * start : 4 * seam[0]])
        start = seam[1]
    out.append(chunks[-1].ids[4 * start :])
    return b"".join(out)


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers; NULL or
    empty text: no ids.  Rows are kept one to one, repeated ones and those
    without an id too; very long texts are encoded in chunks by several tasks;
    an empty table gives no rows.  The pattern must match every character and
    look behind nowhere."""
    if not LOOK < overlap < chunk:
        raise ValueError("an overlap is longer than a match looks ahead, and shorter than a chunk")
    docs = docs_of(df, text, doc_id)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, pieces, _ = _encoder(ranks_path, pattern)
        out = Emitter(schema)
        for d, t in row_stream(batches, "doc_id", "text"):
            raw = b"".join(map(pieces.__getitem__, findall(t)))
            out.add(len(raw), d, raw)
            if out.full():
                yield out.batch()
        yield out.batch()

    is_long = F.length("text") > chunk + overlap
    short = docs.where(~is_long).mapInArrow(run, "doc_id long, ids binary")

    # A long document is told apart by its row: ids may repeat.
    long = docs.withColumn("row", F.monotonically_increasing_id()).where(is_long)
    last = F.ceil((F.length("text") - overlap) / chunk).cast("int") - 1
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("text", i * chunk + 1, chunk + overlap))
    parts = long.select("doc_id", "row", F.posexplode(cut).alias("pos", "text")).repartition("row", "pos")
    marks = pa.list_(pa.int64())
    fields = [("doc_id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("text", pa.string()), ("ids", pa.binary())]
    pieces_schema = pa.schema([*fields, ("head", marks), ("tail", marks)])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, pieces, _ = _encoder(ranks_path, pattern)
        out = Emitter(pieces_schema)
        for d, row, pos, t in row_stream(batches, "doc_id", "row", "pos", "text"):
            c = encoded_chunk(t, pos * chunk, findall, pieces, chunk, overlap)
            flat = [[x for m in c_marks for x in m] for c_marks in (c.head, c.tail)]
            out.add(len(c.ids) + len(t), d, row, pos, t, c.ids, *flat)
            if out.full():
                yield out.batch()
        yield out.batch()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        findall, pieces, _ = _encoder(ranks_path, pattern)
        out = Emitter(schema)
        for d, rows in row_stream(batches, "doc_id", "chunks"):
            pairs = [[list(zip(r[k][::2], r[k][1::2], strict=True)) for k in ("head", "tail")] for r in rows]
            raw = stitched([Chunk(r["ids"], *p) for r, p in zip(rows, pairs, strict=True)])
            if raw is None:
                whole = "".join(r["text"][:chunk] for r in rows[:-1]) + rows[-1]["text"]
                raw = b"".join(map(pieces.__getitem__, findall(whole)))
            out.add(len(raw), d, raw)
            if out.full():
                yield out.batch()
        yield out.batch()

    encoded = parts.mapInArrow(
        chunks, "doc_id long, row long, pos int, text string, ids binary, head array<long>, tail array<long>"
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", "text", "ids", "head", "tail"))).alias("chunks")
    together = encoded.groupBy("row", "doc_id").agg(in_order).select("doc_id", "chunks")
    return short.unionByName(together.mapInArrow(joined, "doc_id long, ids binary"))


def decode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids' byte strings, concatenated; NULL ids
    or an id outside the vocabulary give a NULL."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _encoder(ranks_path, pattern)[2]
        out = Emitter(schema)
        for d, raw in row_stream(batches, "doc_id", "ids"):
            ids = None if raw is None or len(raw) % 4 else np.frombuffer(raw, "<u4")
            if ids is None or len(ids) and ids.max() >= len(table):
                out.add(0, d, raw, None)
            else:
                text = b"".join(map(table.__getitem__, ids.tolist()))
                out.add(len(raw) + len(text), d, raw, text)
            if out.full():
                yield out.batch()
        yield out.batch()

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
