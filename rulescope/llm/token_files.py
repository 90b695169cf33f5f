"""Token ids as files of Huffman-coded blocks, and back.

``encode_ids`` turns texts into ids; ``write_ids`` counts the ids of the whole
corpus, derives one canonical length-limited Huffman code from the counts and
writes the documents in ascending ``doc_id`` order; ``read_ids`` decodes them.

A file set is a folder with two Parquet tables written through Spark's commit
protocol, so a retried or speculative task leaves no partial file:

* ``code``: one row ``lengths binary``, the code length of every id (0: not
  used).  Canonical codes follow from the lengths alone.
* ``blocks``: one row per block of whole documents (about ``BLOCK_IDS`` ids;
  a longer document is a block of its own): ``part`` (range partition, in
  ``doc_id`` order), ``block`` (in the part), ``before`` (ids before it in
  the part), ``doc_ids`` and ``doc_lens`` (64-bit arrays), ``n_ids``,
  ``payload`` (the code bits, most significant first) and ``marks``, the bit
  offsets of every ``MARK_IDS``-th id.  Blocks decode independently, and in a
  block all stretches between marks are decoded side by side by table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulescope.llm import units
from rulescope.llm.common import Emitter, docs_of, row_stream, written_at
from rulescope.session import shared_path
from rulescope.sources.folders import discard

BLOCK_IDS = 65_536
MARK_IDS = 128
#: Longest code; 2 ** MAX_BITS is the size of the decoding table.
MAX_BITS = 18


def encode_ids(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int,
    text: str = "text",
    doc_id: str = "doc_id",
    tiers: tuple[int, ...] | None = None,
) -> DataFrame:
    """(doc_id, ids): ids of every text and ``end_id``, packed little-endian
    in 16 bits if the vocabulary fits, else in 32.  NULL or empty text: the
    end id alone.  With ``tiers`` also ``task``, ``tier`` (the first that
    holds the document, else the last), ``n`` and ``pos``, the ids of the
    same task and tier before it."""
    ddl = "doc_id long, ids binary"
    fields = [("doc_id", pa.int64()), ("ids", pa.binary())]
    if tiers is not None:
        ddl += ", task int, tier int, n long, pos long"
        fields += [("task", pa.int32()), ("tier", pa.int32()), ("n", pa.int64()), ("pos", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = units.load(tokenizer_path), Emitter(schema)
        task = TaskContext.get().partitionId()
        kind = "<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype=kind).tobytes()
        at = [0] * len(tiers or ())
        rows: list[tuple] = []
        size = 0

        def flush() -> None:
            for (d, _), ids in zip(rows, enc.many([t for _, t in rows]), strict=True):
                raw = np.frombuffer(ids, "<u4").astype(kind).tobytes() + end
                if tiers is None:
                    out.add(len(raw), d, raw)
                    continue
                n = len(ids) // 4 + 1
                tier = next((k for k, t in enumerate(tiers) if n <= t), len(tiers) - 1)
                out.add(len(raw) + 24, d, raw, task, tier, n, at[tier])
                at[tier] += n

        for row in row_stream(batches, "doc_id", "text"):
            rows.append(row)
            size += len(row[1]) + 64
            if size > 2 << 20:
                flush()
                rows, size = [], 0
                if out.full():
                    yield out.batch()
        flush()
        yield out.batch()

    return docs_of(df, text, doc_id).mapInArrow(run, ddl)


def id_width(tokenizer_path: str, end_id: int) -> int:
    return 2 if max(units.load(tokenizer_path).size, end_id + 1) <= 1 << 16 else 4


# --- the code -----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge)."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts > 0)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    level, leaf_flags = weights, []
    for _ in range(limit):
        leaf_flags.append(None)
    flags = np.ones(len(weights), dtype=bool)
    leaf_flags[0] = flags
    for i in range(1, limit):
        n = len(level) // 2
        packages = level[: 2 * n : 2] + level[1 : 2 * n : 2]
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        level, leaf_flags[i] = both[order], order < len(weights)
    need = 2 * len(weights) - 2
    for flags in reversed(leaf_flags):
        leaves = int(flags[:need].sum())
        lengths[used[:leaves]] += 1
        need = 2 * (need - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, before = 0, 0
    widths = lengths[order].astype(int)
    for width in np.unique(widths):
        code <<= int(width) - before
        ids = order[widths == width]
        codes[ids] = code + np.arange(len(ids), dtype=np.uint32)
        code, before = code + len(ids), int(width)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Next ``bits`` bits -> (id, length of its code)."""
    codes, bits = canonical_codes(lengths), int(lengths.max(initial=1))
    ids = np.zeros(1 << bits, dtype=np.uint32)
    widths = np.ones(1 << bits, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used].astype(np.int64) << (bits - lengths[used].astype(np.int64)))]
    spans = np.int64(1) << (bits - lengths[used].astype(np.int64))
    n = int(spans.sum())
    ids[:n] = np.repeat(used, spans)
    widths[:n] = np.repeat(lengths[used], spans)
    return ids, widths, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, mark_ids: int) -> tuple[bytes, bytes]:
    """(payload, bit offsets of every ``mark_ids``-th id)."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    starts = ends - width
    n_bytes = (int(ends[-1]) + 7) // 8 if len(ids) else 0
    # A code of at most 25 bits lies within four bytes from its first one.
    value = codes[ids].astype(np.uint64) << (32 - (starts & 7) - width).astype(np.uint64)
    out = np.zeros(n_bytes + 8, dtype=np.int64)
    first = starts >> 3
    for k in range(4):
        part = (value >> np.uint64(24 - 8 * k)) & np.uint64(255)
        if k == 3 and not part.any():
            break
        out += np.bincount(first + k, weights=part, minlength=n_bytes + 8)[: n_bytes + 8].astype(np.int64)
    return out[:n_bytes].astype(np.uint8).tobytes(), starts[::mark_ids].astype("<i8").tobytes()


def unpack(payload: bytes, marks: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int], mark_ids: int) -> np.ndarray:
    """The block's ids; all stretches between marks advance together."""
    ids, widths, bits = table
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.frombuffer(marks, "<i8").copy()
    out = np.zeros((len(at), mark_ids), dtype=np.uint32)
    last = len(windows) - 1
    for k in range(min(mark_ids, n)):
        word = windows[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        key = word >> np.uint32(32 - bits)
        out[:, k] = ids[key]
        at += widths[key]
    return out.reshape(-1)[:n]


# --- writing and reading --------------------------------------------------------


def id_counts(encoded: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents, summed per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        held: list[bytes] = []
        size = 0

        def add() -> None:
            nonlocal total, held, size
            one = np.bincount(np.frombuffer(b"".join(held), f"<u{width}"), minlength=len(total))
            one[: len(total)] += total
            total, held, size = one, [], 0

        for (raw,) in row_stream(batches, "ids"):
            held.append(raw)
            size += len(raw)
            if size > 4 << 20:
                add()
        add()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"]
        )

    return encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(encoded: DataFrame, path: str, width: int, block_ids: int = BLOCK_IDS, mark_ids: int = MARK_IDS) -> None:
    """Writes (doc_id, ids) in ascending ``doc_id`` order to a new folder.

    Rows of one ``doc_id`` are ordered by their ids; a NULL ``doc_id`` comes
    first.  The counts collected to the driver have at most one row per id
    of the vocabulary.
    """
    spark = encoded.sparkSession
    pairs = id_counts(encoded, width).collect()
    counts = np.zeros(max([r["id"] for r in pairs], default=0) + 1, dtype=np.int64)
    for r in pairs:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts, max(MAX_BITS, int(np.ceil(np.log2(len(counts) + 1)))))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()), mark_ids)], "lengths binary, mark_ids int").coalesce(
        1
    ).write.parquet(f"{path}/code")
    tie = F.xxhash64("ids")
    ordered = encoded.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    fields = [("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    fields += [("doc_lens", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary()), ("marks", pa.binary())]
    schema = pa.schema(fields)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), Emitter(schema)
        block, before = 0, 0
        names: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> None:
            nonlocal block, before, names, held, n
            payload, marks = pack(np.concatenate(held), codes, lengths, mark_ids)
            out.add(len(payload), part, block, before, names, [len(x) for x in held], n, payload, marks)
            block, before, names, held, n = block + 1, before + n, [], [], 0

        for d, raw in row_stream(batches, "doc_id", "ids"):
            ids = np.frombuffer(raw, f"<u{width}")
            if held and n + len(ids) > block_ids:
                close()
                if out.full():
                    yield out.batch()
            names.append(d)
            held.append(ids)
            n += len(ids)
        if held:
            close()
        yield out.batch()

    ordered.mapInArrow(
        blocks,
        "part int, block long, before long, doc_ids array<long>, doc_lens array<long>, n_ids long, payload binary, marks binary",
    ).write.parquet(f"{path}/blocks")


BLOCKS_DDL = "part int, block long, before long, doc_ids array<long>, doc_lens array<long>, n_ids long, payload binary, marks binary"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all
    documents before, ``ids`` are little-endian unsigned 32-bit integers.

    The totals joined to the blocks have one row per written part.
    """
    blocks = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/blocks")
    code = spark.read.schema("lengths binary, mark_ids int").parquet(f"{path}/code").first()
    lengths, mark_ids = np.frombuffer(bytes(code["lengths"]), np.uint8), code["mark_ids"]
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row per written part
    starts, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        starts[r["part"]] = at
        at += r["n"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, out = decode_table(lengths), Emitter(schema)
        for part, before, names, lens, n, payload, marks in row_stream(
            batches, "part", "before", "doc_ids", "doc_lens", "n_ids", "payload", "marks"
        ):
            raw = unpack(payload, marks, n, table, mark_ids).astype("<u4").tobytes()
            start, lo = starts[part] + before, 0
            for d, k in zip(names, lens, strict=True):
                out.add(4 * k, d, start, k, raw[4 * lo : 4 * (lo + k)])
                start, lo = start + k, lo + k
                if out.full():
                    yield out.batch()
        yield out.batch()

    names = ("part", "before", "doc_ids", "doc_lens", "n_ids", "payload", "marks")
    return blocks.select(*names).mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def roundtrip(df: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encodes, writes to a new folder of the shared storage, reads back."""
    path = shared_path(df.sparkSession, "token-files")
    encoded, at = written_at(encode_ids(df, tokenizer_path, end_id), "token-ids")
    write_ids(encoded, path, id_width(tokenizer_path, end_id))
    discard(df.sparkSession, at)
    return read_ids(df.sparkSession, path)
