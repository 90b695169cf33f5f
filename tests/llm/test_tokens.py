"""Token counts, byte-level codec, token files, packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from rulescope.llm import bpe_codec, packing, token_counts, token_files, units

P = pytest.importorskip("public_tokenizers")


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def le32(ids) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


ODD_PARTS = [" ", "  ", "\n", " \n", "\t", "　", "\x1c", "'s", "'", "a", "Σ", "ΑΣ", "İ", "É", "é", "1", "23", "!",
             "...", "the", "ing", "THE", "word.", "word,", "<|endoftext|>", "<|ENDOFTEXT|>", "日本", "\U0001f600", "ß", "▁"]


def odd_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


# --- op4 ---


def test_transducer_equals_the_library_for_any_chunking():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp, machine = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.load(path)
    rng = random.Random(3)
    for text in odd_texts(3000, 1) + [" " * n + "the" for n in range(40)] + [" " * n for n in range(40)]:
        want = len(sp.encode(text))
        size = rng.randint(1, 7)
        maps = [machine.chunk_map(text[i : i + size]) for i in range(0, len(text), size)] or [("", -1, "")]
        assert token_counts.total(token_counts.scan(maps, machine)[-1], machine) == want, text
        assert token_counts.total(machine.chunk_map(text), machine) == want if text else want == 0


def test_bounded_caches_do_not_change_counts(monkeypatch):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    monkeypatch.setattr(token_counts, "MAX_STATES", 20)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 5)
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 10)
    machine = token_counts.load.__wrapped__(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in odd_texts(200, 2):
        if text:
            assert token_counts.total(machine.chunk_map(text), machine) == len(sp.encode(text))


@pytest.mark.parametrize("chunk", [50, token_counts.CHUNK])
def test_counts_of_tables(odd_docs, odd_rows, no_docs, chunk):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(map(tuple, token_counts.count_tokens(odd_docs, path, chunk=chunk).collect()))
    want = sorted((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in odd_rows)
    assert got == want
    assert token_counts.count_tokens(no_docs, path).count() == 0


# --- op5 ---


def test_stitched_chunks_equal_the_whole_text():
    findall, pieces, _ = bpe_codec._encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)

    def by_chunks(text: str, chunk: int, overlap: int) -> bytes | None:
        n = max(1, -(-(len(text) - overlap) // chunk))
        parts = [(text[k * chunk : (k + 1) * chunk + overlap], k * chunk) for k in range(n)]
        assert "".join(t[:chunk] for t, _ in parts[:-1]) + parts[-1][0] == text
        return bpe_codec.stitched([bpe_codec.encoded_chunk(t, lo, findall, pieces, chunk, overlap) for t, lo in parts])

    rng = random.Random(4)
    lost = 0
    for _ in range(400):
        text = "".join(rng.choice(ODD_PARTS) for _ in range(rng.randint(0, 120)))
        want = b"".join(map(pieces.__getitem__, findall(text)))
        for chunk, overlap in ((9, 8), (16, 6), (40, 20), (200, 60)):
            got = by_chunks(text, chunk, overlap)
            assert got in (None, want)
            lost += got is None and overlap == 60
    assert lost == 0
    # A pre-token that is longer than the overlap leaves no place to stitch.
    assert by_chunks("a" * 300, 20, 10) is None
    assert by_chunks("word " * 300 + "a" * 50, 64, 60) == b"".join(map(pieces.__getitem__, findall("word " * 300 + "a" * 50)))


def test_chunks_of_a_long_document_are_dealt_to_tasks(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    findall, pieces, _ = bpe_codec._encoder(path, P.PATTERN)
    rng = random.Random(5)
    words = " ".join(rng.choice(["word", "naïve", "日本", "don't", "12,3", "\n\n"]) for _ in range(20_000))
    rows = [(1, words), (1, words), (None, words[:9_000]), (2, "y" * 7_000), (3, "short"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    coded = bpe_codec.encode(df, path, P.PATTERN, chunk=1000, overlap=64)
    want = [(d, b"".join(map(pieces.__getitem__, findall(t or "")))) for d, t in rows]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in coded.collect()), key=str) == sorted(want, key=str)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" in plan and "pos" in plan


def test_codec_roundtrip(odd_docs, odd_rows, no_docs):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe_codec.ranks_of(path)
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe_codec.encode(odd_docs, path, P.PATTERN, chunk=64, overlap=32)
    got = sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe_codec.decode(coded, path, P.PATTERN).collect())
    want = sorted((r[0], le32(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in odd_rows)
    assert got == want
    assert bpe_codec.encode(no_docs, path, P.PATTERN).count() == 0


def test_decode_of_bad_ids_is_null(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(le32([4_000_000]))), (3, bytearray(b"abc"))], "doc_id long, ids binary")
    rows = bpe_codec.decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [r.decoded for r in rows] == [None, None, None]


# --- units, op7 ---


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_equal_the_library(name, monkeypatch, real_rows):
    monkeypatch.setattr(units, "MAX_UNITS", 3000)
    enc, tok = units.UnitEncoder(P.path(name)), tokenizer(name)
    texts = odd_texts(4000, 6) + [t for _, t in real_rows]
    want = [le32(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = [x for i in range(0, len(texts), 100) for x in enc.many(texts[i : i + 100])]
    assert got == want


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 4), (2, 4), (7, 3), (50, 6), (200, 45)):
        counts = rng.integers(1, 10**6, n) ** 2
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and (lengths > 0).all()
        assert n == 1 or sum(2.0 ** -lengths.astype(float)) == 1.0
        if limit == 45:  # no limit in effect: as good as Huffman's own tree
            import heapq

            heap = [(int(c), i) for i, c in enumerate(counts)]
            heapq.heapify(heap)
            cost = 0
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                cost += a[0] + b[0]
                heapq.heappush(heap, (a[0] + b[0], a[1]))
            assert int((counts * lengths).sum()) == cost


def test_blocks_roundtrip():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.zipf(1.3, 5000) % 700, minlength=700)
    lengths = token_files.code_lengths(counts, token_files.MAX_BITS)
    codes, table = token_files.canonical_codes(lengths), token_files.decode_table(lengths)
    used = np.flatnonzero(counts)
    for n in (1, 2, 255, 256, 257, 5000):
        ids = rng.choice(used, n)
        payload, marks = token_files.pack(ids, codes, lengths, 256)
        assert token_files.unpack(payload, marks, n, table, 256).tolist() == ids.tolist()


def test_token_files_of_tables(odd_docs, odd_rows, no_docs):
    tok, end = tokenizer("byte_bpe_50k.json"), 2
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_files.roundtrip(odd_docs, P.path("byte_bpe_50k.json"), end).collect()]
    at, want = 0, []
    for r in sorted(odd_rows, key=lambda r: r[0]):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, end]
        want.append((r[0], at, len(ids), le32(ids)))
        at += len(ids)
    assert sorted(got) == sorted(want)
    assert token_files.roundtrip(no_docs, P.path("byte_bpe_50k.json"), end).count() == 0


# --- op9 ---


def check_packing(rows, texts, end=1, window=2048):
    tok = tokenizer("word_bpe_49k.json")
    want = sorted(le32([*tok.encode(t or "", add_special_tokens=False).ids, end]) for t in texts)
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"], r["dup"]), []).append((r["start"], bytes(r["ids"])))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["sequence_length"]))
        assert zlib.crc32(bytes(r["ids"])) >= 0 and len(r["ids"]) == 4 * r["length"]
    assert sorted(b"".join(x for _, x in sorted(v)) for v in docs.values()) == want
    for v in seqs.values():
        at = 0
        for off, n, size in sorted(v):
            assert off == at and size <= window and size & (size - 1) == 0
            at += n
        assert at == v[0][2]  # full: no padding


def test_packing(odd_docs, no_docs, odd_rows):
    rows, seen = [], {}
    for r in packing.pack(odd_docs, P.path("word_bpe_49k.json"), 1, step_tokens=4096).collect():
        key = (r.doc_id, r.start)
        seen[key] = seen.get(key, -1) + 1  # the repeated row is packed twice
        rows.append(r.asDict() | {"dup": seen[key]})
    # Pieces of the repeated row may be cut at different places; leave it out.
    twice = {r["doc_id"] for r in rows if r["dup"]}
    assert twice == {6}
    tok = tokenizer("word_bpe_49k.json")
    alone = [r for r in rows if r["doc_id"] not in twice]
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in odd_rows}
    for d in {r["doc_id"] for r in alone}:
        parts = sorted((r["start"], bytes(r["ids"])) for r in alone if r["doc_id"] == d)
        assert b"".join(x for _, x in parts) == le32(ids[d])
    assert sum(r["length"] for r in rows) == sum(len(ids[r[0]]) for r in odd_rows)
    assert packing.pack(no_docs, P.path("word_bpe_49k.json"), 1).count() == 0


def test_packing_of_real_documents(real_docs, real_rows):
    rows = [r.asDict() | {"dup": 0} for r in packing.pack(real_docs, P.path("word_bpe_49k.json"), 1).collect()]
    check_packing(rows, [t for _, t in real_rows])


def test_step_groups_are_balanced():
    layout = packing.Layout([256 * 1000 + 7, 512 * 300, 1024 * 100 + 1000, 2048 * 900 + 5], packing.TIERS, 1 << 16)
    totals = {}
    for tier, n in enumerate(layout.totals):
        for _, _, m, _, step in layout.pieces(tier, 0, n):
            totals[step] = totals.get(step, 0) + m
    assert set(totals) == set(range(layout.steps))
    assert max(totals.values()) - min(totals.values()) <= 3 * 2048
