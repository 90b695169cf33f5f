"""Near duplicates, repeated strings, suffix arrays."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rulescope.llm import anchors, near_dedup, quality_rules, substring_dedup
from rulescope.llm.components import connected_components
from rulescope.llm.shingles import shingle_set
from rulescope.llm.suffix_arrays import common_prefixes, suffix_array
from tests.llm import brute


def variants(seed: int) -> list[tuple[int, str]]:
    """Groups of near copies around the threshold, and short texts."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(3000)]
    rows = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([4, 6, 9, 30, 120, 900]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    return list(enumerate(rows))


def near(df):
    rows = near_dedup.near_duplicates(df).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows), key=lambda r: (r[0] is None, r))


def test_near_groups_of_odd_rows(odd_docs, odd_rows, no_docs):
    want = brute.near_groups([(r[0], r[1]) for r in odd_rows])
    assert near(odd_docs) == sorted((r[0], *want[r[0]]) for r in odd_rows)
    assert near(no_docs) == []


def test_near_groups_around_the_threshold(spark):
    rows = variants(1)
    got = near(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == sorted((d, *v) for d, v in brute.near_groups(rows).items())


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for d in range(60):  # one bucket family with many components
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    want = sorted((d, *v) for d, v in brute.near_groups(rows).items())
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    assert near(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_rows_without_id_take_no_part(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert near(df) == [(2, 2, 2, True), (3, 2, 2, False), (None, 2, None, True)]


def test_sketch_registers_agree_with_similarity():
    rng = np.random.default_rng(3)
    for n in (50, 500, 5000):
        both = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(both[: int(1.6 * n)]), np.sort(both[int(0.4 * n) :])
        x, y = near_dedup.sketch(a), near_dedup.sketch(b)
        filled = ((x > 0) | (y > 0)).sum()
        share = ((x == y) & (x > 0)).sum() / filled
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(share - true) < 0.15


def test_one_row_of_each_group_stays(odd_docs, odd_rows):
    kept = sorted(r.doc_id for r in near_dedup.one_of_each(odd_docs).collect())
    want = brute.near_groups([(r[0], r[1]) for r in odd_rows])
    assert kept == sorted(d for d, v in want.items() if v[2])


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 260)] + [(7, 300), (300, 5), (9, 9)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 100 for n in range(100, 161)} | {n: 200 for n in range(200, 260)} | {5: 5, 7: 5, 300: 5}
    assert got == want


def test_shingles_of_few_words():
    assert len(shingle_set("")) == len(shingle_set(" \n")) == 0
    assert len(shingle_set("a b")) == 1 and shingle_set("A b").tolist() == shingle_set("a  B").tolist()
    assert len(shingle_set("a b c d e f")) == 2


# --- suffix arrays ---


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(0)
    for _ in range(150):
        alphabet = rng.choice([b"\x00a", b"ab", b"abcd", bytes(range(256))])
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
        parts += rng.choices(parts, k=rng.randint(0, 4))
        text = b"".join(parts)
        raw = np.frombuffer(text, np.uint8)
        order, rank = suffix_array(raw)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want and rank[order].tolist() == list(range(len(text)))
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        shared = common_prefixes(raw, order, rank, starts, 20).tolist()
        for k in range(1, len(want)):
            a, b = text[want[k - 1] :][:20], text[want[k] :][:20]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == n


def test_equal_windows_lie_in_stretches_of_one_class():
    rng = random.Random(1)
    piece = "".join(rng.choice("abc ") for _ in range(130)).encode()
    texts = [bytes(rng.choice(b"xyz ") for _ in range(rng.randint(0, 200))) + piece for _ in range(3)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    cls, _, at, n = anchors.stretches(anchors.Hasher(), raw, starts)
    place = {int(a) + k: int(c) for c, a, m in zip(cls, at, n, strict=True) for k in range(m)}
    assert len(place) == sum(max(0, len(t) - 99) for t in texts)
    for off in range(31):
        same = {place[int(s) + len(t) - 130 + off] for s, t in zip(starts, texts, strict=True)}
        assert len(same) == 1


def test_merging_sorted_lists_keeps_the_earliest():
    w = [np.array(x, dtype="S3") for x in (["a", "c"], ["a", "b"], ["b", "c"])]
    lists = [(w[0], np.array([5, 5]), np.array([0, 1])), (w[1], np.array([2, 9]), np.array([0, 0])), (w[2], np.array([1, 5]), np.array([4, 2]))]
    lost = [(int(d), int(a)) for x in substring_dedup.merge_sorted(lists) for d, a in zip(*x, strict=True)]
    assert sorted(lost) == [(5, 0), (5, 2), (9, 0)]


def removed(df):
    rows = substring_dedup.remove_repeats(df).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in rows)


def repeats(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(90, 400))) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = ["".join(rng.choice("ijklmnop ü") for _ in range(rng.randint(0, 150)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 40) : len(p) - rng.randint(0, 40)])
        rows.append((d, "".join(parts)))
    return [*rows, (60, "z" * 700), (61, "y" * 99 + "z" * 150), (62, "ab" * 300)]


def test_repeats_of_odd_rows(odd_docs, odd_rows, no_docs):
    want = brute.without_repeats(sorted({(r[0], r[1] or "") for r in odd_rows}))
    assert removed(odd_docs) == sorted((r[0], *want[r[0]]) for r in odd_rows)
    assert removed(no_docs) == []


def test_repeats_with_spread_classes(spark, monkeypatch):
    rows = repeats(3)
    want = sorted((d, *v) for d, v in brute.without_repeats(rows).items())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert removed(df) == want
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 600)
    assert removed(df) == want


def near_equal_stretches(n: int, seed: int = 6) -> list[bytes]:
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh ") for _ in range(260)).encode()
    out = []
    for _ in range(n):
        x = bytearray(base)
        x[rng.randrange(260)] = rng.randrange(256)
        out.append(bytes(x[rng.randrange(30) :]))
    return out


def test_a_shard_takes_little_memory():
    texts = [t for seed in range(40) for t in near_equal_stretches(100, seed)]
    alike = near_equal_stretches(4000)
    doc, at, cls = np.arange(4000), np.zeros(4000, np.int32), np.repeat(np.arange(40), 100)
    shard = pa.table({"shard": np.zeros(4000, np.int64), "cls": cls, "doc_id": doc, "at": at, "bytes": texts})
    found = list(substring_dedup.shard_repeats(shard))  # loads what pyarrow loads late
    tracemalloc.start()
    try:
        substring_dedup.repeats_in(alike, doc, at.astype(np.int64))
        one_class = tracemalloc.get_traced_memory()[1] / sum(map(len, alike))
        tracemalloc.reset_peak()
        list(substring_dedup.shard_repeats(shard))
        classes = tracemalloc.get_traced_memory()[1] / sum(map(len, texts))
    finally:
        tracemalloc.stop()
    assert one_class < 50 and classes < 25  # bytes of memory for one of text; the first was 107
    # In batches or all at once, the same windows repeat.
    covered = {(d, a + k) for b in found for _, _, d, a, n, _ in zip(*b.to_pydict().values(), strict=True) for k in range(n)}
    want = set()
    for c in range(40):
        i = np.flatnonzero(cls == c)
        own, offset, again, _ = substring_dedup.repeats_in([texts[k] for k in i], doc[i], at[i].astype(np.int64))
        want |= set(zip(doc[i][own[again]].tolist(), offset[again].tolist(), strict=True))
    assert covered == want


def test_batches_hold_whole_classes(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH_BYTES", 10)
    cls, sizes = np.array([1, 1, 2, 3, 3, 3, 4, 5, 5]), np.array([4, 4, 2, 9, 9, 9, 1, 5, 4])
    assert list(substring_dedup.class_batches(cls, sizes)) == [(0, 3), (3, 6), (6, 9)]
    assert list(substring_dedup.class_batches(cls[:0], sizes[:0])) == []


def test_firsts_of_a_spread_class_leave_in_batches():
    texts = near_equal_stretches(150)
    doc, at = np.arange(len(texts)), np.zeros(len(texts), np.int32)
    shard = pa.table({"shard": np.full(len(texts), -1), "cls": np.ones(len(texts), np.int64), "doc_id": doc, "at": at, "bytes": texts})
    found = list(substring_dedup.shard_repeats(shard))
    reps = [b for b in found if b.num_rows and b["kind"][0].as_py() == substring_dedup.REP]
    windows = [w for b in reps for w in b["window"].to_pylist()]
    assert set(windows) == {t[k : k + 100] for t in texts for k in range(len(t) - 99)} and len(set(windows)) == len(windows)
    assert max(b.nbytes for b in found) < 4 << 20


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    rows = repeats(4)
    long = [(100, "".join(t for _, t in rows)), (101, "q" + "".join(t for _, t in rows)[37:])]
    monkeypatch.setattr(anchors, "BUFFER", 1 << 12)
    monkeypatch.setattr(anchors, "_POS", np.uint64((1 << 12) - 1))
    monkeypatch.setattr(substring_dedup, "BUFFER", 1 << 12)
    monkeypatch.setattr(substring_dedup, "MERGE_ROWS", 50)
    hasher = anchors.Hasher()
    # In this process: the pieces of one text cover all its windows once.
    raw = long[0][1].encode()
    seen = []
    for lo in range(0, len(raw) - 99, (1 << 12) - 99):
        piece = np.frombuffer(raw[lo : lo + (1 << 12)], np.uint8)
        _, _, at, n = anchors.stretches(hasher, piece, np.zeros(1, np.int64))
        seen += [lo + int(a) + k for a, m in zip(at, n, strict=True) for k in range(m)]
    assert sorted(seen) == list(range(len(raw) - 99))


def test_rows_without_id_are_left_whole(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.remove_repeats(df).collect()) == [
        ("1", 0), ("2", 300), ("None", 0),
    ]


def test_stripped_keeps_columns_and_whole_characters(spark):
    rng = random.Random(6)
    shared = "é" + "".join(rng.choice("abcdé") for _ in range(200))
    rows = [(1, shared, "fr", 9, 201), (2, "own words here ü" + shared, "fr", 9, 217), (3, shared, "fr", 9, 201), (4, None, "fr", 9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, ranges int, n_chars long")
    out = {r.doc_id: r for r in substring_dedup.stripped(df).collect()}
    assert substring_dedup.stripped(df).columns == df.columns
    assert set(out) == {1, 2, 4} and out[1].text == shared and out[2].text == "own words here ü"
    assert out[2].n_chars == len(out[2].text) and out[4].text is None and out[4].n_chars is None


def test_stages_with_columns_of_any_name(spark):
    """Extra columns may be called like the stages' own ones, hold maps, and
    have points in their names; the row that stays of a repeated id is fixed."""
    names = ["__doc", "__ranges", "_id0", "_cuts0", "_lines0", "row", "ranges", "recurring", "kept", "new", "a.b", "spans", "label"]
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text + " end"), (2, text + " end"), (3, None), (4, ""), (5, "other " * 12), (1, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("k"), F.col("text")))
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(n), F.col("text")))
    runs = [sorted(near_dedup.one_of_each(df.repartition(k)).drop("m").collect(), key=str) for k in (1, 5)]
    assert runs[0] == runs[1] and [r.doc_id for r in runs[0] if r.doc_id] == [1, 3, 4, 5]
    assert [r.text for r in runs[0] if r.doc_id == 1] == [text]
    for stage in (near_dedup.one_of_each, substring_dedup.stripped, quality_rules.cleaned):
        out = stage(df)
        assert out.columns == df.columns and out.dtypes == df.dtypes
        assert all(r["a.b"] == (None if r.text is None else "a.b" + r.text) for r in out.collect() if stage is near_dedup.one_of_each)
        assert stage(df.limit(0)).count() == 0
