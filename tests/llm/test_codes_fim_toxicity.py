"""Vector codes, fill-in-the-middle texts, toxicity scores."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulescope.llm import fill_in_middle, toxicity, vector_codes

# --- op11 ---

VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, of string"


def plain_codes(rows: list[tuple], parts: int, entries: int, rounds: int, scale: int) -> tuple[list[tuple], list]:
    """(vec_id, code, error, label_error) rows and codebooks, in Python integers."""
    kept = []
    for vec_id, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(scale * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    d = len(kept[0][1]) // parts
    cut = [[r[1][p * d : p * d + d] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [nearest(c[p], book)[1] for c in cut]
            for k in range(len(book)):
                mine = [c[p] for c, o in zip(cut, of, strict=True) if o == k]
                if mine:
                    book[k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out, totals = [], {}
    for (vec_id, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(x, book) for x, book in zip(c, books, strict=True)]
        error = sum(f[0] for f in found)
        totals[label] = totals.get(label, 0) + error
        out.append((vec_id, "".join(f"{f[1]:02x}" for f in found), error, label))
    return [(i, c, e, totals[label]) for i, c, e, label in out], books


def check_codes(spark, rows, parts, entries, rounds, scale=256):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)
    codes, books = vector_codes.compress(df, parts, entries, rounds, scale)
    got = vector_codes.with_label_errors(codes).select("vec_id", "code", "error", "label_error").collect()
    want, plain_books = plain_codes(rows, parts, entries, rounds, scale)
    order = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert books.tolist() == plain_books
    flat = ",".join(str(x) for p in plain_books for e in p for x in e)
    assert vector_codes.codebooks_hash(books) == hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_codes_equal_plain_k_means(spark, rounds):
    rng = random.Random(rounds)
    centres = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.randrange(4)) for i in range(400)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    check_codes(spark, rows, 4, 16, rounds)


def test_codes_with_ties_odd_rows_and_hot_vectors(spark):
    rng = random.Random(3)
    # Few distinct components: equal distances, equal entries, equal parts.
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(200 + i, [0.5, 0.5, -1.0, 0.0], 7) for i in range(60)]
    rows += [rows[0], rows[0], (3, [1.0, 1.0, 1.0, 1.0], 2), (None, [0.0, 0.0, 0.0, 0.0], None)]
    rows += [(500, None, 1), (501, [], 1), (502, [1.0, None, 0.0, 0.0], 1), (503, [float("nan"), 0.0, 0.0, 0.0], 1)]
    rows += [(-1, [float("inf"), 0.0, 0.0, 0.0], 1)]
    for scale in (256, 3):
        check_codes(spark, rows, 2, 16, 3, scale)
    check_codes(spark, rows[:5], 4, 64, 2)  # fewer vectors than entries


def test_codes_of_many_rare_labels(spark):
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(9)) for _ in range(2)], None if i % 3 else i // 2) for i in range(3000)]
    check_codes(spark, rows, 1, 8, 1, 1)


def test_codes_of_nothing_and_of_unfit_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    codes, books = vector_codes.compress(empty)
    assert vector_codes.with_label_errors(codes).count() == 0 and books.size == 0
    for rows in ([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1.0] * 5, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compress(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS), parts=2)


def test_bounds_hold_after_every_round():
    """Every stored bound is at most the true distance of what it stands for,
    and few distances are needed once entries stand still."""
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (500, 3))
    entries = x[:40].copy()
    bounds, best = vector_codes.Bounds.fresh(x, entries, 6)
    for k in range(6):
        d = np.sqrt(vector_codes.squared(x, entries))
        assert (best == vector_codes.squared(x, entries).min(axis=1)).all()
        assert (bounds.near[:, 0] == vector_codes.squared(x, entries).argmin(axis=1)).all()
        for i in range(len(x)):
            for j in range(bounds.near.shape[1]):
                behind = np.setdiff1d(np.arange(40), bounds.near[i, : j + 1])
                assert bounds.low[i, j] <= d[i, behind].min()
        step = rng.integers(-20, 20, entries.shape) // (k + 1)
        entries = entries + step
        bounds.moved(np.sqrt((step**2).sum(axis=1)))
        bounds = bounds.resized((6, 3, 8, 8, 5, 6)[k])
        best, looked = bounds.assign(x, entries)
    _, looked = bounds.assign(x, entries)
    assert (looked == 1).mean() > 0.9


def test_kept_entries_adapt():
    assert vector_codes.adapted(8, np.array([0, 90, 5, 4, 1, 0, 0, 0, 0, 0]), 64) == 3
    assert vector_codes.adapted(8, np.array([0, 100, 0, 0, 0, 0, 0, 0, 0, 1]), 64) == 2
    assert vector_codes.adapted(8, np.array([0, 50, 0, 0, 0, 0, 0, 0, 0, 50]), 64) == 16
    assert vector_codes.adapted(24, np.array([0] * 25 + [50]), 64) == 32


# --- op12 ---


def plain_fim(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_skip_list_finds_every_rank(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(fill_in_middle, "SLICE", 7)
    for size in [*range(40), 400]:
        text = "".join(rng.choice(" \n\tabé\U0001f600\x85\x1c") for _ in range(size))
        units, found = fill_in_middle.TOKEN.findall(text), fill_in_middle.SkipList(text)
        assert found.n == len(units)
        assert [found.seek(r) for r in range(found.n + 1)] == [len("".join(units[:r])) for r in range(found.n + 1)]


def test_skip_list_of_a_long_text():
    rng = random.Random(2)
    units = [" " * rng.randrange(1, 3) + "x" * rng.randrange(1, 9) for _ in range(200_000)]
    found = fill_in_middle.SkipList("".join(units))
    ends = np.cumsum([0, *map(len, units)])
    assert found.n == len(units) and len(found.widths) >= 3
    # The lanes hold few boundaries, and each lane's links pass what the lane below passes.
    assert sum(map(len, found.widths)) < len(units) / 20
    for below, high, low in zip(found.below, found.widths[1:], found.widths, strict=False):
        assert (np.add.reduceat(low, below[:-1])[:-1] == high[:-1]).all()
    assert all(found.seek(r) == ends[r] for r in [*range(0, found.n, 1009), found.n])


def test_fill_in_middle(spark, odd_docs, odd_rows, real_docs, real_rows, no_docs):
    marked = [(10_000 + i, f"a b <{m}> c d <{m}", "en", "s", 1) for i in range(4) for m in "PSMX"]
    marked += [(20_000 + i, "< S> <S <P <M > <<S <P> "[: i % 20] + "<S <M", "en", "s", 1) for i in range(60)]
    marked = [(i, t.replace("<P>", "<p>") if i >= 20_000 else t, *r) for i, t, *r in marked]
    extra = spark.createDataFrame(marked, odd_docs.schema.simpleString()[7:-1].split(",kept")[0].replace(":", " "))
    for df, rows in ((odd_docs, odd_rows), (real_docs, real_rows), (extra, marked)):
        out = fill_in_middle.transform(df).withColumn("back", fill_in_middle.restored())
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert got == sorted(((r[0], *plain_fim(r[0], r[1] or ""), r[1] or "") for r in rows), key=str)
        assert df is extra or {r[2] for r in got} >= {"plain", "spm"}
    assert fill_in_middle.transform(no_docs).count() == 0


def test_fill_in_middle_without_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    rows = fill_in_middle.transform(df, rate=100, spm=0).orderBy("n").collect()
    assert [(r.doc_id, r.n, r.form) for r in rows] == [(None, 0, "plain"), (None, 3, "psm")]


# --- op13 ---


def test_steps_equal_the_textbook_form():
    rng = random.Random(3)
    size = 30
    mine = toxicity.Ftrl(np.zeros(size + 1), np.zeros(size + 1))
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    for _ in range(300):
        at, toxic = sorted(rng.sample(range(size), 5)), rng.random() < 0.4
        w = {}
        for i in [*at, size]:
            cut = l1 if i < size else 0.0
            w[i] = 0.0 if abs(z[i]) <= cut else -(z[i] - math.copysign(cut, z[i])) / ((b + math.sqrt(n[i])) / a + l2)
        g = 1 / (1 + math.exp(-sum(w.values()))) - toxic
        for i in w:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
            n[i] += g * g
        mine.learn(np.array(at), toxic)
    assert np.allclose(mine.z, z) and np.allclose(mine.n, n)


def test_features_are_grams_and_skip_grams():
    f = toxicity.Features(toxicity.BITS)
    words = "one two three four".split()
    # words (beginnings count for long ones), pairs, triples, and two kinds of skips
    assert len(set(f("one two three four").tolist())) == 4 + 1 + 3 + 2 + 2 + 1
    assert set(f("One, TWO").tolist()) == set(f("one two").tolist())
    assert set(f("a b").tolist()) != set(f("b a").tolist())
    assert f("").tolist() == [] == f(" ... \n").tolist()
    assert set(f(words[0]).tolist()) <= set(f(" ".join(words)).tolist())


@pytest.fixture(scope="module")
def small(spark):
    path = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_toxicity_of_held_out_documents(small):
    docs, labels = small
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    # Area under the curve, and no clean document taken.
    auc = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert auc > 0.9 and sum(r.predicted for r in held if not r.toxic) <= 0.01 * len(clean)
    assert sum(r.predicted for r in held if r.toxic) >= 0.5 * len(toxic)


def test_labels_of_held_out_documents_are_not_read(small):
    docs, labels = small
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity(docs, x).collect())) for x in (labels, changed))
    assert a == b


def test_model_does_not_depend_on_the_partitioning(small):
    docs, labels = small
    a, b = (sorted(map(tuple, toxicity.toxicity(docs.repartition(k), labels.repartition(k)).collect())) for k in (1, 7))
    assert a == b


def test_toxicity_of_odd_rows(spark, odd_docs, odd_rows, no_docs):
    labels = spark.createDataFrame(
        [(1, 0, 0, "x"), (6, 1, 1, "x"), (6, 0, 0, "x"), (None, 1, 1, "x"), (3, None, None, "x"), (999, 1, 1, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    none = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}
    assert toxicity.toxicity(no_docs, labels).count() == 0
    lost = spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")
    assert [r.held_out for r in toxicity.toxicity(lost, labels).collect()] == [False, False]


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 200)
    docs = spark.range(6000).selectExpr("id % 3000 AS doc_id", "concat('t', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    rows = toxicity._sample(docs, labels, "doc_id", "toxic").collect()
    assert 100 < len(rows) < 320 and len({r.doc_id for r in rows}) == len(rows)
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
