"""The pipeline over a small fixture with planted cases."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from rulescope.llm import quality_rules
from rulescope.llm.common import written
from tests.llm import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def planted() -> list[tuple]:
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    passage = prose(60)
    clean = [prose(rng.randint(30, 200)) for _ in range(12)]
    rows = list(clean)
    rows += [clean[0], clean[1].replace(".", " x.")]  # an exact and a near copy
    rows += [f"{prose(80)}\n{passage}\n{prose(80)}" for _ in range(3)]  # a shared passage
    rows += [f"{prose(40)} mail jo.doe@example.com or +1 (212) 555-0100 now."]
    rows += ["too short", None, "spam " * 200]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(rows)]


def test_stages_against_brute_force(spark, planted):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, ids int"
    docs = spark.createDataFrame([(*r, 3) for r in planted], ddl).repartition(3)
    held = [(r[0], r[1]) for r in planted]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, ""), "test-stage")
        got = {r.doc_id: r.text for r in out.collect()}
        assert out.columns == docs.columns
        if name == "quality":
            want = {d: quality_rules.judge(t or "")[8] for d, t in held if quality_rules.judge(t or "")[6]}
            assert want.keys().isdisjoint({d for d, t in held if t is None or brute.quality(t)[5]})
        elif name == "near_dedup":
            groups = brute.near_groups(held)
            want = {d: t for d, t in held if groups[d][2]}
            assert len(want) == len(held) - 2
        elif name == "substring_dedup":
            left = brute.without_repeats(held)
            want = {d: left[d][3].decode(errors="ignore") for d, _ in held}
            assert sum(v[1] > 0 for v in left.values()) == 2
        else:
            want = dict(held)
            for d, t in held:
                for kind, a, b in sorted(brute.pii(t), key=lambda x: -x[1]):
                    want[d] = want[d][:a] + f"[{kind.upper()}]" + want[d][b:]
            assert sum("[EMAIL]" in t for t in want.values()) == 1
        assert got == want, name
        assert all(r.n_chars == len(r.text) for r in out.collect())
        docs, held = out, sorted(got.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in held}


def test_run_over_an_empty_and_a_real_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces.columns)
    assert pieces.count() > 0
