from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """NULL, empty and very long texts, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve", "日本", "don't", "a.b@c.de", "1.2.3.4", "<|endoftext|>"]
    text = " ".join(rng.choice(words) for _ in range(120))
    near = text.replace("w1", "w2", 1)
    odd = [
        None,
        "",
        "   \n\t ",
        "one",
        "one two three four",
        "A b C d e. A b C d e. A b C d e. A b C d e.",
        text,
        text,
        near,
        text + "\n" + text,
        "\x00zero \x1c sep \x85 nel 　 wide   line",
        "x" * 5000,
        " ".join(rng.choice(words) for _ in range(30_000)),
        "same line\nsame line\nother line\nsame line",
        "mail me at a.b%c@d-e.fg.hi or +1 (555) 123-4567, 4111 1111 1111 1111 from 255.1.2.3 or 256.1.2.3",
        "\U0001f600 emoji a@b.c \U0001f600 +49 30 1234567",
    ]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(odd)]
    return rows + [rows[6]]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """With extra columns whose names clash with the operators' own."""
    rows = [(*r, 1, "x", True, b"k", 7) for r in odd_rows]
    ddl = DOCS + ", kept int, label string, base boolean, ids binary, node int"
    return spark.createDataFrame(rows, ddl).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)


@pytest.fixture(scope="session")
def real_rows(real_docs) -> list[tuple[int, str]]:
    return [(r["doc_id"], r["text"]) for r in real_docs.collect()]
