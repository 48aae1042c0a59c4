from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, digest string, shard int, bucket string, `key` string"


def make_rows():
    """Texts with copies, near copies, repeated rows, nulls, empties, one long text, and columns whose names clash."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgéß", k=rng.randint(1, 7))) for _ in range(400)]
    texts: list = []
    for _ in range(40):
        texts.append(" ".join(rng.choices(words, k=rng.randint(1, 120))).capitalize() + ".")
    base = " ".join(rng.choices(words, k=200))
    texts += [base, base, base.upper(), "  " + base.replace(" ", "\n") + "\t"]
    for n in (1, 2, 5, 30):
        w = base.split()
        for k in rng.sample(range(len(w)), n):
            w[k] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, " \t\n", "...", "one", "a b c d", "Oneaen " * 60, ("x" * 500), " ".join(rng.choices(words, k=20_000)), "tail " + base[:300]]
    rows = [(i, t, "en", None if i % 7 == 3 else f"src{i % 5}", len(t or ""), i, 0.5, "d", 1, "b", "k") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
