import random

import pytest

WORDS = ["alpha", "Beta", "gamma.", "delta", "naïve", "日本", "x1", "the", "of", "and"]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, a clashing extra column."""
    rng = random.Random(3)
    long = " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(12_000))
    base = " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(120))
    near = base + " tail"
    rows = [(1, base, "a", 1), (2, base, "b", 2), (3, near, "a", None), (4, "", "a", 0), (5, None, None, None), (6, long, "b", 7), (None, base, None, 3), (7, "one two", "c", 5), (7, "one two", "c", 5), (8, "One  two\n\nthree", "c", 5), (9, "x" * 70_000, "d", 1), (10, "   ", "d", 1)]
    df = spark.createDataFrame([(i, t, "en", s, n, "clash") for i, t, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    return df.repartition(3)


@pytest.fixture(scope="session")
def folder(docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"
