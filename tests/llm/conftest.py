import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows and clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog and then runs away from the farm near the old river bank"
    long_text = " ".join(f"{base} {i}" for i in range(2000))
    rows = [
        (5, base, "en", "a", len(base)), (5, base, "en", "a", len(base)), (7, base, None, "b", None),
        (9, base + " at night", "en", None, 3), (1, None, "en", "a", None), (2, "", "en", "a", 0),
        (None, "a row without an id that has words of its own to count here", "en", "a", 1),
        (None, None, None, None, None), (11, "word", "en", "a", 4), (12, "   \n\t \n", "en", "a", 6),
        (13, long_text, "en", "a", len(long_text)), (14, "x" * 50_000, "en", "a", 50_000),
        (15, "Ünïcödé 日本語 🙂 text\x1fwith\x85odd spaces", "de", "a", 9), (5, "another text under a repeated id", "en", "a", 1),
        (16, "the the the of of and and", "en", "a", 3),
    ]
    extra = "node long, key string, component long, score double, ids string, part int, lost array<int>"
    return spark.createDataFrame([(*r, 1, "k", 2, 0.5, "i", 3, [1]) for r in rows], f"{DOCS}, {extra}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, numbered from 0."""
    return lambda texts: spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
