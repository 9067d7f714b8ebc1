import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, lang_pred string, keep_id long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, near copies; extra columns with clashing names."""
    rng = random.Random(7)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    texts: list[str | None] = [
        None, "", "   ", "\n\n", " \t\r\n", "one", "One", "one two three four", "ONE two  three four", " ".join(base), " ".join(base),
        " ".join(near), " ".join(base).upper(), "line a\nLINE A \nline b\n\nline c", "line a\nline d", "line a", "ünï cödé — 日本語 text 123",
        "12345 67890", "Tie.", words(rng, 60_000, 5000), "a" * 300_000, " ".join(base[:60]), "x\x00y   z", "<|endoftext|> one <|endoftext|>",
    ]
    rows = [(i, t, ["en", "de", None][i % 3], [None, "src1", "src2", "odd"][i % 4], 0, 1.5, 2, "x", 3) for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((None, "null id text here", "en", "src1", None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
