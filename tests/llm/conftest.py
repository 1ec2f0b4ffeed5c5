"""Documents with every odd case: null and empty texts, null ids, ties, repeated rows, copies, very long texts."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def corpus() -> list[tuple]:
    rng = random.Random(5)
    passage = " ".join(_words(rng, 70))
    rows: list[tuple] = []
    for i in range(60):
        words = _words(rng, rng.choice([0, 1, 3, 20, 60, 150]))
        text = " ".join(words)
        if i % 4 == 0:
            text = f"{text}\n{passage}\t{' '.join(_words(rng, 5))}"
        rows.append((i * 3, text, "en" if i % 2 else "fr", "s0", len(text)))
    base = " ".join(_words(rng, 200))
    for i in range(12):  # near copies of each other
        words = base.split(" ")
        words[i * 15] = f"edit{i}"
        text = " ".join(words)
        rows.append((500 + i, text, "en", "s1", len(text)))
    rows += [(700 + i, base, "en", "s0", len(base)) for i in range(8)]  # exact copies
    long = " ".join(_words(rng, 6000))
    rows += [
        (800, long, "en", "s2", len(long)), (801, "", "en", "s2", 0), (802, None, None, None, None), (None, passage, "en", "s2", 1), (None, None, None, None, None),
        (803, "a " * 300, "en", "s2", 600), (804, "\x00\x1f  \t\r\n\x85\xa0", "de", "s2", 5), (805, "日本語 😀 İΣ ǅ <|endoftext|> a", "fr", "s2", 9),
    ]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus over several partitions."""
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
