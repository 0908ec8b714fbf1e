from __future__ import annotations

import random

import pytest

LONG = " ".join(f"word{i % 997}" for i in range(60_000)) + "."


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    text = [f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(words)]
    return " ".join(text)


def changed(text: str, every: int) -> str:
    """The text with every so many words replaced."""
    return " ".join(f"new{i}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents with NULLs, blanks, repeated rows, one very long text, and columns named like helpers."""
    texts = [
        (1, "Same line\nown line one\nÉtude naïve, straße! It's 3.14"),
        (2, "Same line\nown line two"),
        (2, "Same line\nown line two"),
        (3, None),
        (4, ""),
        (5, " \n\t \n"),
        (None, "Same line\nwithout an id"),
        (6, LONG),
        (7, "x" * 50_000),
        (8, "日本語 テキスト <|endoftext|> ok"),
        (9, "one"),
    ]
    rows = [(i, t, "en", None if i == 9 else "src0", len(t or ""), "r", 1, 0.5, "s", 2, 3, "p") for i, t in texts]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, row string, n int, rate double, "
        "site string, id int, copy int, page string"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty(hostile):
    return hostile.limit(0)
