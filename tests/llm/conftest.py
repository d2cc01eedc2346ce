"""Documents with the awkward cases that every operator has to take."""

from __future__ import annotations

import random

import pytest

WORDS = ["the", "of", "and", "house", "river", "stone", "light", "über", "niño", "été", "work", "paper", "glass", "cloud", "train", "garden", "winter", "music", "north", "field"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice([".", ",", ""])) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source, n_chars)"""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(3, 120)) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1], None, None, "", " ", "\n\t \x0b", "one", "one two", "Ünïcode ÀÉ 東京 😀 words " * 20, "x" * 50_000, "a b c " * 9_000, "line one is here\n" * 30, "12 + 34 = 46 $$ ## %%"]
    texts.append(" ".join(rng.choice(WORDS) + str(rng.randint(1, 9)) for _ in range(80)))
    out = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "a row without an id", None, None, None), (None, None, None, None, None)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def clashing(docs):
    """Extra columns with names that operators also use."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("kept", "n_words", "fp", "rank", "_doc", "_text", "word", "_bucket", "size", "shard", "spans", "key", "text_", "c0", "_of", "line")})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
