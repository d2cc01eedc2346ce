from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hiregrid.llm.language import CrossParser, held_out, identify, suffix_automaton

SYLLABLES = {"aa": ["tha", "ing", "ou", "re", "sh"], "bb": ["sch", "ung", "ei", "ver", "ä"], "cc": ["ció", "que", "ñ", "ado", "es"]}


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def phrases(sample: bytes, data: bytes) -> int:
    """Greedy longest matches, one after the other, over the whole text."""
    n = i = 0
    while i < len(data):
        k = 1
        while i + k < len(data) and data[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_automaton_accepts_exactly_the_substrings():
    moves = suffix_automaton(b"abcbcab")

    def accepts(s: bytes) -> bool:
        state = 0
        for c in s:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    every = {b"abcbcab"[i:j] for i in range(7) for j in range(i + 1, 8)}
    assert all(map(accepts, every)) and not any(map(accepts, (b"aa", b"cc", b"abcab", b"bb")))


@pytest.mark.parametrize(("stretch", "segment"), [(256, 1 << 22), (3, 50), (1, 7), (16, 64)])
def test_phrases_equal_one_unbroken_parse(stretch, segment):
    rng = random.Random(1)
    samples = {lang: text(rng, lang, 60).encode() for lang in SYLLABLES}
    parser = CrossParser(samples, stretch, segment)
    texts = [b"", *(text(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 120)).encode() for _ in range(12)), b"", b"zz!", samples["aa"] + samples["aa"], samples["bb"][:200], b""]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [[phrases(samples[lang], t) for lang in parser.languages] for t in texts]
    assert parser.phrases(data, bounds).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 4 + 97 for x in b)), max_size=5), st.integers(1, 5), st.integers(5, 20))
def test_any_text_is_parsed_unbroken(sample, texts, stretch, segment):
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert CrossParser({"x": sample}, stretch, segment).phrases(data, bounds)[:, 0].tolist() == [phrases(sample, t) for t in texts]


def test_held_out_accuracy_and_leak(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(5, 80)), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    lang = {i: x for i, _, x in rows}
    test = [r for r in got if r.held_out]
    assert test and sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.95
    # Labels of the held-out fold don't matter.
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "aa").otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred) for r in identify(other).collect()} == {(r.doc_id, r.lang_pred) for r in got}


@pytest.mark.parametrize("tiny", ["a", "ok", "tha", "hell", "12345 678", "ée"])
def test_a_tiny_label_takes_no_predictions(spark, tiny):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, rng.randint(5, 80)), lang) for i in range(240) for lang in [rng.choice(list(SYLLABLES))]]
    one = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 3 != 1)
    many = [(one, "x " * 20, "dd")] * 3000  # rows of one id, which would fill a common sample
    got = identify(spark.createDataFrame([*rows, (one + 0, tiny, "zz"), *many], "doc_id long, text string, lang string")).where("doc_id < 240").collect()
    lang = {i: x for i, _, x in rows}
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) >= 0.97


def test_awkward_rows(docs, clashing, empty, rows):
    for source in (docs, clashing):
        got = identify(source).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        bare = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
        assert {r.doc_id for r in got if r.lang_pred == "und"} == bare
    assert identify(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}


def test_texts_without_ascii_letters():
    parser = CrossParser({"aa": b"some words here"})
    assert parser.predict(pa.array(["東京", "…", "123", None]))[0] == ["aa", "und", "und", "und"]
