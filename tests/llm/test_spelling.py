"""Spelling variants against all pairs of words in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hiregrid.llm import spelling
from hiregrid.llm.spelling import Automaton, spelling_variants


def edits_once(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[i + (len(a) == len(b)) :] == long[i + 1 :]


def plain_counts(rows) -> dict[str, int]:
    n: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain(rows) -> set[tuple]:
    n = plain_counts(rows)
    by_size: dict[int, list[str]] = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if edits_once(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def result(frame, **more) -> set[tuple]:
    got = [tuple(r) for r in spelling_variants(frame, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(rng: random.Random, n: int):
    words = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "Àbcdef", "àbcdef"]
    return [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "7"]) for _ in range(rng.randint(0, 120))).replace("b", "B" if i % 5 == 0 else "b")) for i in range(n)]


@pytest.mark.parametrize("block", [spelling.BLOCK_WORDS, 3])
def test_equals_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 16 if block == 3 else spelling.PART_WORDS)
    rng = random.Random(block)
    rows = made(rng, 150)
    rows += [rows[0], rows[0], (None, rows[1][1]), (-1, None), (-2, ""), (-3, "x" * 30_000), (-4, "x" * 29_999 + " " + "x" * 30_000), (-5, " ".join(["x" * 30_000, "x" * 29_999, "y" * 5] * 2)), (-6, "chainx " * 3 + "chainxy " * 6 + "chainxyz " * 12 + "chainxyzw " * 24)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), block=block)
    assert got == plain(rows)
    assert sum(f is not None for _, f, *_ in got) > 5 and ("chainx", "chainxy", "chainxyzw", 3, 1, 6) in got


def test_crowded_half_is_asked_in_parts(monkeypatch):
    monkeypatch.setattr(spelling, "PART_WORDS", 40)
    rng = random.Random(1)
    words = sorted({"abcd" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(90)})
    key, blocks = ("abcd", 10, 0), 3
    for own in range(blocks):
        import pyarrow as pa

        held = [w for i, w in enumerate(words) if i % blocks == own]
        asked = held + [w for w in words if w not in held]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([key[0]] * len(asked), [10] * len(asked), [0] * len(asked), asked, [3] * len(asked), [w in held for w in asked])], names=["half", "size", "block", "text", "n", "held"])
        parts = list(spelling._parts_of(iter([batch])))
        got = sorted((a, b) for part in parts for a, b, _ in spelling._look_up(part, False))
        assert len(parts) > 1 and got == sorted((a, b) for a in words for b in held if edits_once(a, b))


def test_automaton_numbers_words_and_is_minimal():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(400)})
    automaton = Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("abcabcabc") is None
    # As many states as there are different sets of endings.
    endings = {frozenset(w[i:] for w in words if w.startswith(p)) for v in words for i in range(len(v) + 1) for p in [v[:i]]}
    assert len(automaton.moves) == len(endings)
    for exact in (0, 1, 3):
        for w in [w for w in words if len(w) >= exact][:80]:
            assert {words[k] for k in automaton.near(w, exact)} == {v for v in words if edits_once(w, v) and v[:exact] == w[:exact]}


def test_awkward_tables(docs, rows, clashing, empty):
    want = plain([(r[0], r[1]) for r in rows])
    assert want and result(docs) == want and result(clashing.withColumn("half", F.lit(1))) == want
    assert result(empty) == set()
