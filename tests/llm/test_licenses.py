"""Notices against edit distances of all substrings and a plain count of exact places."""

from __future__ import annotations

import random
import re

import pytest

from hiregrid.llm.licenses import NOTICES, Notice, NoticeFinder, find_notices, pieces_of

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
FINDER = NoticeFinder()


def least_edits(phrase: str, text: str) -> int:
    """The smallest edit distance of the phrase to any substring."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(phrase, 1):
        before, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            before, row[j] = row[j], min(before + (c != d), row[j] + 1, row[j - 1] + 1)
    return min(row)


def edited(rng: random.Random, phrase: str, n: int) -> str:
    for _ in range(n):
        at, kind, letter = rng.randrange(len(phrase)), rng.randrange(3), rng.choice("abcdxyz ")
        phrase = phrase[:at] + (letter if kind != 1 else "") + phrase[at + (kind != 0) :]
    return phrase


def plain_base(text: str | None):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_places(spark, rows, docs, clashing):
    more = ["Under the MIT License, under-the_mit license! CC BY-NC 4.0", "cc by nc " * 20_000, "thunder the mit license", "under the mit licensed", "apache license version 2.0", "Apache License, Version 21", "under the mit\tlicense é under the mit license"]
    texts = [*rows, *((1000 + i, t, None, None, None) for i, t in enumerate(more))]
    for frame in (spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long"), clashing):
        got = find_notices(frame).collect()
        want = {r["doc_id"]: r["text"] for r in frame.collect() if r["doc_id"] is not None}
        assert len(got) == frame.count()
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(want[r["doc_id"]])
                assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
                assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


@pytest.mark.parametrize("notice", [n for n in NOTICES if n.edits], ids=lambda n: f"{n.label} {n.phrase[:12]}")
def test_found_if_and_only_if_within_edits(notice):
    bare = Notice(notice.label, notice.phrase, notice.edits)
    finder, rng, found = NoticeFinder((bare,)), random.Random(notice.phrase), 0
    for i in range(36):
        around = " ".join("".join(rng.choice("abcdeilnst") for _ in range(rng.randint(1, 9))) for _ in range(3))
        text = f" {around} {' '.join(edited(rng, notice.phrase, i % (notice.edits + 4)).split())} {around} "
        matches = finder.find(text)
        assert bool(matches) == (least_edits(notice.phrase, text) <= notice.edits)
        for m in matches:
            assert m.edits <= notice.edits and least_edits(notice.phrase, text[m.start : m.end]) <= m.edits
        found += bool(matches)
    assert 15 < found < 36


def test_pieces_are_the_notice():
    for notice in NOTICES:
        cut = pieces_of(notice)
        assert "".join(p for _, p in cut) == notice.phrase and len(cut) == notice.edits + 1 and all(p for _, p in cut)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released undr the MIT licence.", "mit"), ("under the BSD license", ""), ("Licensed under the Apache License, Version 1.1", ""), ("Licenced under the Apache Licence, Version 2.0", "apache-2"),
        ("the GNU General Public Licence, version 3 or later", "gpl-3"), ("GNU Lesser General Public License version 3", "lgpl"), ("GNU General Public License version 2", "gpl-2"),
        ("Creative Commons Attribution-NonComercial 4.0", "cc-by-nc"), ("Creative Commons Attribution-ShareAlike 4.0", "cc-by-sa"), ("creative commons attribution 4.0", "cc-by"),
        ("Redistributions and use in source and binary form, with or without modification, are permitted", "bsd"), ("the limit of the mitten under the lamp", ""),
    ],
)
def test_labels_and_spans(text, labels):
    n_words, n_base, _, _, _, got, score, spans = FINDER.scan(text)
    assert got == labels and (score > 0) == bool(labels)
    for span in filter(None, spans.split(",")):
        _, a, b, edits = span.split(":")
        part = text[int(a) : int(b)]
        assert part == part.strip() and len(part) > 8 and int(edits) <= 3


def test_plain_texts_stay_unlabelled():
    rng = random.Random(4)
    words = "the under license version general public software mitigate apachean cc by commons attribution this use of source binary forms permission granted copy with without fee".split()
    assert not any(FINDER.scan(" ".join(rng.choice(words) for _ in range(400)))[5] for _ in range(60))


def test_empty(empty):
    assert find_notices(empty).count() == 0
