from __future__ import annotations

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from hiregrid.llm.quality import QualityRules, keep_good, quality_signals, signals

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #|\n\té😀", max_size=40)), max_size=6))
def test_signals_equal_brute_force(texts):
    out = signals(pa.array(texts, pa.string()), QualityRules())
    assert [tuple(int(out[n][i]) for n in NAMES) for i in range(len(texts))] == [brute(t) for t in texts]


def test_query_over_awkward_rows(docs, clashing, empty, rows):
    for source in (docs, clashing):
        got = quality_signals(source).collect()
        assert Counter((r.doc_id, *(r[n] for n in NAMES)) for r in got) == Counter((r[0], *brute(r[1])) for r in rows)
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_signals(empty).count() == 0


def test_keep_good_returns_the_rows_untouched(clashing):
    kept = keep_good(clashing)
    assert kept.schema == clashing.schema
    ids = {r.doc_id for r in quality_signals(clashing).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == ids and ids


def test_marks_equal_brute_force():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .,|#%\n") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    got = signals(pa.array(texts), QualityRules())["dup_mark_chars"]
    for text, share in zip(texts, got, strict=True):
        marks = re.findall(r"[!-/:-@\[-`{-~]+", text)
        grams = Counter(zip(marks, marks[1:], marks[2:], strict=False))
        inside = {k for i in range(len(marks) - 2) if grams[tuple(marks[i : i + 3])] > 1 for k in range(i, i + 3)}
        assert share == sum(len(marks[k]) for k in inside) / max(sum(map(len, WORD.findall(text))), 1)


def test_verdict_on_planted_texts(spark):
    good = " ".join(f"word{i} and other{i * 7}" for i in range(40))
    bad = {"loop": "again and again " * 60, "lines": "this same line stands here once more\n" * 20}
    rows = [("good", good), ("capitals", good.upper()), *bad.items()]
    got = {r.doc_id: r.kept for r in quality_signals(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"good": True, "capitals": True, **dict.fromkeys(bad, False)}


def test_marks_and_one_repeated_line_are_no_fault(spark):
    code = "\n".join(f"    value_{i} = table[{i * 7}].get('key_{i * 3}', default_{i * 5}) if flag_{i} else other_{i * 11}" for i in range(30))
    markdown = "\n".join(f"| row{i} | {i * 17} | {i * 31} | name{i * 3} | part{i * 5} | kind{i * 13} |" for i in range(30))
    short = "\n".join([" ".join(f"word{i}x{k}" for k in range(12)) for i in range(5)] + [" ".join(f"word0x{k}" for k in range(12))])
    rows = [("code", code), ("table", markdown), ("short", short), ("long", "é a ü b c d e f g h " * 200_000)]
    got = {r.doc_id: (r.kept, r.reason) for r in quality_signals(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"code": (True, None), "table": (True, None), "short": (True, None), "long": (False, "repeated_words")}


def test_planted_repetition_is_found_and_clean_text_left_alone():
    """Passages, phrases and lines that repeat over a third to a half of a text, below the base rule, against the same texts without."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: [rng.choice(words) + rng.choice([*[""] * 8, ",", "."]) for _ in range(n)]
    clean, planted = [], []
    for _ in range(400):
        lines = [prose(rng.randint(8, 20)) for _ in range(rng.randint(10, 30))]
        clean.append("\n".join(map(" ".join, lines)))
        n, kind = sum(map(len, lines)), rng.randrange(3)
        share = rng.uniform(0.35, 0.48)
        if kind == 2:  # one line again and again
            line = prose(12)
            lines += [line] * max(2, round(share * n / (1 - share) / 12))
            rng.shuffle(lines)
        else:  # a phrase, or a passage of a few lines' words, inside other lines
            phrase = prose(rng.randint(5, 9) if kind else rng.randint(20, 40))
            for _ in range(max(2, round(share * n / (1 - share) / len(phrase)))):
                at = rng.choice(lines)
                cut = rng.randint(0, len(at))
                at[cut:cut] = phrase
        planted.append("\n".join(map(" ".join, lines)))
    kept, left = (signals(pa.array(x), QualityRules()) for x in (clean, planted))
    assert kept["kept"].mean() >= 0.99
    fresh = ~left["base_failed"]
    assert fresh.sum() > 200 and (~left["kept"])[fresh].mean() >= 0.95
