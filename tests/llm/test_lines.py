from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import pairwise

from hiregrid.llm.lines import STRETCHES, LineRules, drop_recurring_lines

RULES = LineRules()
DOCS = "doc_id long, text string, n_chars long"


def tokens_of(line: str) -> tuple[str, ...] | None:
    """The normal form, as tokens; none for a line without a constant one."""
    if any(x in line for x in ("  ", "\t", "\r", "\x0b", "\f")):
        line = re.sub(r"[ \t\r\x0B\f]+", " ", line)
    found = tuple("<*>" if re.search("[0-9]", t) else t for t in line.strip(" ").split(" "))
    return found if any(t.replace("<*>", "") for t in found) else None


def cuts(n: int) -> list[int]:
    return [RULES.leading + (n - RULES.leading) * j // STRETCHES for j in range(STRETCHES + 1)]


def brute(rows):
    """Texts after dedup, in row order."""
    texts = {t for _, t, *_ in rows if t is not None}
    lines = {t: {k for x in t.split("\n") if (k := tokens_of(x))} for t in texts}
    # Stretches are counted by rows, all else by distinct texts.
    often = Counter()
    parts = lambda x: [(len(x), x[:2], j, x[a:b]) for j, (a, b) in enumerate(pairwise(cuts(len(x)))) if b > a] if len(x) > 3 else []
    for _, t, *_ in rows:
        for x in lines.get(t, ()):
            often.update(p for p in parts(x) if len(x) > RULES.leading + 1)
    shares = lambda x: any(often[p] >= RULES.min_docs for p in parts(x))
    tokens = lambda x: [(len(x), x[:2], j, t) for j, t in enumerate(x)][RULES.leading :]
    times = Counter()
    for _, t, *_ in rows:
        times.update(k for x in lines.get(t, ()) if shares(x) for k in tokens(x))
    general = {}
    for x in filter(shares, set().union(*lines.values()) if lines else ()):
        needed = max(math.ceil((RULES.min_constant_short if len(x) < RULES.short else RULES.min_constant) * len(x)) - RULES.leading + sum("<*>" in t for t in x), 1)
        found = [k for k in tokens(x) if times[k] >= RULES.min_docs]
        if len(found) >= needed:
            support = sorted((times[k] for k in found), reverse=True)[needed - 1]
            general[x] = ("general", tuple(k for k in found if 2 * times[k] >= support))
    seen = Counter(k for own in lines.values() for k in {*own, *(general[x] for x in own if x in general)})
    keys = lambda x: {k for k in (x, general.get(x)) if k and seen[k] > 1}
    votes, size = Counter(), {}
    for own in lines.values():
        total = sum(map(len, own))
        if own and total - sum(len(x) for x in own if keys(x)) >= RULES.min_own * total:
            votes.update({k for x in own for k in keys(x)})
        size.update({k: len(x) for x in own for k in keys(x)})
    gone = {k for k, n in votes.items() if n >= (RULES.min_docs_short if k[0] == "general" and isinstance(k[1], tuple) and size[k] < RULES.short else RULES.min_docs)}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not ((k := tokens_of(x)) and keys(k) & gone))) for i, t, *_ in rows]


def corpus() -> list[tuple]:
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    body = lambda: [" ".join(word() for _ in range(rng.randint(4, 25))) for _ in range(rng.randint(3, 8))]
    rows = []
    for i in range(60):
        lines = body()
        if i % 3 == 0:
            lines.insert(rng.randint(0, 3), "This work is licensed under version 3 of it.")
        if i % 4 == 0:
            lines.append(f"Posted on 2024-0{i % 9 + 1}-11 at {i}:00 by the staff")
        if i % 5 == 0:
            lines.insert(0, f"You can read more of this in the archive of {word()} {word()} {word()}")
        rows.append((i, "\n".join(lines)))
        if i % 4 == 1:  # two variable fields, in a line of more than fifty tokens
            lines.append(" ".join(["by" if k % 5 else "the" for k in range(20)] + [word()] + [f"w{'abcdefghij'[k % 10]}" for k in range(30)] + [word()] + ["end"] * 9))
        rows.append((400 + i, "\n".join([*body(), "Read more"][: 9 if i % 2 else -1])))
    # A short body with a long passage that many share.
    passage = " ".join(word() for _ in range(70))
    rows += [(500 + i, " ".join(word() for _ in range(30)) + "\n" + " ".join(word() for _ in range(30)) + "\n" + passage) for i in range(12)]
    # A document's own numbered lines, and rows of numbers.
    rows += [(600, "\n".join([f"Chapter {k} begins here" for k in range(9)] + body()))] + [(610 + i, "\n".join([*body(), "12 13 14 15", "7 8"])) for i in range(6)]
    copy = "\n".join(body())
    rows += [(100 + i, copy if i % 2 else copy + "\n" + word() + " and more") for i in range(30)]
    edited = [[word() for _ in range(20)] for _ in range(6)]
    for i in range(8):
        lines = [list(x) for x in edited]
        for x in lines:
            x[rng.randint(6, 9)] = word()
        rows.append((300 + i, "\n".join(map(" ".join, lines))))
    rows += [(200, None), (201, ""), (202, " \t\n\n"), (203, "To."), (204, "This work is licensed under version 4 of it."), (None, "no id\nThis work is licensed under version 3 of it."), (0, rows[0][1]), (205, "x " * 40_000), (206, "a  b\tc d\nYou can  read more of this\tin the archive of q w e")]
    return [(i, t, len(t or "")) for i, t in rows]


def passage_of(rows):
    return next(t for i, t, *_ in rows if i == 500).split("\n")[2]


def test_equal_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = drop_recurring_lines(df, count_col="n_dropped", length_col="n_chars").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert {r.n_dropped for r in got} >= {0, 1, 2}
    left = "\n".join(r.text or "" for r in got)
    assert "licensed" not in left and "Posted on" not in left and "in the archive" not in left and passage_of(rows) not in left
    assert "end end" not in left and "Read more" not in left
    assert left.count("Chapter") == 9 and left.count("12 13 14 15") == 6
    # A group of copies keeps its text.
    assert all(r.n_dropped == 0 for r in got if r.doc_id is not None and (100 <= r.doc_id < 130 or 300 <= r.doc_id < 308))


def test_awkward_rows_and_columns(docs, clashing, empty, rows):
    out = drop_recurring_lines(clashing)
    assert out.columns == clashing.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows)
    assert Counter((r.doc_id, r.text) for r in drop_recurring_lines(docs).collect()) == Counter(brute(rows))
    assert drop_recurring_lines(empty).count() == 0


def test_main_path_has_no_python(docs):
    plan = drop_recurring_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_variable_tokens_anywhere(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows, made = [], []
    for size in (20, 32, 64, 120, 200):
        for variable in range(1, 11):
            if variable > 0.4 * size:
                continue
            line = [word() for _ in range(size)]
            places = [2 + (size - 2) * (k + 1) // (variable + 1) - 1 for k in range(variable)]
            names = [word() for _ in range(8)]
            for i in range(40):
                for k in places:
                    # A few names in one field: each recurs, and yet is variable.
                    line[k] = rng.choice(names) if k == places[0] else word()
                made.append(" ".join(line))
                own = "\n".join(" ".join(word() for _ in range(30)) for _ in range(3))
                rows.append((len(rows), f"{own}\n{made[-1]}", 0))
    got = drop_recurring_lines(spark.createDataFrame(rows, DOCS).repartition(4), count_col="n_dropped").collect()
    assert len(got) == len(rows)
    missed = [r.doc_id // 40 for r in got if made[r.doc_id] in r.text]
    assert not missed
    assert all(len(r.text.split("\n")) == 3 for r in got)
