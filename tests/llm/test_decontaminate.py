from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from hiregrid.llm.decontaminate import contamination, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows: dict[tuple, set] = {}
    for i, text in items:
        w = words(text)
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = Counter()
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if ids := windows.get(tuple(w[j : j + k])):
                    found |= ids
                    hit |= set(range(j, j + k))
        names = sorted(str(x) for x in found if x is not None)
        out[i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)] += 1
    return out


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


def test_equal_brute_force(spark, docs, clashing, empty, rows):
    rng = random.Random(4)
    texts = [r[1] for r in rows if r[1]]
    items = [(i, " ".join(rng.choice(texts).split()[a : a + rng.randint(1, 30)])) for i, a in enumerate(rng.randint(0, 20) for _ in range(25))]
    items += [(100, None), (101, ""), (102, "..."), (None, "house river stone"), (3, items[3][1]), (200, "Ünïcode ÀÉ 東京 😀 words Ünïcode"), (201, "line one is here line one is here line one is here line")]
    bench = spark.createDataFrame(items, ITEMS)
    want = brute(rows, items)
    assert any(k[5] for k in want) and not all(k[5] for k in want)
    for source in (docs, clashing):
        assert result(contamination(source, bench)) == want
    # Blocks of a few words, one pass each, give the same.
    assert result(contamination(docs, bench, block_words=20)) == want
    assert contamination(empty, bench).count() == 0
    none = spark.createDataFrame([], ITEMS)
    assert not any(k[5] for k in result(contamination(docs, none)))
    kept = remove_contaminated(clashing, bench, block_words=20)
    assert kept.schema == clashing.schema
    clean = Counter({i: n for (i, *_, bad), n in want.items() if not bad})
    assert sum(1 for _ in kept.collect()) == sum(n for (*_, bad), n in want.items() if not bad) and clean


def test_the_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "start " + text + " end"), (2, " ".join(text.split()[:9]))], "doc_id long, text string")
    got = {r.doc_id: r.longest for r in contamination(docs, spark.createDataFrame([(1, "x " + text + " y")], ITEMS)).collect()}
    assert got == {1: 40, 2: 0}


def test_one_block_at_a_time(spark, docs, monkeypatch):
    """Three blocks or more: never two broadcast indexes alive, and one pass in the plan that is left."""
    from pyspark import SparkContext

    alive, most = [], []
    plain = SparkContext.broadcast

    def counted(self, value):
        shared = plain(self, value)
        if type(value).__name__ == "TestSuffixes":
            alive.append(shared)
            most.append(len(alive))
            destroy = shared.destroy
            shared.destroy = lambda *a: (alive.remove(shared), destroy(*a))
        return shared

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(4)], ITEMS)
    for operator in (contamination, remove_contaminated):
        out = operator(docs, bench, block_words=50)
        assert out.count() and len(most) >= 3 and set(most) == {1}
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
        alive.clear()
        most.clear()
