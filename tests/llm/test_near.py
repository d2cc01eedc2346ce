from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from hiregrid.llm.near import RADIUS, _cluster_links, keep_one_similar, set_fingerprints, shingle_sets, similar_documents
from hiregrid.llm.simhash import Pigeonhole


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def roots(texts, radius=RADIUS):
    """Text to a representative of its component over all pairs of similarity 0.8 or more whose fingerprints are within the radius."""
    texts = sorted(t or "" for t in texts)
    sets = {t: shingles(t) for t in texts}
    fp = dict(zip(texts, set_fingerprints(*shingle_sets(pa.array(texts, pa.string()), 5)[:2]).tolist(), strict=True))
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or ((fp[a] ^ fp[b]).bit_count() <= radius and x and y and 5 * len(x & y) >= 4 * len(x | y)):
            root[find(a)] = find(b)
    return {t: find(t) for t in texts}


def least(rows):
    root = roots({t for _, t, *_ in rows})
    ids = {}
    for i, t, *_ in rows:
        if i is not None:
            ids[root[t]] = min(ids.get(root[t], i), i)
    return Counter((i, ids.get(root[t])) for i, t, *_ in rows)


def corpus():
    """Texts with copies of which up to 4 words in 90 differ, about the limit of 0.8, and a passage that many share."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    shared, rows = [word() for _ in range(30)], []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 120))] + shared * rng.randint(0, 1)
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text[: len(text) - rng.randint(0, 6)])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("held_most", "dense"), [(1 << 16, 64), (8, 64), (1 << 16, 1), (1 << 16, 0)])
def test_components_equal_all_pairs(spark, held_most, dense):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = least(rows)
    assert len({c for _, c in want}) > 25 and any(i != c for i, c in want)
    assert Counter((r.doc_id, r.component_id) for r in similar_documents(df, held_most=held_most, dense=dense).collect()) == want


def test_awkward_rows_and_columns(docs, clashing, empty, rows):
    for source in (docs, clashing):
        assert Counter((r.doc_id, r.component_id) for r in similar_documents(source).collect()) == least([(i, t or "") for i, t, *_ in rows])
    kept = keep_one_similar(clashing)
    assert kept.schema == clashing.schema
    root = roots({t or "" for _, t, *_ in rows})
    assert Counter(root[r.text or ""] for r in kept.collect()) == Counter(set(root.values()))
    assert similar_documents(empty).count() == 0 and keep_one_similar(empty).count() == 0


def test_the_stage_keeps_what_is_less_similar_and_drops_what_is_more(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10_000)}" for _ in range(60)]
    far, near = list(base), list(base)
    for i in (10, 20, 30):  # 15 of 56 shingles differ: 0.577
        far[i] = "other"
    near[1] = "another"  # 2 of 56: 0.931
    rows = [(1, " ".join(base), "en", "s", 1), (2, " ".join(far), "en", "s", 1), (3, " ".join(near), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2]


def test_recall_of_the_radius():
    """Edited copies of 200 to 600 words: the share whose group is found, of those that similarity alone would group."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(200, 600))]
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(1, len(base) // 60)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    size = lambda root: len(root) - len(set(root.values()))
    assert size(roots(texts)) >= 0.9 * size(roots(texts, 64)) > 0


def test_any_number_of_partitions_covers_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, (n, 40)).astype(np.uint64), axis=0) for n in (1, 3, 6, 8, 9))]))
    for m in range(4, RADIUS + 2):
        part, value, _, role, row = Pigeonhole(fps, len(fps), RADIUS, m).buckets(fps, numbered=True)
        keys = {}
        for p, v, r, i in zip(part.tolist(), value.tolist(), role.tolist(), row.tolist(), strict=True):
            keys.setdefault((p, v), []).append((r, i))
        met = {frozenset((i, j)) for own in keys.values() for r, i in own if r > 0 for q, j in own if q < 2 and i != j}
        want = {frozenset((i, j)) for i, j in combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= RADIUS}
        assert want <= met and len(want) > 100


@pytest.mark.parametrize("most_items", [1 << 20, 150])
def test_cluster_links_against_all_pairs(spark, most_items):
    """One cluster of copies at very different distances, in one block and in many."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = {" ".join(base)}
    while len(texts) < 40:
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.add(" ".join(copy))
    texts = sorted(texts)
    hashes, bounds, digests = shingle_sets(pa.array(texts), 5)
    fps, ids = set_fingerprints(hashes, bounds).view(np.int64).tolist(), digests.view(np.int64).tolist()
    rows = spark.createDataFrame([(i, f, n, i) for i, f, n in zip(ids, fps, np.diff(bounds).tolist(), strict=True)], "id long, fp long, size int, root long")
    sets = spark.createDataFrame([(i, hashes[a:b].view(np.int64).tolist()) for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True)], "id long, items array<long>")
    chain = spark.createDataFrame([(min(p), max(p)) for p in zip(ids, ids[1:], strict=False)], "a long, b long")
    found = [(r.a, r.b) for r in _cluster_links(chain, rows, sets, RADIUS, 80, most_items).collect()]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        root[find(a)] = find(b)
    text = dict(zip(ids, texts, strict=True))
    want = roots(texts)
    assert {frozenset(j for j in ids if find(j) == find(i)) for i in ids} == {frozenset(j for j in ids if want[text[j]] == want[text[i]]) for i in ids}
    assert 1 < len({find(i) for i in ids}) < len(ids)
