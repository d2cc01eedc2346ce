from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hiregrid.llm import simhash
from hiregrid.llm.simhash import Pigeonhole, bucket_links, components, fingerprint_links, keep_one, near_duplicates, shingle_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    """The smallest member of each item's component."""
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(up), 2):
        if linked(a, b):
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


def near(a, b, radius=2):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= radius


def test_fingerprints_equal_brute_force(rows):
    texts = [r[1] for r in rows]
    assert shingle_fingerprints(pa.array(texts, pa.string())).tolist() == [brute(t) for t in texts]


def cloud(rng: random.Random, centres: int, around: int, most: int) -> list[int]:
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            x = c
            for _ in range(rng.randint(0, most)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("correlated", [False, True])
@pytest.mark.parametrize("radius", [2, 5])
def test_thresholds_lose_no_pair(correlated, radius):
    rng = random.Random(7)
    fps = np.array(cloud(rng, 40, 12, 3), np.uint64)
    if correlated:
        fps = fps | np.uint64(0xFFFF)
    fps = np.unique(fps)
    index = Pigeonhole(fps, len(fps), radius)
    assert sorted(int(b) for p in index.parts for b in p) == list(range(64))
    limits = index.thresholds(fps)
    assert (limits.sum(axis=1) == index.radius - len(index.parts) + 1).all() and limits.min() >= -1
    for i, j in combinations(range(len(fps)), 2):
        if near(int(fps[i]), int(fps[j]), radius):
            apart = [int(np.bitwise_count(Pigeonhole.value(fps[[i]], p) ^ Pigeonhole.value(fps[[j]], p))[0]) for p in index.parts]
            assert any(d <= t for d, t in zip(apart, limits[i], strict=True))


@pytest.mark.parametrize("most", [2, 512])
def test_bucket_links_small_and_large(monkeypatch, most):
    monkeypatch.setattr(simhash, "PAIRS_MOST", most)
    fps = np.array(cloud(random.Random(9), 6, 30, 4), np.uint64)
    group = np.zeros(len(fps), np.int64)
    a, b = bucket_links(group, fps, np.ones(len(fps), np.int64), 2)
    pairs = {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)}
    items = fps.tolist()
    assert roots(items, lambda x, y: frozenset((x, y)) in pairs) == roots(items, near)


@pytest.mark.parametrize("held", [8, 1 << 16])
def test_links_and_components_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD_MOST", held)
    fps = np.array(cloud(random.Random(11), 12, 25, 4), np.uint64)
    signed = fps.view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    for radius in (2, 5):
        links = fingerprint_links(df, len(signed), radius)
        got = {x: x for x in signed} | {r.node: r.root for r in components(links).collect()}
        assert got == roots(signed, lambda a, b, radius=radius: near(a, b, radius))


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)], "a long, b long").repartition(4)
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, 301)}


def test_near_duplicates_over_awkward_rows(docs, clashing, empty, rows):
    fps = [brute(r[1]) for r in rows]
    root = roots(set(fps), near)
    least: dict[int, int] = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = Counter((i, f"{f:016x}", least.get(root[f])) for (i, *_), f in zip(rows, fps, strict=True))
    for source in (docs, clashing):
        assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(source).collect()) == want
    assert near_duplicates(empty).count() == 0
    kept = keep_one(clashing)
    assert kept.schema == clashing.schema
    got = kept.collect()
    assert len(got) == len(set(root.values()))
    assert {root[brute(r.text)] for r in got} == set(root.values())
    named = [r for r in got if r.doc_id is not None]
    assert all(r.doc_id == least[root[brute(r.text)]] for r in named)
