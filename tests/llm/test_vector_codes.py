"""Product codes against a plain Lloyd in Python's integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiregrid.llm.vector_codes import MOST, encode_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[tuple(v[p * w : (p + 1) * w]) for p in range(4)] for _, v, _ in kept]
    books = [[list(x[p]) for x in parts[:entries]] for p in range(4)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for x in parts:
                members.setdefault(best(x[p], books[p])[1], []).append(x[p])
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = [[best(x[p], books[p]) for p in range(4)] for x in parts]
    of_label = {}
    for (_, _, label), c in zip(kept, coded, strict=True):
        of_label[label] = of_label.get(label, 0) + sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(k[0]), "".join(f"{e:02x}" for _, e in c), sum(d for d, _ in c), of_label[k[2]], digest) for k, c in zip(kept, coded, strict=True))


def made(n, width, rng, centres=9):
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)], rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize(("n", "entries", "rounds"), [(300, 16, 4), (40, 256, 4), (200, 3, 1), (120, 8, 0)])
def test_equals_plain_rounds(spark, n, entries, rounds):
    rng = random.Random(n)
    rows = made(n, 8, rng)
    rows += [rows[0]] * (n // 3) + [(-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, 2), (-4, [float("inf")] * 8, None), (None, [0.5] * 8, None), (7, [0.0] * 8, 3), (-5, [], 1)]
    rng.shuffle(rows)
    got = encode_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=entries, rounds=rounds)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()) == plain(rows, entries, rounds)


def test_only_changes_are_shuffled(spark):
    from hiregrid.llm import vector_codes

    rows = made(400, 8, random.Random(3))
    seen = []
    changes = vector_codes._changes

    def counted(state, entries, width):
        seen.append(state.where(F.col("was").isNull() | (F.col("was") != F.col("now"))).count())
        return changes(state, entries, width)

    vector_codes._changes = counted
    try:
        encode_vectors(spark.createDataFrame(rows, SCHEMA), entries=8, rounds=6).collect()
    finally:
        vector_codes._changes = changes
    assert seen[0] == 400 and all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] < 100


def test_awkward_rows(spark):
    assert encode_vectors(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert encode_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1), (3, [1e30, -1e30, 0.0, 0.0, 0.0], None), (3, [1e30, -1e30, 0.0, 0.0, 0.0], None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("now", "was", "v", "error", "code", "_label", "vector")})
    got = encode_vectors(docs, entries=1).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 3, 3]
    assert all(r["error"] > 0 and 0 < r["label_error"] < 1 << 63 for r in got)


def test_large_integers_are_exact():
    rng = np.random.default_rng(1)
    x, books = rng.integers(-MOST, MOST, (50, 4, 3)), rng.integers(-MOST, MOST, (4, 7, 3))
    codes, apart = nearest(x, books)
    for i in range(50):
        for p in range(4):
            assert (apart[i, p], codes[i, p]) == min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i, p], e, strict=True)), k) for k, e in enumerate(books[p]))
