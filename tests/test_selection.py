"""Percentiles by selection against sorted lists."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from hiregrid.operators.selection import exact_percentiles

SHARES = {"low": ("x", 0.1), "mid": ("x", 0.5), "high": ("x", 0.9), "least": ("x", 0.0), "most": ("y", 1.0)}


def plain(values, p):
    values = sorted(v for v in values if v is not None and v == v)
    if not values:
        return None
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize(("ranges", "buffered"), [(256, 0), (4, 100), (2, 0), (256, 1 << 18)])
def test_equal_sorted_lists(spark, ranges, buffered):
    rng = random.Random(ranges)
    groups = {"hot": 3000, "two": 2, "one": 1, "ties": 400, None: 50, "none": 3}
    rows = []
    for k, n in groups.items():
        for _ in range(n):
            x = None if k == "none" else rng.choice([1.5, 2.5]) if k == "ties" else rng.choice([rng.random(), rng.random() * 1e9, -3.0, None, float("nan"), 7.0])
            rows.append((k, x, rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "k string, x double, y long").repartition(6)
    got = {r.k: r for r in exact_percentiles(df, ["k"], SHARES, ranges, buffered).collect()}
    assert set(got) == set(groups)
    for k, r in got.items():
        assert r.n_rows == groups[k]
        for name, (c, p) in SHARES.items():
            want = plain([row[1 if c == "x" else 2] for row in rows if row[0] == k], p)
            assert (r[name] is None) == (want is None) and (want is None or r[name] == pytest.approx(want, rel=1e-12, abs=1e-12))
    assert exact_percentiles(df.limit(0), ["k"], SHARES).count() == 0


def test_sketches_that_differ_each_time(spark, monkeypatch):
    """On executors the parts of a sketch arrive in any order, so another evaluation cuts elsewhere: here every evaluation moves all cuts."""

    def moved(cuts):
        by = random.SystemRandom().uniform(-200, 200)
        return [c + by for c in cuts]

    sketch, elsewhere = F.percentile_approx, F.udf(moved, "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda *a: elsewhere(sketch(*a)))
    df = spark.range(4000).select((F.col("id") % 4).alias("k"), (F.col("id") * 1.0).alias("x"), F.col("id").alias("y")).repartition(6)
    for r in exact_percentiles(df, ["k"], SHARES, ranges=16, buffered=0).collect():
        for name, (_, p) in SHARES.items():
            assert r[name] == pytest.approx(plain(range(r.k, 4000, 4), p), rel=1e-12)
