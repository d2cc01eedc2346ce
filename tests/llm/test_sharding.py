from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from hiregrid.llm.sharding import RoomTree, best_fit_decreasing, fewest_capacity, shard_documents


def plain(sizes, capacity):
    """Best fit of one item after another: the bin of each, and the bins' rooms."""
    rooms: list[int] = []
    bins = []
    for s in sizes:
        fit = [(r, i) for i, r in enumerate(rooms) if r >= s]
        at = min(fit)[1] if fit else len(rooms)
        if not fit:
            rooms.append(capacity)
        rooms[at] -= s
        bins.append(at)
    return bins, rooms


def histogram(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_runs_equal_plain_best_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, rooms = plain(sizes, 60)
    found, n = best_fit_decreasing(histogram(sizes), 60)
    assert n == len(rooms) and [b for _, low, high, b in found for _ in range(high - low)] == bins
    assert [s for s, low, high, _ in found for _ in range(high - low)] == sizes


def test_tree_holds_equal_rooms():
    tree = RoomTree()
    for b in range(5):
        tree.add(7, b)
    assert [tree.take_tightest(7) for _ in range(6)] == [(7, b) for b in range(5)] + [None]


def test_near_equal_capacity():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 10_000) for _ in range(3000)), reverse=True)
    used = Counter()
    for s, low, high, b in fewest_capacity(histogram(sizes), 8):
        used[b] += s * (high - low)
    assert len(used) == 8 and max(used.values()) - min(used.values()) < 0.001 * sum(sizes) / 8
    assert fewest_capacity([], 8) == []


def check(got, rows):
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, home = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert home.setdefault(r.text_crc32, r.shard) == r.shard and 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return Counter({s: sum(r["size"] for r in got if r.shard == s) for s in slots})


def test_awkward_rows(docs, clashing, empty, rows):
    for source in (docs, clashing):
        check(shard_documents(source).collect(), rows)
    assert shard_documents(empty).count() == 0


def test_sizes_are_near_equal_with_a_group_of_copies(spark):
    rng = random.Random(2)
    rows = [(i, "w" * rng.randint(1, 400)) for i in range(12_000)] + [(20_000 + i, "copy of one text") for i in range(3000)]
    used = check(shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)
    assert max(used.values()) <= 1.01 * min(used.values())


def test_assignment_is_that_of_plain_best_fit_over_all_groups(spark):
    """12,000 groups, most of them single documents, against one item after another."""
    rng = random.Random(3)
    texts = [f"{i:05d} " + "w" * rng.choice([3, 40, rng.randint(1, 400), rng.randint(1, 4000)]) for i in range(12_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(20_000 + i, rng.choice(texts[:50])) for i in range(2000)] + [(None, texts[0])] * 40
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    used = check(got, rows)
    size = Counter()
    for _, t in rows:
        size[t] += len(t) + 1
    sizes = sorted(size.values(), reverse=True)
    capacity = next(c for c in range(-(-sum(sizes) // 8), 2 * sum(sizes)) if len(plain(sizes, c)[1]) <= 8)
    assert max(used.values()) <= capacity + 8  # halving may stop at a capacity that isn't the very first
    bins, _ = plain(sizes, max(used.values()))
    shards = {r.text_crc32: r.shard for r in got}
    home: dict[int, list[int]] = defaultdict(list)
    for t, n in size.items():
        home[n].append(shards[zlib.crc32(t.encode())])
    want: dict[int, list[int]] = defaultdict(list)
    for n, b in zip(sizes, bins, strict=True):
        want[n].append(b)
    assert {n: sorted(x) for n, x in home.items()} == {n: sorted(x) for n, x in want.items()}
