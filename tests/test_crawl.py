"""Crawls against a plain queue, chains against a plain walk."""

from __future__ import annotations

import random
from collections import deque

import pytest

from hiregrid.operators import crawl


def queue(start, links, keys, most, stop):
    """(url, place, fresh) in the order of a queue."""
    read, seen, known, idle = [start], {start}, set(keys.get(start, ())), 0
    waiting = deque()
    add = lambda page: [waiting.append(t) or seen.add(t) for t in links.get(page, ()) if t not in seen]
    add(start)
    out = [(start, 0, True)]
    while waiting and len(read) < most:
        page = waiting.popleft()
        fresh = bool(set(keys.get(page, ())) - known)
        known |= set(keys.get(page, ()))
        read.append(page)
        out.append((page, len(read) - 1, fresh))
        add(page)
        idle = 0 if fresh else idle + 1
        if idle >= stop:
            break
    return out


@pytest.mark.parametrize(("most", "stop"), [(30, 3), (6, 2), (12, 1)])
def test_crawl_equals_a_queue(spark, most, stop):
    rng = random.Random(most)
    starts, links, keys, want = [], [], [], set()
    for s in range(12):
        n = rng.randint(1, 18)
        own = {f"p{i}": [f"p{rng.randrange(n)}" for _ in range(rng.randint(0, 4))] for i in range(n)}
        jobs = {f"p{i}": [f"k{rng.randrange(6)}" for _ in range(rng.randint(0, 2))] for i in range(n)}
        starts += [(f"s{s}", "p0")] * rng.randint(1, 2)
        links += [(f"s{s}", p, t, k) for p, ts in own.items() for k, t in enumerate(ts)] + [(f"s{s}", "p0", None, 9)]
        keys += [(f"s{s}", p, k) for p, ks in jobs.items() for k in ks]
        want |= {(f"s{s}", *r) for r in queue("p0", own, jobs, most, stop)}
    frames = (spark.createDataFrame(starts, "site string, url string"), spark.createDataFrame(links, "site string, url string, target string, position int"), spark.createDataFrame(keys, "site string, url string, key string"))
    assert {tuple(r) for r in crawl.crawl(*frames, most_pages=most, empty_stop=stop).collect()} == want


def test_a_site_ends_by_pages_not_by_waves(spark):
    """Three pages without anything new end the site, though a wave behind them has new jobs."""
    links = [("s", "p0", x, k) for k, x in enumerate("abcde")] + [("s", "d", "f", 0)]
    keys = [("s", "p0", "k0"), ("s", "d", "k1"), ("s", "e", "k2"), ("s", "f", "k3"), ("s", "a", "k0")]
    got = crawl.crawl(spark.createDataFrame([("s", "p0")], "site string, url string"), spark.createDataFrame(links, "site string, url string, target string, position int"), spark.createDataFrame(keys, "site string, url string, key string"))
    assert [r.url for r in got.orderBy("place").collect()] == ["p0", "a", "b", "c"]


PAGES = "chain string, page string, next string, is_first boolean, signature string, n_rows long, total long"


def walk(pages, ids, size, most):
    """The audit of one chain, page after page."""
    by = {p[0]: p for p in pages}
    at, seen, signatures, found, told, offset, n = pages[0][0], [], set(), set(), None, 0, 0
    exhausted = repeated = looped = broken = capped = False
    while True:
        _, next_, _, signature, rows, total = by[at]
        seen.append(at)
        told = total if total is not None else told
        if rows and signature in signatures:
            repeated = True
            break
        if rows:
            signatures.add(signature)
        n, offset = n + 1, offset + rows
        found |= set(ids.get(at, ()))
        if not rows or rows < size or (told is not None and offset >= told):
            exhausted = True
            break
        if len(seen) == most:
            capped = True
        looped, broken = next_ in seen, next_ is not None and next_ not in by
        if len(seen) == most or next_ is None or next_ in seen or next_ not in by:
            break
        at = next_
    official = told if told is not None else (len(found) if exhausted else None)
    return (official is not None and exhausted and not repeated and len(found) >= official, official, len(found), n, exhausted, repeated, looped, broken, capped)


@pytest.mark.parametrize("most", [250, 6])
def test_chains_equal_a_walk(spark, most):
    rng, rows, ids, want = random.Random(most), [], [], {}
    for c in range(60):
        n, size = rng.randint(1, 14), 3
        names = [f"c{c}p{i}" for i in range(n)]
        end = rng.choice([None, None, f"c{c}p{rng.randrange(n)}", "gone"])
        own = [(p, names[i + 1] if i + 1 < n else end, i == 0, rng.choice(["same", *[f"s{i}"] * 12]), rng.choice([3] * 14 + [2, 0]), rng.choice([None] * 5 + [rng.randint(0, 40)])) for i, p in enumerate(names)]
        held = {p: [rng.randrange(60) for _ in range(r)] for p, _, _, _, r, _ in own}
        rows += [(f"c{c}", *r) for r in own] + [(f"c{c}", *own[0])]
        ids += [(f"c{c}", p, i) for p, x in held.items() for i in x] + [(f"c{c}", names[0], None)]
        want[f"c{c}"] = walk(own, held, size, most)
    got = crawl.audit_chains(spark.createDataFrame(rows, PAGES), spark.createDataFrame(ids, "chain string, page string, id long"), page_size=3, most_pages=most).collect()
    assert {r.chain: tuple(r)[1:] for r in got} == want
    assert {k for w in want.values() for k, v in zip("complete official ids n exhausted repeated looped broken capped".split(), w, strict=True) if v} >= {"complete", "exhausted", "repeated", "looped", "broken"}


def test_a_long_chain_takes_logarithmic_rounds(spark):
    rows = [("c", f"p{i}", f"p{i + 1}" if i < 199 else "p150", i == 0, f"s{i}", 5, None) for i in range(200)]
    rounds = []
    kept = crawl.checkpointed
    crawl.checkpointed = lambda df: rounds.append(1) or kept(df)
    try:
        got = {r.page: r.place for r in crawl.chain_places(spark.createDataFrame(rows, PAGES)).collect()}
    finally:
        crawl.checkpointed = kept
    assert got == {f"p{i}": i for i in range(200)} and len(rounds) <= 22


def test_totals_and_exhaustion(spark):
    """A told total is reached; without one only an empty page proves the end; a repeated page proves nothing."""
    one = [("told", "a", None, True, "x", 2, 2), ("open", "a", "b", True, "x", 2, None), ("open", "b", None, False, "", 0, None), ("again", "a", "b", True, "x", 2, None), ("again", "b", "c", False, "x", 2, None), ("left", "a", None, True, "x", 2, None)]
    ids = [(c, p, i) for c in ("told", "open", "again", "left") for p in "a" for i in (1, 2)]
    got = {r.chain: r for r in crawl.audit_chains(spark.createDataFrame(one, PAGES), spark.createDataFrame(ids, "chain string, page string, id long"), page_size=2).collect()}
    assert (got["told"].complete, got["told"].official) == (True, 2) and (got["open"].complete, got["open"].official, got["open"].exhausted) == (True, 2, True)
    assert (got["again"].complete, got["again"].repeated_page) == (False, True) and (got["left"].complete, got["left"].official, got["left"].exhausted) == (False, None, False)
