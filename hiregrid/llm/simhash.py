"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are compared once each. A bounded sample of them groups correlated bits into partitions. Whatever two
fingerprints differ in at most `radius` bits, for thresholds that sum to radius - partitions + 1 they differ in at most the
threshold in one partition at least; so every fingerprint takes its own, unequal thresholds (-1: not probed) by dynamic
programming on the candidates that the sample lets expect, and probes a partition's values within its threshold. Probes and
members meet in a bucket (partition, value), where the full distance is verified; only a spanning forest of the links
leaves a bucket. Connected components come from rounds of large and small stars over those links.

A bucket is never expanded into rows of pairs. Up to PAIRS_MOST members it is compared in blocks in numpy. Beyond, two members are
linked when they share a value at distance one or less from both, which is the same relation for radius 2 and takes
time in proportion to the bucket; beyond HELD_MOST that very step is a shuffle on the shared values, of which each has at
most 65 members. For other radii a bucket beyond HELD_MOST is dealt out in blocks, of which each two meet in one group. So no
cap drops a link.

Defined cases: a null text, an empty one or one without words has fingerprint zero, which links like any other; fewer words than
a shingle give the shingle of the whole sequence; repeated rows and ids keep a row each; a null doc_id is carried and is
smallest only if its component has no other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACE, checkpointed, flat, pieces, runs

#: Fingerprints, about, that the bits' partitions and the expected candidates are estimated from. Every fingerprint is indexed.
SAMPLE = 8192
PAIRS_MOST = 512
#: Links in a partition of a table of links.
PART_LINKS = 100_000
HELD_MOST = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_fingerprints(texts: pa.StringArray, words: int = 3, seed: int = 42) -> np.ndarray:
    """The unsigned 64-bit SimHash of each text over its lower-cased shingles, repeats included."""
    data, offsets = flat(texts)
    data, inside = _LOWER[data], NOT_SPACE[data]
    starts, ends, of = runs(inside, offsets)
    gaps = ends[ends < offsets[1:][of]]  # the white space after a word, of which one byte stays as a space
    inside[gaps] = True
    data[gaps] = 0x20
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    joined = data[inside].tobytes()
    first, last = at[starts], at[starts] + ends - starts
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    n_words = np.diff(bounds)
    n_each = np.where(n_words >= words, n_words - words + 1, n_words.clip(max=1))
    doc = np.repeat(np.arange(len(texts)), n_each)
    begin = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
    end = begin + np.minimum(words, n_words[doc]) - 1
    ones = np.zeros((len(texts), 64), np.int64)
    digest, block = xxhash.xxh64_intdigest, 1 << 17
    for i in range(0, len(doc), block):
        here = doc[i : i + block]
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first[begin[i : i + block]].tolist(), last[end[i : i + block]].tolist(), strict=True)), np.uint64, len(here))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.diff(here, prepend=-1))
        ones[here[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.bitwise_or.reduce(np.where(2 * ones > n_each[:, None], _BITS, np.uint64(0)), axis=1)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(shingle_fingerprints(piece.column("text"), words, seed).view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(each, rows.drop("text").schema.add("fp", "long"))


class Pigeonhole:
    """Partitions of the 64 bits and the candidates that a probe may expect, from a sample of fingerprints."""

    def __init__(self, sample: np.ndarray, total: int, radius: int = 2, partitions: int = 3, probe_cost: float = 4) -> None:
        self.radius, self.total, self.probe_cost = radius, total, probe_cost
        bits = ((sample[:, None] & _BITS) != 0).astype(float)
        spread = bits - bits.mean(axis=0) if len(sample) else np.zeros((1, 64))
        scale = np.sqrt((spread**2).sum(axis=0))
        scale[scale == 0] = 1
        like = np.abs(spread.T @ spread) / np.outer(scale, scale)
        left, self.parts = list(range(64)), []
        for i in range(partitions):
            own = [max(left, key=lambda b: (like[b, left].sum(), -b))]
            left.remove(own[0])
            while len(own) < -(-64 // partitions) and len(left) > sum(64 // partitions for _ in range(partitions - 1 - i)):
                own.append(max(left, key=lambda b: (like[b, own].sum(), -b)))
                left.remove(own[-1])
            self.parts.append(np.array(sorted(own)))
        self.scale = total / max(len(sample), 1)
        self.known = [np.unique(self.value(sample, p), return_counts=True) for p in self.parts]
        # Beyond one bit, the mean over a part of the sample stands for all.
        some = sample[:: max(1, len(sample) // 512)]
        self.within = []
        for p in self.parts:
            apart = np.bincount(np.bitwise_count(self.value(some, p)[:, None] ^ self.value(sample, p)).ravel(), minlength=radius + 1)[: radius + 1]
            self.within.append(np.cumsum(apart) / max(len(some) * len(sample), 1) * total)

    @staticmethod
    def value(fps: np.ndarray, part: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for i, b in enumerate(part):
            out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
        return out

    @staticmethod
    def flips(part: np.ndarray, n: int) -> list[np.uint64]:
        """Masks of a partition's value that turn exactly n bits."""
        return [np.uint64(sum(1 << i for i in some)) for some in combinations(range(len(part)), n)]

    def expected(self, fps: np.ndarray) -> np.ndarray:
        """Cost by fingerprint, partition and threshold (index 0 for -1): probes and expected candidates."""
        cost = np.zeros((len(fps), len(self.parts), self.radius + 2))
        for i, part in enumerate(self.parts):
            values, counts = self.known[i]
            own = self.value(fps, part)

            def near(x: np.ndarray, values: np.ndarray = values, counts: np.ndarray = counts) -> np.ndarray:
                if not len(values):
                    return np.zeros(len(x))
                at = np.searchsorted(values, x).clip(max=len(values) - 1)
                return np.where(values[at] == x, counts[at], 0) * self.scale

            probes, rows = 0, np.zeros(len(fps))
            for t in range(self.radius + 1):
                probes += comb(len(part), t)
                rows = rows + sum(near(own ^ m) for m in self.flips(part, t)) if t <= 1 else np.maximum(rows, self.within[i][t])
                cost[:, i, t + 1] = self.probe_cost * probes + rows
        return cost

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """The cheapest thresholds of each fingerprint whose sum is radius - partitions + 1."""
        cost, m = self.expected(fps), len(self.parts)
        goal = self.radius - m + 1 + m  # in steps above -1 for each
        best = np.full((len(fps), goal + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for i in range(m):
            now, step = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for t in range(min(self.radius + 1, goal) + 1):
                sums = best[:, : goal + 1 - t] + cost[:, i, t, None]
                lower = sums < now[:, t:]
                now[:, t:][lower], step[:, t:][lower] = sums[lower], t
            best = now
            taken.append(step)
        out, left = np.zeros((len(fps), m), np.int64), np.full(len(fps), goal)
        for i in reversed(range(m)):
            out[:, i] = taken[i][np.arange(len(fps)), left]
            left -= out[:, i]
        return out - 1

    def cost(self, fps: np.ndarray) -> float:
        """The mean cost of these fingerprints at their thresholds."""
        expected, limits = self.expected(fps), self.thresholds(fps) + 1
        return float(sum(np.take_along_axis(expected[:, i], limits[:, i, None], axis=1).sum() for i in range(len(self.parts)))) / max(len(fps), 1)

    def buckets(self, fps: np.ndarray, numbered: bool = False) -> tuple[np.ndarray, ...]:
        """Partition, value, fingerprint and role (0 member, 1 member that probes, 2 probe only) of all bucket entries; if `numbered`, also each one's place in `fps`."""
        limits, out = self.thresholds(fps), []
        for i, part in enumerate(self.parts):
            own = self.value(fps, part)
            out.append((np.full(len(fps), i, np.int32), own, fps, (limits[:, i] >= 0).astype(np.int8), np.arange(len(fps))))
            for t in range(1, self.radius + 1):
                some = np.flatnonzero(limits[:, i] >= t)
                for m in self.flips(part, t) if len(some) else ():
                    out.append((np.full(len(some), i, np.int32), own[some] ^ m, fps[some], np.full(len(some), 2, np.int8), some))
        return tuple(np.concatenate(x) for x in list(zip(*out, strict=True))[: 5 if numbered else 4])


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union in place: labels are row numbers, each at most its own; afterwards linked rows have the same root."""
    while len(a):
        ra, rb = labels[a], labels[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def bucket_links(group: np.ndarray, fps: np.ndarray, roles: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the groups (sorted), as pairs of fingerprints."""
    labels = np.arange(len(fps))
    edges = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(edges, len(group)))
    probed = np.maximum.reduceat(roles, edges) > 0 if len(edges) else np.zeros(0, bool)
    size_of = np.repeat(np.where(probed, sizes, 0), sizes)
    rows = np.flatnonzero((size_of > 1) & ((size_of <= PAIRS_MOST) | (radius != 2)))
    for k in range(1, int(size_of[rows].max(initial=1))):
        rows = rows[(rows + k < len(fps))]
        rows = rows[group[rows] == group[rows + k]]
        asked = (np.maximum(roles[rows], roles[rows + k]) > 0) & (np.minimum(roles[rows], roles[rows + k]) < 2)
        some = rows[asked]
        near = np.bitwise_count(fps[some] ^ fps[some + k]) <= radius
        join_labels(labels, some[near], some[near] + k)
    if radius == 2:
        for i in np.flatnonzero(probed & (sizes > PAIRS_MOST)):
            own = np.arange(edges[i], edges[i] + sizes[i])
            keys = np.concatenate([fps[own], *(fps[own] ^ b for b in _BITS)])
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            join_labels(labels, own[order[1:][same] % len(own)], own[order[:-1][same] % len(own)])
    linked = labels != np.arange(len(fps))
    return fps[linked], fps[labels[linked]]


def fingerprint_links(distinct: DataFrame, n: int, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of fingerprints in `distinct` (column fp) whose closure is that of all pairs within the radius."""
    deal = max(1, n // SAMPLE)
    sample = np.array([r["fp"] for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(deal)) == 0).collect()], np.int64).view(np.uint64)
    index = Pigeonhole(np.sort(sample), n, radius)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, value, fps, roles = index.buckets(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(value.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(roles)], names=["part", "value", "fp", "role"])

    def verify(batches: Iterator[pa.RecordBatch], in_blocks: bool = False) -> Iterator[pa.RecordBatch]:
        names, held, giant = ["a", "b", "hot"], None, None

        def out(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), hot))], names=names)

        def linked(x: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.any(x[:2, 1:] != x[:2, :-1], axis=0)) if x.shape[1] else np.zeros(0, np.int64)
            group = np.concatenate([np.zeros(min(1, x.shape[1]), np.int64), group])
            return out(*bucket_links(group, x[2].view(np.uint64), x[3], radius), False)

        for batch in batches:
            x = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
            if held is not None:
                x = np.concatenate([held, x], axis=1)
            if giant is not None:
                more = int(np.argmin(np.append((x[:2] == giant[:, None]).all(axis=0), False)))
                if radius == 2:
                    yield out(x[2, :more], x[2, :more], True)
                x = x[:, more:]
                giant = giant if not x.shape[1] else None
            if not x.shape[1]:
                held = None
                continue
            last = x.shape[1] - int(np.argmin(np.append((x[:2, ::-1] == x[:2, -1:]).all(axis=0), False)))
            yield linked(x[:, :last])
            held = x[:, last:]
            if held.shape[1] > HELD_MOST and not in_blocks:
                giant = held[:2, 0].copy()
                yield out(held[2], held[2], True) if radius == 2 else out(giant[:1], giant[1:], True)
                held = None
        if held is not None:
            yield linked(held)

    entered = distinct.mapInArrow(enter, "part int, value long, fp long, role byte")
    dealt = lambda rows: rows.repartition("part", "value").sortWithinPartitions("part", "value", "fp")
    found = checkpointed(dealt(entered).mapInArrow(verify, "a long, b long, hot boolean"))
    near = found.where("not hot").select("a", "b")
    if not found.where("hot").limit(1).count():
        return near
    if radius != 2:
        # Each two blocks of a bucket too large for a task meet in a group of their own.
        hot = found.where("hot").select(F.col("a").alias("p"), F.col("b").alias("v"))
        again = entered.join(hot, (F.col("part") == F.col("p")) & (F.col("value") == F.col("v"))).drop("p", "v")
        blocks = again.groupBy(F.col("part").alias("p"), F.col("value").alias("v")).agg(F.ceil(F.count(F.lit(1)) / (HELD_MOST // 4)).alias("blocks"))
        again = again.join(blocks, (F.col("part") == F.col("p")) & (F.col("value") == F.col("v"))).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
        again = again.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        again = again.select("part", F.xxhash64("value", F.least("block", "other"), F.greatest("block", "other")).alias("value"), "fp", "role")
        return near.unionByName(checkpointed(dealt(again).mapInArrow(partial(verify, in_blocks=True), "a long, b long, hot boolean")).select("a", "b"))
    # Fingerprints of buckets too large for a task: at most 65 share a value at distance one or less.
    keys = found.where("hot").select("a").distinct().select("a", F.explode(F.array(F.col("a"), *(F.col("a").bitwiseXOR(F.lit(int(b.view(np.int64)))) for b in _BITS))).alias("key"))
    shared = keys.select("a", F.min("a").over(W.partitionBy("key")).alias("b")).where("a <> b")
    return near.unionByName(shared)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every linked node, by rounds of large and small stars."""
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    mark = sign(edges)
    while mark[0]:
        # As many partitions as the links fill, whatever the session's number: each writes files of its own in every exchange.
        few = max(8, -(-mark[0] // PART_LINKS))
        edges = edges.coalesce(few)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that Spark can split the join's partition of a node with very many links.
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")).coalesce(few))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(few))
        before, mark = mark, sign(edges)
        if before == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    rows = checkpointed(fingerprints(docs, words, seed, id_col, text_col))
    own = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(fingerprint_links(own.select("fp"), own.count(), radius))
    own = own.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written first, so that the join's exchanges are its own and Spark can split the partition of a very large component.
    least = checkpointed(own.groupBy("root").agg(F.min("least").alias("component_id")))
    own = own.select(F.col("fp").alias("of"), "root").join(least, "root").select("of", "component_id")
    return rows.join(own, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those whose doc_id isn't the smallest of its component; of rows that
    share that doc_id, one stays. A component without any doc_id keeps one of its rows."""
    key = F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary"))
    named = near_duplicates(docs.select(F.struct(docs[id_col].alias("id"), key.alias("key")).alias("doc"), docs[text_col].alias("text")), words, seed, radius, "doc", "text")
    each = named.groupBy("component_id", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    first = F.min_by("doc_id", F.struct(F.col("doc_id.id").isNull(), F.col("doc_id.id"), F.col("doc_id.key")))
    kept = checkpointed(each.groupBy("component_id").agg(first.alias("doc"), F.max("copies").alias("copies")).select(F.col("doc.id").alias("_id"), F.col("doc.key").alias("_key"), "copies"))
    repeated = kept.where("copies > 1").limit(1).count() > 0  # rows repeated as a whole
    kept = kept.select("_id", "_key").distinct()
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    id_at, text_at = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    inner = inner.withColumn("_of", F.md5(F.coalesce(F.col(text_at), F.lit("")).cast("binary")))
    found = inner.join(kept, F.col(id_at).eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_key")))
    if repeated:
        found = found.dropDuplicates(["_of", id_at])
    return found.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
