"""Near-duplicates by SimHash candidates and exact word-shingle similarity.

A text is the set of its distinct shingles, as 64-bit hashes, and has a SimHash over that set. The generalised pigeonhole index of
`simhash` brings fingerprints within `radius` bits together; its number of partitions is the one that costs least for as many fingerprints as
there are, so buckets don't grow in step with the corpus. Each candidate pair is verified on the whole sets: it links if the Jaccard
similarity is at least `percent`. Components of the links are the groups.

A bucket is never expanded into rows of all its pairs. First every set is tried against the smallest candidate of its bucket only. Then, of those
with more candidates, the pairs that aren't connected yet are tried, all of them: a set with at most DENSE candidates in a bucket pair by pair;
sets that all have more come together once, as a cluster, and are compared there, where only the links leave the task. Whole sets are never
stored: they are made again from the texts for those that have a candidate, which a filter of fixed size finds before the shuffle. A bucket of
more than `held_most` rows, and a cluster of more than DENSE_ITEMS shingles, is dealt out in blocks, of which each two meet in one group. So no
cap drops a pair within the radius.

What the method can lose are pairs of similar sets whose fingerprints differ in more bits; tests and the README give the share.

Defined cases: a null text, an empty one or one without words has the empty set, and equal sets always link; fewer words than a
shingle give the shingle of the whole sequence; repeated rows and ids keep a row each; a null doc_id is carried and is smallest
only if its component has no other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, RollingHash, among, checkpointed, flat, masks, mixed, pieces, runs
from .simhash import _BITS, _LOWER, SAMPLE, Pigeonhole, components, join_labels

#: Bits in which the fingerprints of a candidate pair may differ.
RADIUS = 12
#: Rows of a bucket that one group may have.
HELD_MOST = 1 << 16
#: Candidates in a bucket beyond which a set isn't tried pair by pair, and shingles in a block of what is compared instead.
DENSE, DENSE_ITEMS = 16, 1 << 20
#: Cost of a probe, a row that is shuffled and sorted, in comparisons of two fingerprints in numpy.
PROBE_COST = 1500
#: Costs that count as equal: so much of the least.
NEARLY = 1.15
PAIR, MANY, CLUSTER, HOT = range(4)


def shingle_sets(texts: pa.StringArray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct lower-cased shingles: hashes of all texts, bounds by text, and a digest of each set."""
    data, offsets = flat(texts)
    data, inside = _LOWER[data], NOT_SPACE[data]
    starts, ends, of = runs(inside, offsets)
    inside[ends[ends < offsets[1:][of]]] = True
    data[~NOT_SPACE[data]] = 0x20
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=at[1:])
    first, last = at[starts], at[starts] + ends - starts
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    n_words = np.diff(bounds)
    n_each = np.where(n_words >= words, n_words - words + 1, n_words.clip(max=1))
    doc = np.repeat(np.arange(len(texts)), n_each)
    begin = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
    end = begin + np.minimum(words, n_words[doc]) - 1
    hashes = RollingHash(data[inside])(first[begin], last[end])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[new], hashes[new]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes), dtype=np.uint64, out=total[1:])
    return hashes, bounds, mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def set_fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each set: a bit is 1 if set in over half of the hashes."""
    n = np.diff(bounds)
    ones = np.zeros((len(n), 64), np.int64)
    doc, block = np.repeat(np.arange(len(n)), n), 1 << 17
    for i in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[i : i + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = doc[i : i + block]
        edge = np.flatnonzero(np.diff(here, prepend=-1))
        ones[here[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.bitwise_or.reduce(np.where(2 * ones > n[:, None], _BITS, np.uint64(0)), axis=1)


def _sets(rows: DataFrame, words: int, items: bool) -> DataFrame:
    """doc_id, id (the set's digest), size, and fp (fingerprint) or items (the set) of every row of doc_id and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                hashes, bounds, digests = shingle_sets(piece.column("text"), words)
                if items:
                    last = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                else:
                    last = pa.array(set_fingerprints(hashes, bounds).view(np.int64))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(digests.view(np.int64)), pa.array(np.diff(bounds), pa.int32()), last], names=["doc_id", "id", "size", "items" if items else "fp"])

    last = T.StructField("items", T.ArrayType(T.LongType())) if items else T.StructField("fp", T.LongType())
    return rows.mapInArrow(each, rows.drop("text").schema.add("id", "long").add("size", T.IntegerType()).add(last))


def _near(fps: np.ndarray, role: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of a bucket's rows within the radius: each has a member in it, and one that probes. Some four million comparisons at a time."""
    members = np.flatnonzero(role < 2)
    step = max(1, (1 << 22) // max(len(fps), 1))
    for k in range(0, len(members), step):
        own = members[k : k + step]
        i, j = np.nonzero((np.bitwise_count(fps[own][:, None] ^ fps) <= radius) & ((role[own] > 0)[:, None] | (role > 0)))
        i = own[i]
        once = (i != j) & ((role[j] == 2) | (i < j))
        i, j = i[once], j[once]
        yield np.minimum(i, j), np.maximum(i, j)


def bucket_pairs(x: np.ndarray, radius: int, every: bool, dense: int = DENSE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What the buckets give: kind and two columns of ids. Rows of x, sorted by the first two: item (bucket), id, fp, role, root.

    `every` gives all pairs of different roots, but those between two ids with more than `dense` such candidates: of these each comes with
    one of its cluster. Otherwise each id is paired with the smallest id within the radius only, and all of those that may have more are marked.
    """
    item, ids, fps, role, root = x
    fps = fps.view(np.uint64)
    edges = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    if not len(edges):
        return
    ends = np.append(edges[1:], len(item))
    worth = (ends - edges > 1) & (np.minimum.reduceat(role, edges) < 2) & (np.maximum.reduceat(role, edges) > 0)
    if every:
        worth &= np.maximum.reduceat(root, edges) != np.minimum.reduceat(root, edges)
    for low, high in zip(edges[worth].tolist(), ends[worth].tolist(), strict=True):
        own, n = ids[low:high], high - low
        roots = root[low:high]

        def near(low: int = low, high: int = high, own: np.ndarray = own, roots: np.ndarray = roots) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in _near(fps[low:high], role[low:high], radius):
                apart = (roots[i] != roots[j]) if every else (own[i] != own[j])
                yield i[apart], j[apart]

        degree, least, some = np.zeros(n, np.int64), np.arange(n), np.arange(n)
        for i, j in near():
            if len(i):
                degree += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
                np.minimum.at(least, j, i)
                some[i], some[j] = j, i
        if not degree.any():
            continue
        if not every:
            paired = np.flatnonzero(least < np.arange(n))
            yield PAIR, own[paired], own[least[paired]]
            many = own[(degree > 1) | ((degree == 1) & (degree[some] > 1))]
            yield MANY, many, many
            continue
        crowded, labels = degree > dense, np.arange(n)
        for i, j in near():
            both = crowded[i] & crowded[j]
            yield PAIR, own[i[~both]], own[j[~both]]
            join_labels(labels, i[both], j[both])
        joined = np.flatnonzero(labels < np.arange(n))
        yield CLUSTER, own[joined], own[labels[joined]]


def _candidates(nodes: DataFrame, index: Pigeonhole, every: bool, held_most: int, dense: int = DENSE) -> DataFrame:
    """Distinct kind, a <= b of what `bucket_pairs` gives over all buckets. `nodes` has id, fp, root."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, root = (c.to_numpy() for c in batch.columns)
            for i in range(0, len(ids), 1 << 12):
                part, value, _, role, row = index.buckets(fps[i : i + (1 << 12)].view(np.uint64), numbered=True)
                item = mixed((value << np.uint64(6)) ^ part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(item.view(np.int64)), pa.array(ids[i + row]), pa.array(fps[i + row]), pa.array(role), pa.array(root[i + row])], names=["item", "id", "fp", "role", "root"])

    def meet(batches: Iterator[pa.RecordBatch], in_blocks: bool = False) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["kind", "a", "b"])

        def given(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            n = 0
            for kind, a, b in bucket_pairs(x, index.radius, every, dense):
                held.setdefault(kind, []).append((a, b))
                n += len(a)
                if n > 1 << 17:
                    yield from (out(k, *map(np.concatenate, zip(*v, strict=True))) for k, v in held.items())
                    held, n = {}, 0
            if n:
                yield from (out(k, *map(np.concatenate, zip(*v, strict=True))) for k, v in held.items())

        held, giant = np.zeros((5, 0), np.int64), None
        for batch in batches:
            x = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            if giant is not None:
                x = x[:, x[0] != giant]
            if not x.shape[1]:
                held = x
                continue
            last = int(np.searchsorted(x[0], x[0, -1]))
            yield from given(x[:, :last])
            held = x[:, last:]
            if held.shape[1] > held_most and not in_blocks:
                giant = held[0, 0]
                yield out(HOT, held[0, :1], held[0, :1])
                held = held[:, :0]
        if held.shape[1]:
            yield from given(held)

    entries = nodes.select("id", "fp", "root").mapInArrow(enter, "item long, id long, fp long, role byte, root long")
    dealt = lambda rows: rows.repartition("item").sortWithinPartitions("item", "id")
    found = checkpointed(dealt(entries).mapInArrow(meet, "kind byte, a long, b long").distinct())
    hot = found.where(F.col("kind") == HOT).select(F.col("a").alias("h"))
    if not hot.limit(1).count():
        return found
    again = entries.join(hot, F.col("item") == F.col("h")).drop("h")
    blocks = again.groupBy(F.col("item").alias("h")).agg(F.ceil(F.count(F.lit(1)) / (held_most // 4)).alias("blocks"))
    again = again.join(blocks, F.col("item") == F.col("h")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    again = again.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    again = again.select(F.xxhash64("item", F.least("block", "other"), F.greatest("block", "other")).alias("item"), "id", "fp", "role", "root")
    more = dealt(again).mapInArrow(partial(meet, in_blocks=True), "kind byte, a long, b long")
    return checkpointed(found.where(F.col("kind") != HOT).unionByName(more).distinct())


def cluster_links(ids: np.ndarray, fps: np.ndarray, roots: np.ndarray, side: np.ndarray, items: np.ndarray, bounds: np.ndarray, radius: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among sets (sorted hashes, bounds by row): within the radius and of the similarity. Of two sides, only
    pairs across; pairs of equal roots, or that are connected by then, aren't compared."""
    n, size = len(ids), np.diff(bounds)
    labels = np.searchsorted(np.unique(roots), roots)
    found: list[tuple[int, int]] = []
    across = bool(side.any())
    for i in range(n - 1):
        other = np.arange(i + 1, n)
        other = other[(labels[other] != labels[i]) & (np.bitwise_count(fps[other] ^ fps[i]) <= radius)]
        other = other[(side[other] != side[i]) | (not across)]
        other = other[(100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])) & (size[other] > 0)]
        if not len(other) or not size[i]:
            continue
        mine = items[bounds[i] : bounds[i + 1]]
        theirs = np.concatenate([items[bounds[j] : bounds[j + 1]] for j in other.tolist()])
        at = np.searchsorted(mine, theirs).clip(max=len(mine) - 1)
        same = np.add.reduceat(mine[at] == theirs, np.cumsum(size[other]) - size[other], dtype=np.int64)
        for j in other[(100 + percent) * same >= percent * (size[i] + size[other])].tolist():
            if labels[j] != labels[i]:
                labels[labels == labels[j]] = labels[i]
                found.append((i, j))
    a, b = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return ids[a], ids[b]


def _cluster_links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, radius: int, percent: int, most_items: int = DENSE_ITEMS) -> DataFrame:
    """The links inside clusters, which `pairs` (a, b) hold together. `nodes` has id, fp, size, root."""
    held_by = components(pairs).toDF("node", "cluster")
    rows = checkpointed(nodes.join(held_by, F.col("id") == F.col("node")).drop("node"))
    blocks = rows.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") / most_items)).alias("blocks"))
    rows = rows.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("group"), (F.col("block") > F.col("other")).cast("byte").alias("side"), "id", "fp", "root")
    items = among(sets.select("id", "items"), masks(rows.select("id"))).where("_among").drop("_among").dropDuplicates(["id"])

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        group = pa.Table.from_batches(held)
        items = group.column("items").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())]).astype(np.int64)
        ids, fps, root, side = (group.column(c).to_numpy() for c in ("id", "fp", "root", "side"))
        a, b = cluster_links(ids, fps.view(np.uint64), root, side, items.flatten().to_numpy().view(np.uint64), bounds, radius, percent)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)) if len(group) else np.zeros(1, np.int64)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if held and group[low] != now:
                    yield links(held)
                    held = []
                now = group[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield links(held)

    dealt = rows.join(items, "id").repartition("group").sortWithinPartitions("group", "id")
    return checkpointed(dealt.mapInArrow(verify, "a long, b long"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the similarity."""
    pairs = pairs.where("a <> b")
    some = among(sets.select("id", "size", "items"), masks(pairs.select(F.explode(F.array("a", "b")).alias("id")))).where("_among").drop("_among")
    some = some.dropDuplicates(["id"])
    x = pairs.join(some.toDF("a", "size_a", "items_a"), "a").join(some.toDF("b", "size_b", "items_b"), "b")
    return checkpointed(x.where((100 + percent) * F.size(F.array_intersect("items_a", "items_b")).cast("long") >= percent * (F.col("size_a") + F.col("size_b")).cast("long")).select("a", "b"))


def near_index(nodes: DataFrame, n: int, radius: int) -> Pigeonhole:
    """The index with the number of partitions that costs least, from a bounded sample of the fingerprints."""
    deal = max(1, n // SAMPLE)
    sample = np.sort(np.array([r["fp"] for r in nodes.where(F.pmod(F.xxhash64("id"), F.lit(deal)) == 0).select("fp").collect()], np.int64).view(np.uint64))
    # A probe is a row that is shuffled and sorted, a candidate a comparison in numpy.
    tried = [Pigeonhole(sample, n, radius, m, probe_cost=PROBE_COST) for m in range(4, radius + 2)]
    cost = [index.cost(sample[:: max(1, len(sample) // 512)]) for index in tried]
    # Of nearly equal costs the one with most partitions, for its probes, which are rows on disk and in the network, are fewest.
    return next(index for index, c in reversed(list(zip(tried, cost, strict=True))) if c <= NEARLY * min(cost))


def similar_documents(docs: DataFrame, words: int = 5, percent: int = 80, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", held_most: int = HELD_MOST, dense: int = DENSE) -> DataFrame:
    """Per row of `docs`: doc_id, component_id (the smallest doc_id reachable over pairs within the radius and of at least `percent` % similarity)."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    whole = _sets(rows, words, True)
    sets = checkpointed(_sets(rows, words, False))
    own = checkpointed(sets.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    index = near_index(own, own.count(), radius)
    of_kind = lambda rows, kind: rows.where(F.col("kind") == kind).select("a", "b")
    first = _candidates(own.select("id", "fp", F.col("id").alias("root")), index, False, held_most, dense)
    links = _verified(of_kind(first, PAIR), whole, percent)
    some = among(own.select("id", "fp", "size"), masks(of_kind(first, MANY).select(F.col("a").alias("id")))).where("_among").drop("_among")
    some = checkpointed(some.join(components(links), F.col("id") == F.col("node"), "left").select("id", "fp", "size", F.coalesce("root", "id").alias("root")))
    rest = _candidates(some, index, True, held_most, dense)
    links = links.unionByName(_verified(of_kind(rest, PAIR), whole, percent))
    if of_kind(rest, CLUSTER).limit(1).count():
        links = links.unionByName(_cluster_links(of_kind(rest, CLUSTER), some, whole, radius, percent))
    links = checkpointed(links)
    own = own.join(components(links), F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    # Written first, so that the join's exchanges are its own and Spark can split the partition of a very large component.
    least = checkpointed(own.groupBy("root").agg(F.min("least").alias("component_id")))
    own = own.select(F.col("id").alias("of"), "root").join(least, "root").select("of", "component_id")
    return sets.select("doc_id", "id").join(own, F.col("id") == F.col("of")).select("doc_id", "component_id")


def keep_one_similar(docs: DataFrame, words: int = 5, percent: int = 80, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without those whose doc_id isn't the smallest of its component; of rows that
    share that doc_id, one stays. A component without any doc_id keeps one of its rows."""
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key = F.md5(F.coalesce(F.col(f"c{names.index(text_col)}"), F.lit("")).cast("binary"))
    inner = inner.withColumn("_doc", F.struct(F.col(f"c{names.index(id_col)}").alias("id"), key.alias("key")))
    named = similar_documents(inner, words, percent, radius, "_doc", f"c{names.index(text_col)}")
    each = checkpointed(named.groupBy("component_id", "doc_id").agg(F.count(F.lit(1)).alias("copies")))
    first = F.min_by("doc_id", F.struct(F.col("doc_id.id").isNull(), F.col("doc_id.id"), F.col("doc_id.key")))
    kept = each.groupBy("component_id").agg(first.alias("kept")).withColumnRenamed("component_id", "of")
    # Only rows that go, or of which one stays, are shuffled; the filter passes a few more of them.
    gone = checkpointed(each.join(kept, F.col("component_id") == F.col("of")).where((F.col("doc_id") != F.col("kept")) | (F.col("copies") > 1)).select("doc_id", (F.col("doc_id") != F.col("kept")).alias("goes")))
    marked = among(inner.withColumn("_hash", F.xxhash64("_doc")), masks(gone.select(F.xxhash64("doc_id").alias("id"))), "_hash")
    some = marked.where("_among").join(gone, (F.col("_hash") == F.xxhash64("doc_id")) & F.col("_doc").eqNullSafe(F.col("doc_id")), "left")
    once = some.where("not goes").dropDuplicates(["_doc"])
    out = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return reduce(DataFrame.unionByName, (x.select(*out) for x in (marked.where("not _among"), some.where("goes is null"), once)))
