"""Sharding by best-fit decreasing: groups of equal texts are indivisible and enter the tightest room that holds them.

The law that holds is `bytes`: shard sizes are near equal. Groups are keyed by the digest of their text, so texts are never
shuffled. Every group is planned by its own size: what the driver gets is the count of groups by size, and equal sizes are placed as a run,
which fills the tightest room before it takes the next, exactly as one after another would. Rooms stand in a balanced tree; the fixed
capacity is the smallest, as far as halving finds it, with which the decreasing best fit needs no more than the given number of shards.
Groups then get a rank within their size and take the planned shard by a join on size and rank.

Distinct sizes of groups add up to no more than the bytes of all texts, so there are at most the square root of twice those bytes (14
million at 100 TB, where every size would have to occur), and the plan has at most as many steps a size as there are shards.

Defined cases: a null text has size 1 and falls in the group of empty texts; repeated rows share a shard and take slots of
their own; an empty table gives an empty table; null ids are carried; other columns are ignored. A group larger than the
mean shard stays whole, its shard is then as large as the group needs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, ranked


class RoomTree:
    """A balanced search tree (treap with hashed priorities) of (room, bin)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, left: list | None, right: list | None) -> list | None:
        if left is None or right is None:
            return left or right
        if left[1] > right[1]:
            left[3] = self._merge(left[3], right)
            return left
        right[2] = self._merge(left, right[2])
        return right

    def add(self, room: int, bin_: int) -> None:
        key = (room, bin_)
        left, right = self._split(self.root, key)
        priority = (room * 0x9E3779B1 + bin_ * 0x85EBCA77) & 0xFFFFFFFF
        self.root = self._merge(self._merge(left, [key, (priority ^ priority >> 15) * 0x2C1B3C6D & 0xFFFFFFFF, None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest room of at least `size`."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        lowest = right
        while lowest[2] is not None:
            lowest = lowest[2]
        room, bin_ = lowest[0]
        _, rest = self._split(right, (room, bin_ + 1))
        self.root = self._merge(left, rest)
        return room, bin_


def best_fit_decreasing(counts: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, end rank, bin) for (size, items of that size) in decreasing order, and the number of bins.

    The tightest room that holds an item is still the tightest with the item in it, so equal items fill one room after another.
    """
    tree, out, n = RoomTree(), [], 0
    for size, items in counts:
        done = 0
        while done < items:
            found = tree.take_tightest(size)
            if found is None:
                found, n = (capacity, n), n + 1
            some = min(items - done, found[0] // size)
            tree.add(found[0] - some * size, found[1])
            out.append((size, done, done + some, found[1]))
            done += some
    return out, n


def fewest_capacity(counts: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs for the smallest fixed capacity, as far as halving finds it, that needs at most `shards` bins."""
    low = max(counts[0][0] if counts else 1, -(-sum(size * n for size, n in counts) // shards))
    high, step, best = low, 1, None
    while best is None:
        bins, n = best_fit_decreasing(counts, high)
        if n <= shards:
            best = bins
        else:
            low, high, step = high + 1, high + step, 2 * step
    while low < high:
        mid = (low + high) // 2
        bins, n = best_fit_decreasing(counts, mid)
        if n <= shards:
            best, high = bins, mid
        else:
            low = mid + 1
    return best


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, law, shard, slot, grown_shard. `slot` is gapless from 0 in each shard."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = checkpointed(docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest")))
    groups = checkpointed(rows.groupBy("digest").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("copies")))
    counts = groups.groupBy("group_size").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).orderBy(F.desc("group_size")).toPandas()
    steps: dict[int, list[tuple[int, int, int]]] = {}
    for size, low, high, shard in fewest_capacity(list(zip(counts["group_size"].tolist(), counts["n"].tolist(), strict=True)), shards):
        steps.setdefault(size, []).append((low, high, shard))
    plan = docs.sparkSession.createDataFrame(list(steps.items()), "step_size bigint, steps array<struct<lo: bigint, hi: bigint, shard: int>>")
    # No hint: the plan grows with the number of different sizes, Spark looks at how large it is.
    placed = ranked(groups, ["group_size"], ["digest"], "rank", int(counts["n"].sum())).join(plan, F.col("group_size") == F.col("step_size"))
    step = F.filter("steps", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    # Written first, so that the join's exchanges are its own and Spark can split the partition of a very large group.
    placed = checkpointed(placed.select(F.col("digest").alias("of"), step["shard"].alias("shard")))
    rows = rows.join(placed, F.col("digest") == F.col("of")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard")
    # Ranks need the same rows again, in two passes; `nth` tells rows apart that are equal in all else.
    rows = checkpointed(rows.withColumn("nth", F.monotonically_increasing_id()))
    return ranked(rows, ["shard"], ["doc_id", "size", "text_crc32", "nth"], "slot", int(counts["copies"].sum())).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
