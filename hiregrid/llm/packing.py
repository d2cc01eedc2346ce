"""Best-fit packing planned on the histogram of lengths.

One Arrow pass tokenizes every whole text and cuts what is longer than a sequence. The only thing that reaches the driver is
the count of pieces by length (at most one number per length up to the capacity, whatever the corpus size). Best-fit
decreasing then runs over counts: all pieces of a length enter the tightest open room, many sequences at a time,
and each step of the plan is a segment of ranks within that length. Pieces get their rank within their length and
take the planned slot by a join on length and rank.

Defined cases: a null or empty text is one piece with nothing but the end token; repeated rows and ids are separate documents
with slots of their own; a null id is carried; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, ranked

#: Texts of these characters only are cut with `re`, where its classes and the tokenizer's agree; others go to the tokenizer whole.
_PLAIN = "\t\n\r -~¡-ÿŒœ–—‘-”…€"
_OTHER = re.compile(f"[^{_PLAIN}]")
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿŒœ"
_NUMBERS = "0-9²³¹¼-¾"
#: The pre-tokenizer's public pattern, in the plain characters' classes.
_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")


class TokenBytes(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit bytes, filled on first use.

    Whole texts with unusual characters, or with an added token's content, go through `tokenizers`. A pre-token of plain characters that was not met before is
    merged by tiktoken from the very merge ranks of the tokenizer's own vocabulary, which gives the same ids in less time;
    a vocabulary whose ranks are not its ids leaves this to `tokenizers` too.
    """

    def __init__(self, path: str, most: int = 150_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.most = most
        self.merge = _merger(self.tokenizer)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.merge(word), "<u4").tobytes() if self.merge else self.whole(word)
        if len(self) < self.most and len(word) < 64:
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text) or any(x in text for x in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _TOKENS.findall(text)))


def _merger(tokenizer):  # noqa: ANN001, ANN202
    """tiktoken over the tokenizer's vocabulary, where that is one of byte-level merges whose ids are their ranks."""
    import tiktoken

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(c): b for b, c in [*zip(shown, shown, strict=True), *((b, 256 + i) for i, b in enumerate(hidden))]}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    try:
        ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token not in special}
    except KeyError:
        return None
    if len({*ranks.values()}) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_loaded: dict[str, TokenBytes] = {}


def token_bytes(path: str) -> TokenBytes:
    """One table per worker process."""
    if path not in _loaded:
        _loaded[path] = TokenBytes(path)
    return _loaded[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. Only a document longer than the capacity is cut; its first piece is the short one."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = token_bytes(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = table.ids(text.as_py() or "") + end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    at.append(row)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(each, schema)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns segments (length, first rank, end rank, first sequence, pieces in each sequence, offset): the piece of rank r goes to
    sequence `first + (r - first rank) // pieces`. Their number depends on the capacity, not on the counts.
    """
    rooms: list[int] = []  # the sizes of open rooms, in order
    open_at: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    plan: list[tuple[int, int, int, int, int, int]] = []
    fresh = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_at:
                insort(rooms, room)
            open_at.setdefault(room, []).append((first, n))

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        done, todo = 0, counts[length]
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[i]
            else:
                room, first, n = capacity, fresh, -(-todo // (capacity // length))
                fresh += n
            each = min(room // length, todo)
            used = min(n, todo // each)
            plan.append((length, done, done + used * each, first, each, capacity - room))
            put(room - each * length, first, used)
            put(room, first + used, n - used)
            done += used * each
            todo -= used * each
    return plan


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # `nth` tells pieces apart that are equal in all else, so that many of them aren't ranked in one task.
    found = checkpointed(tokenized_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).withColumn("nth", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    step = "struct<hi: bigint, lo: bigint, first: bigint, each: bigint, at: bigint>"
    slots: dict[int, list[tuple[int, ...]]] = {}
    for length, lo, hi, first, each, offset in plan:
        slots.setdefault(length, []).append((hi, lo, first, each, offset))
    steps = docs.sparkSession.createDataFrame(list(slots.items()), f"slot_length bigint, steps array<{step}>")
    placed = ranked(found, ["length"], ["doc_id", "piece", "ids_crc32", "nth"], "rank", sum(counts.values()))
    # The plan is bounded by the capacity alone, so it may be broadcast.
    placed = placed.join(F.broadcast(steps), F.col("length") == F.col("slot_length"))
    placed = placed.withColumn("step", F.filter("steps", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0])
    nth = F.col("rank") - F.col("step.lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("step.first") + F.floor(nth / F.col("step.each"))).cast("long").alias("sequence_id"),
        (F.col("step.at") + F.pmod(nth, F.col("step.each")) * F.col("length")).cast("long").alias("offset"),
    )
