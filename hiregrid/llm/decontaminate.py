"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a slice of an Arrow batch. Its words become 64-bit hashes; the suffixes that can begin a match (their leading words
are those of some benchmark suffix; nothing else can match) are sorted into a suffix array. Every benchmark suffix is then
binary-searched in it, all at once in numpy: the neighbours of its place hold its longest verbatim match, the interval
around it every location that matches over the whole window. Words under a match of a window are hit.

The benchmark is taken in blocks of a bounded number of words, one after another as they come from its partitions. Each block is one pass that
adds its hits to a column of the row (or drops the row); if there is another block, what the pass gave is written in the shared folder and the
block's broadcast is destroyed first. So driver and executors hold one block's index, within BLOCK_WORDS, and the driver the next one's texts;
no shuffle is needed for any number of blocks.

Defined cases: a null or empty text, or an item without words, matches nothing; an item shorter than the window is one
window; repeated items count once by id, an item without id hits but is not listed; repeated documents keep a row each; an
empty table gives an empty table, an empty benchmark hits nothing; other columns are ignored (`remove_contaminated`
returns them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, checkpointed, covered, flat, pieces, runs, window_hash

#: Words of the benchmark that one pass holds in memory (about 30 bytes each).
BLOCK_WORDS = 4_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.array([b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" for b in range(256)])


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each lower-cased word, and the first word of each text (one more at the end)."""
    data, offsets = flat(texts)
    data = _LOWER[data]
    starts, ends, of = runs(_WORD[data], offsets)
    return RollingHash(data)(starts, ends), np.searchsorted(of, np.arange(len(texts) + 1))


class TestSuffixes:
    """The suffixes of a block of benchmark items that begin a window."""

    def __init__(self, ids: list, texts: list[str | None], window: int) -> None:
        self.words, self.bounds = word_hashes(pa.array(texts, pa.string()))
        self.ids, self.window = ids, window
        n = np.diff(self.bounds)
        self.need = np.minimum(window, n)  # the words that a match must have
        each = np.where(n > 0, n - self.need + 1, 0)
        self.item = np.repeat(np.arange(len(ids)), each)
        self.at = self.bounds[:-1][self.item] + np.arange(len(self.item)) - np.repeat(np.cumsum(each) - each, each)
        self.end = self.bounds[1:][self.item]
        self.lead = int(min(3, n[n > 0].min())) if len(self.item) else 0
        self.leads = np.unique(window_hash(self.words, self.lead)[self.at]) if self.lead else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.leads >> np.uint64(44)).astype(np.int64)] = True


def _beside(words: np.ndarray, at: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The first n word hashes from each place, zero beyond the text's end."""
    places = at[:, None] + np.arange(n)
    return np.where(places < end[:, None], words[np.minimum(places, len(words) - 1)], np.uint64(0))


def suffix_array(words: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes sorted by their first `depth` words: places, ends and those words."""
    head = _beside(words, at, end, depth)
    order = np.lexsort(head.T[::-1])
    return at[order], end[order], head[order]


def search(head: np.ndarray, keys: np.ndarray, widths: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all keys at once: the first row of `head` not below (right: above) the key in its first `width` words."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(head), np.int64)
    used = np.arange(head.shape[1]) < widths[:, None]
    while (open_ := low < high).any():
        mid = (low + high) // 2
        rows = head[np.minimum(mid, len(head) - 1)]
        differ = (rows != keys) & used
        first = np.argmax(differ, axis=1)
        line = np.arange(len(keys))
        less = differ[line, first] & (rows[line, first] < keys[line, first])
        same = ~differ.any(axis=1)
        go = open_ & (less | (same if right else False))
        low = np.where(go, mid + 1, low)
        high = np.where(open_ & ~go, mid, high)
    return low


def matches(words: np.ndarray, bounds: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verbatim matches of whole windows: place of the first word in the shard, its item, and the words of the longest match there."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(test.item) or len(words) < test.lead:
        return none
    lead = window_hash(words, test.lead)
    at = np.flatnonzero(test.sieve[(lead >> np.uint64(44)).astype(np.int64)])
    at = at[np.isin(lead[at], test.leads)]
    end = bounds[1:][np.searchsorted(bounds, at, side="right") - 1]
    at, end = at[at + test.lead <= end], end[at + test.lead <= end]
    if not len(at):
        return none
    at, end, head = suffix_array(words, at, end, test.window)
    keys = _beside(test.words, test.at, test.end, test.window)
    widths = test.need[test.item]
    low, high = search(head, keys, widths, False), search(head, keys, widths, True)
    n = high - low
    suffix = np.repeat(np.arange(len(n)), n)
    rows = low[suffix] + np.arange(len(suffix)) - np.repeat(np.cumsum(n) - n, n)
    place, stop, own, own_stop = at[rows], end[rows], test.at[suffix], test.end[suffix]
    whole = place + widths[suffix] <= stop
    place, stop, own, own_stop, suffix = (x[whole] for x in (place, stop, own, own_stop, suffix))
    length = widths[suffix].copy()
    open_ = np.arange(len(place))
    while len(open_):  # on to the longest match
        a, b = place[open_] + length[open_], own[open_] + length[open_]
        inside = (a < stop[open_]) & (b < own_stop[open_])
        open_, a, b = open_[inside], a[inside], b[inside]
        open_ = open_[words[a] == test.words[b]]
        length[open_] += 1
    return place, test.item[suffix], length


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str, block_words: int) -> Iterator[TestSuffixes]:
    """The suffixes of the benchmark's items in blocks, one at least."""
    ids: list = []
    texts: list = []
    held = some = 0
    for row in benchmark.select(benchmark[id_col].alias("i"), benchmark[text_col].alias("t")).toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"])
        held += len(row["t"] or "") // 4
        if held >= block_words:
            yield TestSuffixes(ids, texts, window)
            ids, texts, held, some = [], [], 0, 1
    if ids or not some:
        yield TestSuffixes(ids, texts, window)


def _in_passes(rows: DataFrame, blocks: Iterator[TestSuffixes], one_pass: Callable[[Iterator[pa.RecordBatch], TestSuffixes], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`rows` through one pass for each block; all passes but the last are written, and their block forgotten, before the next begins."""
    context = rows.sparkSession.sparkContext
    block = next(blocks)
    while True:
        shared = context.broadcast(block)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            return one_pass(batches, shared.value)

        rows = rows.mapInArrow(each, rows.schema)
        block = next(blocks, None)
        if block is None:
            return rows
        rows = checkpointed(rows)
        shared.destroy()


def contamination_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, text, n_words and `spans`: structs of first word, words matched at the longest, item id."""
    item_type = benchmark.schema[item_col].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("item", T.StringType())])
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.lit(None).cast("long").alias("n_words"), F.array().cast(T.ArrayType(span)).alias("spans"))
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())]))
    as_text = str if isinstance(item_type, T.NumericType | T.StringType) else repr

    def one_pass(batches: Iterator[pa.RecordBatch], test: TestSuffixes) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words, bounds = word_hashes(piece.column("text"))
                place, item, length = matches(words, bounds, test)
                doc = np.searchsorted(bounds, place, side="right") - 1
                spans = piece.column("spans").to_pylist() if len(place) or any(len(x) for x in piece.column("spans")) else [[]] * piece.num_rows
                spans = [list(x) for x in spans] if len(place) else spans
                for d, p, i, k in zip(doc.tolist(), (place - bounds[doc]).tolist(), item.tolist(), length.tolist(), strict=True):
                    spans[d].append({"start": p, "length": k, "item": None if test.ids[i] is None else as_text(test.ids[i])})
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text"), pa.array(np.diff(bounds)), pa.array(spans, arrow_span)], names=["doc_id", "text", "n_words", "spans"])

    return _in_passes(rows, _blocks(benchmark, window, item_col, text_col, block_words), one_pass)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest verbatim match)."""
    spans = contamination_spans(docs, benchmark, window, id_col, text_col, item_col, block_words).drop("text")
    schema = T.StructType([*spans.drop("spans").schema, T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("longest", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, found in zip(batch.column("n_words").to_pylist(), batch.column("spans"), strict=True):
                found = found.as_py() if len(found) else []
                # A match goes on as long as its windows do, so the longest match covers what its windows cover.
                hit = int(covered(np.array([s["start"] for s in found], np.int64), np.array([s["length"] for s in found], np.int64), n).sum()) if found else 0
                items = sorted({s["item"] for s in found if s["item"] is not None})
                out.append((hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0, max((s["length"] for s in found), default=0)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()), strict=True))], names=schema.names)

    return spans.mapInArrow(each, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs`, all columns, in which no window of an item occurs."""
    at = docs.columns.index(text_col)

    def one_pass(batches: Iterator[pa.RecordBatch], test: TestSuffixes) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, names=[str(i) for i in range(batch.num_columns)])
            for piece in pieces(named, str(at)):
                words, bounds = word_hashes(piece.column(at))
                place, _, _ = matches(words, bounds, test)
                clean = np.ones(piece.num_rows, bool)
                clean[np.searchsorted(bounds, place, side="right") - 1] = False
                yield pa.RecordBatch.from_arrays(piece.filter(pa.array(clean)).columns, schema=batch.schema)

    return _in_passes(docs, _blocks(benchmark, window, item_col, item_text_col, block_words), one_pass)
