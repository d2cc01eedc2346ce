"""Product codes of vectors: a codebook for each part of the vector, fitted by Lloyd's rounds whose sums are kept up by deltas.

A vector becomes integers, cut into equal consecutive parts, each coded by the nearest of up to 256 entries of its part's codebook. All
arithmetic is on integers, so the result doesn't depend on the order in which anything is added up.

State goes from round to round: a written table with each vector and the entries its parts had (and have), and the running sums and counts of
every entry. A round assigns all parts, then shuffles only what changed: each task adds up, by entry, the parts that came (plus) and those that
left (minus), so it sends at most one row an entry, however many vectors share one. The codebooks and sums are bounded by the parameters
(parts * entries * width integers); they are all that the driver holds and all that tasks are sent. A round without a change ends the fit, for
all later ones would be equal.

Defined cases: rows whose vector is null, empty, or holds a null, a NaN or an infinity are dropped, as are those of another length than the vector
of the smallest id; a length that the parts don't divide is filled up with zeros; integers beyond 2 ** 30 either way count as that, sums of
squares beyond 64 bits as the largest 64-bit integer. Repeated rows and ids are rows of their own and tie by their vectors; null ids come last. Fewer rows than entries give
smaller codebooks; an empty table gives an empty table; ties go to the lower entry. Vectors of any length are whole, in batches of Arrow; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are held within this, either way.
MOST = 1 << 30
_LONG = (1 << 63) - 1
#: Vectors whose distances are computed at once.
_ROWS = 2048


def _joined(rows: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as binary values."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int64) * rows.strides[0]
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)]).cast(pa.binary())


def _parts(column: pa.Array, kind: type) -> np.ndarray:
    """(rows, PARTS, -1) from binary values of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), PARTS, -1)


def _whole(vectors: pa.ListArray, width: int) -> np.ndarray:
    """(rows, PARTS, width) integers of vectors of one length."""
    values = np.clip(np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(SCALE)), -MOST, MOST).astype(np.int32).reshape(len(vectors), -1)
    return np.pad(values, ((0, 0), (0, PARTS * width - values.shape[1]))).reshape(len(values), PARTS, width)


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each part and the squared distance to it: (rows, PARTS) each. Ties go to the lower entry."""
    codes, apart = np.zeros(vectors.shape[:2], np.uint8), np.zeros(vectors.shape[:2], object)
    largest = max((int(np.abs(x.astype(np.int64)).max()) for x in (vectors, books) if x.size), default=0)
    kind = np.float64 if 4 * vectors.shape[2] * largest * largest < 1 << 53 else object  # doubles are exact below, Python's integers always
    for p in range(vectors.shape[1]):
        entries = books[p].astype(kind)
        squares = (entries * entries).sum(axis=1)
        for low in range(0, len(vectors), _ROWS):
            x = vectors[low : low + _ROWS, p].astype(kind)
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + squares
            best = d.argmin(axis=1)
            codes[low : low + _ROWS, p] = best
            apart[low : low + _ROWS, p] = [int(v) for v in d[np.arange(len(d)), best]]
    return codes, apart


def _state(key: list[T.StructField]) -> T.StructType:
    return T.StructType([*key, T.StructField("v", T.BinaryType()), T.StructField("was", T.BinaryType()), T.StructField("now", T.BinaryType()), T.StructField("error", T.LongType())])


def _assigned(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """The state of the next round: `now` by these codebooks, `was` the assignment before (null at first)."""
    first = "now" not in rows.columns
    schema = _state([rows.schema["vec_id"], rows.schema["label"]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _whole(batch.column("vector"), width) if first else _parts(batch.column("v"), np.int32)
            codes, apart = nearest(vectors, books)
            error = pa.array([min(_LONG, sum(row)) for row in apart.tolist()], pa.int64())
            was = pa.nulls(batch.num_rows, pa.binary()) if first else batch.column("now")
            v = _joined(vectors.reshape(len(vectors), -1)) if first else batch.column("v")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), v, was, _joined(codes), error], names=schema.names)

    return rows.mapInArrow(each, schema)


def _changes(state: DataFrame, entries: int, width: int) -> DataFrame:
    """part, entry, n, s0, s1, ..: what the last assignment adds to each entry's count and sums; only entries with a change."""
    names = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "entry", "n", *names)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, entries, width + 1), np.int64)
        seen = np.zeros((PARTS, entries), bool)
        for batch in batches:
            fresh = np.array([x is None for x in batch.column("was").to_pylist()], bool)
            vectors, now = _parts(batch.column("v"), np.int32).astype(np.int64), _parts(batch.column("now"), np.uint8)[:, :, 0]
            was = _parts(batch.column("was").fill_null(bytes(PARTS)), np.uint8)[:, :, 0]
            for p in range(PARTS):
                moved = fresh | (was[:, p] != now[:, p])
                for codes, sign, rows in ((now, 1, moved), (was, -1, moved & ~fresh)):
                    to = codes[rows, p]
                    np.add.at(total[p, :, 1:], to, sign * vectors[rows, p])
                    np.add.at(total[p, :, 0], to, sign)
                    seen[p, to] = True
        part, entry = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, *total[part, entry].T)], names=schema.names)

    changed = state.where(F.col("was").isNull() | (F.col("was") != F.col("now"))).select("v", "was", "now")
    return changed.mapInArrow(each, schema).groupBy("part", "entry").agg(*(F.sum(n).alias(n) for n in ("n", *names)))


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per kept row of `vectors`: vec_id, code, error, label_error, codebooks_sha256. At most 256 entries."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    shortest = rows.orderBy(*order).select(F.size("vector").alias("n")).take(1)
    if not shortest:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    rows = rows.where(F.size("vector") == shortest[0]["n"])
    width = -(-shortest[0]["n"] // PARTS)
    first = pa.array([r["vector"] for r in rows.orderBy(*order).limit(entries).collect()], pa.list_(pa.float64()))
    books = np.ascontiguousarray(_whole(first, width).astype(np.int64).transpose(1, 0, 2))

    sums, state = np.zeros((*books.shape[:2], width + 1), np.int64), rows
    for round_ in range(rounds + 1):
        last, state = state, written(_assigned(state, books, width), "vector-codes")
        if last is not rows:
            discard(last)
        if round_ == rounds:
            break
        changes = _changes(state, books.shape[1], width).collect()  # at most one row for each entry
        if not changes:
            break
        for part, entry, *delta in changes:
            sums[part, entry] += np.array(delta)
        used = sums[:, :, 0] > 0
        books = np.where(used[:, :, None], sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    of_label = state.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    coded = state.select("vec_id", "label", F.lower(F.hex("now")).alias("code"), "error")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("_label")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
