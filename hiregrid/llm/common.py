"""Pieces that several corpus operators share: Arrow text buffers, word bounds, hashes, ranks, checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20

#: The words of most operators: runs of anything but ASCII white space.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Byte ranges are hashed by two polynomials modulo this prime; products and whole prefix sums stay within 64 bits.
_PRIME = (1 << 31) - 1
_RANDOM = np.random.default_rng(20240229)
_BASES = tuple(int(x) for x in _RANDOM.integers(1 << 16, _PRIME, 2))
_BYTE_VALUES = _RANDOM.integers(1, _PRIME, (2, 256)).astype(np.uint64)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where it names none (tests on one machine)."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{re.sub('[^a-z0-9]+', '-', name)}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what `written` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `most` bytes of text each; a longer text comes alone."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], dtype=np.int32)[batch.column(column).offset :][: batch.num_rows + 1] if batch.num_rows else np.zeros(1, np.int32)
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, int(offsets[first]) + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def flat(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and each text's bounds in it. A null text is empty."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and text numbers of the maximal runs of true bytes, none across two texts."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    edges = offsets[(offsets > 0) & (offsets < len(mask))]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[edges] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[edges - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below 2 ** 63."""
    return x % np.uint64(_PRIME)


@lru_cache(maxsize=1)
def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each base its powers from 0 to n, and those of its inverse."""

    def up_to(base: int) -> np.ndarray:
        row = np.ones(1, np.uint64)
        while len(row) <= n:
            row = np.concatenate([row, _reduced(row * np.uint64(pow(base, len(row), _PRIME)))])
        return row[: n + 1].astype(np.uint32)

    return [(up_to(base), up_to(pow(base, -1, _PRIME))) for base in _BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of hashes don't cancel."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """62-bit hashes of any byte ranges of a buffer: two polynomials modulo a prime, each from one prefix sum of powers."""

    def __init__(self, data: np.ndarray) -> None:
        size = max(CHUNK_BYTES, 1 << max(len(data) - 1, 1).bit_length())
        self.parts = []
        for (up, down), values in zip(_powers(size), _BYTE_VALUES, strict=True):
            prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_reduced(values[data] * up[: len(data)]), dtype=np.uint64, out=prefix[1:])
            self.parts.append((_reduced(prefix).astype(np.uint32), down))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for prefix, down in self.parts:
            apart = prefix[ends].astype(np.uint64) + np.uint64(_PRIME) - prefix[starts]
            out = (out << np.uint64(31)) | _reduced(_reduced(apart) * down[starts])
        return mixed(out ^ mixed((ends - starts).astype(np.uint64)))


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words, from the words' hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + words[j : j + len(out)]
    return mixed(out)


def covered(starts: np.ndarray, length: int | np.ndarray, total: int) -> np.ndarray:
    """Which of `total` places lie in [start, start + length) of any start."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


#: Bits, as a power of two, of a filter that spares rows a shuffle; the join after it is exact, so this is a matter of time.
FILTER_BITS = 24


def _filter_word(x: Column) -> Column:
    return F.pmod(F.shiftright(x, 6), F.lit(1 << (FILTER_BITS - 6)))


def _filter_bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def masks(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """A filter for the hashes in `id_col`: at most 2 ** (FILTER_BITS - 6) rows, so it may be broadcast."""
    return ids.select(_filter_word(F.col(id_col)).alias("_word"), _filter_bit(F.col(id_col)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def among(rows: DataFrame, filter_: DataFrame, id_col: str = "id") -> DataFrame:
    """Adds `_among`: false only where the filter lacks the row's hash."""
    found = rows.join(F.broadcast(filter_), _filter_word(F.col(id_col)) == F.col("_word"), "left")
    return found.withColumn("_among", F.coalesce(F.col("_bits").bitwiseAND(_filter_bit(F.col(id_col))) != 0, F.lit(False))).drop("_word", "_bits")


def ranked(rows: DataFrame, keys: list[str], order: list[str], out: str, n_rows: int, in_bucket: int = 4096) -> DataFrame:
    """Adds `out`, a gapless rank from 0 within the keys (any number of rows a key), in order of a hash and `order`.

    No task gets all rows of a key: the rows are dealt by key and hash bucket, each bucket counts on from the sum of the
    buckets before it. `rows` has to give the same rows again (a checkpoint); equal rows get different ranks.
    """
    buckets = max(1, -(-n_rows // in_bucket))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    each = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    each = each.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_bucket").alias("_b"), F.coalesce(before, F.lit(0)).alias("_before"))
    same: Column = F.col("_bucket") == F.col("_b")
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    place = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*(F.col(c).asc_nulls_first() for c in order)))
    return rows.join(each, same).withColumn(out, F.col("_before") + place - 1).drop("_bucket", "_b", "_before", *(f"_{k}" for k in keys))
