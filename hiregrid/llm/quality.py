"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths and of lines.

Each text is cut into words (runs of anything but ASCII white space). Rolling hashes give each run of n words, each line and each
three consecutive runs of marks (ASCII signs that are neither letters nor digits) a 64-bit value; sorting the values within a text
finds those that occur twice or more, and the share of the text's word characters that lie inside them is held against a limit
for each kind. A limit falls with the text's length: one short passage that stands twice is much of a short text, and no fault of it. N-grams and
lines alone decide beside the base rule; repeated marks are shown, for code, tables and formulas repeat theirs as well. All work is in numpy
over an Arrow buffer of many texts, so there is no shuffle and memory is bounded by the batch.

Defined cases: a null or empty text has no words and fails the base rule; a very long text is a buffer of its own, taken whole; a share equal to its
limit passes, and of several rules that fail the first is told; repeated rows each get their own result; an
empty table gives an empty table; null ids pass through; other columns, whatever their names, are ignored by
`quality_signals` and returned untouched by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import NOT_SPACE, RollingHash, covered, flat, pieces, runs, window_hash


@dataclass(frozen=True)
class QualityRules:
    """Limits of the verdict: shares of word characters inside duplicated n-grams and lines."""

    min_words: int = 50
    #: Percent of the words that may lie in repeated three-word windows.
    max_repeat_percent: int = 50
    #: By the n-gram's words, in a text of any length. Shorter ones also repeat by chance in long texts.
    gram_limits: dict[int, float] = field(default_factory=lambda: {2: 0.60, 3: 0.45, 5: 0.26, 7: 0.25, 10: 0.15})
    max_duplicate_line_chars: float = 0.15
    #: Share of the lines.
    max_duplicate_lines: float = 0.50
    #: Words in repeated n-grams that a text has for nothing (a line of a dozen words that stands twice), and half as many in later lines.
    free_words: float = 24.0


_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_MARK = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])

SIGNALS = {
    "n_words": np.int64, "word_chars": np.int64, "n_symbols": np.int64, "n_dup_lines": np.int64, "n_repeat_words": np.int64,
    "base_failed": np.bool_, "kept": np.bool_, "dup_line_chars": np.float64, "dup_gram_chars": np.float64, "dup_mark_chars": np.float64, "reason": object,
}


def _repeated(of: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For values grouped by `of` (ascending): which occur twice or more in their group, and which are not the first."""
    again, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        salted = hashes + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(salted, kind="stable")
        same = (salted[order][1:] == salted[order][:-1]) & (of[order][1:] == of[order][:-1])
        later[order[1:][same]] = True
        again[order[1:][same]] = again[order[:-1][same]] = True
    return again, later


def signals(texts: pa.StringArray, rules: QualityRules) -> dict[str, np.ndarray]:
    """The signals and the verdict of each text."""
    data, offsets = flat(texts)
    n = len(texts)
    starts, ends, of = runs(NOT_SPACE[data], offsets)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])
    chars = points[ends] - points[starts]
    of_word = np.searchsorted(of, np.arange(n + 1))  # the first word of each text
    sums = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[of_word])
    out = {"n_words": np.diff(of_word), "word_chars": sums(chars), "n_symbols": per_text(_SYMBOL[data])}
    hashed = RollingHash(data)
    words = hashed(starts, ends)

    line_starts, line_ends, line_of = runs(data != 0x0A, offsets)
    first_word = np.searchsorted(starts, line_starts)
    with_word = (first_word < len(starts)) & (np.append(starts, len(data))[first_word] < line_ends)
    line_starts, line_ends, line_of = line_starts[with_word], line_ends[with_word], line_of[with_word]
    _, later = _repeated(line_of, hashed(line_starts, line_ends))
    out["n_dup_lines"] = np.bincount(line_of[later], minlength=n)
    at = np.searchsorted(starts, np.stack([line_starts, line_ends]))
    total = np.concatenate([[0], np.cumsum(chars)])
    line_chars = total[at[1]] - total[at[0]]
    some = np.maximum(out["word_chars"], 1)
    free = rules.free_words / np.maximum(out["n_words"], 1)
    out["dup_line_chars"] = np.bincount(line_of[later], line_chars[later], minlength=n) / some
    dup_lines = out["n_dup_lines"] / np.maximum(np.bincount(line_of, minlength=n), 1)

    reasons = np.full(n, None, object)
    out["dup_gram_chars"] = np.zeros(n)
    over: list[tuple[str, np.ndarray]] = []
    for length, limit in sorted({3: 1.0, **rules.gram_limits}.items()):  # three words are counted in any case
        grams = window_hash(words, length)
        whole = of[: len(grams)] == of[length - 1 :] if len(grams) else np.zeros(0, bool)
        places = np.flatnonzero(whole)
        again, _ = _repeated(of[places], grams[places])
        inside = covered(places[again], length, len(words))
        if length == 3:
            out["n_repeat_words"] = sums(inside).astype(np.int64)
        share = sums(chars * inside) / some
        out["dup_gram_chars"] = np.maximum(out["dup_gram_chars"], share)
        over.append((f"repeated_{length}_grams", share > limit + free))
    mark_starts, mark_ends, mark_of = runs(_MARK[data], offsets)
    grams = window_hash(hashed(mark_starts, mark_ends), 3)
    places = np.flatnonzero(mark_of[: len(grams)] == mark_of[2:]) if len(grams) else np.zeros(0, np.int64)
    again, _ = _repeated(mark_of[places], grams[places])
    inside = covered(places[again], 3, len(mark_starts))
    out["dup_mark_chars"] = np.bincount(mark_of[inside], (mark_ends - mark_starts)[inside], minlength=n) / some
    base = [("few_words", out["n_words"] < rules.min_words), ("repeated_words", 100 * out["n_repeat_words"] > rules.max_repeat_percent * out["n_words"])]
    over.append(("repeated_lines", (out["dup_line_chars"] > rules.max_duplicate_line_chars + free / 2) | (dup_lines > rules.max_duplicate_lines)))
    out["base_failed"] = base[0][1] | base[1][1]
    bad = out["base_failed"].copy()
    for reason, failed in [*base, *over]:
        reasons[failed & (reasons == None)] = reason  # noqa: E711
        bad |= failed
    return out | {"kept": ~bad, "reason": reasons}


def quality_signals(docs: DataFrame, rules: QualityRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: its id, the signals, base_failed, kept, and the first rule that failed."""
    rules = rules or QualityRules()
    kinds = {np.int64: (T.LongType(), pa.int64()), np.bool_: (T.BooleanType(), pa.bool_()), np.float64: (T.DoubleType(), pa.float64()), object: (T.StringType(), pa.string())}
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(k, kinds[v][0]) for k, v in SIGNALS.items())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = signals(piece.column("text"), rules)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(found[k], kinds[v][1], from_pandas=True) for k, v in SIGNALS.items())], names=["doc_id", *SIGNALS])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(each, schema)


def keep_good(docs: DataFrame, rules: QualityRules | None = None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns."""
    rules = rules or QualityRules()
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, names=[str(i) for i in range(batch.num_columns)])
            for piece in pieces(named, str(at)):
                kept = piece.filter(pa.array(signals(piece.column(at), rules)["kept"]))
                yield pa.RecordBatch.from_arrays(kept.columns, schema=batch.schema)

    return docs.mapInArrow(each, docs.schema)
