"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language accepts all its substrings. A text is parsed greedily: the longest match in the
language's text is one phrase, the next phrase begins where it ends. A language whose text is like it needs few,
long phrases; phrases * log2(reference length) / text length estimates the cross entropy, and the smallest wins. The reference length is one for
all, the longest: a pointer into a shorter sample would look cheaper, and a tiny sample, in which each byte is a phrase, would win every text.

The automata are walked as tables over bytes of lower-cased text, many stretches of text at a time in numpy. Each stretch is first walked
from the root; then those whose predecessor ends in another state are walked again from that state, until they meet their first walk. So
phrases go on across stretches, and the result is that of one unbroken parse of the whole text. Fitting takes a bounded sample:
documents in the order of a hash of their id, up to SAMPLE_BYTES for each language and SAMPLE_TOTAL for all; of more than MOST_LANGUAGES labels the
rarer are not learned, nor is one whose sample has no letter.

Defined cases: a null text or one without letters is `und` with score 0, as is every text if nothing is labelled; a tie goes to the
first language by name; very long texts are parsed whole, by segments that hand on their state; repeated rows get equal results; null ids are carried; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat, pieces

#: Bytes of labelled text behind each language's automaton and behind all (which share them evenly), and documents drawn for each.
SAMPLE_BYTES = 32_768
SAMPLE_TOTAL = 1 << 19
SAMPLE_DOCS = 48
MOST_LANGUAGES = 512
#: Bytes that one lane of a walk takes, and bytes of a text in one walk; a matter of time and memory, not of results.
STRETCH = 256
SEGMENT = 1 << 22

_SPACE = 0x20


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    longest, link = [0], [-1]
    last = 0
    for c in text:
        now = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[now] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                link[q] = link[now] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = now
    return moves


def normal_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 in which every run of ASCII characters other than letters is one space; bounds of each text."""
    data, offsets = flat(pc.utf8_lower(texts.fill_null("") if texts.null_count else texts))
    kept = _LETTER[data]
    data = np.where(kept, data, np.uint8(_SPACE))
    again = np.zeros(len(data), bool)
    again[1:] = ~kept[1:] & ~kept[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    at = np.concatenate([[0], np.cumsum(~again)])
    return data[~again], at[offsets]


_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


class CrossParser:
    """One walk table for each language."""

    def __init__(self, samples: dict[str, bytes], stretch: int = STRETCH, segment: int = SEGMENT) -> None:
        self.stretch, self.segment = stretch, segment
        self.languages = sorted(samples)
        self.bits = np.log2(max(map(len, samples.values()), default=0) + 1)
        self.tables = [self._table(samples[x]) for x in self.languages]

    @staticmethod
    def _table(sample: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The number of each byte, and entries of (next state * width) * 2, and 1 more if a phrase begins with this byte."""
        seen = sorted(set(sample))
        symbol = np.full(256, len(seen), np.int32)
        symbol[seen] = np.arange(len(seen))
        moves, width = suffix_automaton(sample), len(seen) + 1
        table = np.full((len(moves), width), -1, np.int64)
        for state, row in enumerate(moves):
            for c, to in row.items():
                table[state, symbol[c]] = to * width * 2
        # A phrase begins at the root, with a byte that can't go on, and with one that no phrase has, which is a phrase by itself.
        table[0] = fresh = np.where(table[0] < 0, 0, table[0]) | 1
        return symbol, np.where(table < 0, fresh, table).astype(np.int32 if len(moves) * width < 1 << 30 else np.int64).ravel()

    def _walk(self, table: np.ndarray, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One unbroken parse of each range from its state: the phrases that begin in it, and its last state."""
        each = -(-(ends - starts) // self.stretch)
        of = np.repeat(np.arange(len(starts)), each)
        first = np.cumsum(each) - each
        low = starts[of] + self.stretch * (np.arange(len(of)) - first[of])
        high = np.minimum(ends[of], low + self.stretch)
        head = np.zeros(len(of), bool)
        head[first[each > 0]] = True
        path, begins = np.zeros(max(len(symbols), 1), table.dtype), np.zeros(len(symbols), bool)

        def run(lanes: np.ndarray, now: np.ndarray, again: bool) -> None:
            length = high[lanes] - low[lanes]
            order = np.argsort(-length, kind="stable")
            at, now, left = low[lanes][order], now[order], length[order]
            for k in range(self.stretch):
                alive = left > k
                if not alive.all():
                    at, now, left = at[alive], now[alive], left[alive]
                if not len(at):
                    return
                step = table[now + symbols[at + k]]
                now = step >> 1
                if again:
                    apart = now != path[at + k]
                    begins[at + k] = step & 1
                    if not apart.all():
                        at, now, left = at[apart], now[apart], left[apart]
                    path[at + k] = now
                else:
                    path[at + k], begins[at + k] = now, step & 1

        given = np.where(head, state[of], 0)
        run(np.arange(len(of)), given, False)
        todo = np.flatnonzero(~head)
        while len(todo):
            entered = path[low[todo] - 1].astype(np.int64)
            changed = entered != given[todo]
            todo, entered = todo[changed], entered[changed]
            given[todo] = entered
            last = path[high[todo] - 1].copy()
            run(todo, entered, True)
            # Lanes behind one whose last state has changed are walked again.
            todo = todo[path[high[todo] - 1] != last] + 1
            todo = todo[todo < len(of)]
            todo = todo[~head[todo]]
        total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
        return total[ends] - total[starts], np.where(ends > starts, path[np.maximum(ends, 1) - 1], state)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, (symbol, table) in enumerate(self.tables):
            state, rows, low = np.zeros(len(out), np.int64), np.arange(len(out)), offsets[:-1]
            while len(rows):
                high = np.minimum(low + self.segment, offsets[1:][rows])
                # Texts of a buffer follow each other; only one longer than a segment comes here again, by itself.
                base = int(low[0])
                count, state = self._walk(table, symbol[data[base : int(high.max())]], low - base, high - base, state)
                out[rows, i] += count
                more = high < offsets[1:][rows]
                rows, low, state = rows[more], high[more], state[more]
        return out

    def predict(self, texts: pa.StringArray) -> tuple[list[str], np.ndarray]:
        """The language and the score of each text: 1 less the share of the best entropy in the second best."""
        data, offsets = normal_bytes(texts)
        lettered = np.diff(np.concatenate([[0], np.cumsum(data != _SPACE)])[offsets]) > 0
        plain = np.diff(np.concatenate([[0], np.cumsum((data != _SPACE) & (data < 0x80))])[offsets]) > 0
        for i in np.flatnonzero(lettered & ~plain):
            lettered[i] = any(c.isalpha() for c in texts[int(i)].as_py())
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        entropy = self.phrases(data, offsets) * self.bits
        best = entropy.argmin(axis=1)
        two = np.sort(entropy, axis=1)[:, :2]
        score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9) if two.shape[1] > 1 else np.ones(len(texts))
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def held_out(doc_id: Column) -> Column:
    """Documents of this fold are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """Automata from a bounded sample of the labelled documents outside the held-out fold."""
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"), docs[lang_col].alias("l")).where(F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return CrossParser({})
    most = min(SAMPLE_BYTES, SAMPLE_TOTAL // len(counts))
    place = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(7)), F.lit(1 << 40))
    limit = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, SAMPLE_DOCS / n) * (1 << 40)))))
    sample: dict[str, bytes] = {}
    drawn = rows.where(place < F.element_at(limit, F.col("l"))).select("l", F.substring("t", 1, most).alias("t"), place.alias("p"))
    # For each language by itself, so that many rows of one id take no other's place.
    drawn = drawn.withColumn("k", F.row_number().over(W.partitionBy("l").orderBy("p", "t"))).where(F.col("k") <= 2 * SAMPLE_DOCS)
    for row in drawn.orderBy("l", "k").collect():
        own = sample.setdefault(row["l"], b"")
        if len(own) < most:
            sample[row["l"]] = (own + normal_bytes(pa.array([row["t"]]))[0].tobytes() + b" ")[:most]
    return CrossParser({k: v for k, v in sample.items() if any(c.isalpha() for c in v.decode(errors="ignore"))})


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row of `docs`: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col))
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    schema = T.StructType([*rows.drop("text").schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                langs, score = shared.value.predict(piece.column("text"))
                yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(langs, pa.string()), pa.array(score)], names=schema.names)

    return rows.mapInArrow(each, schema)
