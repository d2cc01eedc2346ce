"""Spelling variants: words of a corpus that differ by one character, and the form that each is a variant of.

Two words at distance one agree either in the first half (the error is behind it) or in the second. So each word is looked up twice: in a forward
minimal acyclic automaton of all words that begin with its first half, which is walked exactly and then completed with one error, and,
reversed, in a backward one. Halves are taken of the shorter of the two words, so a word is kept under the halves of its own length and of
one less, and asked for under both. Words are dealt out by a hash of their half, and an automaton is built of each such part; its states count the words behind
them, which numbers the words without a hash table, and the number finds a word's count. Pairs found in both directions or under both lengths are deduplicated.

A half that very many words share is cut into blocks by another hash, each asked by all words of the half, so no part exceeds a bound that a
task holds; parts are as many as the vocabulary needs. The form of a word has at least twice its count, so ways to a root double their counts in each
step and have at most 62; pointers are doubled until none moves.

Defined cases: a null or empty text has no words; a null id is the empty string in the hash; very long texts and words are taken whole; repeated rows count again; ties of counts go to
the smallest word by code points; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Words of one part, and of one block of a half.
PART_WORDS = 1 << 14
BLOCK_WORDS = 1 << 14
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """The minimal acyclic automaton of distinct words in code-point order; each word's number is its place in that order."""

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = [False]
        self.moves: list[dict[str, int]] = [{}]
        register: dict[tuple, int] = {}
        path = [0]  # the states of the last word, not yet minimal
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth + 1:
                state = path.pop()
                key = (self.final[state], *self.moves[state].items())
                known = register.setdefault(key, state)
                if known != state:
                    self.moves[path[-1]][last[len(path) - 1]] = known
                    if state == len(self.moves) - 1:
                        self.moves.pop()
                        self.final.pop()

        for word in words:
            shared = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            settle(shared)
            for c in word[shared:]:
                self.moves.append({})
                self.final.append(False)
                self.moves[path[-1]][c] = len(self.moves) - 1
                path.append(len(self.moves) - 1)
            self.final[path[-1]] = True
            last = word
        settle(0)
        self._count()

    def _count(self) -> None:
        """The words behind each state, and before each move of it."""
        behind = [-1] * len(self.moves)
        self.before: list[dict[str, int]] = [{} for _ in self.moves]
        stack = [0]
        while stack:
            state = stack[-1]
            todo = [t for t in self.moves[state].values() if behind[t] < 0]
            if todo:
                stack += todo
                continue
            stack.pop()
            n = int(self.final[state])
            for c, t in self.moves[state].items():
                self.before[state][c] = n
                n += behind[t]
            behind[state] = n

    def walk(self, state: int, number: int, rest: str) -> tuple[int, int] | None:
        """State and number behind the characters, if there is a way."""
        for c in rest:
            to = self.moves[state].get(c)
            if to is None:
                return None
            number += self.before[state][c]
            state = to
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that have the first `exact` characters of this one and differ by one error behind them."""
        at = self.walk(0, 0, word[:exact])
        found: set[int] = set()
        i = exact
        while at:
            state, number = at
            own = word[i] if i < len(word) else None
            for c, to in self.moves[state].items():
                n = number + self.before[state][c]
                # A character more, or another one, before the rest; one more in a run of equal ones is tried at the run's end only.
                for rest in (() if c == own else (i,) if own is None else (i, i + 1)):
                    end = self.walk(to, n, word[rest:])
                    if end and self.final[end[0]]:
                        found.add(end[1])
            if own is None:
                break
            if i == exact or own != word[i - 1]:  # a character less, the first of a run
                end = self.walk(state, number, word[i + 1 :])
                if end and self.final[end[0]]:
                    found.add(end[1])
            at = self.walk(state, number, own)
            i += 1
        return found

    def number(self, word: str) -> int | None:
        end = self.walk(0, 0, word)
        return end[1] if end and self.final[end[0]] else None


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, often: int = 3, noise: int = 97) -> DataFrame:
    """word, n: words of at least `least` code points that stand at least `often` times, after the deletions that the ids decide."""
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("i"), F.translate(docs[text_col], _CAPITALS, _SMALL).alias("t"))
    runs = rows.select("i", F.explode(F.regexp_extract_all("t", F.lit("([a-z\\u00C0-\\u00FF]+)"), F.lit(1))).alias("run")).where(F.length("run") >= least)
    h = F.crc32(F.concat_ws(":", "i", "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def _half(word: Column, size: Column, backward: bool) -> Column:
    """The first half of a word whose partner and it have at least `size` characters; backward, the second, reversed."""
    # Both halves together have all `size` characters, so an error leaves one of them as it is.
    taken = F.floor((size + 1) / 2) if backward else F.floor(size / 2)
    return F.substring(F.reverse(word) if backward else word, F.lit(1), taken.cast("int"))


def _keyed(words: DataFrame, backward: bool) -> DataFrame:
    """Each word (reversed if backward) under its halves: half, size, text, n."""
    size = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    rows = words.select("word", "n", size)
    return rows.select(_half(F.col("word"), F.col("size"), backward).alias("half"), "size", (F.reverse("word") if backward else F.col("word")).alias("text"), "n")


def _pairs(words: DataFrame, backward: bool, parts: int, block: int) -> DataFrame:
    """word, near, near_n: words at distance one that agree in the half; perhaps more than once."""
    rows = _keyed(words, backward)
    # Only halves with more words than a block are cut: at most two rows for `block` words, whatever the vocabulary.
    crowded = rows.groupBy("half", "size").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    crowded = crowded.select(F.col("half").alias("_half"), F.col("size").alias("_size"), F.ceil(F.col("_n") / block).cast("long").alias("_blocks"))
    rows = rows.join(F.broadcast(crowded), (F.col("half") == F.col("_half")) & (F.col("size") == F.col("_size")), "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).withColumn("held", F.col("block") == F.pmod(F.xxhash64("text"), F.col("_blocks")))
    order = ("half", "size", "block")
    dealt = rows.select(*order, "text", "n", "held").repartition(parts, *order).sortWithinPartitions(*order, F.col("held").desc(), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _parts_of(batches):
            out = _look_up(some, backward)
            for low in range(0, len(out), 1 << 16):
                columns = zip(*out[low : low + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

    return dealt.mapInArrow(each, "word string, near string, near_n long")


@dataclass(slots=True)
class _Row:
    key: tuple[str, int, int]
    text: str
    n: int
    held: bool
    asks: bool = True


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[_Row]]:
    """The rows of a partition, in its order, in parts of about PART_WORDS; a part has all words held under the keys that it asks."""
    some: list[_Row] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("half", "size", "block", "text", "n", "held")]
        for half, size, block, text, n, held in zip(*columns, strict=True):
            key = (half, size, block)
            if len(some) >= PART_WORDS:
                last = some[-1]
                if last.key != key:
                    yield some
                    some = []
                elif not last.held and sum(r.asks for r in some) >= PART_WORDS:
                    # Words that are held come first, so all of this key are here; they stay for those that still ask.
                    yield some
                    some = [replace(r, asks=False) for r in some if r.held and r.key == key]
            some.append(_Row(key, text, n, held))
    if some:
        yield some


def _look_up(some: list[_Row], backward: bool) -> list[tuple[str, str, int]]:
    """The pairs of one part, each under one size: that of the shorter word."""
    counts = {r.text: r.n for r in some if r.held}
    texts = sorted(counts)
    automaton = Automaton(texts)
    shown = (lambda t: t[::-1]) if backward else (lambda t: t)
    out = []
    for r in some:
        if r.asks:
            near = (texts[number] for number in automaton.near(r.text, len(r.key[0])))
            out += [(shown(r.text), shown(t), counts[t]) for t in near if min(len(t), len(r.text)) == r.key[1]]
    return out


def near_words(words: DataFrame, n_words: int, block: int = BLOCK_WORDS) -> DataFrame:
    """word, near, near_n: every pair of words (word, n) at distance one, in both directions, once."""
    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-4 * n_words // PART_WORDS))
    both = reduce(DataFrame.unionAll, [_pairs(words, backward, parts, block) for backward in (False, True)])
    return both.groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form) whose forms lead to no cycle: pointers are doubled until none moves."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(7):  # ways have at most 62 steps
        step = found.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        found = checkpointed(found.join(step, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        if found.where("_moved").isEmpty():
            break
        found = found.drop("_moved")
    return found.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2, block: int = BLOCK_WORDS) -> DataFrame:
    """Per word of the corpus: word, form, root, n, n_near, form_n. A form's count is at least `ratio` (2 or more) times its word's."""
    words = checkpointed(vocabulary(docs, id_col, text_col))
    pairs = near_words(words, words.count(), block)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_b"))
    own = words.join(best.select(F.col("word").alias("_word"), "n_near", F.col("_b.near").alias("near"), (-F.col("_b.m")).alias("near_n")), F.col("word") == F.col("_word"), "left")
    is_form = F.col("near_n") >= ratio * F.col("n")
    own = checkpointed(own.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = _roots(own.where(F.col("form").isNotNull())).withColumnRenamed("word", "_word")
    return own.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
