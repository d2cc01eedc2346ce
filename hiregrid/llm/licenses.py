"""Licence scans: short notices found with a bounded number of edits.

A text is brought to words with one space between them. A notice that may hold k edits is cut into k + 1 pieces; by the pigeonhole principle
one piece stands unedited in every place where the notice does, so an automaton of all pieces (one pass over the text) gives the candidates. Around each
candidate the `regex` library matches the whole notice with at most k edits, in a window as wide as those edits allow; windows that overlap
are one. The words that tell a licence from another (its name, its version) have to stand unedited in a match. Notices are
counted where their words stand exactly as well; those of the base do so at all places, overlapping ones included.

Defined cases: a null or empty text has no words and score 0; very long texts are taken whole (time grows with the text and its candidates, memory with the
text); of notices that match the same place all count, of equal spans one; repeated rows each get their own result; null ids are carried; an
empty table gives an empty table; other columns are ignored. Spans are code points of the text, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    #: Edits (characters inserted, deleted or replaced) that a match may hold. The time of a match grows tenfold with every two: 3 are 0.2 ms, 11 are seconds.
    edits: int = 0
    #: Words that have to stand unedited.
    needs: tuple[str, ...] = ()
    #: Whether its exact places are counted.
    base: bool = False


# The phrases that have to be counted, and wordings of well-known notices.
NOTICES = (
    Notice("mit", "under the mit license", 2, ("mit",), base=True),
    Notice("apache-2", "apache license version 2", 2, ("apache", "2"), base=True),
    Notice("cc-by-nc", "cc by nc", base=True),
    Notice("mit", "permission is hereby granted free of charge to any person", 3),
    Notice("apache-2", "licensed under the apache license 2 0", 3, ("apache", "2")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3, ("creative", "commons")),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3, ("creative", "commons")),
    Notice("cc-by", "creative commons attribution 4 0", 2, ("creative", "commons", "4")),
    Notice("cc0", "cc0 1 0 universal", 1, ("cc0",)),
    Notice("gpl-2", "gnu general public license version 2", 3, ("gnu", "general", "2")),
    Notice("gpl-3", "gnu general public license version 3", 3, ("gnu", "general", "3")),
    Notice("lgpl", "gnu lesser general public license", 3, ("lesser",)),
    Notice("agpl", "gnu affero general public license", 3, ("affero",)),
    Notice("mpl-2", "mozilla public license version 2", 3, ("mozilla", "2")),
    Notice("epl-2", "eclipse public license version 2", 3, ("eclipse", "2")),
    Notice("bsd", "redistribution and use in source and binary forms with or", 3),
    Notice("isc", "copy modify and or distribute this software for any purpose", 3),
    Notice("unlicense", "this is free and unencumbered software", 3),
    Notice("boost", "boost software license version 1 0", 3, ("boost", "1")),
    Notice("zlib", "the origin of this software must not be misrepresented", 3),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Every byte that no word has becomes a space, A-Z small letters.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def pieces_of(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece): the notice in edits + 1 pieces of nearly equal length."""
    n = notice.edits + 1
    cuts = [len(notice.phrase) * i // n for i in range(n + 1)]
    return [(a, notice.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Match:
    """A notice at [start, end) of the words' text, with so many edits."""

    notice: Notice
    start: int
    end: int
    edits: int


class NoticeFinder:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        self.notices = notices
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, piece in pieces_of(notice):
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), tuple(uses)))
        self.automaton.make_automaton()
        self.fuzzy = [regex.compile(f"(?:{n.phrase}){{e<={n.edits}}}", regex.ENHANCEMATCH) for n in notices]

    def find(self, text: str) -> list[Match]:
        """All matches in words with a space before, between and behind them; exact places and edited ones."""
        places: list[set[int]] = [set() for _ in self.notices]
        for last, (size, uses) in self.automaton.iter(text):
            for i, offset in uses:
                places[i].add(last + 1 - size - offset)
        out = []
        for i, found in enumerate(places):
            if found:
                out += self._matches(i, text, sorted(found))
        return out

    def _matches(self, i: int, text: str, found: list[int]) -> Iterator[Match]:
        notice = self.notices[i]
        size, k = len(notice.phrase), notice.edits
        exact = [p for p in found if p > 0 and text.startswith(notice.phrase, p) and text[p - 1] == " " and text[p + size] == " "]
        for p in exact:
            yield Match(notice, p, p + size, 0)
        if not k:
            return
        windows: list[list[int]] = []
        for p in found:
            low, high = max(p - k, 0), min(p + size + k, len(text))
            if windows and low < windows[-1][1]:
                windows[-1][1] = high
            else:
                windows.append([low, high])
        known = set(exact)
        for low, high in windows:
            wide = text[text.rfind(" ", 0, low + 1) : text.find(" ", high - 1) + 1]
            if not all(f" {w} " in wide for w in notice.needs):
                continue
            for m in self.fuzzy[i].finditer(text, low, high):
                a, b = m.span()
                if a in known:
                    continue
                own = text[text.rfind(" ", 0, a + 1) + 1 : text.find(" ", b - 1)].split()
                if all(w in own for w in notice.needs):
                    yield Match(notice, a, b, sum(m.fuzzy_counts))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, str]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:start:end:edits) of one text."""
        words = (text or "").encode().translate(_PLAIN).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, ""
        plain = f" {b' '.join(words).decode()} "
        matches = self.find(plain)
        if not matches:
            return len(words), 0, None, None, "", "", 0.0, ""
        spaces = np.flatnonzero(np.frombuffer(plain.encode("utf-32-le"), np.uint32) == 0x20)
        base = [m for m in matches if m.notice.base and not m.edits and plain[m.start - 1] == " " and plain[m.end] == " "]
        starts = np.searchsorted(spaces, [m.start for m in base]) - 1
        bounds = [m.span() for m in _WORD.finditer(text)]
        of = lambda at: int(np.searchsorted(spaces, at, side="right")) - 1  # noqa: E731  the word at a place, or behind a space
        spans = sorted({(bounds[min(of(m.start), len(words) - 1)][0], bounds[min(of(m.end - 1 - (plain[m.end - 1] == " ")), len(words) - 1)][1], m.notice.label, m.edits) for m in matches})
        return (
            len(words), len(base), int(starts.min()) if base else None, int(starts.max()) if base else None,
            ",".join(sorted({m.notice.label for m in base})), ",".join(sorted({m.notice.label for m in matches})),
            max(1 - m.edits / len(m.notice.phrase) for m in matches), ",".join(f"{label}:{a}:{b}:{e}" for a, b, label, e in spans),
        )


_COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string()}
_finders: dict[tuple, NoticeFinder] = {}


def find_notices(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans. No shuffle."""
    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, kinds[t]) for n, t in _COLUMNS.items())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if notices not in _finders:
            _finders[notices] = NoticeFinder(notices)
        for batch in batches:
            rows = [_finders[notices].scan(x.as_py()) for x in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else ([] for _ in _COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _COLUMNS.values(), strict=True))], names=schema.names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(each, schema)
