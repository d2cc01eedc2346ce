r"""Secret scans: patterns of known kinds, and a token-efficiency test for random strings.

Texts are searched as a whole. Known kinds are regular expressions. The method finds more: a run of characters that keys are
written in, which a byte-pair vocabulary can only cut into many short tokens, is a random string; digests of known lengths, UUIDs, numbers
and spans already found are left out first. Letters alone have to be cut shorter than letters with digits, for long compound words of many
languages come near.

Defined cases: a null or empty text has no spans; repeated rows each get their own result; null ids are carried; an empty
table gives an empty table; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import flat, pieces, runs

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_SIGNS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_KEY = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") for b in range(256)])
#: Digests of 128 to 512 bits in hex, and UUIDs: identifiers, not keys.
_KNOWN = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{48}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|sha\d+-\S+)")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


@dataclass(frozen=True)
class SecretRules:
    min_assigned: int = 6
    min_access: int = 20
    min_hex: int = 24
    #: A random string has at least so many characters, ...
    min_random: int = 20
    #: ... and at most so many for each token; without digits so many.
    max_chars_per_token: float = 1.9
    max_letters_per_token: float = 1.75


class Scanner:
    def __init__(self, vocabulary: str, rules: SecretRules, pattern: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.rules = rules

    def is_random(self, run: str) -> bool:
        if _KNOWN.fullmatch(run) or not _LETTER.search(run):
            return False
        most = self.rules.max_chars_per_token if _DIGIT.search(run) else self.rules.max_letters_per_token
        return len(run) <= most * len(self.encode(run))

    def scan(self, texts: pa.StringArray) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text's spans, by start and then kind as listed."""
        rules = self.rules
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        data, offsets = flat(texts)
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        starts, ends, of = runs(_HEX[data], offsets)
        long_ = ends - starts >= rules.min_hex
        for a, b, d in zip(starts[long_].tolist(), ends[long_].tolist(), of[long_].tolist(), strict=True):
            base = points[offsets[d]]
            found[d].append((int(points[a] - base), 2, int(points[b] - base)))
        for d, text in enumerate(texts.to_pylist()):
            if not text:
                continue
            small = text.lower()
            if any(s in small for s in _ASSIGN_SIGNS):
                found[d] += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= rules.min_assigned]
            if "AKIA" in text:
                found[d] += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= rules.min_access]
        starts, ends, of = runs(_KEY[data], offsets)
        long_ = ends - starts >= rules.min_random
        at, known, ends_so_far = -1, [], []
        for a, b, d in zip(starts[long_].tolist(), ends[long_].tolist(), of[long_].tolist(), strict=True):
            if d != at:
                at, known = d, sorted(found[d])
                ends_so_far = list(accumulate((z for _, _, z in known), max))
            base = points[offsets[d]]
            low, high = int(points[a] - base), int(points[b] - base)
            before = bisect_left(known, (high,))
            if not (before and ends_so_far[before - 1] > low) and self.is_random(data[a:b].tobytes().decode()):
                found[d].append((low, 3, high))
        return [[(a, b, KINDS[k]) for a, k, b in sorted(x)] for x in found]


_scanners: dict[tuple, Scanner] = {}


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, rules: SecretRules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, the number of spans of each kind, base_sha256 over those of known kinds, spans."""
    rules = rules or SecretRules()
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, pattern, rules)
        if key not in _scanners:
            _scanners[key] = Scanner(vocabulary, rules, pattern)
        for batch in batches:
            for piece in pieces(batch, "text"):
                spans = _scanners[key].scan(piece.column("text"))
                counts = [pa.array([sum(s[2] == k for s in own) for own in spans], pa.int64()) for k in KINDS]
                shown = [[f"{k}:{a}:{b}" for a, b, k in own] for own in spans]
                base = [hashlib.sha256(",".join(x for x in own if not x.startswith(KINDS[3])).encode()).hexdigest() for own in shown]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *counts, pa.array(base), pa.array([",".join(own) for own in shown])], names=schema.names)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(each, schema)
