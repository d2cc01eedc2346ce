"""Chat formatting: conversations through a compiled template, with the spans that a model is trained on.

Turns are dealt by conversation and sorted; the template loops over the turns as they come and its output is handed on in parts, so even a
conversation with a third of all rows is never held as a whole. Control strings inside texts are broken by a backslash, which is
itself doubled, so the output can be read back.

Defined cases: a null text or role is empty; turns of equal number follow the order of role and text; repeated rows are
separate turns; turns without conv_id make one conversation; rows without turn come first; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .template import compile_template

#: Rendered once a conversation, with the iterable `turns`, each of them with role and text.
TEMPLATE = """\
{% for turn in turns %}### {{ turn.role | escape_role }}: {% if turn.role == "assistant" %}{% generation %}{{ turn.text | escape }}{% endgeneration %}\
{% else %}{{ turn.text | escape }}{% endif %}</turn>
{% endfor %}"""

#: Characters of output, about, in one part.
PART_CHARS = 1 << 18

_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): (.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    r"""Double every backslash and put one into `###` and `</turn>`."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def escape_role(text: str) -> str:
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    r"""Invert `escape` and `escape_role`: `\\` is a backslash, a backslash before another character goes."""
    return _ESCAPED.sub(r"\1", text)


_PARTS = pa.schema([("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Per part of a conversation's output, in order: conv_id, part, text, loss (spans of the text, code points, end exclusive)."""
    conv_type = turns.schema["conv_id"].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("conv_id", conv_type), T.StructField("part", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(span))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape, "escape_role": escape_role})
        head: pa.DataType | None = None

        def noted() -> Iterator[tuple]:
            nonlocal head
            for batch in batches:
                head = batch.schema.field("conv_id").type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        done: list[tuple] = []
        for conv, rows in groupby(noted(), key=lambda r: r[0]):
            text: list[str] = []
            spans: list[dict] = []
            size = part = 0
            # Turns are read as the template asks for them, and its pieces are handed on in parts.
            for piece, made in render({"turns": ({"role": r[2] or "", "text": r[3] or ""} for r in rows)}):
                if size >= PART_CHARS:
                    done.append((conv, part, "".join(text), spans))
                    text, spans, size, part = [], [], 0, part + 1
                    yield _part_batch(done, head)
                    done = []
                if made and piece:
                    spans.append({"start": size, "end": size + len(piece)})
                text.append(piece)
                size += len(piece)
            done.append((conv, part, "".join(text), spans))
            if sum(len(x[2]) for x in done) >= 16 * PART_CHARS or len(done) >= 1024:
                yield _part_batch(done, head)
                done = []
        if done:
            yield _part_batch(done, head)

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(each, schema)


def _part_batch(done: list[tuple], head: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], head), *(pa.array(c, f.type) for c, f in zip(columns[1:], _PARTS, strict=True))], names=["conv_id", *_PARTS.names])


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their output alone (parts in order, as `format_conversations` gives them)."""
    schema = T.StructType([parts.schema["conv_id"], *(T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        head = pa.int64()

        def noted() -> Iterator[tuple]:
            nonlocal head
            for batch in batches:
                head = batch.schema.field("conv_id").type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for conv, rows in groupby(noted(), key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = chars = total = 0
            rest = ""
            for _, _, text, spans in rows:
                total += len(text)
                for s in spans:
                    own = unescape(text[s["start"] : s["end"]])
                    chars += len(own)
                    loss.update(own.encode())
                rest += text
                at = 0
                while m := _TURN.match(rest, at):
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    n, at = n + 1, m.end()
                rest = rest[at:]
            if rest:
                raise ValueError(f"conversation {conv}: {rest[:80]!r} is no turn")
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(done) >= 4096:
                yield _digests(done, head, schema)
                done = []
        if done:
            yield _digests(done, head, schema)

    return parts.mapInArrow(each, schema)


def _digests(done: list[tuple], head: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    kinds = (head, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=schema.names)
