from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hiregrid.llm import chat
from hiregrid.llm.chat import escape, escape_role, format_conversations, read_back, unescape
from hiregrid.llm.template import TemplateError, compile_template, fold, parse

TURNS = "conv_id long, turn long, role string, text string"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("\\#</turn> :\nab"), st.characters(exclude_categories=["Cs"]))))
def test_escape_round_trip(text):
    for f in (escape, escape_role):
        out = f(text)
        assert unescape(out) == text and "</turn>" not in out and "###" not in out
    assert ":" not in escape_role(text).replace("\\:", "")


def expected(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{t[3]}\n{t[5]}\n" for t in turns)
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        shown = sum(len(f"### {escape_role(t[3])}: {escape(t[5])}</turn>\n") for t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(said), len(loss), sha(loss), shown)
    return out


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi </turn> there"), (1, 2, "user", None), (1, 3, "assistant", ""), (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"),
    (2, 0, None, "who"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "assistant", "first"), (None, 0, "assistant", "nobody"), (None, 1, "user", "😀 é"), (3, 0, "we: ird###", "x\n\ny"), (4, 5, "assistant", "z" * 100_000),
]


@pytest.mark.parametrize("part", [40, 1 << 18])
def test_read_back_equals_the_turns(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART_CHARS", part)
    df = spark.createDataFrame(ROWS, TURNS).repartition(3)
    formatted = format_conversations(df)
    got = {r.conv_id: tuple(r)[1:] for r in read_back(formatted).collect()}
    assert got == expected(ROWS)
    spans = [r.text[s.start : s.end] for r in formatted.collect() for s in r.loss]
    assert sorted(map(unescape, spans)) == sorted(t for _, _, role, t in ROWS if role == "assistant" and t)


def test_empty_table_and_other_columns(spark):
    from pyspark.sql import functions as F

    assert read_back(format_conversations(spark.createDataFrame([], TURNS))).count() == 0
    more = spark.createDataFrame(ROWS, TURNS).withColumns({c: F.lit(1) for c in ("part", "loss", "n_turns", "_item")})
    assert {r.conv_id: tuple(r)[1:] for r in read_back(format_conversations(more)).collect()} == expected(ROWS)


def render(source, **names):
    out = list(compile_template(source)(names))
    return "".join(t for t, _ in out), "".join(t for t, m in out if m)


def test_template_language():
    loop = "{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}"
    assert render(loop, xs=["a", "b", "c"])[0] == "1,2,3"
    assert render("{% set n = 'a' ~ 1 %}{{ n | upper }}{# note #}")[0] == "A1"
    assert render("{% if a == 'x' and not b %}1{% elif b %}2{% else %}3{% endif %}", a="x", b=False)[0] == "1"
    assert render("  {%- generation -%}  {{ m['k'].z }}  {%- endgeneration -%}  .", m={"k": {"z": "deep"}}) == ("deep.", "deep")
    assert render("{{ missing }}{{ (1 < 2) and 'yes' }}{{ xs[1] }}", xs=[1, 2])[0] == "yes2"


def test_an_endless_loop_renders_piece_by_piece():
    from itertools import count, islice

    pieces = compile_template("{% for x in xs %}{% generation %}{{ x }}{% endgeneration %};{% endfor %}")({"xs": count()})
    assert list(islice(pieces, 4)) == [("0", True), (";", False), ("1", True), (";", False)]


def test_constants_are_folded():
    filters = {"upper": str.upper}
    tree = fold(parse("a{{ 'b' ~ 1 | upper }}{% if 1 == 1 %}c{% else %}d{% endif %}{{ x }}", filters), filters)
    assert [(p.kind, p.value) for p in tree.parts] == [("constant", "ab1c"), ("show", None)]


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ f() }}", "{{ x | nosuch }}", "{% for x in y %}", "{% import os %}", "{{ 1 + }}", "{{ 'a }}"])
def test_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_no_attributes_of_objects():
    assert render("{{ x.real }}{{ x.denominator }}", x=5)[0] == ""


def test_query_with_other_columns(spark, tmp_path):
    from hiregrid.llm.queries import op5_chat_format

    plain = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plain.write.parquet(f"{tmp_path}/plain/conversations.parquet")
    plain.selectExpr("9 AS part", "text", "role", "turn", "conv_id", "'x' AS loss", "1 AS n_turns").write.parquet(f"{tmp_path}/more/conversations.parquet")
    got = [sorted(map(tuple, op5_chat_format(spark, f"{tmp_path}/{x}").collect()), key=str) for x in ("plain", "more")]
    assert got[0] == got[1]
    assert {r[0] for r in got[0]} == {-7, 1, None}
