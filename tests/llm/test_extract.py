from __future__ import annotations

from html import escape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hiregrid.llm.extract import Block, BlockRules, blocks, extract_main_text, first_pass, main_text, second_pass, weigh_parts

RULES = BlockRules()
LONG = "the cat and the dog of the house are in the garden with a ball " * 4
PAGE = """<!DOCTYPE html><html lang="en"><head><title>Title</title><style>p{{margin:0}}</style><script>var t="</p>";track(1);</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad <p>x</p> --><div class="ad">Buy the best of it now.</div>
<div class="cookie-notice">This site uses cookies, and you have to accept them to go on reading all of its pages.</div>
<article><h1>Short.</h1><p><b>{0}<br><p>{1}&amp; R&#233;sum&eacute;</p><p>Tiny.</p><ul><li>one item<li>two &lt;items&gt;</ul><div class="share"><a href=x>Share</a></div></article>
<aside>{1}</aside><form>{1}<input type=text></form><section id="comments"><p>{1}</p></section><footer>&copy; example</footer></body></html>"""


def test_a_page_with_everything():
    assert main_text(PAGE.format("Bold  start\n of it", LONG), RULES).split("\n") == ["Short.", "Bold start of it", LONG + "& Résumé", "Tiny.", "one item", "two <items>"]


def test_a_page_without_an_article():
    page = f"<div><a href=x>Home</a> <a href=y>About</a></div><div><h2>Heading</h2><p>{LONG}<p>Brief note here.<p>{LONG}</div><div class=comments><p>{LONG}</div><p>contact us</p><footer>{LONG}</footer>"
    text = LONG.strip()
    assert main_text(page, RULES).split("\n")[:4] == ["Heading", text, "Brief note here.", text]


FEW = "xylem quartz bronze fjord vortex nymph " * 6  # long, without stop words


def test_stop_words_decide_without_an_article():
    page = f"<div><p>{LONG}<p>{FEW}<p>{LONG}</div>"
    text = LONG.strip()
    assert main_text(page, RULES).split("\n") == [text, text]
    assert main_text(page, BlockRules(stop_words=frozenset())) == ""


def test_ambiguous_blocks_follow_their_neighbours():
    page = f"<ul><li><a href=a>Home</a></ul><p>menu note</p><ul><li><a href=b>More</a></ul><h2>Title</h2><p>{LONG}</p><p>short words</p><p>{LONG}</p><p>after</p><ul><li><a href=c>One</a><li><a href=d>Two</a></ul><h3>Links</h3><ul><li><a href=e>x</a></ul>"
    text = LONG.strip()
    assert main_text(page, RULES).split("\n") == ["Title", text, "short words", text, "after"]
    found, parts, around = blocks(page)
    weigh_parts(found, parts, around)
    first_pass(found, RULES)
    assert "short words" not in [b.text for b in found if b.label]


def test_both_passes_decide_inside_an_article():
    page = f"<article><h1>Head</h1><p>{LONG}</p><p>{FEW}</p><ul><li><a href=a>Other story</a></ul><p>see also</p><ul><li><a href=b>Third story</a></ul></article>"
    assert main_text(page, RULES).split("\n") == ["Head", LONG.strip(), FEW.strip()]  # the ambiguous paragraph has text before and links behind
    assert main_text(page.replace(f"<p>{FEW}</p><ul>", f"<ul><li><a href=c>x</a></ul><p>{FEW}</p><ul>"), RULES).split("\n") == ["Head", LONG.strip()]
    # Nothing decided: blocks without a stop word are no text, one stop word in any of them is enough, as is being short.
    assert main_text(f"<nav>x</nav><article><p>{FEW}</p><p>Tiny</p></article>", RULES) == ""
    assert main_text(f"<nav>x</nav><article><p>{FEW}</p><p>The tiny</p></article>", RULES).split("\n") == [FEW.strip(), "The tiny"]
    assert main_text("<nav>x</nav><article><h1>Head</h1><p>Tiny</p></article>", RULES).split("\n") == ["Head", "Tiny"]


def test_density_decides_every_block_of_an_article():
    page = f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><p>Tiny</p></article>"
    assert len(main_text(page, RULES).split("\n")) == 4
    assert main_text(page, BlockRules(stop_words=frozenset())) == ""
    found, parts, around = blocks(page)
    weigh_parts(found, parts, around)
    first_pass(found, RULES)
    assert [b.label for b in found] == [None, True, True, None]


@pytest.mark.parametrize("wrapper", ['<div class="comments-open">', '<div class="comment-list-page">', '<div class="post comments-closed">', '<div class="hentry comments-open"><div>'])
def test_wrappers_that_only_tell_of_comments(wrapper):
    for inner in (f"<article><p>{LONG}</p><p>Tiny</p></article>", f"<p>{LONG}</p><p>Tiny</p>"):
        assert main_text(f"{wrapper}{inner}<ol class='comment-list'><li class='comment'><p>{LONG}</p></ol></div>", RULES).split("\n") == [LONG.strip(), "Tiny"]


@given(st.lists(st.tuples(st.sampled_from([None, None, True, False]), st.booleans(), st.sampled_from([0, 0, 1, 2]), st.booleans(), st.sampled_from(["x", "the", FEW])), max_size=12))
def test_second_pass_against_brute_force(shape):
    found = [Block(text, 0, 0, main, heading, boiler=boiler and label is False, label=label) for label, heading, main, boiler, text in shape]
    want = []
    marked = any(b.main and not b.boiler for b in found)
    for i, b in enumerate(found):
        if b.label is not None:
            want.append(b.label)
            continue
        known = [k for k, x in enumerate(found) if x.label is not None and not x.boiler]
        sides = [[k for k in known if k < i][-1:], [k for k in known if k > i][:1]]
        near = [k for k in sum(sides, []) if not b.main or found[k].main == b.main]
        nearest = [found[k].label for k in near if abs(k - i) == min(abs(j - i) for j in near)]
        alike = [x.text for x in found if x.label is None and x.main == b.main]
        alone = FEW not in alike or "the" in alike
        if b.main:
            want.append(any(found[k].label for k in near) if near else alone)
        elif not any(found[k].label for k in near):
            want.append(not near and not marked and alone)
        elif b.heading:
            want.append(bool(sides[1]) and found[sides[1][0]].label)
        else:
            want.append(all(nearest) if marked else any(nearest))
    second_pass(found, RULES)
    assert [b.label for b in found] == want


@pytest.mark.parametrize("wrapper", ['<div class="layout has-sidebar">', '<div id="no-header">', '<div class="sidebar-layout">', "<form>", '<div class="with-nav site-search-result page-share">'])
def test_wrappers_that_name_boilerplate(wrapper):
    for page in (f"{wrapper}<nav><a href=a>x</a></nav><article><p>{LONG}</p><p>Tiny</p></article></div></form>", f"{wrapper}<p>{LONG}</p><p>Tiny</p></div></form><footer>no</footer>"):
        assert main_text(page, RULES).split("\n") == [LONG.strip(), "Tiny"]


def test_names_inside_an_article_leave_the_decision_to_density():
    page = f'<article><p>{LONG}</p><section class="related side tags"><p>{LONG}</p></section><div class="related"><a href=a>Other</a></div><div class="ad-slot">{LONG}</div><div class="comment-list"><p>{LONG}</p></div></article>'
    assert main_text(page, RULES).split("\n") == [LONG.strip()] * 2


def test_comments_longer_than_the_text_stay_out():
    assert main_text(f"<p>{LONG}</p><div id=comments>{f'<article><p>{LONG}</p></article>' * 9}</div>", RULES) == LONG.strip()


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("<p", ""), ("<script>alert(1)", ""), ("<!-- open", ""), ("<nav>x</nav>", ""), ("<article><p>a<b>b</article>", "ab"), ('<article><p title="a>b">c</p></article>', "c"), ("<article><p>1 < 2 && 3 > 2</article>", "1 < 2 && 3 > 2")])
def test_broken_pages(html, text):
    assert main_text(html, RULES) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab <>&;é\n\t", min_size=1, max_size=30), max_size=6))
def test_paragraphs_come_back(parts):
    html = "<nav><a href=x>no</a></nav><article>" + "".join(f"<p>{escape(p)}</p>" for p in parts) + "</article><footer>no</footer>"
    assert main_text(html, RULES) == "\n".join(t for p in parts if (t := " ".join(p.split())))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ap\"'=!- &;", max_size=60))
def test_any_markup_is_read(html):
    main_text(html, RULES)


def test_long_hostile_pages_end():
    for html in ("<" * 200_000, "<p " * 50_000, '<a "' * 50_000, "<div>" * 20_000 + "x", "<!--" * 50_000, "&" * 200_000):
        main_text(html, RULES)


def test_query(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", PAGE.format("Bold", LONG)), (1, "u", PAGE.format("Bold", LONG)), (None, None, None), (2, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for pages in (df, df.withColumns({"text": F.lit(1), "n_chars": F.lit("x")})):
        got = sorted(((r.page_id or 0, r.url, r.n_chars, len(r.text)) for r in extract_main_text(pages).collect()), key=str)
        n = len(main_text(rows[0][2], RULES))
        assert got == sorted([(1, "u", n, n), (1, "u", n, n), (0, None, 0, 0), (2, None, 0, 0)], key=str)
    assert extract_main_text(df.limit(0)).count() == 0
