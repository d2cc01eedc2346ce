"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels every block by its link density, its length and its density of stop
words: linked ones are boilerplate, long enough ones with many stop words are text, very long ones with none are boilerplate. Short blocks, and long ones with few stop words, stay ambiguous; in the
second pass they take the label of the nearest decided neighbours, a heading that of what follows it. Without a neighbour that is text, blocks
are text together if a stop word stands in any of them or all are short, so what a page says in a language whose stop words the rules don't know is not text.

Markup weighs on the thresholds. Elements whose tag, role or class says that they are what density can't tell from text
(menus, headers, footers, sidebars, notices, adverts, forms, comments) need more stop words than a text can have, unless such an element holds the page's
article or, on a page without one, most of its text. An `article` or `main` part lowers the density that its blocks need and keeps their neighbours
to themselves; beside it, blocks need more, unless most of the page's text is there.

Defined cases: null or empty html gives an empty text; broken markup is read as far as it goes (an unclosed script, style or comment
hides the rest); a very long page is read whole, by one task; between two equally near neighbours of different labels text wins, beside an article boilerplate; repeated rows each get their own result; null ids and urls are carried; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class BlockRules:
    max_link_density: float = 0.4
    #: Characters from which a block is decided by its own features.
    short: int = 70
    #: Characters from which a block needs only half the stop words.
    long: int = 200
    min_stop_density: float = 0.20
    #: Stop words that a block of an article needs.
    min_main_density: float = 0.10
    stop_words: frozenset[str] = field(default_factory=lambda: STOP_WORDS)


# Frequent function words of the languages that pages are expected in.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur sich sie sind und von war was wie wir zu zum zur "
    "al como con cuando de del desde donde el ella en entre era es esta este fue ha la las lo los más me muy no o para pero por que se si sin sobre son su sus también un una y ya "
    "che di da il lo gli ma mi non per più questo sono del della dei alla nel os as do da dos das em na no um uma para com não mais van het een en dat die niet zijn op te".split()
)
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul video audio".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas noframes noembed xmp".split())
_BOILER_TAGS = frozenset("nav footer aside form menu button select fieldset dialog head".split())
_MAIN_TAGS = frozenset(["article", "main"])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# What a class or id begins with on parts that read like text but aren't the article's.
_BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar header footer masthead "
    "cookie cookies consent gdpr notice notices newsletter signup disclaimer copyright".split()
)
# Whole classes and ids of readers' comments; blog software also writes comments-open and the like on what holds the article.
_COMMENT_NAMES = frozenset("comment comments comment-list comments-list commentlist comments-area comment-area comment-section comments-section comment-body comment-content comment-respond respond disqus disqus_thread".split())
_OUTSIDE_MAIN_ONLY = frozenset(["header"])  # an article's own header holds its title
# An attribute's value may hold a ">"; the possessive parts keep an unclosed quote from being tried again and again.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"(?<!\S)[A-Za-z]+(?![A-Za-z])")  # the head of each class
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    part: int  # number of the innermost enclosing part that markup says is boilerplate, 0 outside
    main: int  # number of the enclosing article or main part, 0 outside
    heading: bool
    boiler: bool = False
    label: bool | None = None


@dataclass(slots=True)
class Part:
    """An element that by its markup is boilerplate (kind "tag", "name" or "never": not even if it holds most of the page)."""

    kind: str
    above: int
    chars: int = 0
    mains: int = 0


def _kind(tag: str, attributes: str, in_main: bool) -> str | None:
    if tag in _BOILER_TAGS or (tag in _OUTSIDE_MAIN_ONLY and not in_main):
        return "tag"
    if not attributes or tag in ("html", "body") or tag in _MAIN_TAGS:
        return None
    found = None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return "never"
        if name in ("class", "id"):
            names = {w.lower() for w in _NAME.findall(value)}
            if _COMMENT_NAMES.intersection(value.lower().split()):
                return "never"
            if any(w in _BOILER_NAMES and not (in_main and w in _OUTSIDE_MAIN_ONLY) for w in names):
                found = "name"
        elif name == "role" and value.lower() in _BOILER_ROLES:
            found = "tag"
    return found


def blocks(html: str) -> tuple[list[Block], list[Part], list[int]]:
    """The blocks with text in page order, the parts that markup says are boilerplate, and the part around each article or main part."""
    out: list[Block] = []
    parts = [Part("", 0)]
    around = [0]
    pieces: list[str] = []
    linked = 0
    open_: list[tuple[str, int, int]] = []  # tag, enclosing part, enclosing main
    count: dict[str, int] = {}
    links = 0

    def end() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                _, part, main = open_[-1] if open_ else ("", 0, 0)
                out.append(Block(text, min(linked, len(text)), part, main, any(count.get(h) for h in _HEADINGS)))
            pieces.clear()
        linked = 0

    def close(tag: str) -> None:
        nonlocal links
        while open_:
            top = open_.pop()[0]
            count[top] -= 1
            links -= top == "a"
            if top == tag:
                return

    at = 0
    while True:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            pieces.append(text)
            linked += len(text.strip()) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag in _BLOCK:
                end()
            if count.get(tag):
                close(tag)
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            if tag in _BLOCK:
                end()
            continue
        if tag in _BLOCK:
            end()
            # What the markup may leave open ends here.
            if count.get("p"):
                close("p")
            if tag == "li" and open_ and count.get("li") and "li" in (x[0] for x in open_[-3:]):
                close("li")
        elif tag == "br":
            pieces.append(" ")
        if tag in _VOID:
            continue
        _, part, main = open_[-1] if open_ else ("", 0, 0)
        if kind := _kind(tag, attributes, main > 0):
            parts.append(Part(kind, part))
            part = len(parts) - 1
        if tag in _MAIN_TAGS and not main:
            around.append(part)
            main = len(around) - 1
        open_.append((tag, part, main))
        count[tag] = count.get(tag, 0) + 1
        links += tag == "a"
    end()
    return out, parts, around


def weigh_parts(found: list[Block], parts: list[Part], around: list[int]) -> None:
    """Whether each block is in a part that is boilerplate by its markup, and in an article or main part that isn't."""
    free = [True] * len(parts)  # no tag, and nothing that never counts, around
    for i in range(1, len(parts)):
        free[i] = free[parts[i].above] and parts[i].kind == "name"
    for p in around[1:]:
        parts[p].mains += 1
    for b in found:
        parts[b.part].chars += len(b.text) - b.linked
    own_main = any(free[p] for p in around[1:])
    for part in reversed(parts[1:]):
        parts[part.above].chars += part.chars
        parts[part.above].mains += part.mains
    boiler = [False] * len(parts)
    for i, part in enumerate(parts[1:], 1):
        holds = part.mains > 0 or (not own_main and 2 * part.chars > parts[0].chars)
        counts = part.kind == "never" or not holds or (part.kind == "tag" and own_main)
        boiler[i] = boiler[part.above] or counts
    for b in found:
        b.boiler = boiler[b.part]
        if boiler[around[b.main]]:
            b.main = 0


def stop_density(text: str, rules: BlockRules) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in rules.stop_words for w in words) / max(len(words), 1)


def first_pass(found: list[Block], rules: BlockRules) -> None:
    """Label what its own features decide."""
    marked = sum(len(b.text) for b in found if b.main and not b.boiler)
    beside = sum(len(b.text) - b.linked for b in found if not b.main and not b.boiler and len(b.text) >= rules.short)
    for b in found:
        n = len(b.text)
        if b.boiler or b.linked > rules.max_link_density * n:
            b.label = False
        elif not b.main and marked >= beside and marked:
            b.label = False if n >= rules.short else None
        elif n >= rules.short:
            least = rules.min_main_density if b.main else rules.min_stop_density / 2 if n >= rules.long else rules.min_stop_density
            density = stop_density(b.text, rules)
            b.label = True if density >= least else False if density == 0 and n >= rules.long and not b.main else None


def second_pass(found: list[Block], rules: BlockRules) -> None:
    """What is still ambiguous takes the label of the nearest decided neighbours."""
    marked = any(b.main and not b.boiler for b in found)
    # What markup says is boilerplate tells nothing of the text beside it; only on pages without any decided text it bounds the blocks.
    decided = [(i, b.label) for i, b in enumerate(found) if b.label is not None and not b.boiler]
    # Parts with a long block, in whose ambiguous blocks not one stop word stands.
    open_ = [b for b in found if b.label is None]
    failed = {b.main for b in open_ if len(b.text) >= rules.short} - {b.main for b in open_ if stop_density(b.text, rules) > 0}
    before, j = None, 0
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        while j < len(decided) and decided[j][0] <= i:
            before, j = decided[j], j + 1
        if b.label is not None:
            continue
        after = decided[j] if j < len(decided) else None
        near = [(k, label) for k, label in filter(None, (before, after)) if found[k].main == b.main or not b.main]
        if not any(label for _, label in near) and not (near and b.main):
            # Nothing near is text: short blocks speak for themselves where nothing else does.
            labels[i] = b.main not in failed and (bool(b.main) or not (marked or near or b.part))
        elif b.heading and not b.main:
            labels[i] = bool(after and after[1])
        elif b.main:
            labels[i] = any(label for _, label in near)  # out only between boilerplate
        else:
            closest = min(abs(k - i) for k, _ in near)
            nearest = [label for k, label in near if abs(k - i) == closest]
            labels[i] = all(nearest) if marked else any(nearest)
    for b, label in zip(found, labels, strict=True):  # an inherited label isn't handed on
        b.label = label


def main_text(html: str | None, rules: BlockRules) -> str:
    found, parts, around = blocks(html or "")
    weigh_parts(found, parts, around)
    first_pass(found, rules)
    second_pass(found, rules)
    return "\n".join(b.text for b in found if b.label)


def extract_main_text(pages: DataFrame, rules: BlockRules | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of `pages`: page_id, url, text, n_chars."""
    rules = rules or BlockRules()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    schema = T.StructType([*rows.drop("html").schema, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                texts = [main_text(x.as_py(), rules) for x in some.column("html")]
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return rows.mapInArrow(each, schema)
