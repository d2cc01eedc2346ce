"""Text recipes: comparable names, phrases, role categories, countries, places, markup."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import filled, once

#: `\b` of ASCII words on either side, whatever the engine takes for a word.
_EDGE_L, _EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def words(pattern: str) -> str:
    """A regular expression for `\\b(pattern)\\b`, ASCII and in either case."""
    return f"(?i){_EDGE_L}(?:{pattern}){_EDGE_R}"


def comparable(x: Column) -> Column:
    """Lower case, `&` as and, every other run of signs one space; null is empty."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(x, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word containment of comparable texts; an empty one contains nothing."""
    space = F.lit(" ")
    return (text != "") & (phrase != "") & F.concat(space, text, space).contains(F.concat(space, phrase, space))


# Legal forms that a company name may end in.
LEGAL_WORDS = ("incorporated", "inc", "corporation", "corp", "company", "co", "limited", "ltd", "llc", "plc", "holdings?", "group")


def strip_legal(x: Column, legal: tuple[str, ...] = LEGAL_WORDS) -> Column:
    """A comparable name without legal forms."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, f"{_EDGE_L}(?:{'|'.join(legal)}){_EDGE_R}", " "), r"\s+", " "))


# Role categories by the words of title and place; the first that matches holds.
ROLES = [
    ("security", "security|guard|protection|surveillance|clearance|cleared|intelligence|cia|nsa|dod|soc|ciso"),
    ("logistics", "logistics|supply chain|warehouse|shipping|distribution|transport|fleet|procurement|dispatcher"),
    ("medical", "medical|nurse|physician|doctor|paramedic|emt|health|clinical|rn|lpn|cna|surgical|pharmacy|dental"),
    ("admin", "admin|administrative|coordinator|receptionist|executive assistant|office manager|hr |human resources|payroll|clerk"),
    ("aviation", "aviation|pilot|aircraft|flight|airfield|airport|helicopter|fixed wing|mechanic|avionics|faa"),
    ("engineering", "engineer|developer|software|hardware|systems|network|devops|architect|technical|data|cyber|it |information technology"),
    ("remote", "remote|work from home|wfh|virtual|telecommute"),
    ("overseas", "overseas|deployed|deployment|contingency|oconus|iraq|afghanistan|kuwait|bahrain|qatar|djibouti|germany|japan|korea"),
]
#: `\b` after a trailing space wants a word character next.
_ROLE_SPACE = {"hr ": "hr (?=[A-Za-z0-9_])", "it ": "it (?=[A-Za-z0-9_])"}


def role_category(title: Column, location: Column | None = None) -> Column:
    """The first category whose words occur in title and location, else `other`."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(location, F.lit("")) if location is not None else F.lit(""))
    low = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    # The text is cut into words once, as a generator's output would be; phrases are looked for as substrings first.
    held = F.array_distinct(F.split(low, "[^a-z0-9_]+"))

    def pick(words_: Column, low: Column) -> Column:
        out = F.lit("other")
        for name, pattern in reversed(ROLES):
            every = pattern.split("|")
            test = F.arrays_overlap(words_, F.array(*(F.lit(w) for w in every if w.isalnum())))
            for w in every:
                if not w.isalnum():
                    edge = f"{_EDGE_L}{_ROLE_SPACE[w]}" if w in _ROLE_SPACE else words(w)
                    test = test | (low.contains(w) & low.rlike(edge))
            out = F.when(test, F.lit(name)).otherwise(out)
        return out

    return F.get(F.transform(F.array(F.struct(held.alias("w"), low.alias("l"))), lambda x: pick(x["w"], x["l"])), F.lit(0))


# Country names that payloads use.
COUNTRIES = {
    "usa": "US", "us": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US",
    "uk": "GB", "united kingdom": "GB", "great britain": "GB", "england": "GB", "canada": "CA", "germany": "DE", "deutschland": "DE",
    "france": "FR", "spain": "ES", "italy": "IT", "netherlands": "NL", "japan": "JP", "south korea": "KR", "korea": "KR", "kuwait": "KW",
    "qatar": "QA", "bahrain": "BH", "iraq": "IQ", "afghanistan": "AF", "djibouti": "DJ", "australia": "AU", "india": "IN", "mexico": "MX",
    "poland": "PL", "romania": "RO", "turkey": "TR", "united arab emirates": "AE", "uae": "AE", "saudi arabia": "SA", "philippines": "PH",
}


def country_code(x: Column) -> Column:
    """A known name's code, else a two-letter code in capitals, else null."""
    known = F.create_map(*(F.lit(v) for pair in COUNTRIES.items() for v in pair))
    return once(F.lower(F.trim(x)), lambda name: F.coalesce(F.element_at(known, name), F.when(name.rlike("^[a-z]{2}$"), F.upper(name))))


def city_part(location: Column) -> Column:
    """The part before the first comma; a remote place has none."""
    return once(filled(F.trim(F.split_part(location, F.lit(","), F.lit(1)))), lambda first: F.when(~F.lower(first).contains("remote"), first))


def state_part(location: Column) -> Column:
    """The part between the first two commas."""
    return filled(F.trim(F.split_part(location, F.lit(","), F.lit(2))))


def one_space(x: Column) -> Column:
    """One space for every run of white space, none around. A text of single spaces isn't rewritten."""
    return F.trim(once(x, lambda v: F.when(v.contains("  ") | v.rlike(r"[\t\n\x0B\f\r]"), F.regexp_replace(v, r"\s+", " ")).otherwise(v)))


def strip_markup(html: Column) -> Column:
    """Text of a fragment: CDATA opened, tags gone, the five basic entities and `&nbsp;` decoded, one space between words."""

    def bare(x: Column) -> Column:
        return F.when(x.contains("<"), F.regexp_replace(F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), r"(?s)<[^>]+>", " ")).otherwise(x)

    def decoded(x: Column) -> Column:
        out = x
        for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            out = F.replace(out, F.lit(entity), F.lit(sign))
        return F.when(x.contains("&"), out).otherwise(x)

    return one_space(once(once(html, bare), decoded))


def xml_tag(block: Column, tag: str) -> Column:
    """The text of the first `<tag>` in a block, else null."""
    return filled(strip_markup(F.regexp_extract(block, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)))


def xml_blocks(text: Column, tag: str) -> Column:
    """The inner text of every `<tag>`, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def anchors(html: Column) -> Column:
    """(href, text) of every anchor, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"), strip_markup(F.regexp_replace(a, r"(?is)^<a\s[^>]*>|</a>$", "")).alias("text")))
