"""URL recipes: three canonical forms of an apply URL, hosts, sites, and providers known by their URLs."""

from __future__ import annotations

from dataclasses import dataclass

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import once as _once

# Query parameters that only track, by canonical form.
_TRACKING_JOBS = ("gh_src", "source", "src", "trackingid", "trk", "referrer", "referral", "lever-origin", "lever-source")
_TRACKING_TRUTH = ("source", "src", "ref", "referrer", "referral", "trackingid", "trk", "gh_src", "lever-source", "lever-origin")
_TRACKING_AUDIT = ("source", "src", "ref", "referrer", "trackingid", "trk", "gh_src")

_PARTS = r"^(?i:(https?))://(?:[^/?#@\s]*@)?([^/?#:@\s]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


@dataclass(frozen=True)
class UrlForm:
    """What a canonical form drops besides `utm_*`, fragments and default ports. Parameters are always sorted by key."""

    drop: tuple[str, ...]
    strip_www: bool = False
    strip_slash: bool = False


JOBS = UrlForm(_TRACKING_JOBS)
TRUTH = UrlForm(_TRACKING_TRUTH, strip_www=True, strip_slash=True)
AUDIT = UrlForm(_TRACKING_AUDIT, strip_slash=True)


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, n)


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL, else null."""
    return F.nullif(F.lower(_part(url, 2)), F.lit(""))


def site(url: Column) -> Column:
    """Host without a leading `www.`."""
    return F.regexp_replace(host(url), r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Equal sites, or one a subdomain of the other (columns are URLs)."""
    a, b = site(a), site(b)
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))


def registrable_host(url: Column) -> Column:
    """The last two labels of the host."""
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def _clean_query(query: Column, drop: tuple[str, ...]) -> Column:
    """Form-encoded parameters, decoded, filtered, sorted by key (stable) and encoded again."""
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(read(F.regexp_extract(p, "^[^=]*", 0)).alias("k"), i.alias("i"), read(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.filter(pairs, lambda s: ~F.lower(s["k"]).startswith("utm_") & ~F.lower(s["k"]).isin(*drop))
    return F.array_join(F.transform(F.array_sort(kept), lambda s: F.concat(F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"]))), "&")


def canonical(url: Column, form: UrlForm = JOBS) -> Column:
    """The canonical form of an http(s) URL; null for anything else. The URL is found once, and not again for each part of its form."""
    return _once(url, lambda u: _canonical(u, form))


def _canonical(url: Column, form: UrlForm) -> Column:
    scheme, name, port, path, query = F.lower(_part(url, 1)), F.lower(_part(url, 2)), _part(url, 3), _part(url, 4), _part(url, 5)
    if form.strip_www:
        name = F.regexp_replace(name, r"^www\.", "")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    query = _once(_clean_query(query, form.drop), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    out = F.concat(scheme, F.lit("://"), name, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query)
    if form.strip_slash:
        out = F.regexp_replace(out, "/$", "")
    return F.when(host(url).isNotNull(), out)


def first_apply_url(candidates: list[Column], form: UrlForm = JOBS) -> Column:
    """The canonical form of the first candidate that is an http(s) URL."""
    return canonical(F.coalesce(*(F.when(host(c).isNotNull(), c) for c in candidates)), form)


# Providers of hosted job boards, by URL; group 1 is the board.
ATS_PATTERNS = [
    ("greenhouse", r"(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)"),
    ("lever", r"jobs(?:\.eu)?\.lever\.co/([a-z0-9_.-]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([a-z0-9_.%-]+)"),
    ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([a-z0-9_-]+)"),
    ("bamboohr", r"([a-z0-9-]+)\.bamboohr\.com"),
    ("recruitee", r"([a-z0-9-]+)\.recruitee\.com"),
    ("workable", r"apply\.workable\.com/([a-z0-9_-]+)"),
    ("personio", r"([a-z0-9-]+)\.jobs\.personio\.(?:com|de)"),
    ("workday", r"([a-z0-9-]+)\.(?:wd\d+\.)?(?:myworkdayjobs|myworkdaysite)\.com"),
    ("icims", r"([a-z0-9-]+)\.icims\.com"),
    ("taleo", r"([a-z0-9-]+)\.taleo\.net"),
    ("jobvite", r"jobs\.jobvite\.com/([a-z0-9_-]+)"),
    ("jazzhr", r"([a-z0-9-]+)\.applytojob\.com"),
    ("neogov", r"(?:www\.)?governmentjobs\.com/careers/([a-z0-9_-]+)"),
    ("usajobs", r"(?:www\.)?usajobs\.gov/()"),
]


def ats_provider(url: Column) -> Column:
    """The provider that hosts a board at this URL, else null."""
    low = F.lower(url)
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ATS_PATTERNS):
        out = F.when(low.rlike("//" + pattern), F.lit(name)).otherwise(out)
    return out


def ats_board(url: Column) -> Column:
    """The board's id at its provider, else null."""
    low = F.lower(url)
    return F.coalesce(*(F.nullif(F.regexp_extract(low, "//" + pattern, 1), F.lit("")) for _, pattern in ATS_PATTERNS))


# Hosted job boards in the order in which they are tried: provider, pattern of the host, where the board's id stands (the URL's pattern,
# the host's first label, a token of the path), confidence.
HOSTED_BOARDS = [
    ("greenhouse", r"greenhouse\.io", r"greenhouse\.io/(?:embed/job_board\?for=)?([^/?#&]+)", "high"),
    ("lever", r"jobs\.lever\.co", r"jobs\.lever\.co/([^/?#&]+)", "high"),
    ("ashby", r"jobs\.ashbyhq\.com", r"jobs\.ashbyhq\.com/([^/?#&]+)", "high"),
    ("recruitee", r"^[^.]+\.recruitee\.com$", "label", "high"),
    ("smartrecruiters", r"(?:jobs|api)\.smartrecruiters\.com", r"(?:jobs\.smartrecruiters\.com|api\.smartrecruiters\.com/v1/companies)/([^/?#&]+)", "high"),
    ("bamboohr", r"^[^.]+\.bamboohr\.com$", "label", "high"),
    ("workday", r"myworkdayjobs\.com|myworkdaysite\.com|workdayjobs\.com", "site", "high"),
    ("icims", r"icims\.com", "", "medium"),
    ("taleo", r"taleo\.net", "", "medium"),
    ("oracle", r"oraclecloud\.com", "", "medium"),
    ("jobvite", r"jobvite\.com", "path", "medium"),
    ("successfactors", r"successfactors\.com", "path", "medium"),
    ("workable", r"apply\.workable\.com$", "path", "high"),
    ("teamtailor", r"teamtailor\.com$", "label", "high"),
    ("personio", r"jobs\.personio\.(?:com|de)$", "label", "high"),
    ("comeet", r"comeet\.(?:com|co)$", "path", "medium"),
    ("breezyhr", r"breezy\.hr$", "label", "high"),
    ("jazzhr", r"applytojob\.com$", "path", "medium"),
    ("rippling", r"ats\.rippling\.com$", "path", "high"),
    ("dayforce", r"dayforcehcm\.com$", "path2", "medium"),
    ("ukg", r"ultipro\.com$|ukg\.com$", "", "medium"),
    ("adp", r"workforcenow\.adp\.com$", "", "medium"),
    ("paylocity", r"recruiting\.paylocity\.com$", "", "medium"),
    ("paycom", r"paycomonline\.net$", "", "medium"),
    ("governmentjobs", r"governmentjobs\.com$", r"/careers/([^/?#]+)", "high"),
    ("neogov", r"neogov\.com$", "", "medium"),
    ("applicantpro", r"applicantpro\.com$", "label", "medium"),
    ("pinpoint", r"pinpointhq\.com$", "label", "medium"),
    ("zoho_recruit", r"zohorecruit\.com$", "", "medium"),
    ("bullhorn", r"bullhornstaffing\.com$", "", "medium"),
    ("ceipal", r"ceipal\.com$", "", "medium"),
    ("clearcompany", r"clearcompany\.com$", "label", "medium"),
    ("cornerstone", r"csod\.com$", "label", "medium"),
    ("eightfold", r"eightfold\.ai$", "", "medium"),
    ("avature", r"avature\.net$", "label", "medium"),
    ("phenom", r"phenom\.com$", "", "medium"),
    ("hirebridge", r"hirebridge\.com$", "", "medium"),
    ("silkroad", r"silkroad\.com$", "", "medium"),
]
# Boards that count only with this in the path or the URL.
_HOSTED_ALSO = {"bamboohr": "/careers", "oracle": "hcm|career|job"}
# What a page's markup says of its provider, in the order in which it is tried.
MARKUP_SIGNALS = [
    ("greenhouse", "greenhouse"), ("lever", r"lever\.co|lever-jobs"), ("ashby", "ashbyhq"), ("recruitee", "recruitee"), ("smartrecruiters", "smartrecruiters"), ("bamboohr", "bamboohr"), ("workday", "myworkdayjobs|workday"), ("icims", "icims"),
    ("taleo", "taleo"), ("oracle", "oraclecloud.*hcm|oracle recruiting"), ("jobvite", "jobvite"), ("successfactors", "successfactors"), ("workable", "workable"), ("teamtailor", "teamtailor"), ("personio", "personio"), ("comeet", "comeet"),
    ("breezyhr", "breezy"), ("jazzhr", "jazzhr|applytojob"), ("rippling", "rippling"), ("dayforce", "dayforce"), ("ukg", "ultipro|ukg"), ("adp", r"workforcenow\.adp|adp recruiting"), ("paylocity", "paylocity"), ("paycom", "paycom"),
    ("governmentjobs", "governmentjobs|neogov"), ("applicantpro", "applicantpro"), ("pinpoint", "pinpointhq"), ("zoho_recruit", "zohorecruit"), ("bullhorn", "bullhornstaffing"), ("ceipal", "ceipal"), ("clearcompany", "clearcompany"),
    ("cornerstone", "csod|cornerstone"), ("eightfold", "eightfold"), ("avature", "avature"), ("phenom", "phenom"), ("hirebridge", "hirebridge"), ("silkroad", "silkroad"),
]


def _literals(pattern: str) -> list[str]:
    """The texts of which one stands in whatever a pattern of the tables matches."""
    out = []
    for part in re.sub(r"\(\?:jobs\|api\)\\.|^\^\[\^\.\]\+\\\.", "", pattern).split("|") if "(?:com|de" not in pattern and "(?:com|co" not in pattern else [pattern.split(r"\.(?:")[0]]:
        out.append(part.replace("\\.", ".").replace(".*hcm", "").strip("$^"))
    return out


#: A URL with none of these leads to no hosted board; those that stand in it choose the rules that are tried.
_BOARD_SIGNS = {provider: ["greenhouse"] if provider == "greenhouse" else _literals(pattern) for provider, pattern, *_ in HOSTED_BOARDS}
_MARKUP_SIGNS = {provider: _literals(pattern) for provider, pattern in MARKUP_SIGNALS}


def _any_of(signs: dict[str, list[str]]) -> str:
    # Longer ones first, for alternatives are tried in order.
    return "|".join(re.escape(x) for x in sorted({x for own in signs.values() for x in own}, key=lambda x: (-len(x), x)))


def _signed(found: Column, signs: list[str]) -> Column:
    return F.array_contains(found, signs[0]) if len(signs) == 1 else F.arrays_overlap(found, F.array(*map(F.lit, signs)))


def _first_of(tests: list[tuple[int, Column]]) -> Column:
    out = F.lit(None).cast("int")
    for k, test in reversed(tests):
        out = F.when(test, k).otherwise(out)
    return out


def hosted_board(url: Column) -> Column:
    """provider, board and confidence (struct) of the hosted job board that a URL leads to; null for other URLs. Escapes in the URL are decoded first."""
    group = lambda x, pattern: F.nullif(F.regexp_extract(x, f"(?i){pattern}", 1), F.lit(""))

    def parts(decoded: Column) -> Column:
        site, path = F.lower(F.regexp_extract(decoded, r"^(?i)https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.regexp_extract(decoded, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
        signs = F.array_distinct(F.regexp_extract_all(F.lower(decoded), F.lit(f"({_any_of(_BOARD_SIGNS)})"), F.lit(1)))
        return F.when(decoded.rlike(f"(?i){_any_of(_BOARD_SIGNS)}"), F.struct(decoded.alias("url"), site.alias("site"), path.alias("path"), signs.alias("signs"), F.filter(F.split(path, "/"), lambda x: x != "").alias("tokens")))

    def board(u: Column) -> Column:
        site, tokens, whole = u["site"], u["tokens"], u["url"]
        token = lambda k: F.get(tokens, F.lit(k))
        site_of = F.when(token(0).rlike("^[a-z]{2}-[A-Z]{2}$"), token(1)).otherwise(token(0))
        named = F.coalesce(group(whole, r"(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board\?for=)?([^/?#&]+)"), group(whole, "[?&]for=([^&#]+).*greenhouse"), group(whole, HOSTED_BOARDS[0][2]))
        where = {"label": F.split_part(site, F.lit("."), F.lit(1)), "path": token(0), "path2": token(1), "": F.lit(None).cast("string"), "site": F.concat_ws("/", F.regexp_extract(whole, r"^(?i)(https?://[^/?#]+)", 1), site_of)}
        tests, idents = [], []
        for k, (provider, pattern, at, _) in enumerate(HOSTED_BOARDS):
            ident = named if provider == "greenhouse" else where[at] if at in where else group(whole, at)
            # Those whose board is read from the whole URL are found by it; without a board it is another page of theirs.
            test = ident.isNotNull() if provider in ("greenhouse", "lever", "ashby", "smartrecruiters") else site.rlike(pattern)
            if provider in _HOSTED_ALSO:
                test &= (u["path"] if provider == "bamboohr" else whole).rlike(f"(?i){_HOSTED_ALSO[provider]}")
            tests.append((k, _signed(u["signs"], _BOARD_SIGNS[provider]) & test))
            idents.append((k, at, ident))
        said = lambda column: F.array(*(F.lit(row[column]) for row in HOSTED_BOARDS))

        def chosen(k: Column) -> Column:
            ident = F.lit(None).cast("string")
            for at in where:
                ident = F.when(k.isin([i for i, own, _ in idents if own == at]), where[at]).otherwise(ident)
            for i, at, own in idents:
                if at not in where:
                    ident = F.when(k == i, own).otherwise(ident)
            ident = F.trim(F.regexp_replace(F.regexp_replace(ident, r"(?i)^www\.", ""), "/$", ""))
            return F.when(k.isNotNull(), F.struct(F.get(said(0), k).alias("provider"), ident.alias("board"), F.get(said(3), k).alias("confidence")))

        return _once(_first_of(tests), chosen)

    decoded = F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)
    return _once(_once(decoded, parts), lambda u: F.when(u.isNotNull(), board(u)))


def company_slug(name: Column) -> Column:
    """A company's name run together, without legal forms; null if nothing is left."""
    bare = F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit("and")), r"(?<![a-z0-9_])(?:inc\.?|llc|ltd\.?|corp\.?|corporation|company|co\.?|plc|holdings?|group|the)(?![a-z0-9_])", "")
    return F.nullif(F.regexp_replace(bare, "[^a-z0-9]", ""), F.lit(""))


#: Providers whose board is guessed from the company's name where only the markup tells of them.
_GUESSED = ("greenhouse", "lever", "smartrecruiters", "ashby", "recruitee")


def detect_ats(page_url: Column, links: Column | None = None, html: Column | None = None, company: Column | None = None) -> Column:
    """The provider of a career page: by its URL, else by the first of its links (array) that leads to a hosted board, else by signals in its markup.

    One pass over the markup finds all signals; of those found the first in order holds. Its board is the company's slug for providers of
    which boards are named so, and the page's own first path for Workday.
    """
    found = hosted_board(page_url)
    if links is not None:
        found = F.coalesce(found, F.get(F.filter(F.transform(links, hosted_board), lambda x: x.isNotNull()), F.lit(0)))
    if html is not None:

        def by_markup(low: Column) -> Column:
            def chosen(signs: Column) -> Column:
                tests = [(k, _signed(signs, _MARKUP_SIGNS[p]) & (low.rlike(pattern) if ".*" in pattern else F.lit(True))) for k, (p, pattern) in enumerate(MARKUP_SIGNALS)]
                return _once(_first_of(tests), lambda k: F.get(F.array(*(F.lit(p) for p, _ in MARKUP_SIGNALS)), k))

            return _once(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({_any_of(_MARKUP_SIGNS)})"), F.lit(1))), chosen)

        tokens = F.filter(F.split(F.regexp_extract(page_url, r"^(?i)https?://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
        own = F.concat_ws("/", F.regexp_extract(page_url, r"^(?i)(https?://[^/?#]+)", 1), F.when(F.get(tokens, F.lit(0)).rlike("^[a-z]{2}-[A-Z]{2}$"), F.get(tokens, F.lit(1))).otherwise(F.get(tokens, F.lit(0))))
        slug = F.lit(None).cast("string") if company is None else company_slug(company)
        guess = lambda p: F.when(p == "workday", own).when(p.isin(*_GUESSED), slug)
        found = F.coalesce(found, _once(_once(F.lower(html), by_markup), lambda p: F.when(p.isNotNull(), F.struct(p.alias("provider"), guess(p).alias("board"), F.lit("medium").alias("confidence")))))
    return found


def workday_board(url: Column) -> Column:
    """tenant, site, language and the listing's endpoint (struct) of a Workday board's URL; null for others and for one without a site."""
    site = F.lower(F.regexp_extract(url, r"^(?i)https?://([^/?#:]+)", 1))
    parts = F.filter(F.split(F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    language = F.when(F.get(parts, F.lit(0)).rlike("^[a-z]{2}-[A-Z]{2}$"), F.concat(F.lit("/"), F.get(parts, F.lit(0)))).otherwise("")
    board = F.when(language != "", F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    tenant = F.split_part(site, F.lit("."), F.lit(1))
    endpoint = F.concat(F.regexp_extract(url, r"^(?i)(https?://[^/?#]+)", 1), F.lit("/wday/cxs/"), tenant, F.lit("/"), board, F.lit("/jobs"))
    is_board = site.rlike(r"(?:myworkdayjobs|myworkdaysite|workdayjobs)\.com$") & board.isNotNull()
    return F.when(is_board, F.struct(tenant.alias("tenant"), board.alias("site"), language.alias("language"), endpoint.alias("endpoint")))
