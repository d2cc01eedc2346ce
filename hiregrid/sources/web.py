"""Pages and search results of the open web: career pages with anchors and JSON-LD, search APIs, boards, registries."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fnv1a_base36, lenient_time, pick, truthy
from ..functions.text import anchors, city_part, comparable, contains_phrase, country_code, one_space, state_part, strip_markup, words
from ..functions.urls import AUDIT, canonical, host
from ..functions.values import filled, once
from ..operators.frames import computed, first_rows
from ..operators.quality import clean_title, is_detail_url, is_generic_title
from .payloads import _finish, _items, _job, _read, feed, table_rows


# Codes of states that a place may end in.
_STATE_CODES = "AL|AK|AZ|AR|CA|CO|CT|DC|DE|FL|GA|HI|IA|ID|IL|IN|KS|KY|LA|MA|MD|ME|MI|MN|MO|MS|MT|NC|ND|NE|NH|NJ|NM|NV|NY|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VA|VT|WA|WI|WV|WY"


def absolute(url: Column, base: Column) -> Column:
    """A link against the page it stands on: absolute, protocol-relative, rooted, or beside the page; without its fragment."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    bare = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(bare.rlike(r"^https?://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    return (
        F.when(url == "", base).when(url.rlike("(?i)^https?://"), url).when(url.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string")).when(url.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), url))
        .when(url.startswith("/"), F.concat(root, url)).when(url.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), url)).otherwise(F.concat(folder, url))
    )


def linked_jobs(pages: DataFrame) -> DataFrame:
    """Anchors of career pages (payload, page_url) that lead to one job and read like a title."""
    rows = pages.select(*(c for c in pages.columns if c != "payload"), F.posexplode(anchors(F.col("payload"))).alias("_seq", "_a"))
    title, url = clean_title(F.col("_a.text")), absolute(F.col("_a.href"), F.col("page_url"))
    # The filter's many patterns would otherwise each hold the whole expression.
    rows = computed(rows, _title=title, _url=url).drop("_a").where(F.length("_title").between(3, 180) & ~is_generic_title(F.col("_title")) & is_detail_url(F.col("_url")))
    place = F.nullif(F.regexp_extract("_title", r"([A-Z][A-Za-z .'-]+,\s*[A-Z]{2})(?![A-Za-z0-9_])", 1), F.lit(""))
    raw = F.to_json(F.struct(F.lit("strong_job_detail_link").alias("parser"), F.col("page_url").alias("listing_page_url")))
    return _finish(rows, _job("career_page", raw, title=F.col("_title"), location=place, city=city_part(place), state=state_part(place), apply_url=F.col("_url"))).drop("_title", "_url")


def _postings(node: Column) -> Column:
    """JSON texts of the nodes of a JSON-LD block: an array's items, a graph's nodes, or the object itself."""
    items = F.coalesce(F.from_json(node, "array<string>"), F.array(node))
    return F.flatten(F.transform(items, lambda n: F.coalesce(F.from_json(F.get_json_object(n, "$['@graph']"), "array<string>"), F.array(n))))


def json_ld_jobs(pages: DataFrame) -> DataFrame:
    """JobPosting nodes of the pages' JSON-LD. A date that isn't given is taken from validThrough."""
    blocks = F.regexp_extract_all(F.col("payload"), F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    rows = pages.select(*(c for c in pages.columns if c != "payload"), F.posexplode(F.flatten(F.transform(blocks, lambda b: _postings(F.trim(b))))).alias("_seq", "_item"))
    i = F.col("_item")
    kind = F.lower(F.coalesce(F.get_json_object(i, "$['@type']"), F.lit("")))
    rows = rows.where(kind.rlike(r'^"?jobposting"?$|^\[.*"jobposting".*\]$'))
    at = lambda path: pick(i, f"jobLocation[0].{path}", f"jobLocation.{path}")
    city, state = at("address.addressLocality"), at("address.addressRegion")
    country = F.coalesce(pick(i, "jobLocation[0].address.addressCountry.name", "jobLocation.address.addressCountry.name"), at("address.addressCountry"))
    remote = (F.get_json_object(i, "$.jobLocationType") == "TELECOMMUTE") | (at("['@type']") == "VirtualLocation")
    place = F.coalesce(F.nullif(F.concat_ws(", ", city, state, country), F.lit("")), F.when(remote, "Remote"), pick(i, "jobLocation"))
    title = clean_title(strip_markup(pick(i, "title", "name")))
    out = _job(
        "career_page", F.to_json(F.struct(F.lit("json_ld").alias("parser"), F.col("page_url").alias("listing_page_url"))), external_id=pick(i, "identifier.value", "identifier.name", "identifier[0].value", "identifier"), title=title,
        department=pick(i, "employmentType", "occupationalCategory"), location=place, city=city, state=state, country=country_code(country), is_remote=F.coalesce(remote, F.lit(False)), posted_at=lenient_time(pick(i, "datePosted", "validThrough")),
        apply_url=absolute(F.coalesce(pick(i, "url", "sameAs"), F.lit("")), F.col("page_url")),
    )
    return _finish(rows, out).where(~is_generic_title(F.col("title")))


def career_page(pages: DataFrame, source: str = "career_page") -> DataFrame:
    """JSON-LD jobs of each page and its linked jobs, each URL once, JSON-LD first. A hosted board is the same under `ats:<provider>`."""
    from ..operators.dedupe import first_wins

    both = json_ld_jobs(pages).withColumn("_seq", F.col("_seq").cast("long")).unionByName(linked_jobs(pages).withColumn("_seq", F.lit(1_000_000) + F.col("_seq")))
    return first_wins(both.withColumn("source", F.lit(source)), ["page_url", "apply_url"])


# What in a result's path, query, or host with both marks one job; generic paths and titles; sites that title their pages; names of countries.
_RESULT_PATHS = r"/(?:job|jobs|positions?|openings?|requisitions?)/[^/?#]{3,}|/[^/]*\d{4,}[^/]*/?$"
_RESULT_QUERY = "(?:jobid|job_id|gh_jid|requisitionid|reqid|postingid|jk)="
_RESULT_URLS = (
    r"boards\.greenhouse\.io/[^/]+/jobs/\d+|jobs\.lever\.co/[^/]+/[^/?#]+|(?:myworkdayjobs|workdayjobs)\.com/.+/job/|smartrecruiters\.com/[^/]+/\d+|icims\.com/jobs/\d+|taleo\.net/.+(?:jobdetail|requisition)"
    r"|jobvite\.com/.+(?:job|position)|bamboohr\.com/careers/\d+|usajobs\.gov/job/\d+|indeed\.com/viewjob|linkedin\.com/jobs/view/"
)
_GENERIC_PATH = "(?i)^/(?:careers?|jobs?|employment|join-us|work-with-us)/?$"
_GENERIC_RESULT = r"^(?:careers?|jobs?|job search|search jobs|job openings|open positions|employment opportunities|join our team|work with us)(?:\s+(?:at|with|for)\s+.+)?$"
_TITLED_BY = r"(?i)\s*[|•]\s*(?:LinkedIn|Indeed(?:\.com)?|Glassdoor|ZipRecruiter|USAJOBS).*$"
_COUNTRY_NAMES = [
    ("united states|u\\.s\\.|usa", "US"), ("canada", "CA"), ("united kingdom|great britain|uk", "GB"), ("germany", "DE"), ("kuwait", "KW"), ("qatar", "QA"), ("bahrain", "BH"), ("iraq", "IQ"), ("poland", "PL"), ("australia", "AU"), ("japan", "JP"),
    ("south korea|korea", "KR"),
]
#: Where a country's name may begin: their first letters, and no word that goes on.
_COUNTRY_WORD = f"(?=[{''.join(sorted({n[0] for names, _ in _COUNTRY_NAMES for n in names.split('|')}))}])(?<![A-Za-z0-9_])"
_REMOTE = "remote|work from home|wfh|virtual"


def _is_generic_result(title: Column) -> Column:
    # Few titles begin like one; the others needn't be rewritten.
    return title.rlike(r"(?i)^[\s|:–—-]*(?:career|job|search|open|employ|join|wor)") & one_space(F.regexp_replace(F.lower(title), "[|:–—-]+", " ")).rlike(_GENERIC_RESULT)


def _named_country(said: Column) -> Column:
    """The country that a text names, else US."""
    out = F.lit("US")
    for names, code in reversed(_COUNTRY_NAMES):
        out = F.when(said.rlike(f"(?i){_COUNTRY_WORD}(?:{names})(?![A-Za-z0-9_])"), code).otherwise(out)
    return F.when(said.rlike(f"(?i){_COUNTRY_WORD}(?:{'|'.join(names for names, _ in _COUNTRY_NAMES)})(?![A-Za-z0-9_])"), out).otherwise("US")


def search_results(pages: DataFrame, source: str = "web:langsearch", rows_at: tuple[str, ...] = ("data.webPages.value", "webPages.value", "results", "data")) -> DataFrame:
    """Results of a web search (with `employer`) that look like one job by path, query or host; ids are hashes.

    The title loses the name of the site and the part that names the employer; the place is Remote, a city with a state's code, or what is
    labelled a location; the country is named, else US.
    """
    rows, at = _read(_items(pages, *rows_at), "url", "displayUrl", "link", "name", "title", "snippet", "description", "summary", "text", "datePublished", "published_date", "date")
    rows = computed(rows, _url=F.regexp_replace(F.trim(at("url", "displayUrl", "link")), "#.*$", "")).where(F.col("_url").rlike("(?i)^https?://"))
    rows = computed(rows, _whole=strip_markup(at("name", "title")), _path=F.regexp_extract("_url", r"^https?://[^/?#]+([^?#]*)", 1)).where("_whole != ''")
    path = F.col("_path")
    looks = path.rlike(f"(?i){_RESULT_PATHS}") | F.regexp_extract("_url", r"\?([^#]*)", 1).rlike(f"(?i){_RESULT_QUERY}") | F.col("_url").rlike(f"(?i){_RESULT_URLS}")
    rows = rows.where(looks & ~F.when(path == "", "/").otherwise(path).rlike(_GENERIC_PATH) & ~_is_generic_result(F.col("_whole")))
    employer = F.coalesce(F.trim("employer"), F.lit(""))
    title = F.regexp_replace(F.regexp_replace("_whole", _TITLED_BY, ""), F.concat(F.lit(r"(?i)\s*[|–—-]\s*(?:careers?|jobs?)?(?:\s+at)?\s*\Q"), employer, F.lit(r"\E.*$")), F.lit(""))
    rows = computed(rows, _title=one_space(title)).where(F.length("_title").between(3, 180) & ~_is_generic_result(F.col("_title")))
    rows = computed(rows, _text=F.concat_ws(" ", "_whole", strip_markup(at("snippet", "description")), strip_markup(at("summary", "text"))))
    rows = computed(rows, _remote=F.col("_text").rlike(f"(?=[rwvRWV]){words(_REMOTE)}"))
    # A look at the next letter is cheaper than one back, so it comes first.
    city = filled(F.trim(F.regexp_extract("_text", rf"(?=[A-Z])(?<![A-Za-z0-9_])([A-Z][A-Za-z.'-]*(?:\s+[A-Z][A-Za-z.'-]*){{0,3}},\s*(?:{_STATE_CODES}))(?![A-Za-z0-9_])", 1)))
    labelled = filled(F.trim(F.regexp_extract("_text", r"(?i)(?=[ljw])(?<![A-Za-z0-9_])(?:location|job location|work location)\s*[:\-–—]\s*([^|•.;]{2,80})", 1)))
    rows = computed(rows, _place=F.when(F.col("_remote"), "Remote").otherwise(F.coalesce(city, labelled)))
    country = once(F.concat_ws(" ", "_place", "_text"), _named_country)
    key = F.concat(F.lit(source.rpartition(":")[2] + "-"), fnv1a_base36(F.concat_ws("|", F.col("employer"), F.col("_url"), F.col("_title"))))
    part = lambda k: F.when(F.col("_place") != "Remote", filled(F.trim(F.split_part("_place", F.lit(","), F.lit(k)))))
    columns = _job(source, F.col("_item"), external_id=key, title=F.col("_title"), department=F.col("employer"), location=F.col("_place"), city=part(1), state=part(2), country=country, is_remote=F.col("_remote"), posted_at=lenient_time(at("datePublished", "published_date", "date")), apply_url=F.col("_url"))
    # No filter follows, so fields that nobody reads needn't be worked out.
    return rows.select(*(c for c in pages.columns if c != "payload"), "_seq", *columns)


def theirstack(pages: DataFrame) -> DataFrame:
    """Rows with an id, a title and a URL, each URL once; the monitored employer stands in where the row names none."""
    from ..operators.dedupe import first_wins

    rows, i = _items(pages, "data"), F.col("_item")
    place, country = pick(i, "long_location", "short_location", "location", "locations[0].display_name"), pick(i, "country_code", "locations[0].country_code", "company_object.country_code")
    out = _finish(rows, _job(
        "theirstack", i, external_id=F.concat(F.lit("theirstack-"), pick(i, "id", "job_id")), title=clean_title(pick(i, "job_title", "title", "normalized_title")), department=F.coalesce(pick(i, "company", "company_object.name"), F.col("employer")), location=place,
        city=pick(i, "locations[0].name", "cities[0]"), state=pick(i, "state_code", "locations[0].state_code", "locations[0].state"), country=country, lat=pick(i, "latitude", "locations[0].latitude").try_cast("double"), lng=pick(i, "longitude", "locations[0].longitude").try_cast("double"),
        is_remote=truthy(pick(i, "remote")), posted_at=lenient_time(pick(i, "date_reposted", "date_posted", "discovered_at")), apply_url=canonical(pick(i, "final_url", "url", "source_url"), AUDIT),
    ))
    return first_wins(out.where((F.col("title") != "") & F.col("external_id").isNotNull() & F.col("apply_url").isNotNull()), ["apply_url"])


def jibe(pages: DataFrame) -> DataFrame:
    """Jobs of a Jibe listing: title and slug under `data`; the URL is the board's base and the slug."""
    rows, i = _items(pages, "jobs"), F.col("_item")
    slug = pick(i, "data.slug", "data.req_id")
    return _finish(rows, _job("jibeapply", i, external_id=slug, title=pick(i, "data.title"), department=pick(i, "data.department", "data.category[0]"), location=pick(i, "data.full_location", "data.location_name"), city=pick(i, "data.city"), state=pick(i, "data.state"), country=country_code(pick(i, "data.country_code", "data.country")), posted_at=lenient_time(pick(i, "data.posted_date")), apply_url=F.concat(F.regexp_replace("base_url", "/$", ""), F.lit("/jobs/"), slug))).where("title is not null")


def table_jobs(pages: DataFrame, source: str, title: int = 0, department: int | None = None, location: int | None = 1) -> DataFrame:
    """Jobs of an HTML table with a link in each row: JazzHR-like boards and others that list jobs in rows."""
    rows = table_rows(pages).where(F.size("hrefs") > 0)
    cell = lambda k: F.nullif(F.get("cells", F.lit(k)), F.lit("")) if k is not None else F.lit(None).cast("string")
    url, place = absolute(F.get("hrefs", F.lit(0)), F.col("page_url")), cell(location)
    ident = F.coalesce(*(F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"/apply/(?:jobs/details/)?([A-Za-z0-9_-]{4,})", r"/([A-Za-z0-9_-]{4,})/?(?:\?.*)?$")))
    columns = _job(source, F.to_json(F.struct(F.lit("structured_table").alias("parser"))), external_id=ident, title=cell(title), department=cell(department), location=place, city=city_part(place), state=state_part(place), apply_url=url)
    return rows.select(*(c for c in rows.columns if c not in ("cells", "hrefs")), *columns).where("title is not null")


# Public-sector boards by host, the paths (with query) of their postings, and the names in their titles.
PUBLIC_BOARDS = {
    "board:icma": ("icma.org", r"/job-posts/\d+"),
    "board:naco": ("naco.org", r"/(?:job|jobs|career|careers)[/?#-]"),
    "board:careersingovernment": ("careersingovernment.com", r"/job/\d+/"),
}
_BOARD_TITLES = "ICMA|Careers in Government|NACo"


def board_of(url: Column) -> Column:
    """The public-sector board whose posting a URL is, by host and path with query; null for others."""

    def label(u: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, (domain, pattern) in PUBLIC_BOARDS.items():
            out = F.when(((u["site"] == domain) | u["site"].endswith("." + domain)) & u["path"].rlike(f"(?i){pattern}"), name).otherwise(out)
        return out

    return once(F.struct(F.regexp_replace(host(url), r"^www\.", "").alias("site"), F.regexp_extract(url, r"^https?://[^/?#]+([^#]*)", 1).alias("path")), label)


def public_boards(pages: DataFrame) -> DataFrame:
    """Search results (payload, with entity_name and aliases of the entity searched for) that are postings of public-sector boards and name the
    entity, or it without its kind of government, as a phrase; each URL once."""
    names = F.concat(F.array("entity_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    bare = lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, "^(?:city|county|state|town|village|borough) of ", ""), " (?:city|county)$", ""))
    # Names are a page's, so they are made comparable before its results are taken apart; without their kind of government they are phrases too.
    phrases = once(F.filter(F.transform(names, comparable), lambda n: F.length(n) >= 4), lambda some: F.array_union(some, F.filter(F.transform(some, bare), lambda n: F.length(n) >= 4)))
    rows, at = _read(_items(computed(pages, _phrases=phrases), "data.webPages.value"), "url", "displayUrl", "name", "snippet", "summary", "datePublished")
    rows, url = rows.withColumn("_url", at("url", "displayUrl")), F.col("_url")
    rows = computed(computed(rows, _board=board_of(url)).where("_board IS NOT NULL"), _title=strip_markup(at("name")))
    rows = computed(rows, _text=F.concat_ws(" ", "_title", strip_markup(F.concat_ws(" ", at("snippet"), at("summary")))))
    rows = computed(rows, _said=comparable(F.col("_text")))
    named = F.exists("_phrases", lambda n: contains_phrase(F.col("_said"), n))
    short = F.trim(F.regexp_replace("_title", rf"(?i)\s*[|–—-]\s*(?:{_BOARD_TITLES}).*$", ""))
    # The part behind a dash that begins with one of the entity's names goes too.
    cut = lambda t, n: F.trim(F.regexp_replace(t, F.concat(F.lit(r"(?i)\s*[|–—-]\s*\Q"), F.trim(n), F.lit(r"\E.*$")), F.lit("")))
    for_names = F.aggregate(F.filter(names, lambda n: F.trim(n) != ""), short, lambda t, n: F.when(t.rlike("[|–—-]"), cut(t, n)).otherwise(t))
    labelled = filled(F.trim(F.regexp_extract("_text", r"(?i)(?=[la])(?<![A-Za-z0-9_])(?:location|address)\s*[:\-–—]\s*([^|;]{2,90})", 1)))
    place = F.coalesce(labelled, filled(F.regexp_extract("_text", rf"(?=[A-Z])(?<![A-Za-z0-9_])([A-Z][A-Za-z.' -]{{1,48}},\s*(?:{_STATE_CODES}))(?![A-Za-z0-9_])", 1)))
    rows = computed(rows.where(named), _short=for_names, _place=place).where(F.length("_short").between(3, 180))
    # Each URL's first result is chosen before its fields are worked out; a window carries the columns that are read and no others.
    carried = [c for c in pages.columns if c not in ("payload", "aliases")]
    rows = first_rows(rows.withColumn("_same", F.lower(url)), [*carried, "_same"], [F.col("_seq")])
    columns = _job(
        F.col("_board"), F.col("_item"), external_id=F.concat("_board", F.lit("-"), fnv1a_base36(url)), title=F.col("_short"), department=F.col("entity_name"), location=F.col("_place"), city=filled(F.trim(F.split_part("_place", F.lit(","), F.lit(1)))),
        state=filled(F.regexp_extract("_place", r",\s*([A-Z]{2})(?![A-Za-z0-9_])", 1)), country=F.lit("US"), is_remote=F.col("_text").rlike(r"(?i)(?=[rvt])(?<![A-Za-z0-9_])(?:remote|virtual|telework)(?![A-Za-z0-9_])"), posted_at=lenient_time(at("datePublished")), apply_url=url,
    )
    return rows.select(*carried, "aliases", "_seq", *columns)


#: Feeds of portals by level of government; each is a generic feed under its own name.
PORTALS = ("private", "federal", "state", "county", "city", "municipal")


def portal_feed(pages: DataFrame, portal: str, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    if portal not in PORTALS:
        raise ValueError(f"unknown portal {portal!r}")
    return feed(pages, f"portal:{portal}", keys)


# --- registries --------------------------------------------------------------------------------------------------------


def _header(name: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def zipped_tables(spark: SparkSession, path: str) -> DataFrame:
    """The largest CSV or text member of every archive: archive, line number, values by header (map), problem. The separator is that of the header.

    No line is dropped: one with more values than the header has no values and the problem `fields`; one that isn't UTF-8 keeps its values, with
    replacement characters, and has the problem `encoding`.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = [m for m in z.infolist() if m.filename.lower().endswith((".csv", ".txt"))]
                    if not members:
                        continue
                    with z.open(max(members, key=lambda m: m.file_size)) as f:
                        text = io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline="")
                        first = text.readline()
                        bare = "".join(p for k, p in enumerate(first.split('"')) if k % 2 == 0)  # outside quotes
                        sep = max(",|\t;", key=bare.count)
                        names = [_header(c) for c in next(csv.reader([first], delimiter=sep), [])]
                        rows = enumerate(row for row in csv.reader(text, delimiter=sep) if row)
                        while some := list(islice(rows, 20_000)):
                            whole = [dict(zip(names, [*row, *[""] * (len(names) - len(row))], strict=True)) if len(row) <= len(names) else {} for _, row in some]
                            problem = ["fields" if len(row) > len(names) else "encoding" if any("\ufffd" in v for v in row) else None for _, row in some]
                            yield pd.DataFrame({"archive": name, "line": [k for k, _ in some], "fields": whole, "problem": problem})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "archive string, line long, fields map<string,string>, problem string")


# Kinds of governments by the census's type code.
GOVERNMENT_TYPES = ("state", "county", "municipality", "township", "special_district", "school_district", "federal", "other")


def census_governments(rows: DataFrame, source_year: int) -> DataFrame:
    """Census rows (fields) as registry rows, with whatever else the rows carry; codes keep their leading zeros. Rows without id or name go."""
    f = lambda *names: F.coalesce(*(F.nullif(F.trim(F.element_at("fields", n)), F.lit("")) for n in names))
    pad = lambda c, n: F.lpad(c, n, "0")
    code = f("type_code", "unit_type", "govt_type").try_cast("int")
    kind = F.get(F.array(*(F.lit(t) for t in GOVERNMENT_TYPES)), code)
    out = rows.select(
        *(c for c in rows.columns if c != "fields"),
        f("census_id_pid6", "census_government_id", "gid", "id").alias("id"), f("unit_name", "name", "government_name").alias("name"), F.coalesce(kind, F.lower(f("unit_type", "government_type"))).alias("government_type"), pad(f("fips_state", "state_fips"), 2).alias("state_fips"),
        F.upper(f("state", "state_code")).alias("state_code"), pad(f("fips_county", "county_fips"), 3).alias("county_fips"), f("county_area_name", "county_name").alias("county_name"), pad(f("fips_place", "place_fips"), 5).alias("place_fips"), f("web_address", "website").alias("website"),
        F.lit(source_year).alias("source_year"), F.lit(True).alias("is_active"),
    )
    return out.where("id is not null and name is not null")


def directory_entries(pages: DataFrame, directory: str, minimum_rows: int) -> DataFrame:
    """Organisations with links of a directory page: the anchors of its tables and lists, last one of a name wins; refused if too few."""
    from ..operators.dedupe import last_wins

    rows = pages.select("page_url", F.posexplode(anchors(F.col("payload"))).alias("_seq", "_a"))
    rows = rows.select("_seq", strip_markup(F.col("_a.text")).alias("organization_name"), absolute(F.col("_a.href"), F.col("page_url")).alias("jobs_url"))
    rows = rows.where((F.length("organization_name") >= 3) & F.col("jobs_url").isNotNull() & ~is_generic_title(F.col("organization_name")))
    out = last_wins(rows.withColumn("entry_key", F.lower("organization_name")), ["entry_key"]).withColumn("directory_key", F.lit(directory)).drop("_seq")
    if (n := out.count()) < minimum_rows:
        raise ValueError(f"refused: {n} entries of {directory}, at least {minimum_rows} are expected")
    return out
