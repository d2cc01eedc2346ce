"""Normalisers: a captured page of a provider (one JSON or XML text a row) into rows of one schema.

Each takes a DataFrame with `payload` (text) and whatever else the capture knows (entity_id, board, ...), which is carried; `_seq` counts the rows of a
page in order. Fields are read by path, so a payload with other fields, or none, gives nulls and not an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite, lenient_time, pick, relative_date, truthy
from ..functions.text import city_part, country_code, state_part, strip_markup, xml_blocks, xml_tag
from ..operators.frames import computed, first_rows

FIELDS = ("external_id", "source", "title", "department", "location", "city", "state", "country", "lat", "lng", "is_remote", "posted_at", "apply_url", "raw_data")


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _job(source: str | Column, item: Column, **fields: Column) -> list[Column]:
    kinds = {"lat": "double", "lng": "double", "is_remote": "boolean", "posted_at": "timestamp"}
    location = fields.get("location", _null())
    known = {"source": F.lit(source) if isinstance(source, str) else source, "raw_data": item, "is_remote": F.coalesce(F.lower(location).contains("remote"), F.lit(False))} | fields
    return [known.get(c, _null()).cast(kinds.get(c, "string")).alias(c) for c in FIELDS]


def _items(pages: DataFrame, *paths: str) -> DataFrame:
    """One row per item of the first of these arrays that a page has; `$` is the page itself."""
    arrays = F.coalesce(*(F.from_json(F.col("payload") if p == "$" else F.get_json_object("payload", f"$.{p}"), "array<string>") for p in paths))
    return pages.select(*(c for c in pages.columns if c != "payload"), F.posexplode(arrays).alias("_seq", "_item")).where("_item is not null")


def _read(rows: DataFrame, *keys: str, of: str = "_item", inside: str = "") -> tuple[DataFrame, Callable[..., Column]]:
    """Rows with these keys of a JSON object (text, column `of`), read in one pass, and a function to the first of some keys that isn't null or blank.

    Of a repeated key the last value holds. One half of a surrogate pair spoils the whole pass, so items with such escapes are read from `_item`
    key by key; there the object stands at the path `inside`.
    """
    held = {k: f"{of}_{k}" for k in keys}
    cut = F.coalesce(F.col("_item").rlike(r"(?i)\\ud[89a-f]"), F.lit(False)).alias("_cut")
    read = rows.select("*", cut, F.json_tuple(of, *keys).alias(*held.values()))
    # Settled here, so that the item itself needn't be carried on for that.
    read = read.select(*rows.columns, *(F.when(F.col("_cut"), F.get_json_object("_item", f"$.{inside}{k}")).otherwise(F.col(c)).alias(c) for k, c in held.items()))
    return read, lambda *some: F.coalesce(*(F.nullif(F.col(held[k]), F.lit("")) for k in some))


def _finish(rows: DataFrame, columns: list[Column]) -> DataFrame:
    # A generator's output is computed once; a filter on a field would otherwise find it again, and the fields that it is made of.
    return rows.select(*(c for c in rows.columns if c != "_item"), F.inline(F.array(F.struct(*columns))))


def greenhouse(pages: DataFrame) -> DataFrame:
    """The date is that of the last update, which is all the board gives."""
    rows, i = _items(pages, "jobs"), F.col("_item")
    place = pick(i, "location.name")
    return _finish(rows, _job("greenhouse", i, external_id=pick(i, "id"), title=pick(i, "title"), department=pick(i, "departments[0].name"), location=place, city=city_part(place), state=state_part(place), posted_at=lenient_time(pick(i, "updated_at")), apply_url=pick(i, "absolute_url")))


def lever(pages: DataFrame) -> DataFrame:
    rows, i = _items(pages, "$"), F.col("_item")
    place = pick(i, "categories.location")
    return _finish(rows, _job("lever", i, external_id=pick(i, "id"), title=pick(i, "text"), department=pick(i, "categories.department", "categories.team"), location=place, city=city_part(place), state=state_part(place), country=F.lit("US"), posted_at=lenient_time(pick(i, "createdAt")), apply_url=pick(i, "hostedUrl", "applyUrl")))


def smartrecruiters(pages: DataFrame) -> DataFrame:
    rows, i = _items(pages, "content"), F.col("_item")
    parts = F.concat_ws(", ", pick(i, "location.city"), pick(i, "location.region"), F.upper(pick(i, "location.country")))
    return _finish(rows, _job("smartrecruiters", i, external_id=pick(i, "id"), title=pick(i, "name"), department=pick(i, "department.label"), location=F.nullif(parts, F.lit("")), city=pick(i, "location.city"), state=pick(i, "location.region"), country=F.upper(pick(i, "location.country")), is_remote=truthy(pick(i, "location.remote")), posted_at=lenient_time(pick(i, "releasedDate")), apply_url=pick(i, "applyUrl", "ref")))


def bamboohr(pages: DataFrame) -> DataFrame:
    rows, i = _items(pages, "result", "$"), F.col("_item")
    place = F.nullif(F.concat_ws(", ", pick(i, "location.city"), pick(i, "location.state")), F.lit(""))
    return _finish(rows, _job("bamboohr", i, external_id=pick(i, "id"), title=pick(i, "jobOpeningName", "title"), department=pick(i, "departmentLabel", "department"), location=place, city=pick(i, "location.city"), state=pick(i, "location.state"), is_remote=truthy(pick(i, "isRemote")), posted_at=lenient_time(pick(i, "datePosted")), apply_url=pick(i, "applyUrl", "url")))


def ashby(pages: DataFrame) -> DataFrame:
    """Listed jobs only."""
    rows, i = _items(pages, "jobs"), F.col("_item")
    rows = rows.where(F.coalesce(F.get_json_object(i, "$.isListed") != "false", F.lit(True)))
    place = pick(i, "location", "address.postalAddress.addressLocality")
    return _finish(rows, _job("ashby", i, external_id=pick(i, "id"), title=pick(i, "title"), department=pick(i, "department", "team"), location=place, city=F.coalesce(pick(i, "address.postalAddress.addressLocality"), city_part(place)), state=F.coalesce(pick(i, "address.postalAddress.addressRegion"), state_part(place)), country=country_code(pick(i, "address.postalAddress.addressCountry")), is_remote=truthy(pick(i, "isRemote")), posted_at=lenient_time(pick(i, "publishedAt")), apply_url=pick(i, "jobUrl", "applyUrl")))


def recruitee(pages: DataFrame) -> DataFrame:
    """Published offers, and those that say nothing of their status."""
    rows, i = _items(pages, "offers"), F.col("_item")
    rows = rows.where(F.coalesce(pick(i, "status"), F.lit("published")) == "published")
    return _finish(rows, _job("recruitee", i, external_id=pick(i, "id"), title=pick(i, "title"), department=pick(i, "department"), location=pick(i, "location"), city=pick(i, "city"), state=pick(i, "state_code", "state_name"), country=country_code(pick(i, "country_code", "country")), is_remote=truthy(pick(i, "remote")), posted_at=lenient_time(pick(i, "published_at", "created_at")), apply_url=pick(i, "careers_url", "careers_apply_url")))


def workday(pages: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The id is the first bullet field, else the path's last part; the URL is the board's `base_url` and the path; dates are relative to as_of."""
    rows, i = _items(pages, "jobPostings"), F.col("_item")
    now = as_of if as_of is not None else F.current_timestamp()
    path, place = pick(i, "externalPath"), pick(i, "locationsText")
    base = F.col("base_url") if "base_url" in pages.columns else F.lit("")
    return _finish(rows, _job("workday", i, external_id=F.coalesce(pick(i, "bulletFields[0]"), F.nullif(F.regexp_extract(path, r"_([^_/]+)$", 1), F.lit("")), path), title=pick(i, "title"), location=place, city=city_part(place), state=state_part(place), country=country_code(F.element_at(F.split(place, r",\s*"), -1)), posted_at=relative_date(pick(i, "postedOn"), now), apply_url=F.concat(base, path)))


def workable(pages: DataFrame) -> DataFrame:
    """Only jobs with an apply URL."""
    rows, i = _items(pages, "jobs", "results"), F.col("_item")
    url = pick(i, "url", "application_url", "shortlink")
    place = F.nullif(F.concat_ws(", ", pick(i, "city", "location.city"), pick(i, "state", "location.region")), F.lit(""))
    return _finish(rows, _job("workable", i, external_id=pick(i, "shortcode", "id"), title=pick(i, "title"), department=pick(i, "department"), location=place, city=pick(i, "city", "location.city"), state=pick(i, "state", "location.region"), country=country_code(pick(i, "country", "location.country")), is_remote=truthy(pick(i, "telecommuting", "remote")), posted_at=lenient_time(pick(i, "published_on", "created_at")), apply_url=url)).where("apply_url is not null")


def usajobs(pages: DataFrame) -> DataFrame:
    """The same item on two pages is one job: the first of each id is chosen before its fields are worked out."""
    d, carried = "MatchedObjectDescriptor", [c for c in pages.columns if c != "payload"]
    rows, at = _read(_items(pages, "SearchResult.SearchResultItems"), "MatchedObjectId")
    rows = first_rows(computed(rows, _id=F.coalesce(at("MatchedObjectId"), pick(F.col("_item"), f"{d}.PositionID"))), [*carried, "_id"], [F.col("_seq")])
    # Under a wildcard a text keeps its quotes, so one that holds JSON isn't taken for an object.
    part = lambda text, path: F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), f"$[*].{path}")
    rows, at = _read(computed(rows, _job=part(F.col("_item"), d)), "PositionTitle", "DepartmentName", "OrganizationName", "PositionLocationDisplay", "PublicationStartDate", "PositionURI", of="_job", inside=f"{d}.")
    rows, here = _read(computed(rows, _at=part(F.col("_job"), "PositionLocation[0]")), "LocationName", "CityName", "CountrySubDivisionCode", "CountryCode", "Latitude", "Longitude", of="_at", inside=f"{d}.PositionLocation[0].")
    place = F.coalesce(at("PositionLocationDisplay"), here("LocationName"))
    columns = _job("usajobs", F.col("_item"), external_id=F.col("_id"), title=at("PositionTitle"), department=at("DepartmentName", "OrganizationName"), location=place, city=city_part(here("CityName")), state=here("CountrySubDivisionCode"), country=country_code(here("CountryCode")), lat=finite(here("Latitude")), lng=finite(here("Longitude")), posted_at=lenient_time(at("PublicationStartDate")), apply_url=F.coalesce(at("PositionURI"), pick(F.col("_item"), f"{d}.ApplyURI[0]")))
    return rows.select(*carried, "_seq", *columns)


def nlx(pages: DataFrame) -> DataFrame:
    rows, i = _items(pages, "Jobs", "jobs", "results", "data", "items"), F.col("_item")
    place = pick(i, "Location", "location", "cityState")
    return _finish(rows, _job("nlx", i, external_id=pick(i, "JvId", "id", "jobId", "guid", "ReferenceNumber"), title=pick(i, "JobTitle", "title", "Title"), department=pick(i, "Company", "company", "employer"), location=place, city=F.coalesce(pick(i, "city", "City"), city_part(place)), state=F.coalesce(pick(i, "state", "State"), state_part(place)), posted_at=lenient_time(pick(i, "DatePosted", "AccquisitionDate", "date_posted", "postedDate")), apply_url=pick(i, "URL", "url", "applyUrl", "link")))


def careeronestop(pages: DataFrame) -> DataFrame:
    """A mirror of the national exchange; its dates are those of acquisition, so none is taken."""
    rows, i = _items(pages, "Jobs"), F.col("_item")
    place = pick(i, "Location")
    return _finish(rows, _job("careeronestop", i, external_id=pick(i, "JvId"), title=pick(i, "JobTitle"), department=pick(i, "Company"), location=place, city=city_part(place), state=state_part(place), country=F.lit("US"), apply_url=pick(i, "URL"))).withColumn("lineage_root", F.lit("careeronestop:nlx_mirror"))


def adzuna(pages: DataFrame) -> DataFrame:
    rows, i = _items(pages, "results"), F.col("_item")
    area = F.from_json(F.get_json_object(i, "$.location.area"), "array<string>")
    return _finish(rows, _job("adzuna", i, external_id=pick(i, "id"), title=strip_markup(pick(i, "title")), department=pick(i, "category.label"), location=pick(i, "location.display_name"), city=F.when(F.size(area) > 2, F.element_at(area, -1)), state=F.get(area, F.lit(1)), country=country_code(F.get(area, F.lit(0))), lat=finite(pick(i, "latitude")), lng=finite(pick(i, "longitude")), posted_at=lenient_time(pick(i, "created")), apply_url=pick(i, "redirect_url")))


# Where generic feeds keep their rows and fields.
ROW_PATHS = ("data", "jobs", "results", "items", "postings", "hits", "records", "jobs_results", "data.jobs", "response.jobs", "result.jobs", "$")
FEED_KEYS = {
    "external_id": ("job_id", "id", "jobId", "uuid", "slug", "guid", "requisition_id"), "title": ("job_title", "title", "name", "position", "positionTitle"), "department": ("department", "category", "team", "job_category"),
    "location": ("job_location", "location", "location.name", "locationName", "formatted_location"), "city": ("job_city", "city", "location.city"), "state": ("job_state", "state", "region", "location.state"),
    "country": ("job_country", "country", "country_code", "location.country"), "lat": ("job_latitude", "latitude", "lat"), "lng": ("job_longitude", "longitude", "lng", "lon"),
    "posted_at": ("job_posted_at_datetime_utc", "date_posted", "posted_at", "publication_date", "created_at", "published", "date"), "apply_url": ("job_apply_link", "apply_url", "url", "link", "redirect_url", "absolute_url", "job_url"),
}


def feed(pages: DataFrame, source: str, keys: dict[str, tuple[str, ...]] | None = None, row_paths: tuple[str, ...] = ROW_PATHS) -> DataFrame:
    """Any JSON feed: rows at the first known path, each field at the first key that has a value."""
    rows, i = _items(pages, *row_paths), F.col("_item")
    at = {c: pick(i, *paths) for c, paths in (FEED_KEYS | (keys or {})).items()}
    at |= {"city": F.coalesce(at["city"], city_part(at["location"])), "state": F.coalesce(at["state"], state_part(at["location"])), "country": country_code(at["country"]), "lat": finite(at["lat"]), "lng": finite(at["lng"]), "posted_at": lenient_time(at["posted_at"])}
    return _finish(rows, _job(source, i, **at)).where("title is not null")


def neogov_rss(pages: DataFrame) -> DataFrame:
    """Items with a title and a link; `feed_status` of each page is in `neogov_status`."""
    rows = pages.select(*(c for c in pages.columns if c != "payload"), F.posexplode(xml_blocks(F.col("payload"), "item")).alias("_seq", "_item"))
    i = F.col("_item")
    place = F.nullif(F.regexp_extract(xml_tag(i, "description"), r"(?i)location\s*:\s*([A-Za-z .'-]+,\s*[A-Z]{2})", 1), F.lit(""))
    raw = F.to_json(F.struct(xml_tag(i, "guid").alias("guid"), xml_tag(i, "category").alias("category"), F.lit("structured_rss").alias("parser")))
    out = _job("gov:neogov_rss", raw, external_id=F.coalesce(xml_tag(i, "guid"), xml_tag(i, "link")), title=xml_tag(i, "title"), department=xml_tag(i, "category"), location=place, city=city_part(place), state=state_part(place), country=F.lit("US"), posted_at=lenient_time(xml_tag(i, "pubDate")), apply_url=xml_tag(i, "link"))
    return _finish(rows, out).where("title is not null and apply_url is not null")


def neogov_status(pages: DataFrame) -> DataFrame:
    """Per page: items, invalid_items, status. A page that is no feed is an error and never a proven zero; so is one with an item that can't be read."""
    p = F.col("payload")
    items = xml_blocks(p, "item")
    bad = F.size(F.filter(items, lambda i: xml_tag(i, "title").isNull() | xml_tag(i, "link").isNull()))
    is_feed = F.coalesce(p.rlike(r"(?i)<(?:rss|feed|channel)[\s>]"), F.lit(False))
    status = F.when(~is_feed | (bad > 0), "error").when(F.size(items) == 0, "zero").otherwise("success")
    return pages.select(*(c for c in pages.columns if c != "payload"), F.when(is_feed, F.size(items)).otherwise(0).alias("items"), F.when(is_feed, bad).otherwise(0).alias("invalid_items"), status.alias("status"), (status == "zero").alias("authoritative_zero"))


def personio(pages: DataFrame) -> DataFrame:
    """XML positions; the posting's URL stays on the host that served it (`base_url`)."""
    rows = pages.select(*(c for c in pages.columns if c != "payload"), F.posexplode(xml_blocks(F.col("payload"), "position")).alias("_seq", "_item"))
    i = F.col("_item")
    base = F.regexp_extract(F.col("base_url"), r"^(https?://[^/]+)", 1) if "base_url" in pages.columns else F.lit("")
    place = xml_tag(i, "office")
    return _finish(rows, _job("personio", F.to_json(F.struct(xml_tag(i, "recruitingCategory").alias("category"))), external_id=xml_tag(i, "id"), title=xml_tag(i, "name"), department=xml_tag(i, "department"), location=place, city=city_part(place), posted_at=lenient_time(xml_tag(i, "createdAt")), apply_url=F.concat(base, F.lit("/job/"), xml_tag(i, "id"))))


def sitemap_urls(pages: DataFrame) -> DataFrame:
    """Every `<loc>` of a sitemap, in order, and whether it names another sitemap."""
    found = F.transform(xml_blocks(F.col("payload"), "loc"), strip_markup)
    rows = pages.select(*(c for c in pages.columns if c != "payload"), F.col("payload").rlike("(?i)<sitemapindex").alias("is_index"), F.posexplode(found).alias("_seq", "url"))
    return rows.where(F.col("url").rlike("^https?://"))


def table_rows(pages: DataFrame) -> DataFrame:
    """Cells of every HTML table row: `cells` (texts) and `hrefs`."""
    cell = F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>")
    rows = pages.select(*(c for c in pages.columns if c != "payload"), F.posexplode(xml_blocks(F.col("payload"), "tr")).alias("_seq", "_row"))
    return rows.select("*", F.transform(F.regexp_extract_all("_row", cell, F.lit(1)), strip_markup).alias("cells"), F.regexp_extract_all("_row", F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)"), F.lit(1)).alias("hrefs")).drop("_row").where(F.size("cells") > 0)


def json_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text lines (column value) as (rows of one feed schema, lines that are no JSON object)."""
    good = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    rows = lines.where(F.trim("value") != "")
    return feed(rows.where(good).select(F.concat(F.lit("["), F.col("value"), F.lit("]")).alias("payload")), "scrapy:career_page", row_paths=("$",)), rows.where(~F.coalesce(good, F.lit(False)))


#: Providers by the name that their rows carry.
NORMALISERS: dict[str, Callable[..., DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "smartrecruiters": smartrecruiters, "bamboohr": bamboohr, "ashby": ashby, "recruitee": recruitee, "workday": workday, "workable": workable,
    "usajobs": usajobs, "nlx": nlx, "careeronestop": careeronestop, "adzuna": adzuna, "gov:neogov_rss": neogov_rss, "personio": personio,
}


def normalise(pages: DataFrame) -> DataFrame:
    """Pages of many providers (provider, payload, ...) through the normaliser of each; other providers' pages are read as feeds."""
    carried = [c for c in pages.columns if c != "payload"]
    parts = [f(pages.where(F.col("provider") == name)).select(*carried, "_seq", *FIELDS) for name, f in NORMALISERS.items()]
    parts.append(feed(pages.where(~F.col("provider").isin(*NORMALISERS)), "jobapi:generic").select(*carried, "_seq", *FIELDS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
