"""Feeds read by rows of a table: what an adapter asks for, and where its payload keeps rows and fields, is data and no code.

`adapters` has one row an adapter: adapter (its name), host, path, source, and, each of them optional, params (map of templates), results_path, keys (map of
field to more keys, tried first) and enabled. All adapters go through one plan: the table is joined to the pages and its paths are read by VARIANT at run time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite, lenient_time, shift31_hash, truthy
from ..operators.frames import column_or_null

# Where payloads keep their rows, and the keys of each field in order.
ROW_PATHS = ("data", "results", "jobs", "job_results", "items", "postings", "response.jobs", "data.jobs", "data.results", "data.items", "data.job_results")
FIELD_KEYS = {
    "title": ("job_title", "title", "name", "position", "jobName", "position_title"),
    "city": ("job_city", "city", "location_city", "formattedWorkLocationCity"),
    "state": ("job_state", "state", "region", "province", "location_state", "formattedWorkLocationState"),
    "country": ("job_country", "country", "location_country", "formattedWorkLocationCountry"),
    "location": ("job_location", "location", "formattedLocation", "formatted_work_location"),
    "apply_url": ("job_apply_link", "job_google_link", "apply_link", "url", "link", "job_url", "posting_url"),
    "employer": ("employer_name", "company_name", "company", "hiring_company", "organization"),
    "external_id": ("job_id", "id", "jobkey", "jobKey", "posting_id", "position_id", "slug"),
    "department": ("department", "category", "job_category"),
    "is_remote": ("job_is_remote", "is_remote", "remote"),
    "lat": ("job_latitude", "latitude", "lat"),
    "lng": ("job_longitude", "longitude", "lng", "lon"),
    "posted_at": ("job_posted_at_datetime_utc", "job_posted_at_timestamp", "posted_at", "datePosted", "date_posted", "pubDate", "created_at"),
}
HOME_COUNTRY = "US"

#: Ways that can be read: names between dots.
_WAY = r"^[^.\[\]\s]+(\.[^.\[\]\s]+)*$"


def _known(adapters: DataFrame) -> DataFrame:
    """The usable adapters, as columns _adapter and _a: with a host and a path, and not switched off."""
    c = lambda name, kind="string": (F.col(name) if name in adapters.columns else F.lit(None)).cast(kind)
    name = F.regexp_replace(F.regexp_replace(F.trim(c("host")), "(?i)^https?://", ""), "/.*$", "")
    fields = F.struct(name.alias("host"), c("path").alias("path"), F.coalesce(c("source"), F.concat(F.lit("jobapi:"), "adapter")).alias("source"), c("params", "map<string,string>").alias("params"), c("results_path").alias("results_path"), c("keys", "map<string,array<string>>").alias("keys"))
    return adapters.where(F.coalesce(c("enabled", "boolean"), F.lit(True))).select(F.col("adapter").alias("_adapter"), fields.alias("_a")).where("_a.host != '' AND _a.path != ''")


def requests(asked: DataFrame, adapters: DataFrame, country: str = "us", location: str = "", limit: int = 25) -> DataFrame:
    """Adds `url`, the request of each row's adapter for the row's entity (entity_name; optional aliases, portal, category, industry).

    Templates may name {entity}, {alias} (the first one, else the name), {country}, {location}, {limit}, {portal}, {category} and {industry}. Blank
    parameters are left out. Rows of unknown or unusable adapters are left out.
    """
    told = lambda name: F.coalesce(column_or_null(asked, name).cast("string"), F.lit(""))
    alias = F.coalesce(F.nullif(F.get((F.col("aliases") if "aliases" in asked.columns else F.lit(None)).cast("array<string>"), F.lit(0)), F.lit("")), told("entity_name"))
    values = {"entity": told("entity_name"), "alias": alias, "country": F.lit(country), "location": F.lit(location), "limit": F.lit(str(limit)), "portal": told("portal"), "category": told("category"), "industry": told("industry")}

    def filled(template: Column) -> Column:
        for name, value in values.items():
            template = F.replace(template, F.lit(f"{{{name}}}"), value)
        return template

    rows = asked.join(_known(adapters), F.col("adapter") == F.col("_adapter"))
    pairs = F.transform(F.map_entries("_a.params"), lambda p: F.struct(p["key"].alias("key"), filled(p["value"]).alias("value")))
    query = F.array_join(F.transform(F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""), lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    path = F.when(F.col("_a.path").startswith("/"), F.col("_a.path")).otherwise(F.concat(F.lit("/"), "_a.path"))
    return rows.withColumn("url", F.concat(F.lit("https://"), "_a.host", path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).drop("_adapter", "_a")


def _said(value: Column) -> Column:
    """(kind, text) of a value; null for none, JSON's null and the empty text."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    text = F.when(kind.isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), F.try_variant_get(value, "$", "string"))
    return F.when((kind != "VOID") & ~((kind == "STRING") & (text == "")), F.struct(kind.alias("kind"), F.nullif(F.trim(text), F.lit("")).alias("text")))


def _at(value: Column, way: Column) -> Column:
    return F.try_variant_get(value, F.concat(F.lit("$."), way), "variant")


def _field(name: str, keys: Iterable[str]) -> Column:
    """The text of the first key that has a value: the adapter's own keys, then the fixed ones. A value that is no text, number or boolean ends the search with null."""
    own = F.filter(F.element_at("_a.keys", F.lit(name)), lambda k: k.rlike(_WAY))
    first = F.get(F.filter(F.transform(own, lambda k: _said(_at(F.col("_item"), k))), lambda s: s.isNotNull()), F.lit(0))
    return F.coalesce(first, *(_said(F.try_variant_get("_item", f"$.{k}", "variant")) for k in keys))["text"]


def _items(pages: DataFrame, adapters: DataFrame) -> DataFrame:
    """One row an item of the first array that a page has: at the adapter's path, at ROW_PATHS in order, or the payload itself; a row of nulls where there is none."""
    rows = pages.join(_known(adapters), F.col("adapter") == F.col("_adapter")).withColumn("_payload", F.try_parse_json("payload"))
    array = lambda way: F.try_variant_get("_payload", way, "array<variant>")
    preferred = F.when(F.col("_a.results_path").rlike(_WAY), array(F.concat(F.lit("$."), F.coalesce("_a.results_path", F.lit("data")))))
    found = F.coalesce(preferred, *(array(f"$.{p}") for p in ROW_PATHS), array("$"))
    return rows.select(*(c for c in pages.columns if c != "payload"), "_a", F.posexplode_outer(found).alias("_seq", "_item"))


def adapter_jobs(pages: DataFrame, adapters: DataFrame) -> DataFrame:
    """Jobs of captured pages (adapter, payload; optional entity_name), by the table of adapters: the page's columns, _seq and the fields of a job.

    A row needs a title. A missing country is the home one; a missing place is put together from city, state and country; a missing department is the
    employer; a missing id is a hash of source, entity, title, place and URL (or the row's number). Per entity, source and id the first row of the page stays.

    Defined cases: payloads that are null, malformed or without rows, and pages of unknown adapters, give nothing; ways that can't be read are passed over; items that
    are no objects are dropped; empty tables give an empty table; other columns are returned untouched.
    """
    rows = _items(pages, adapters)
    carried = [c for c in pages.columns if c != "payload"]
    at = {name: _field(name, keys).alias(name) for name, keys in FIELD_KEYS.items()}
    rows = rows.select(*carried, "_seq", "_a", "_item", F.struct(*at.values()).alias("_f")).where("_f.title IS NOT NULL")
    f = lambda name: F.col(f"_f.{name}")
    country = F.upper(F.coalesce(f("country"), F.lit(HOME_COUNTRY)))
    place = F.coalesce(f("location"), F.concat_ws(", ", f("city"), f("state"), F.coalesce(f("country"), F.lit(HOME_COUNTRY))))
    entity = F.coalesce(column_or_null(pages, "entity_name").cast("string"), F.lit(""))
    made = F.concat(F.lit("generated-"), shift31_hash(F.concat_ws(":", "_a.source", entity, f("title"), place, F.coalesce(f("apply_url"), F.col("_seq").cast("string")))).cast("string"))
    remote = truthy(f("is_remote")) | F.concat_ws(" ", f("title"), place).rlike(r"(?i)\bremote\b")
    jobs = {
        "external_id": F.coalesce(f("external_id"), made), "source": F.col("_a.source"), "title": f("title"), "department": F.coalesce(f("department"), f("employer")), "employer": f("employer"), "location": place, "city": f("city"), "state": f("state"),
        "country": country, "lat": finite(f("lat")), "lng": finite(f("lng")), "is_remote": remote, "is_overseas": country != HOME_COUNTRY, "posted_at": lenient_time(f("posted_at")), "apply_url": f("apply_url"), "raw_data": F.to_json("_item"),
    }
    out = rows.select(*carried, "_seq", *(c.alias(name) for name, c in jobs.items()))
    first = out.groupBy(entity.alias("_entity"), F.col("source").alias("_source"), F.col("external_id").alias("_id")).agg(F.min_by(F.struct("*"), F.struct("_seq", F.xxhash64("raw_data"))).alias("_job"))
    return first.select("_job.*")


def adapter_use(pages: DataFrame, adapters: DataFrame) -> DataFrame:
    """Per entity_name and source: jobs (rows with a title), used, and the note of one that gave none."""
    title = _field("title", FIELD_KEYS["title"])
    entity = column_or_null(pages, "entity_name").cast("string").alias("entity_name")
    counts = _items(pages, adapters).groupBy(entity, F.col("_a.source").alias("source")).agg(F.count(title).alias("jobs"))
    return counts.select("*", (F.col("jobs") > 0).alias("used"), F.when(F.col("jobs") == 0, F.concat("source", F.lit(" (0 jobs returned)"))).alias("note"))
