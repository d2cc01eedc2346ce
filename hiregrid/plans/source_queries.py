"""Registered queries of the normalisers: payloads are written from the parts table and read back, the twin states what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import computed
from ..sources import adapters, payloads, web
from . import lens as L
from .queries import query

_KEY = "CAST(p_partkey AS VARCHAR)"
_TITLE = "p_name || ' ' || p_partkey"
_DAY = "CAST(DATE '2024-01-01' + p_size AS DATE)"
_CITY, _STATE = "'Town ' || (p_partkey % 50)", "CASE p_size % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'NV' ELSE 'TX' END"
_URL = "'https://jobs.example.org/j/' || p_partkey"


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _title() -> Column:
    return F.concat_ws(" ", "p_name", "p_partkey")


def _city() -> Column:
    return F.concat(F.lit("Town "), F.pmod("p_partkey", F.lit(50)).cast("string"))


def _state() -> Column:
    return F.when(F.col("p_size") % 3 == 0, "CA").when(F.col("p_size") % 3 == 1, "NV").otherwise("TX")


def _place() -> Column:
    return F.concat_ws(", ", _city(), _state())


def _url() -> Column:
    return F.concat(F.lit("https://jobs.example.org/j/"), _key())


def _day(suffix: str = "") -> Column:
    return F.concat(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("string"), F.lit(suffix))


def _s(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _captured(spark: SparkSession, d: str, payload: Column, **more: Column) -> DataFrame:
    """One captured page for each part. Parts are few bytes and in few pieces, pages are work: they are dealt out to all cores first."""
    return computed(L.spread(L.table(spark, d, "part"), "p_partkey"), payload=payload, **more).select("p_partkey", "payload", *more)


def _shown(jobs: DataFrame, *columns: str) -> DataFrame:
    """The key and these columns; posted_at as a day."""
    return jobs.select("p_partkey", *(F.to_date("posted_at").alias("posted_day") if c == "posted_day" else F.col(c) for c in columns))


_COMMON = f"{_KEY} AS external_id, {_TITLE} AS title, {_CITY} AS city, {_STATE} AS state, {_URL} AS apply_url"
_COMMON_COLUMNS = ("external_id", "title", "city", "state", "apply_url")


@query(f"SELECT p_partkey, {_COMMON}, 'lever' AS source, p_brand AS department, 'US' AS country, {_DAY} AS posted_day FROM part")
def lever_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(id=_key(), text=_title(), categories=_s(location=_place(), team=F.col("p_brand")), createdAt=F.unix_millis(F.timestamp_seconds((F.lit(19723) + F.col("p_size")).cast("long") * 86400 + 36000)), hostedUrl=_url())
    return _shown(payloads.lever(_captured(spark, d, F.to_json(F.array(item)))), *_COMMON_COLUMNS, "source", "department", "country", "posted_day")


@query(f"SELECT p_partkey, {_COMMON}, 'US' AS country, {_CITY} || ', ' || {_STATE} || ', US' AS location, p_size > 40 AS is_remote, {_DAY} AS posted_day FROM part")
def smartrecruiters_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(id=_key(), name=_title(), location=_s(city=_city(), region=_state(), country=F.lit("us"), remote=F.col("p_size") > 40), releasedDate=_day("T08:00:00.000Z"), ref=_url())
    return _shown(payloads.smartrecruiters(_captured(spark, d, F.to_json(_s(content=F.array(item))))), *_COMMON_COLUMNS, "country", "location", "is_remote", "posted_day")


@query(f"SELECT p_partkey, {_COMMON}, p_type AS department, p_size % 2 = 0 AS is_remote FROM part")
def bamboohr_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(id=_key(), jobOpeningName=_title(), departmentLabel=F.col("p_type"), location=_s(city=_city(), state=_state()), isRemote=F.when(F.col("p_size") % 2 == 0, "yes").otherwise("no"), url=_url())
    return _shown(payloads.bamboohr(_captured(spark, d, F.to_json(_s(result=F.array(item))))), *_COMMON_COLUMNS, "department", "is_remote")


@query(f"SELECT p_partkey, {_COMMON}, 'DE' AS country FROM part WHERE p_size % 5 <> 0")
def ashby_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(id=_key(), title=_title(), isListed=F.col("p_size") % 5 != 0, location=_place(), address=_s(postalAddress=_s(addressLocality=_city(), addressRegion=_state(), addressCountry=F.lit("Germany"))), jobUrl=_url())
    return _shown(payloads.ashby(_captured(spark, d, F.to_json(_s(jobs=F.array(item))))), *_COMMON_COLUMNS, "country")


@query(f"SELECT p_partkey, {_COMMON}, {_DAY} AS posted_day FROM part WHERE p_size % 4 <> 0")
def recruitee_payload(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("p_size") % 4 == 0, "draft").when(F.col("p_size") % 4 == 1, "published")
    item = _s(id=F.col("p_partkey"), title=_title(), status=status, location=_place(), city=_city(), state_code=_state(), published_at=_day(" 09:30:00"), careers_url=_url())
    return _shown(payloads.recruitee(_captured(spark, d, F.to_json(_s(offers=F.array(item))))), *_COMMON_COLUMNS, "posted_day")


@query(f"""SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'R' || p_partkey ELSE 'JR-' || p_partkey END AS external_id, {_TITLE} AS title, {_CITY} AS city, {_STATE} AS state, 'https://acme.wd1.example.org/job/x_JR-' || p_partkey AS apply_url,
CASE WHEN p_size < 10 THEN DATE '2024-01-31' WHEN p_size < 20 THEN DATE '2024-01-30' ELSE CAST(DATE '2024-01-31' - p_size AS DATE) END AS posted_day FROM part""")
def workday_payload(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    posted = F.when(n < 10, "Posted Today").when(n < 20, "Posted Yesterday").otherwise(F.concat(F.lit("Posted "), n.cast("string"), F.lit("+ Days Ago")))
    item = _s(title=_title(), externalPath=F.concat(F.lit("/job/x_JR-"), _key()), locationsText=_place(), postedOn=posted, bulletFields=F.when(n % 2 == 0, F.array(F.concat(F.lit("R"), _key()))))
    pages = _captured(spark, d, F.to_json(_s(total=F.lit(1), jobPostings=F.array(item))), base_url=F.lit("https://acme.wd1.example.org"))
    return _shown(payloads.workday(pages, F.lit("2024-01-31 12:00:00").cast("timestamp")), *_COMMON_COLUMNS, "posted_day")


@query(f"SELECT p_partkey, {_COMMON}, p_size > 25 AS is_remote, {_DAY} AS posted_day FROM part WHERE p_size % 3 <> 0")
def workable_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(shortcode=_key(), title=_title(), city=_city(), state=_state(), telecommuting=F.col("p_size") > 25, published_on=_day(), url=F.when(F.col("p_size") % 3 != 0, _url()))
    return _shown(payloads.workable(_captured(spark, d, F.to_json(_s(jobs=F.array(item))))), *_COMMON_COLUMNS, "is_remote", "posted_day")


@query(f"SELECT p_partkey, {_KEY} AS external_id, {_TITLE} AS title, p_type AS department, {_CITY} AS city, 'https://acme.jobs.example.org/job/' || p_partkey AS apply_url FROM part")
def personio_payload(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<workzag-jobs><position><id>"), _key(), F.lit("</id><office>"), _place(), F.lit("</office><department>"), F.col("p_type"), F.lit("</department><name><![CDATA["), _title(), F.lit("]]></name></position></workzag-jobs>"))
    pages = _captured(spark, d, body, base_url=F.lit("https://acme.jobs.example.org/xml?language=en"))
    return _shown(payloads.personio(pages), "external_id", "title", "department", "city", "apply_url")


@query(f"SELECT p_partkey, {_COMMON}, CAST(p_size AS DOUBLE) AS lat, CAST(-p_partkey % 180 AS DOUBLE) AS lng, {_DAY} AS posted_day FROM part")
def usajobs_payload(spark: SparkSession, d: str) -> DataFrame:
    where = _s(CityName=_place(), CountrySubDivisionCode=_state(), CountryCode=F.lit("United States"), Latitude=F.col("p_size").cast("double"), Longitude=(-(F.col("p_partkey") % 180)).cast("double"))
    item = _s(MatchedObjectId=_key(), MatchedObjectDescriptor=_s(PositionTitle=_title(), PositionLocation=F.array(where), PublicationStartDate=_day("T00:00:00.000"), PositionURI=_url()))
    # The same item on two pages is one job.
    pages = _captured(spark, d, F.to_json(_s(SearchResult=_s(SearchResultItems=F.array(item, item)))))
    return _shown(payloads.usajobs(pages), *_COMMON_COLUMNS, "lat", "lng", "posted_day")


@query(f"SELECT p_partkey, {_COMMON}, p_brand AS department FROM part")
def nlx_payload(spark: SparkSession, d: str) -> DataFrame:
    first = F.to_json(_s(Jobs=F.array(_s(JvId=_key(), JobTitle=_title(), Company=F.col("p_brand"), Location=_place(), URL=_url()))))
    other = F.to_json(_s(items=F.array(_s(guid=_key(), Title=_title(), employer=F.col("p_brand"), city=_city(), state=_state(), link=_url()))))
    return _shown(payloads.nlx(_captured(spark, d, F.when(F.col("p_size") % 2 == 0, first).otherwise(other))), *_COMMON_COLUMNS, "department")


@query(f"SELECT p_partkey, {_COMMON}, 'careeronestop:nlx_mirror' AS lineage_root, TRUE AS without_date FROM part")
def careeronestop_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(JvId=_key(), JobTitle=_title(), Location=_place(), URL=_url(), AccquisitionDate=_day())
    out = payloads.careeronestop(_captured(spark, d, F.to_json(_s(Jobs=F.array(item)))))
    return out.select("p_partkey", *_COMMON_COLUMNS, "lineage_root", F.col("posted_at").isNull().alias("without_date"))


@query(f"SELECT p_partkey, {_COMMON}, 'US' AS country, p_type AS department, CAST(p_size AS DOUBLE) AS lat, {_DAY} AS posted_day FROM part")
def adzuna_payload(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("<strong>"), F.col("p_name"), F.lit("</strong> "), _key())
    item = _s(id=_key(), title=title, category=_s(label=F.col("p_type")), location=_s(display_name=_place(), area=F.array(F.lit("US"), _state(), _city())), latitude=F.col("p_size").cast("double"), created=_day("T00:00:00Z"), redirect_url=_url())
    return _shown(payloads.adzuna(_captured(spark, d, F.to_json(_s(results=F.array(item))))), *_COMMON_COLUMNS, "country", "department", "lat", "posted_day")


@query(f"SELECT p_partkey, {_COMMON}, 'jobapi:parts' AS source, 'GB' AS country FROM part")
def feed_payload(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    one, two = F.to_json(F.array(_s(job_id=_key(), job_title=_title(), job_location=_place(), job_country=F.lit("UK"), job_apply_link=_url()))), F.to_json(F.array(_s(slug=_key(), position=_title(), city=_city(), region=_state(), country=F.lit("gb"), link=_url())))
    body = F.when(k == 0, F.concat(F.lit('{"data":'), one, F.lit("}"))).when(k == 1, F.concat(F.lit('{"result":{"jobs":'), two, F.lit("}}"))).otherwise(one)
    return _shown(payloads.feed(_captured(spark, d, body), "jobapi:parts"), *_COMMON_COLUMNS, "source", "country")


@query(f"SELECT p_partkey, {_COMMON}, 'jobapi:a' || (p_partkey % 20) AS source, p_brand AS department, {_CITY} || ', ' || {_STATE} || ', US' AS location FROM part WHERE p_partkey % 20 <> 5")
def adapter_feeds(spark: SparkSession, d: str) -> DataFrame:
    """Twenty adapters in one plan, one of them switched off; a third of them says where its rows are."""
    known = [(f"a{k}", "api.example.org", "/search", f"jobapi:a{k}", "page.rows" if k % 3 == 1 else None, k != 5) for k in range(20)]
    table = spark.createDataFrame(known, "adapter string, host string, path string, source string, results_path string, enabled boolean")
    k = F.pmod("p_partkey", F.lit(20))
    items = F.to_json(F.array(_s(job_id=_key(), job_title=_title(), job_city=_city(), job_state=_state(), job_apply_link=_url(), employer_name=F.col("p_brand"))))
    other = F.to_json(F.array(_s(slug=_key(), position=_title(), location_city=_city(), region=_state(), link=_url(), company=F.col("p_brand"))))
    body = F.when(k % 3 == 0, F.concat(F.lit('{"data":"none","response":{"jobs":'), other, F.lit("}}"))).when(k % 3 == 1, F.concat(F.lit('{"data":[],"page":{"rows":'), items, F.lit("}}"))).otherwise(items)
    pages = _captured(spark, d, body, adapter=F.concat(F.lit("a"), k.cast("string")), entity_name=_key())
    return _shown(adapters.adapter_jobs(pages, table), *_COMMON_COLUMNS, "source", "department", "location")


@query(f"SELECT p_partkey, {_COMMON}, 'portal:county' AS source FROM part")
def portal_payload(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(_s(postings=F.array(_s(ref=_key(), name=_title(), location=_place(), url=_url()))))
    return _shown(web.portal_feed(_captured(spark, d, body), "county", {"external_id": ("ref",)}), *_COMMON_COLUMNS, "source")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 = 1 THEN 0 ELSE 1 END AS items, CASE WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS invalid_items,
CASE p_size % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'zero' WHEN 2 THEN 'error' ELSE 'success' END AS status, p_size % 4 = 1 AS authoritative_zero FROM part""")
def rss_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 4
    body = F.when(k == 0, "<html>Please sign in</html>").when(k == 1, "<rss><channel></channel></rss>").when(k == 2, "<rss><channel><item><title>A</title></item></channel></rss>").otherwise("<rss><channel><item><title>A</title><link>https://x.org/1</link></item></channel></rss>")
    return payloads.neogov_status(_captured(spark, d, body)).select("p_partkey", "items", "invalid_items", "status", "authoritative_zero")


@query("""SELECT p_partkey, k AS _seq, 'https://x.org/' || CASE k WHEN 0 THEN 'jobs/' ELSE 'more/' END || p_partkey AS url, p_size % 7 = 0 AS is_index FROM part, (SELECT unnest([0, 1]) AS k)""")
def sitemap_payload(spark: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("p_size") % 7 == 0, "sitemapindex").otherwise("urlset")
    body = F.concat(F.lit("<"), tag, F.lit("><url><loc>https://x.org/jobs/"), _key(), F.lit("</loc></url><url><loc> https://x.org/more/"), _key(), F.lit(" </loc></url><url><loc>mailto:x</loc></url></"), tag, F.lit(">"))
    return payloads.sitemap_urls(_captured(spark, d, body)).select("p_partkey", "_seq", "url", "is_index")


@query(f"SELECT p_partkey, {_TITLE} AS title, p_type AS department, {_CITY} AS city, {_STATE} AS state, 'https://x.org/apply/AB' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS apply_url, 'AB' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS external_id FROM part")
def table_payload(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("<table><tr><th>Title</th></tr><tr><td><a href='/apply/AB"), F.lpad(_key(), 6, "0"), F.lit("'>"), _title(), F.lit("</a></td><td>"), _place(), F.lit("</td><td>"), F.col("p_type"), F.lit("</td></tr></table>"))
    pages = _captured(spark, d, body, page_url=F.lit("https://x.org/list"))
    return web.table_jobs(pages, "jazzhr", department=2).select("p_partkey", "title", "department", "city", "state", "apply_url", "external_id")


@query(f"SELECT {_KEY} AS external_id, {_TITLE} AS title, CASE WHEN p_size % 6 = 0 THEN 'rejected' ELSE 'scrapy:career_page' END AS kind FROM part")
def json_lines_import(spark: SparkSession, d: str) -> DataFrame:
    good = F.to_json(_s(id=_key(), title=_title(), url=_url()))
    lines = L.table(spark, d, "part").select(F.when(F.col("p_size") % 6 == 0, F.concat(_key(), F.lit("|"), _title(), F.lit("|{"))).otherwise(good).alias("value"))
    rows, bad = payloads.json_lines(lines)
    bad = bad.select(F.split_part("value", F.lit("|"), F.lit(1)).alias("external_id"), F.split_part("value", F.lit("|"), F.lit(2)).alias("title"), F.lit("rejected").alias("kind"))
    return rows.select("external_id", "title", F.col("source").alias("kind")).unionByName(bad)


@query(f"SELECT p_partkey, 'theirstack-' || p_partkey AS external_id, {_TITLE} AS title, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Watched Co' END AS department, {_STATE} AS state, CAST(p_size AS DOUBLE) AS lat, {_URL} AS apply_url, {_DAY} AS posted_day FROM part")
def theirstack_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(id=F.col("p_partkey"), job_title=_title(), company=F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), state_code=_state(), latitude=F.col("p_size").cast("double"), date_posted=_day(), final_url=F.concat(_url(), F.lit("?utm_source=x")))
    again = _s(id=F.col("p_partkey") + 1_000_000, job_title=F.lit("the same URL again"), url=_url())
    unusable = _s(id=F.lit(None).cast("long"), job_title=F.lit("no id"), url=F.lit("https://x.org/z"))
    # Keys differ from item to item, so the array is written by hand.
    body = F.concat(F.lit('{"data":['), F.concat_ws(",", F.to_json(item), F.to_json(again), F.to_json(unusable)), F.lit("]}"))
    return _shown(web.theirstack(_captured(spark, d, body, employer=F.lit("Watched Co"))), "external_id", "title", "department", "state", "lat", "apply_url", "posted_day")


@query(f"SELECT p_partkey, {_KEY} AS external_id, {_TITLE} AS title, {_CITY} AS city, {_STATE} AS state, 'https://careers.example.org/jobs/' || p_partkey AS apply_url, {_DAY} AS posted_day FROM part")
def jibe_payload(spark: SparkSession, d: str) -> DataFrame:
    item = _s(data=_s(slug=_key(), title=_title(), city=_city(), state=_state(), posted_date=_day("T00:00:00Z")))
    pages = _captured(spark, d, F.to_json(_s(totalCount=F.lit(1), jobs=F.array(item))), base_url=F.lit("https://careers.example.org/"))
    return _shown(web.jibe(pages), "external_id", "title", "city", "state", "apply_url", "posted_day")


@query(f"""SELECT p_partkey, 'board:naco' AS source, {_TITLE} AS title, 'County of Part' AS department, {_CITY} AS city, {_STATE} AS state, 'https://jobs.naco.org/jobs/' || p_partkey AS apply_url, p_size % 2 = 0 AS is_remote FROM part WHERE p_size % 5 <> 0 OR p_size % 3 = 0""")
def board_payload(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.when(F.col("p_size") % 5 == 0, "Other Town").otherwise("Part County"), F.lit(" is hiring"), F.when(F.col("p_size") % 2 == 0, ", remote work").otherwise(""), F.lit(". Location: "), _place(), F.lit("; apply"))
    page = _s(url=F.concat(F.lit("https://jobs.naco.org/jobs/"), _key()), name=F.concat(_title(), F.when(F.col("p_size") % 3 == 0, " - Part County careers").otherwise(""), F.lit(" | NACo Career Center")), snippet=said)
    listing = _s(url=F.lit("https://www.icma.org/jobs-search"), name=F.lit("Jobs of Part County"), snippet=said)
    body = F.to_json(_s(data=_s(webPages=_s(value=F.array(page, listing)))))
    pages = _captured(spark, d, body, entity_name=F.lit("County of Part"), aliases=F.array(F.lit("Part County")))
    return _shown(web.public_boards(pages), "source", "title", "department", "city", "state", "apply_url", "is_remote")


@query(f"""SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS id, {_TITLE} AS name, CASE WHEN p_size % 4 = 0 THEN 'state' WHEN p_size % 4 = 1 THEN 'county' WHEN p_size % 4 = 2 THEN 'municipality' ELSE 'township' END AS government_type, '06' AS state_fips, 'CA' AS state_code,
CASE WHEN p_size % 4 = 0 THEN '06' WHEN p_size % 4 = 1 THEN '06' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN p_size % 4 = 2 THEN '06' || lpad(CAST(p_size AS VARCHAR), 5, '0') END AS fips FROM part WHERE p_size <> 13""")
def census_registry(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.registry import geographic_fips

    fields = F.create_map(F.lit("census_id_pid6"), F.lpad(_key(), 6, "0"), F.lit("unit_name"), F.when(F.col("p_size") != 13, _title()).otherwise(""), F.lit("type_code"), (F.col("p_size") % 4).cast("string"), F.lit("fips_state"), F.lit("6"), F.lit("state"), F.lit("ca"), F.lit("fips_county"), F.col("p_size").cast("string"), F.lit("fips_place"), F.col("p_size").cast("string"))
    rows = web.census_governments(L.spread(L.table(spark, d, "part"), "p_partkey").select("p_partkey", fields.alias("fields")), 2024)
    fips = geographic_fips(F.col("government_type"), F.col("state_fips"), F.concat("county_fips"), F.col("place_fips"))
    return rows.select("p_partkey", "id", "name", "government_type", "state_fips", "state_code", fips.alias("fips"))


@query(f"""SELECT p_partkey, {_TITLE} AS title, CASE WHEN p_size % 4 = 0 THEN 'Remote' ELSE 'Town, ' || {_STATE} END AS location, CASE WHEN p_size % 4 = 0 THEN NULL ELSE {_STATE} END AS state, CASE WHEN p_size % 5 = 0 THEN 'DE' ELSE 'US' END AS country,
p_size % 4 = 0 AS is_remote, 'https://x.org/' || CASE p_size % 3 WHEN 0 THEN 'job/' || p_partkey || '-abc' WHEN 1 THEN 'find?jobId=' || p_partkey ELSE 'p/' || (100000 + p_partkey) END AS apply_url FROM part""")
def search_payload(spark: SparkSession, d: str) -> DataFrame:
    """Three results for each part: one job, a page of jobs, and one whose title is generic."""
    k, n = F.col("p_size") % 3, F.col("p_size")
    url = F.concat(F.lit("https://x.org/"), F.when(k == 0, F.concat(F.lit("job/"), _key(), F.lit("-abc"))).when(k == 1, F.concat(F.lit("find?jobId="), _key())).otherwise(F.concat(F.lit("p/"), (F.lit(100_000) + F.col("p_partkey")).cast("string"))), F.lit("#top"))
    name = F.concat(_title(), F.when(n % 2 == 0, " - Careers at Part Co today").otherwise(" | LinkedIn"))
    said = F.concat(F.lit("the office in Town, "), _state(), F.when(n % 5 == 0, ", of a firm from Germany").otherwise(""), F.when(n % 4 == 0, "; work from home").otherwise(""))
    job = _s(url=url, name=name, snippet=said)
    body = F.to_json(_s(data=_s(webPages=_s(value=F.array(job, _s(url=F.lit("https://x.org/careers/"), name=name, snippet=said), _s(url=F.lit("https://x.org/job/12345"), name=F.lit("Job openings at Part Co"), snippet=said))))))
    return _shown(web.search_results(_captured(spark, d, body, employer=F.lit("Part Co"))), "title", "location", "state", "country", "is_remote", "apply_url")
