"""Registered queries of source health, discovery and upkeep: the operators over the lenses, and the same in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import urls as U
from ..operators import benchmark, discovery, health, lifecycle
from . import lens as L
from .queries import EVENTS_AT, ORDERS_AT, WITH_JOBS, query

_ORDERS_AT, _EVENTS_AT = datetime.fromisoformat(L.ORDERS_AS_OF), datetime.fromisoformat(L.EVENTS_AS_OF)


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the first priority as snapshots of truth."""
    o = L.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    urls = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("https://x.org/1"))).otherwise(F.array().cast("array<string>"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("captured_at"), (F.col("o_orderkey") % 50).alias("official_job_count"), urls.alias("job_urls"))


_TRUTH = "truth AS (SELECT o_orderkey AS id, o_custkey AS entity_id, o_orderdate AS captured_at, o_orderkey % 50 AS official_job_count, o_orderkey % 2 = 0 AS has_urls FROM orders WHERE o_orderpriority = '1-URGENT')"


def _audits(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "incomplete").when(F.col("event_type") == "signup", "unsupported").otherwise("complete")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.concat(F.lit("s"), F.col("event_id") % 3).alias("source_key"), status.alias("status"), (status == "complete").alias("complete"), F.col("ts").alias("audited_at"))


_AUDITS = """audits AS (SELECT event_id AS id, user_id AS entity_id, 's' || (event_id % 3) AS source_key, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'incomplete' WHEN 'signup' THEN 'unsupported' ELSE 'complete' END AS status, ts AS audited_at FROM events)"""


@query(f"""WITH {L.ENTITIES}, {L.CHECKS}, {_TRUTH}, {_AUDITS} SELECT (SELECT COUNT(*) FROM entities WHERE is_active) AS active_entities, (SELECT COUNT(*) FROM checks) AS latest_source_checks, (SELECT COUNT(*) FROM checks WHERE jobs_found % 2 = 0) AS open_incidents,
(SELECT COUNT(*) FROM checks WHERE jobs_found % 2 = 0 AND jobs_found % 3 < 2) AS high_incidents, (SELECT COUNT(*) FROM truth) AS truth_snapshots, (SELECT COUNT(DISTINCT entity_id) FROM truth) AS truth_entities, (SELECT COUNT(*) FROM audits) AS official_audits,
(SELECT COUNT(DISTINCT entity_id) FROM audits WHERE status = 'complete') AS independently_audited_entities""")
def health_summary(spark: SparkSession, d: str) -> DataFrame:
    c, k = L.checks(spark, d), F.col("jobs_found")
    incidents = c.select(F.when(k % 2 == 0, "open").otherwise("resolved").alias("status"), F.when(k % 3 == 0, "critical").when(k % 3 == 1, "high").otherwise("low").alias("severity"))
    return health.health_summary(L.entities(spark, d), c, incidents, _truth(spark, d), _audits(spark, d))


@query(f"""WITH {L.ENTITIES}, {_TRUTH} SELECT portal, COUNT(DISTINCT entity_id) AS entities, COUNT(*) AS snapshots, MAX(captured_at) AS latest_snapshot FROM truth JOIN entities e ON e.id = entity_id GROUP BY 1""")
def truth_coverage(spark: SparkSession, d: str) -> DataFrame:
    return health.truth_coverage(L.entities(spark, d), _truth(spark, d))


@query(f"""WITH {L.ENTITIES}, {_TRUTH}, t AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY captured_at DESC, id DESC) AS rn FROM truth) WHERE rn = 1)
SELECT e.id, name, portal, COALESCE(score, 0) AS coverage_score, captured_at AS latest_truth_at, official_job_count AS latest_official_count FROM entities e LEFT JOIN t ON t.entity_id = e.id WHERE is_active ORDER BY captured_at IS NULL DESC, portal, coverage_score DESC, name LIMIT 180""")
def truth_candidates(spark: SparkSession, d: str) -> DataFrame:
    return health.truth_candidates(L.entities(spark, d), _truth(spark, d))


@query(f"""WITH {_AUDITS}, l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, source_key ORDER BY audited_at DESC, id DESC) AS rn FROM audits) WHERE rn = 1)
SELECT id, entity_id, source_key, status FROM l ORDER BY CASE status WHEN 'error' THEN 1 WHEN 'incomplete' THEN 2 WHEN 'unsupported' THEN 3 ELSE 4 END, audited_at DESC, id LIMIT 150""")
def latest_audits(spark: SparkSession, d: str) -> DataFrame:
    return health.latest_audits(_audits(spark, d)).select("id", "entity_id", "source_key", "status")


@query(f"""WITH m AS (SELECT 'n' || n_nationkey AS directory_key, n_nationkey * 3 AS minimum FROM nation), g AS (SELECT 'n' || c_nationkey AS directory_key, COUNT(*) FILTER (c_acctbal >= 0) AS n_active, MAX(o) FILTER (c_acctbal >= 0) AS newest
FROM customer LEFT JOIN (SELECT o_custkey, MAX(o_orderdate) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_nationkey % 6 <> 5 GROUP BY 1)
SELECT directory_key, COALESCE(n_active, 0) AS n_active, COALESCE(n_active, 0) < minimum OR newest IS NULL OR newest < {ORDERS_AT} - INTERVAL 7 DAY AS due FROM m LEFT JOIN g USING (directory_key)""")
def directories_due(spark: SparkSession, d: str) -> DataFrame:
    seen = L.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen_at"))
    entries = L.table(spark, d, "customer").where("c_nationkey % 6 <> 5").join(seen, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.concat(F.lit("n"), "c_nationkey").alias("directory_key"), (F.col("c_acctbal") >= 0).alias("is_active"), "last_seen_at")
    minimums = L.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("directory_key"), (F.col("n_nationkey") * 3).alias("minimum"))
    return health.directories_due(entries, minimums, _ORDERS_AT).select("directory_key", "n_active", "due")


_OUTCOME = "CASE l_linenumber WHEN 1 THEN 'kept' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'off_target' WHEN 4 THEN 'low_quality' WHEN 5 THEN 'closed' ELSE 'kept' END"


@query(f"""WITH r AS (SELECT l_suppkey AS entity_id, l_returnflag AS source, {_OUTCOME} AS outcome, l_quantity > 25 AS is_new, l_linestatus = 'O' AS claim FROM lineitem WHERE l_linenumber > 1 OR l_suppkey % 2 = 0)
SELECT entity_id, COUNT(*) FILTER (outcome <> 'closed') AS raw_discovered, COUNT(*) FILTER (outcome = 'kept') AS total, COUNT(*) FILTER (outcome = 'kept' AND is_new) AS new, COUNT(*) FILTER (outcome = 'low_quality') AS quality_rejected,
COUNT(*) FILTER (outcome = 'off_target') AS off_target_rejected, COUNT(*) FILTER (outcome = 'duplicate') AS duplicates_removed, COUNT(*) FILTER (outcome = 'closed') AS closed, COUNT(DISTINCT source) FILTER (outcome = 'kept') AS n_sources,
CASE WHEN COUNT(*) FILTER (outcome = 'kept') > 0 OR bool_or(claim) THEN 'success' ELSE 'partial' END AS status FROM r GROUP BY 1""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    outcome = F.when(n == 2, "duplicate").when(n == 3, "off_target").when(n == 4, "low_quality").when(n == 5, "closed").otherwise("kept")
    rows = L.table(spark, d, "lineitem").where("l_linenumber > 1 OR l_suppkey % 2 = 0").select(F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("source"), outcome.alias("outcome"), (F.col("l_quantity") > 25).alias("is_new"), (F.col("l_linestatus") == "O").alias("claim"))
    return health.ingest_summary(rows).withColumn("n_sources", F.size("sources_used").cast("long")).drop("sources_used")


@query(f"""WITH {L.LATEST} SELECT DISTINCT entity_id FROM latest WHERE source_class = 'authoritative' AND checked_at < {EVENTS_AT} - INTERVAL 48 HOUR""")
def stale_on_read(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.frames import first_rows

    last = first_rows(L.checks(spark, d), ["entity_id", "source"], [F.col("checked_at").desc(), F.col("id").desc()])
    return health.stale_on_read(last.withColumnRenamed("checked_at", "last_checked_at"), _EVENTS_AT)


@query(f"""{WITH_JOBS}, {L.LOCATIONS} SELECT id, entity_id FROM locations WHERE is_active AND portal = 'BUILDING' AND upper(country) = 'ASIA' AND role_category = 'security' AND posted_at >= TIMESTAMP '1998-01-01' AND nation % 2 = 0""")
def filtered_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = L.locations(spark, d).where("is_active").withColumn("is_overseas", F.col("nation") % 2 == 0)
    return rows.where(health.job_filters(portal="BUILDING", country="asia", role="security", new_since=datetime(1998, 1, 1), overseas=True)).select("id", "entity_id")


@query("SELECT event_id AS id, value FROM events UNION ALL SELECT event_id + 10000000, value * 2 FROM events WHERE event_type = 'view'")
def append_history(spark: SparkSession, d: str) -> DataFrame:
    e = L.table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    return lifecycle.append_once(e.select("id", "value"), e.where("event_type = 'view'").select((F.col("id") + 10_000_000).alias("id"), (F.col("value") * 2).alias("value")), ["id"])


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'old' END AS name FROM part WHERE p_size % 2 = 0 OR p_size % 5 = 0")
def prune_rebuild(spark: SparkSession, d: str) -> DataFrame:
    part, at = L.table(spark, d, "part"), lambda t: F.lit(t).cast("timestamp")
    # Odd rows divisible by five were written while the rebuild ran.
    before = part.select(F.col("p_partkey").alias("id"), F.lit("old").alias("name"), F.when(F.col("p_size") % 5 == 0, at("2024-01-31 06:00:00")).otherwise(at("2024-01-01 00:00:00")).alias("updated_at"))
    rebuilt = part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), at("2024-01-31 07:00:00").alias("updated_at"))
    return lifecycle.prune_after_rebuild(before, rebuilt, ["id"], datetime(2024, 1, 31)).select("id", "name")


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS portal, CASE WHEN c_nationkey % 3 = 0 THEN FALSE ELSE TRUE END AS is_active,
CASE WHEN c_nationkey % 3 = 0 THEN 2 ELSE 1 END AS n_aliases, c_nationkey % 3 = 0 AS touched FROM customer""")
def entity_patch(spark: SparkSession, d: str) -> DataFrame:
    c = L.table(spark, d, "customer")
    e = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.lit("a")).alias("aliases"), F.col("c_mktsegment").alias("portal"), F.lit(True).alias("is_active"), F.lit("2020-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    good = F.create_map(F.lit("name"), F.lit("renamed"), F.lit("portal"), F.lit(None).cast("string"), F.lit("is_active"), F.lit("false"), F.lit("aliases"), F.lit('["x", "y"]'), F.lit("id"), F.lit("9"))
    patches = c.where("c_nationkey % 3 < 2").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 3 == 0, good).otherwise(F.create_map(F.lit("score"), F.lit("1"))).alias("fields"))
    return lifecycle.patch_entities(e, patches, datetime(2024, 1, 1)).select("id", "name", "portal", "is_active", F.size("aliases").alias("n_aliases"), (F.year("updated_at") == 2024).alias("touched"))


@query(f"""{WITH_JOBS}, m AS (SELECT id AS entity_id, portal FROM entities WHERE id % 9 = 0), k AS (SELECT m.*, e.is_active FROM m JOIN entities e ON e.id = m.entity_id), h AS (SELECT portal, COUNT(*) AS held FROM k WHERE is_active GROUP BY 1),
f AS (SELECT e.id AS entity_id, e.portal, ROW_NUMBER() OVER (PARTITION BY e.portal ORDER BY e.id % 2 DESC, score DESC NULLS LAST, name, e.id) AS rn, COALESCE(held, 0) AS held FROM entities e LEFT JOIN h USING (portal) WHERE is_active AND e.id NOT IN (SELECT entity_id FROM k WHERE is_active))
SELECT entity_id, portal, is_active FROM k UNION ALL SELECT entity_id, portal, TRUE FROM f WHERE rn <= 40 - held""")
def cohort_upkeep(spark: SparkSession, d: str) -> DataFrame:
    e = L.entities(spark, d).withColumns({"has_truth": F.col("id") % 2, "updated_at": F.lit(None).cast("timestamp")})
    members = e.where("id % 9 = 0").select(F.col("id").alias("entity_id"), "portal", (F.col("id") % 2 == 0).alias("is_active"), F.lit(_ORDERS_AT).alias("added_at"))
    return benchmark.maintain_cohort(members, e, _ORDERS_AT, size=40).select("entity_id", "portal", "is_active")


@query(f"""WITH {_TRUTH}, l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY captured_at DESC, id DESC) AS rn FROM truth) WHERE rn = 1)
SELECT entity_id, official_job_count, CASE WHEN has_urls THEN 'ground_truth' ELSE 'official_count' END AS evidence FROM l WHERE captured_at >= {ORDERS_AT} - INTERVAL 8760 HOUR""")
def truth_in_force(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.truth_in_force(_truth(spark, d), _ORDERS_AT, max_age_hours=8760).drop("job_urls")


@query("""SELECT event_id, n % 4 <> 3 AS readable, CASE WHEN n % 4 <> 3 THEN n % 2 = 0 END AS safety_sensitive, CASE WHEN n % 4 <> 3 THEN CASE WHEN n % 3 = 0 THEN 'high' ELSE 'unknown' END END AS physical_demand,
CASE WHEN n % 4 <> 3 THEN CAST(least(100, greatest(0, floor(n * 2.5 + 0.5))) AS BIGINT) END AS opportunity_score, CASE WHEN n % 4 <> 3 THEN 'a b' END AS reason FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS n FROM events)""")
def enrichment_answers(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor("value")
    body = F.concat(F.lit('{"safety_sensitive": '), F.when(n % 2 == 0, "1").otherwise("0"), F.lit(', "physical_demand": "'), F.when(n % 3 == 0, "HIGH").otherwise("heavy"), F.lit('", "opportunity_score": "'), (n * 2.5).cast("string"), F.lit('", "reason": "  a \\n b "}'))
    text = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Bye."))).when(n % 4 == 2, body).otherwise("I can't say {that")
    a = N.enrichment_answer(text)
    return L.table(spark, d, "events").select("event_id", a.isNotNull().alias("readable"), *(a[c].alias(c) for c in ("safety_sensitive", "physical_demand", "opportunity_score", "reason")))


# URLs of boards with what is found: provider, board, confidence.
_BOARDS = [
    ("https://boards.greenhouse.io/embed/job_board?for=acme", "greenhouse", "acme", "high"), ("https://jobs.lever.co/acme/1", "lever", "acme", "high"), ("https://jobs.ashbyhq.com/acme", "ashby", "acme", "high"), ("https://acme.recruitee.com/o/x", "recruitee", "acme", "high"),
    ("https://jobs.smartrecruiters.com/Acme/1", "smartrecruiters", "Acme", "high"), ("https://acme.bamboohr.com/careers/7", "bamboohr", "acme", "high"), ("https://acme.bamboohr.com/login", None, None, None),
    ("https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/1", "workday", "https://acme.wd5.myworkdayjobs.com/Ext", "high"), ("https://careers-acme.icims.com/jobs", "icims", None, "medium"), ("https://acme.taleo.net/careersection", "taleo", None, "medium"),
    ("https://x.fa.us2.oraclecloud.com/hcmUI/jobs", "oracle", None, "medium"), ("https://x.oraclecloud.com/storage", None, None, None), ("https://jobs.jobvite.com/acme/jobs", "jobvite", "acme", "medium"), ("https://career4.successfactors.com/career", "successfactors", "career", "medium"),
    ("https://apply.workable.com/acme/", "workable", "acme", "high"), ("https://acme.teamtailor.com/jobs", "teamtailor", "acme", "high"), ("https://acme.jobs.personio.de/x", "personio", "acme", "high"), ("https://www.comeet.com/jobs/acme", "comeet", "jobs", "medium"),
    ("https://acme.breezy.hr/p/1", "breezyhr", "acme", "high"), ("https://acme.applytojob.com/apply/1", "jazzhr", "apply", "medium"), ("https://ats.rippling.com/acme/jobs", "rippling", "acme", "high"), ("https://us.dayforcehcm.com/CandidatePortal/acme", "dayforce", "acme", "medium"),
    ("https://recruiting.ultipro.com/X", "ukg", None, "medium"), ("https://workforcenow.adp.com/x", "adp", None, "medium"), ("https://recruiting.paylocity.com/x", "paylocity", None, "medium"), ("https://www.paycomonline.net/x", "paycom", None, "medium"),
    ("https://www.governmentjobs.com/careers/fresno?x=1", "governmentjobs", "fresno", "high"), ("https://acme.neogov.com/", "neogov", None, "medium"), ("https://acme.applicantpro.com/jobs", "applicantpro", "acme", "medium"), ("https://acme.pinpointhq.com/", "pinpoint", "acme", "medium"),
    ("https://acme.zohorecruit.com/", "zoho_recruit", None, "medium"), ("https://x.bullhornstaffing.com/", "bullhorn", None, "medium"), ("https://jobs.ceipal.com/", "ceipal", None, "medium"), ("https://acme.clearcompany.com/", "clearcompany", "acme", "medium"),
    ("https://acme.csod.com/ux", "cornerstone", "acme", "medium"), ("https://acme.eightfold.ai/careers", "eightfold", None, "medium"), ("https://acme.avature.net/x", "avature", "acme", "medium"), ("https://jobs.phenom.com/x", "phenom", None, "medium"),
    ("https://acme.hirebridge.com/", "hirebridge", None, "medium"), ("https://acme.silkroad.com/", "silkroad", None, "medium"), ("https://www.example.org/careers", None, None, None),
]
_quoted = lambda x: "NULL" if x is None else f"'{x}'"


@query(f"""WITH b(k, provider, board, confidence) AS (VALUES {", ".join(f"({k}, {_quoted(p)}, {_quoted(b)}, {_quoted(c)})" for k, (_, p, b, c) in enumerate(_BOARDS))})
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'bamboohr' ELSE 'greenhouse' END WHEN p_size % 3 = 1 THEN COALESCE(provider, 'silkroad') ELSE provider END AS provider,
CASE WHEN p_size % 3 < 2 THEN board WHEN p_partkey % 2 = 1 THEN replace(p_name, ' ', '') END AS board, CASE WHEN p_size % 3 = 2 OR (p_size % 3 = 1 AND provider IS NULL) THEN 'medium' ELSE confidence END AS confidence FROM part JOIN b ON k = p_partkey % {len(_BOARDS)}""")
def ats_detection(spark: SparkSession, d: str) -> DataFrame:
    """A third of the pages stand on the board's URL, a third link to it and then to another, a third only speak of a provider."""
    url = F.get(F.array(*(F.lit(u) for u, *_ in _BOARDS)), F.col("p_partkey") % len(_BOARDS))
    k, own = F.col("p_size") % 3, F.lit("https://www.example.org/jobs")
    markup = F.when(F.col("p_partkey") % 2 == 0, "<script src='x.BambooHR.js'>").otherwise("<div id='Greenhouse-app'> silkroad")
    page, links = F.when(k == 0, url).otherwise(own), F.when(k == 1, F.array(own, url, F.lit("https://acme.silkroad.com/"))).otherwise(F.array(own))
    found = U.detect_ats(page, links, F.when(k == 2, markup).otherwise(""), F.concat("p_name", F.lit(" Holdings, Inc.")))
    rows = L.table(spark, d, "part").select("p_partkey", found.alias("found"))
    return rows.select("p_partkey", F.col("found.provider").alias("provider"), F.col("found.board").alias("board"), F.col("found.confidence").alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN NULL ELSE 't' || p_partkey END AS tenant, CASE WHEN p_size % 3 = 2 THEN NULL ELSE 'Ext' || p_size END AS site, CASE p_size % 3 WHEN 0 THEN '/en-US' WHEN 1 THEN '' END AS language,
CASE WHEN p_size % 3 = 2 THEN NULL ELSE 'https://t' || p_partkey || '.wd1.myworkdayjobs.com/wday/cxs/t' || p_partkey || '/Ext' || p_size || '/jobs' END AS endpoint FROM part""")
def workday_boards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    url = F.concat(F.lit("https://t"), "p_partkey", F.lit(".wd1.myworkdayjobs.com"), F.when(k == 0, F.concat(F.lit("/en-US/Ext"), "p_size", F.lit("/job/1"))).when(k == 1, F.concat(F.lit("/Ext"), "p_size")).otherwise("/"))
    return L.table(spark, d, "part").select("p_partkey", F.inline_outer(F.array(U.workday_board(url))))


@query("""SELECT p_partkey, [p_name] AS company, CASE WHEN p_size % 2 = 0 THEN [p_name || ' County', p_name] ELSE [p_name || ' County'] END AS government,
list_sort(list_distinct([replace(p_name, ' ', ''), 'countyof' || replace(p_name, ' ', '') || 'county'] || CASE WHEN p_size % 2 = 0 THEN [replace(p_name, ' ', '') || 'county', replace(p_name, ' ', '') || 'city'] ELSE [] END)) AS slugs FROM part""")
def entity_aliases(spark: SparkSession, d: str) -> DataFrame:
    portal = F.when(F.col("p_size") % 2 == 0, "counties_and_cities").otherwise("state_agencies")
    name = F.concat(F.lit("County of "), "p_name", F.lit(" County"))
    lists = {"company": discovery.company_aliases(F.concat("p_name", F.lit(" Holdings, LLC"))), "government": discovery.government_aliases(name, portal), "slugs": F.array_sort(discovery.board_slugs(name, portal))}
    lists["company"] = F.transform(lists["company"], lambda x: F.replace(x, F.lit(" ,"), F.lit("")))
    return L.table(spark, d, "part").select("p_partkey", *(v.alias(k) for k, v in lists.items()))


@query("""SELECT p_partkey AS entity_id, CASE WHEN p_size % 4 = 0 THEN 'https://www.governmentjobs.com/careers/x' ELSE 'https://x.gov/jobs' END AS url, CASE WHEN p_size % 4 = 0 THEN 100 WHEN p_size % 4 = 1 THEN 94 ELSE 92 END AS score FROM part WHERE p_size % 4 < 3""")
def government_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four results for each part: a third party's, the government's own page, a hosted board, another government's."""
    part, k = L.spread(L.table(spark, d, "part"), "p_partkey"), F.col("p_size") % 4
    said = F.when(k == 2, F.concat("p_name", F.lit(" careers"))).when(k == 3, F.lit("elsewhere careers")).otherwise(F.concat(F.lit("City of "), "p_name"))
    result = lambda url, name: F.struct(F.lit(url).alias("url"), name.alias("name"), F.lit("").alias("snippet"), F.lit(None).cast("string").alias("summary"))
    pages = F.array(result("https://x.com/jobs", said), result("https://x.gov/jobs", said), F.when(k == 0, result("https://www.governmentjobs.com/careers/x", said)), F.when(k < 3, result("https://y.gov/about", said)))
    rows = part.select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("City of "), "p_name").alias("entity_name"), F.explode(F.array_compact(pages)).alias("r")).select("entity_id", "entity_name", "r.*")
    return discovery.best_government_pages(rows)


@query("""SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 170 WHEN 1 THEN 90 WHEN 2 THEN 65 ELSE -25 END AS score, c_nationkey % 4 <> 3 AND c_acctbal >= 0 AND (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY') AS due FROM customer""")
def association_boards(spark: SparkSession, d: str) -> DataFrame:
    c, k, s = L.table(spark, d, "customer"), F.col("c_nationkey") % 4, F.col("c_mktsegment")
    url = F.when(k == 0, "https://x.governmentjobs.com/careers/abc").when(k == 1, "https://league.org/jobs").when(k == 2, "https://league.org/x").otherwise("https://other.org/x")
    text = F.when(k == 0, "Careers").when(k == 1, "Job board").when(k == 2, "Current openings").otherwise("Conference")
    score = discovery.association_link_score(url, text, F.lit("https://www.league.org/"))
    entries = c.select("c_custkey", (F.col("c_acctbal") >= 0).alias("is_active"), F.lit("municipal_league").alias("entry_type"), F.when(k != 3, "https://league.org").alias("source_url"), F.when(s == "MACHINERY", F.lit("2023-01-01 00:00:00")).when(s != "BUILDING", F.lit("2024-01-20 00:00:00")).cast("timestamp").alias("checked_at"))
    due = discovery.associations_due(entries, _EVENTS_AT).select(F.col("c_custkey").alias("_k"))
    # A customer of nation 0 of 4 has a hosted board (90), careers in its text (55) and a path (25).
    return c.join(due, F.col("c_custkey") == F.col("_k"), "left").select("c_custkey", score.alias("score"), F.col("_k").isNotNull().alias("due"))


@query(f"""WITH {L.ENTITIES}, {L.CHECKS} SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM checks WHERE source = 'view' AND checked_at >= {EVENTS_AT} - INTERVAL 14 DAY)""")
def discovery_due(spark: SparkSession, d: str) -> DataFrame:
    markers = L.checks(spark, d).where("source = 'view'").select("entity_id", F.col("checked_at").alias("discovered_at"))
    return discovery.discovery_due(L.entities(spark, d), markers, _EVENTS_AT).select("id")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS source_graph_key, CASE o_orderpriority WHEN '1-URGENT' THEN 'root' WHEN '5-LOW' THEN NULL ELSE o_orderpriority END AS lineage, o_orderkey AS kept,
CASE o_orderpriority WHEN '5-LOW' THEN NULL ELSE 'true' END AS verified, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN 'true' ELSE 'false' END AS shared, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN 'false' ELSE 'true' END AS needs FROM orders""")
def graph_annotation(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    jobs = L.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source_key"), F.to_json(F.struct(F.col("o_orderkey").alias("kept"), F.lit("was").alias("source_graph_key"))).alias("raw_data"))
    jobs = jobs.withColumn("raw_data", F.when(F.col("source_key") == "5-LOW", F.to_json(F.struct(F.col("o_orderkey").alias("kept")))).otherwise(F.col("raw_data")))
    rows = [("1-URGENT", "root", "authoritative", True, False), ("2-HIGH", None, "verified", True, True), ("3-MEDIUM", None, "verified", False, None), ("4-NOT SPECIFIED", None, "authoritative", None, False)]
    sources = spark.createDataFrame(rows, "source_key string, lineage_root string, source_class string, is_verified boolean, is_shared boolean")
    at = lambda name: F.get_json_object("raw_data", f"$.{name}")
    return discovery.annotate_graph(jobs, sources).select("o_orderkey", at("source_graph_key").alias("source_graph_key"), at("source_graph_lineage").alias("lineage"), at("kept").cast("long").alias("kept"), at("source_graph_verified_for_entity").alias("verified"), at("source_graph_shared_inventory").alias("shared"), at("source_graph_required_employer_verification").alias("needs"))


@query("""SELECT slot, lower(p_name) AS employer, MIN(p_partkey) AS first FROM (SELECT *, p_size % 3 AS slot FROM part WHERE p_size <> 7) GROUP BY 1, 2""")
def watched_employers(spark: SparkSession, d: str) -> DataFrame:
    rows = discovery.watched_employers(_assignments(spark, d))
    return rows.select("slot", F.lower("name").alias("employer"), F.col("_seq").alias("first"))


def _assignments(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return L.table(spark, d, "part").select(name.alias("name"), F.when(F.col("p_size") != 7, F.col("p_size") % 3).alias("slot"), F.lit("prospects").alias("portal"), F.col("p_partkey").alias("_seq"))


@query("""SELECT lower(p_name) AS employer, CASE split_part(lower(p_name), ' ', 2) WHEN 'widget' THEN 'none' WHEN 'gear' THEN 'reactivate' ELSE 'insert' END AS action FROM part WHERE p_size <> 7 GROUP BY 1, 2""")
def watched_sync(spark: SparkSession, d: str) -> DataFrame:
    part = L.table(spark, d, "part").select("p_name").distinct().where("split_part(p_name, ' ', 2) IN ('widget', 'gear')")
    e = part.select(F.col("p_name").alias("id"), F.initcap("p_name").alias("name"), F.lit(None).cast("array<string>").alias("aliases"), (F.split_part("p_name", F.lit(" "), F.lit(2)) == "widget").alias("is_active"), F.lit(0).alias("created_at"))
    return discovery.sync_watched(_assignments(spark, d), e).select(F.lower("name").alias("employer"), "action")


@query(f"""{WITH_JOBS}, {L.LOCATIONS}, r AS (SELECT id, portal, state, country, nation = 1 AS was, nation % 4 = 2 AS in_texas, lat, lng FROM locations WHERE is_active),
p AS (SELECT portal, CASE WHEN was THEN '' ELSE state END AS state, country, CASE WHEN was OR lat IS NULL THEN CASE WHEN in_texas THEN 31.0545e0 END ELSE lat END AS la, CASE WHEN was OR lng IS NULL THEN CASE WHEN in_texas THEN -97.5635e0 END ELSE lng END AS ln, in_texas AS fb FROM r)
SELECT portal, state, country, round(la, 4) AS lat_key, round(ln, 4) AS lng_key, fb AS is_fallback, COUNT(*) AS n_jobs FROM p WHERE la IS NOT NULL GROUP BY ALL""")
def map_places(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of some nations also name a state whose point is a fallback; those of nation 0 have no point, those of nation 1 a stored fallback."""
    from ..operators import geo

    rows = L.locations(spark, d).where("is_active")
    named = rows.withColumn("location", F.lit(None).cast("string")).withColumn("shown", F.col("state")).withColumn("state", F.when(F.col("nation") % 4 == 2, "TX").otherwise(F.col("state")))
    out = geo.map_locations(named, ("portal", "shown"))
    return out.select("portal", F.when(F.col("state") == "", "").otherwise(F.col("shown")).alias("state"), "country", "lat_key", "lng_key", "is_fallback", "n_jobs")
