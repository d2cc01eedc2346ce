"""The driver's tables seen as the domain's: entities, jobs, snapshots, source checks, pages. Each lens is a projection; its SQL twin stands beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The instants at which the lenses are evaluated.
ORDERS_AS_OF = "2001-07-31 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
BASELINE = "1995-01-01"


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def day(text: str) -> Column:
    return F.lit(text[:10]).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small file dealt out by key to four tasks a core, for queries whose work on a row is far more than its bytes tell.

    As many tasks as a shuffle has at least: executors that haven't joined the session yet aren't counted among its cores.
    """
    session = rows.sparkSession
    return rows.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("portal"), (F.col("c_acctbal") >= 0).alias("is_active"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").alias("nation"))


ENTITIES = "entities AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS portal, c_acctbal >= 0 AS is_active, c_acctbal AS score, c_nationkey AS nation FROM customer)"

_ROLES = {"1-URGENT": "security", "2-HIGH": "logistics", "3-MEDIUM": "medical", "5-LOW": "engineering"}


def jobs(spark: SparkSession, d: str) -> DataFrame:
    role = F.lit(None).cast("string")
    for key, name in _ROLES.items():
        role = F.when(F.col("o_orderpriority") == key, name).otherwise(role)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").cast("string").alias("external_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("posted_at"),
        F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "F").alias("is_active"), role.alias("role_category"), F.col("o_totalprice").alias("pay"),
    )


JOBS = (
    "jobs AS (SELECT o_orderkey AS id, o_custkey AS entity_id, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS source, o_orderdate AS posted_at, o_orderdate AS updated_at, o_orderdate AS created_at, "
    "o_orderstatus <> 'F' AS is_active, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ROLES.items()) + " END AS role_category, o_totalprice AS pay FROM orders)"
)


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Per entity and day with an order: all orders so far."""
    daily = jobs(spark, d).groupBy("entity_id", F.to_date("posted_at").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("n"))
    return daily.withColumn("total_active", F.sum("n").over(W.partitionBy("entity_id").orderBy("snapshot_date").rowsBetween(W.unboundedPreceding, 0))).withColumns({"new_this_week": F.col("n"), "closed_count": F.lit(0).cast("long")}).drop("n")


SNAPSHOTS = "snapshots AS (SELECT entity_id, snapshot_date, SUM(n) OVER (PARTITION BY entity_id ORDER BY snapshot_date) AS total_active, n AS new_this_week FROM (SELECT entity_id, CAST(posted_at AS DATE) AS snapshot_date, COUNT(*) AS n FROM jobs GROUP BY 1, 2))"


def checks(spark: SparkSession, d: str) -> DataFrame:
    """The history of source checks."""
    n = F.floor("value")
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("_seq"), F.col("user_id").alias("entity_id"), kind.alias("source"), F.when(kind.isin("view", "click"), "authoritative").otherwise("verified").alias("source_class"),
        F.when((kind == "error") & (F.pmod(n, F.lit(7)) == 0), "error").when(n == 0, "zero").otherwise("success").alias("status"), n.cast("long").alias("jobs_found"), F.col("ts").alias("checked_at"), F.col("props").alias("details"),
        F.when(kind == "signup", "nlx-mirror:signup").when(kind == "purchase", "careeronestop").otherwise(kind).alias("lineage_root"), F.lit(False).alias("authoritative_zero"), kind.alias("source_key"),
    )


CHECKS = (
    "checks AS (SELECT event_id AS id, user_id AS entity_id, event_type AS source, CASE WHEN event_type IN ('view','click') THEN 'authoritative' ELSE 'verified' END AS source_class, "
    "CASE WHEN event_type = 'error' AND CAST(floor(value) AS BIGINT) % 7 = 0 THEN 'error' WHEN floor(value) = 0 THEN 'zero' ELSE 'success' END AS status, CAST(floor(value) AS BIGINT) AS jobs_found, ts AS checked_at, "
    "CASE event_type WHEN 'signup' THEN 'nlx-mirror:signup' WHEN 'purchase' THEN 'careeronestop' ELSE event_type END AS lineage_root FROM events)"
)
RANKED = "ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, source ORDER BY checked_at DESC, id DESC) AS rn FROM checks)"
LATEST = f"{CHECKS}, {RANKED}, latest AS (SELECT * FROM ranked WHERE rn = 1), previous AS (SELECT * FROM ranked WHERE rn = 2)"


def locations(spark: SparkSession, d: str) -> DataFrame:
    """Jobs with a place: the nation as state, the region as country, a point from their keys; nation 0 has none."""
    e, n, r = entities(spark, d), table(spark, d, "nation"), table(spark, d, "region")
    place = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("state"), F.col("r_name").alias("country"))
    key = F.col("nation")
    rows = jobs(spark, d).join(e.select(F.col("id").alias("_e"), "nation", "portal"), F.col("entity_id") == F.col("_e")).join(F.broadcast(place), "nation")
    return rows.withColumns({"city": F.lit(None).cast("string"), "lat": F.when(key > 0, key + 0.123456), "lng": F.when(key > 0, -key - 0.654321), "raw_data": F.when(key == 1, '{"normalized_location_quality":"state fallback"}').otherwise("{}")}).drop("_e")


LOCATIONS = (
    "locations AS (SELECT j.*, e.portal, n.n_name AS state, r.r_name AS country, e.nation, CASE WHEN e.nation > 0 THEN e.nation + 0.123456e0 END AS lat, CASE WHEN e.nation > 0 THEN -e.nation - 0.654321e0 END AS lng "
    "FROM jobs j JOIN entities e ON j.entity_id = e.id JOIN nation n ON e.nation = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"
)


def mirrored_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page as three sources saw it: the career page, a hosted board through a tracking link, a job feed that dropped the fragment."""
    p = table(spark, d, "pages")
    url = F.regexp_replace("url", "#.*$", "")
    tracked = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_campaign=a&gh_src=b"))
    seen = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("career_page").alias("source"), F.col("url").alias("u")), F.struct(F.lit(1).alias("k"), F.lit("greenhouse").alias("source"), tracked.alias("u")), F.struct(F.lit(2).alias("k"), F.lit("jobapi:feed").alias("source"), url.alias("u"))))
    rows = p.select("page_id", F.length("html").alias("size"), seen.alias("s"))
    return rows.select(F.lit(1).cast("long").alias("entity_id"), (F.col("page_id") * 3 + F.col("s.k")).alias("_seq"), F.col("s.source").alias("source"), F.concat(F.col("page_id").cast("string"), F.lit("-"), F.col("s.k").cast("string")).alias("external_id"), F.col("s.u").alias("url"), F.concat(F.lit("Job "), F.col("page_id").cast("string")).alias("title"), F.when(F.col("s.k") == 0, "").otherwise(F.col("s.source")).alias("department"), F.when(F.col("s.k") == 2, F.col("size").cast("double")).alias("lat"))


def canonical_sql(url: str, drop: tuple[str, ...], strip_www: bool = False, strip_slash: bool = False) -> str:
    """The SQL twin of the URL canonicaliser, for URLs without user, port and escapes."""
    host = f"lower(regexp_extract({url}, '^https?://([^/?#]+)', 1))"
    host = f"regexp_replace({host}, '^www\\.', '')" if strip_www else host
    path = f"regexp_extract({url}, '^https?://[^/?#]+([^?#]*)', 1)"
    names = ", ".join(f"'{x}'" for x in drop)
    kept = f"list_sort(list_filter(string_split(regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(regexp_extract(p, '^[^=]*')) NOT IN ({names})))"
    out = f"regexp_extract({url}, '^https?') || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"
    return f"regexp_replace({out}, '/$', '')" if strip_slash else out


MIRRORED = (
    "mirrored AS (SELECT page_id * 3 + k AS seq, page_id, k, CASE k WHEN 0 THEN 'career_page' WHEN 1 THEN 'greenhouse' ELSE 'jobapi:feed' END AS source, CASE k WHEN 0 THEN 80 WHEN 1 THEN 100 ELSE 55 END AS score, "
    "CASE k WHEN 0 THEN url WHEN 1 THEN bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_campaign=a&gh_src=b' ELSE bare END AS url, CASE WHEN k = 2 THEN CAST(length(html) AS DOUBLE) END AS lat "
    "FROM (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM pages), (SELECT unnest([0, 1, 2]) AS k))"
)
