"""Every registered query: the operators over the lenses, and the same in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import benchmark, coverage, dedupe, geo, identity, lifecycle, metrics, quality, registry, reliability, runs, search
from ..operators.frames import first_rows, latest
from ..sources import payloads, web
from . import lens as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ORDERS_AT = f"TIMESTAMP '{L.ORDERS_AS_OF}'"
EVENTS_AT = f"TIMESTAMP '{L.EVENTS_AS_OF}'"
WITH_JOBS = f"WITH {L.ENTITIES}, {L.JOBS}"


# --- entities and jobs -------------------------------------------------------------------------------------------------


@query(f"""{WITH_JOBS}, c AS (SELECT entity_id, COUNT(*) AS n, COUNT(*) FILTER (posted_at >= {ORDERS_AT} - INTERVAL 7 DAY) AS new FROM jobs WHERE is_active GROUP BY 1)
SELECT portal, COUNT(*) AS total_entities, COUNT(c.n) AS hiring_entities, CAST(COALESCE(SUM(c.n), 0) AS BIGINT) AS open_roles, CAST(COALESCE(SUM(c.new), 0) AS BIGINT) AS new_this_week
FROM entities e LEFT JOIN c ON c.entity_id = e.id WHERE e.is_active GROUP BY portal""")
def portal_kpis(spark: SparkSession, d: str) -> DataFrame:
    return metrics.portal_kpis(L.entities(spark, d), L.jobs(spark, d), L.at(L.ORDERS_AS_OF))


@query(f"""{WITH_JOBS}, c AS (SELECT entity_id, COUNT(*) AS n, COUNT(*) FILTER (posted_at >= {ORDERS_AT} - INTERVAL 7 DAY) AS new FROM jobs WHERE is_active GROUP BY 1)
SELECT id, name, portal, COALESCE(c.n, 0) AS active_jobs, COALESCE(c.new, 0) AS new_jobs FROM entities e LEFT JOIN c ON c.entity_id = e.id WHERE e.is_active""")
def entities_with_counts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.entities_with_counts(L.entities(spark, d), L.jobs(spark, d), L.at(L.ORDERS_AS_OF)).select("id", "name", "portal", "active_jobs", "new_jobs")


@query(f"{WITH_JOBS} SELECT entity_id, COALESCE(role_category, 'other') AS role_category, COUNT(*) AS n_jobs FROM jobs WHERE is_active GROUP BY 1, 2")
def role_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return metrics.role_breakdown(L.jobs(spark, d))


_ROLE_CASES = " ".join(f"WHEN regexp_matches(t, '\\b({p})\\b', 'i') THEN '{n}'" for n, p in T.ROLES)


@query(f"SELECT doc_id, CASE {_ROLE_CASES} ELSE 'other' END AS role_category FROM (SELECT doc_id, COALESCE(text, '') || ' ' || COALESCE(source, '') AS t FROM documents)")
def classify_roles(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "documents").select("doc_id", T.role_category(F.col("text"), F.col("source")).alias("role_category"))


def _role_counts(roles: tuple[str, ...]) -> str:
    return ", ".join(f"COUNT(*) FILTER (is_active AND COALESCE(role_category, 'other') = '{r}') AS role_{r}" for r in roles)


@query(f"""{WITH_JOBS} SELECT entity_id, COUNT(*) FILTER (is_active) AS total_active, COUNT(*) FILTER (is_active AND posted_at >= {ORDERS_AT} - INTERVAL 7 DAY) AS new_this_week,
COUNT(*) FILTER (NOT is_active) AS closed_count, {_role_counts(metrics.ROLE_CATEGORIES)} FROM jobs GROUP BY 1""")
def daily_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily_snapshot(L.jobs(spark, d), L.at(L.ORDERS_AS_OF)).drop("snapshot_date")


_THEN = ", ".join(f"arg_max(total_active, snapshot_date) FILTER (snapshot_date <= DATE '{L.ORDERS_AS_OF[:10]}' - {n}) AS total_{n}" for n in (30, 60, 90))


@query(f"{WITH_JOBS}, {L.SNAPSHOTS} SELECT entity_id, {_THEN.replace('arg_max(', 'CAST(arg_max(').replace(') AS total', ') AS BIGINT) AS total')} FROM snapshots WHERE snapshot_date >= DATE '{L.BASELINE}' GROUP BY 1")
def snapshot_asof(spark: SparkSession, d: str) -> DataFrame:
    return metrics.snapshot_at(L.snapshots(spark, d), (30, 60, 90), L.day(L.ORDERS_AS_OF), L.day(L.BASELINE))


_TREND = ", ".join(f"CASE WHEN COALESCE(total_{n}, 0) <> 0 THEN CAST(floor((COALESCE(now, 0) - total_{n}) / total_{n} * 100 + 0.5) AS BIGINT) ELSE 0 END AS trend{n}" for n in (30, 60, 90))


@query(f"""{WITH_JOBS}, {L.SNAPSHOTS}, t AS (SELECT entity_id, {_THEN} FROM snapshots GROUP BY 1),
n AS (SELECT entity_id, COUNT(*) AS now, COUNT(*) FILTER (posted_at >= {ORDERS_AT} - INTERVAL 7 DAY) AS new FROM jobs WHERE is_active GROUP BY 1)
SELECT COALESCE(n.entity_id, t.entity_id) AS entity_id, COALESCE(now, 0) AS total_active, COALESCE(new, 0) AS new_this_week, CAST(0 AS BIGINT) AS mapped_jobs, {_TREND} FROM n FULL JOIN t ON n.entity_id = t.entity_id""")
def entity_trend(spark: SparkSession, d: str) -> DataFrame:
    return metrics.entity_trend(L.jobs(spark, d), L.snapshots(spark, d), L.at(L.ORDERS_AS_OF), baseline=L.day(L.BASELINE))


@query(f"""{WITH_JOBS}, {L.SNAPSHOTS}, k AS (SELECT entity_id, snapshot_date, CAST(total_active AS BIGINT) AS total_active, new_this_week FROM snapshots WHERE snapshot_date >= DATE '{L.ORDERS_AS_OF[:10]}' - 90),
n AS (SELECT entity_id, COUNT(*) AS now, COUNT(*) FILTER (posted_at >= {ORDERS_AT} - INTERVAL 7 DAY) AS new FROM jobs WHERE is_active GROUP BY 1)
SELECT * FROM k UNION ALL SELECT n.entity_id, DATE '{L.ORDERS_AS_OF[:10]}', now, new FROM n LEFT JOIN (SELECT entity_id, arg_max(total_active, snapshot_date) AS last FROM k GROUP BY 1) x USING (entity_id) WHERE last IS DISTINCT FROM now""")
def trend_history(spark: SparkSession, d: str) -> DataFrame:
    jobs, as_of = L.jobs(spark, d), L.at(L.ORDERS_AS_OF)
    now = jobs.where("is_active").groupBy("entity_id").agg(F.count(F.lit(1)).alias("total_active"), F.count_if(metrics.new_this_week(F.col("posted_at"), as_of)).alias("new_this_week"))
    return metrics.trend_history(L.snapshots(spark, d), now, L.day(L.ORDERS_AS_OF), baseline=L.day(L.BASELINE)).drop("closed_count")


@query(f"""{WITH_JOBS}, f AS (SELECT id, entity_id, source, pay, posted_at FROM jobs WHERE is_active ORDER BY posted_at DESC NULLS LAST, id LIMIT 800)
SELECT id, entity_id, source, pay FROM (SELECT * FROM f WHERE pay >= 100000 ORDER BY posted_at DESC NULLS LAST, id LIMIT 200)""")
def open_jobs_page(spark: SparkSession, d: str) -> DataFrame:
    return metrics.jobs_page(L.jobs(spark, d).where("is_active"), F.col("pay") >= 100000, 200).select("id", "entity_id", "source", "pay")


@query(f"""{WITH_JOBS}, {L.LOCATIONS} SELECT portal, '' AS city, state, country, round(lat, 4) AS lat_key, round(lng, 4) AS lng_key, COUNT(*) AS n_jobs FROM locations WHERE is_active AND nation > 1 GROUP BY ALL""")
def map_buckets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.location_buckets(L.locations(spark, d), ("portal",), 4).drop("lat", "lng")


@query(f"""{WITH_JOBS}, {L.LOCATIONS} SELECT entity_id, '' AS city, state, country, round(lat, 5) AS lat_key, round(lng, 5) AS lng_key, COUNT(*) AS n_jobs, min(lat) AS lat, min(lng) AS lng FROM locations WHERE is_active AND nation > 1 GROUP BY ALL""")
def entity_map(spark: SparkSession, d: str) -> DataFrame:
    return metrics.location_buckets(L.locations(spark, d))


@query(f"""{WITH_JOBS}, {L.LOCATIONS} SELECT portal, COUNT(*) FILTER (nation > 1) AS "real", COUNT(*) FILTER (nation = 1) AS fallback, COUNT(*) FILTER (nation = 0) AS unmapped FROM locations WHERE is_active GROUP BY 1""")
def map_coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.map_coverage(L.locations(spark, d), ("portal",))


@query(f"""WITH {L.CHECKS}, j AS (SELECT entity_id, jobs_found % 5 AS k, jobs_found FROM checks) SELECT entity_id, COUNT(*) FILTER (k <> 0) AS enriched_jobs, COUNT(*) AS total_jobs,
CAST(floor(COUNT(*) FILTER (k <> 0) / COUNT(*) * 100 + 0.5) AS BIGINT) AS coverage_pct, COALESCE(CAST(floor(SUM(jobs_found) FILTER (k <> 0) / COUNT(*) FILTER (k <> 0) + 0.5) AS BIGINT), 0) AS average_score,
COUNT(*) FILTER (k = 1) AS drug_testing, COUNT(*) FILTER (k = 2) AS high_physical_demand, COUNT(*) FILTER (k <> 0 AND jobs_found >= 70) AS high_opportunity FROM j GROUP BY 1""")
def health_signals(spark: SparkSession, d: str) -> DataFrame:
    c = L.checks(spark, d)
    k = F.pmod("jobs_found", F.lit(5))
    raw = F.when(k == 0, "{}").otherwise(F.to_json(F.struct(F.struct((k == 1).alias("likely_drug_testing"), F.when(k == 2, "HIGH").otherwise("low").alias("physical_demand"), F.col("jobs_found").alias("opportunity_score")).alias("clarifai_oh"))))
    rows = c.select("entity_id", F.lit(True).alias("is_active"), raw.alias("raw_data"))
    return metrics.health_signals(rows).select("entity_id", "enriched_jobs", "total_jobs", "coverage_pct", "average_score", "drug_testing", "high_physical_demand", "high_opportunity")


# --- source checks -----------------------------------------------------------------------------------------------------

_CHECK_COLUMNS = "entity_id, source, id, status, jobs_found"


@query(f"WITH {L.LATEST} SELECT {_CHECK_COLUMNS} FROM latest")
def latest_check(spark: SparkSession, d: str) -> DataFrame:
    return latest(L.checks(spark, d), ["entity_id", "source"], ["id", "status", "jobs_found"], ["checked_at", "id"])


@query(f"WITH {L.LATEST} SELECT {_CHECK_COLUMNS} FROM previous")
def previous_check(spark: SparkSession, d: str) -> DataFrame:
    return reliability.previous_checks(L.checks(spark, d)).select("entity_id", "source", "id", "status", "jobs_found")


_DAILY = (
    f"{L.CHECKS}, daily AS (SELECT * FROM (SELECT *, date_trunc('day', checked_at) AS day, ROW_NUMBER() OVER (PARTITION BY entity_id, date_trunc('day', checked_at), source ORDER BY checked_at DESC, id DESC) AS rn FROM checks "
    f"WHERE checked_at >= {EVENTS_AT} - INTERVAL 30 DAY AND status IN ('success', 'zero')) WHERE rn = 1)"
)


@query(f"WITH {_DAILY} SELECT entity_id, source, id, jobs_found, CAST(day AS DATE) AS day FROM daily")
def daily_latest_check(spark: SparkSession, d: str) -> DataFrame:
    return reliability.latest_daily_checks(L.checks(spark, d), L.at(L.EVENTS_AS_OF)).select("entity_id", "source", "id", "jobs_found", F.to_date("day").alias("day"))


@query(f"""WITH {L.LATEST} SELECT source, COUNT(*) AS entities, COUNT(*) FILTER (status IN ('success', 'zero')) AS healthy, COUNT(*) FILTER (status = 'error') AS errors, COUNT(*) FILTER (status = 'zero') AS zeros,
CAST(SUM(jobs_found) AS BIGINT) AS jobs_found, CAST(MIN(checked_at) AS DATE) AS oldest_day, CAST(MAX(checked_at) AS DATE) AS newest_day FROM latest GROUP BY 1""")
def source_fleet(spark: SparkSession, d: str) -> DataFrame:
    rows = latest(L.checks(spark, d), ["entity_id", "source"], ["id", "status", "jobs_found", "checked_at"], ["checked_at", "id"])
    return reliability.source_fleet(rows).withColumns({"oldest_day": F.to_date("oldest_check"), "newest_day": F.to_date("newest_check")}).drop("oldest_check", "newest_check")


_INCIDENTS = f"""pairs AS (SELECT l.*, p.jobs_found AS before, p.status AS was FROM latest l LEFT JOIN previous p USING (entity_id, source)),
incidents AS (
SELECT entity_id, 'source-error:' || source AS incident_key, 'source_error' AS kind, CASE WHEN source_class = 'authoritative' THEN 'high' ELSE 'medium' END AS severity, source FROM pairs WHERE status = 'error'
UNION ALL SELECT entity_id, 'unverified-zero:' || source, 'unverified_authoritative_zero', 'high', source FROM pairs WHERE status = 'zero' AND source_class = 'authoritative'
UNION ALL SELECT entity_id, 'stale:' || source, 'stale_authoritative_source', 'medium', source FROM pairs WHERE source_class = 'authoritative' AND checked_at < {EVENTS_AT} - INTERVAL 48 HOUR
UNION ALL SELECT entity_id, 'zero-after-nonzero:' || source, 'zero_after_nonzero', CASE WHEN source_class = 'authoritative' THEN 'high' ELSE 'medium' END, source FROM pairs WHERE status <> 'error' AND was <> 'error' AND before >= 5 AND jobs_found = 0
UNION ALL SELECT entity_id, 'sudden-drop:' || source, 'sudden_inventory_drop', CASE WHEN source_class = 'authoritative' THEN 'high' ELSE 'medium' END, source FROM pairs WHERE status <> 'error' AND was <> 'error' AND before >= 10 AND jobs_found > 0 AND jobs_found <= greatest(1, floor(before * 0.25))
UNION ALL SELECT entity_id, 'sudden-spike:' || source, 'sudden_inventory_spike', 'medium', source FROM pairs WHERE status <> 'error' AND was <> 'error' AND before >= 5 AND jobs_found >= before * 4 AND jobs_found - before >= 20)"""


def _two_latest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = L.checks(spark, d)
    return reliability.previous_checks(c, n=1), reliability.previous_checks(c, n=2)


@query(f"WITH {L.LATEST}, {_INCIDENTS} SELECT * FROM incidents")
def incidents_single(spark: SparkSession, d: str) -> DataFrame:
    now, before = _two_latest(spark, d)
    return reliability.source_incidents(now, before, L.at(L.EVENTS_AS_OF))


def _pairs_sql(rows: str, keys: str, lineage: str) -> str:
    """Independent lineages of `rows`, then pairs in the order of source."""
    return (
        f"lines AS (SELECT *, {lineage} AS lineage FROM {rows}), one AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {keys}, lineage ORDER BY jobs_found DESC, id) AS lr FROM lines) WHERE lr = 1), "
        f"sides AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, a.source AS source_a, a.jobs_found AS jobs_a, b.source AS source_b, b.jobs_found AS jobs_b FROM one a JOIN one b USING ({keys}) WHERE a.source < b.source AND (a.jobs_found > 0 OR b.jobs_found > 0))"
    )


_LINEAGE = "CASE WHEN lineage_root = 'careeronestop' OR starts_with(lineage_root, 'nlx-mirror:') THEN 'nlx' ELSE lineage_root END"
_LINEAGE_BASE = "CASE WHEN lineage_root = 'careeronestop' THEN 'nlx' ELSE lineage_root END"
_r6 = lambda x: f"floor({x} * 1e6 + 0.5) / 1e6"
_BASELINES = (
    f"{_DAILY}, {_pairs_sql('daily', 'entity_id, day', _LINEAGE_BASE)}, obs AS (SELECT source_a, source_b, CASE WHEN jobs_b > 0 THEN jobs_a / jobs_b END AS ratio, least(jobs_a, jobs_b) / greatest(jobs_a, jobs_b) AS symmetric, CAST(abs(jobs_a - jobs_b) AS DOUBLE) AS delta FROM sides), "
    f"baselines AS (SELECT source_a, source_b, COUNT(*) AS sample_count, {_r6('quantile_cont(ratio, 0.5)')} AS median_ratio, {_r6('quantile_cont(ratio, 0.1)')} AS p10_ratio, {_r6('quantile_cont(ratio, 0.9)')} AS p90_ratio, {_r6('quantile_cont(delta, 0.5)')} AS median_abs_delta FROM obs GROUP BY 1, 2 HAVING COUNT(*) >= 5)"
)


@query(f"WITH {_BASELINES} SELECT * FROM baselines")
def source_pair_baselines(spark: SparkSession, d: str) -> DataFrame:
    return reliability.pair_baselines(L.checks(spark, d), L.at(L.EVENTS_AS_OF)).drop("symmetric_median", "symmetric_p10", "symmetric_p90")


@query(f"""WITH {_BASELINES}, {L.RANKED}, usable AS (SELECT entity_id, source, jobs_found, id, lineage_root FROM ranked WHERE rn = 1 AND status IN ('success', 'zero')),
{_pairs_sql('usable', 'entity_id', _LINEAGE).replace('lines AS', 'lines2 AS').replace('FROM lines)', 'FROM lines2)').replace('one AS', 'one2 AS').replace('FROM one a JOIN one b', 'FROM one2 a JOIN one2 b').replace('sides AS', 'sides2 AS')}
SELECT s.entity_id, 'cross-source-disagreement:' || s.source_a || ':' || s.source_b AS incident_key, s.source_a, s.jobs_a, s.source_b, s.jobs_b, b.sample_count IS NOT NULL AS learned_baseline
FROM sides2 s LEFT JOIN baselines b ON s.source_a = b.source_a AND s.source_b = b.source_b
WHERE CASE WHEN b.sample_count IS NOT NULL THEN greatest(jobs_a, jobs_b) >= 20 AND abs(jobs_a - jobs_b) >= 10 AND (CASE WHEN jobs_b = 0 THEN p90_ratio > 0 ELSE COALESCE(p10_ratio > 0 AND jobs_a / jobs_b < p10_ratio * 0.5, false) OR COALESCE(p90_ratio > 0 AND jobs_a / jobs_b > p90_ratio * 2, false) END)
ELSE greatest(jobs_a, jobs_b) >= 50 AND least(jobs_a, jobs_b) <= floor(greatest(jobs_a, jobs_b) * 0.1) END""")
def incidents_cross_source(spark: SparkSession, d: str) -> DataFrame:
    now, _ = _two_latest(spark, d)
    base = reliability.pair_baselines(L.checks(spark, d), L.at(L.EVENTS_AS_OF))
    return reliability.cross_source_incidents(now, base).drop("kind", "severity")


_EARLIER = "2024-01-16 00:00:00"


def _incidents_at(spark: SparkSession, d: str, as_of: str) -> DataFrame:
    c = L.checks(spark, d).where(F.col("checked_at") < L.at(as_of))
    return reliability.source_incidents(reliability.previous_checks(c, n=1), reliability.previous_checks(c, n=2), L.at(as_of))


def _as_of_sql(as_of: str, name: str) -> str:
    """The incidents' CTEs at another instant, as a subquery."""
    body = f"WITH {L.LATEST}, {_INCIDENTS} SELECT * FROM incidents".replace(EVENTS_AT, f"TIMESTAMP '{as_of}'").replace("FROM events)", f"FROM events WHERE ts < TIMESTAMP '{as_of}')")
    return f"{name} AS ({body})"


@query(f"""WITH {_as_of_sql(_EARLIER, 'before')}, {_as_of_sql(L.EVENTS_AS_OF, 'now')}
SELECT COALESCE(n.entity_id, b.entity_id) AS entity_id, COALESCE(n.incident_key, b.incident_key) AS incident_key, COALESCE(n.kind, b.kind) AS kind, CASE WHEN n.incident_key IS NOT NULL THEN 'open' ELSE 'resolved' END AS status,
CASE WHEN b.incident_key IS NOT NULL THEN DATE '{_EARLIER[:10]}' ELSE DATE '{L.EVENTS_AS_OF[:10]}' END AS first_seen, CASE WHEN n.incident_key IS NOT NULL THEN DATE '{L.EVENTS_AS_OF[:10]}' ELSE DATE '{_EARLIER[:10]}' END AS last_seen
FROM before b FULL JOIN now n ON b.entity_id = n.entity_id AND b.incident_key = n.incident_key""")
def incident_state(spark: SparkSession, d: str) -> DataFrame:
    before, now = L.at(_EARLIER), L.at(L.EVENTS_AS_OF)
    known = _incidents_at(spark, d, _EARLIER).withColumns({"status": F.lit("open"), "first_seen": before, "last_seen": before, "resolved_at": F.lit(None).cast("timestamp_ntz")})
    out = lifecycle.incident_states(known, _incidents_at(spark, d, L.EVENTS_AS_OF), now)
    return out.select("entity_id", "incident_key", "kind", "status", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"))


@query(f"""WITH {L.LATEST}, {_pairs_sql('latest', 'entity_id', _LINEAGE)} SELECT entity_id, lineage, source, jobs_found FROM one""")
def lineage_collapse(spark: SparkSession, d: str) -> DataFrame:
    now, _ = _two_latest(spark, d)
    return dedupe.collapse_lineages(now, ["entity_id"], dedupe.lineage_reliability(now["lineage_root"], now["source"])).select("entity_id", "lineage", "source", "jobs_found")


_RANK = "CASE {0} WHEN 'success' THEN 4 WHEN 'zero' THEN 3 WHEN 'error' THEN 2 ELSE 1 END"


@query(f"""WITH {L.CHECKS}, f AS (SELECT entity_id, source, list_reduce(list({{'id': id, 'status': status, 'jobs_found': jobs_found}} ORDER BY id),
lambda a, x: CASE WHEN {_RANK.format('x.status')} > {_RANK.format('a.status')} OR x.jobs_found > a.jobs_found THEN x ELSE a END) AS r FROM checks GROUP BY 1, 2)
SELECT entity_id, source, r.status AS status, r.jobs_found AS jobs_found FROM f""")
def check_fold(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.fold_checks(L.checks(spark, d).select("entity_id", "source", "_seq", "status", "jobs_found")).drop("_seq")


def _expected(spark: SparkSession, d: str) -> DataFrame:
    """Every entity with checks is expected to have all event types, and a source that is never checked."""
    kinds = F.explode(F.array(*(F.lit(x) for x in ("view", "click", "purchase", "signup", "error", "sitemap")))).alias("source_key")
    e = L.checks(spark, d).select("entity_id").distinct().select("entity_id", kinds)
    first = F.col("source_key").isin("view", "click")
    return e.withColumns({"source_class": F.when(first, "authoritative").otherwise("verified"), "source_type": F.lit("job_board"), "lineage_root": F.when(F.col("source_key") == "view", "ats:view").otherwise(F.col("source_key")), "ats_provider": F.lit(None).cast("string"), "is_primary": F.lit(False)})


_SCORED = f"""WITH {L.LATEST}, e AS (SELECT DISTINCT entity_id, k AS source FROM checks, (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'sitemap']) AS k)),
m AS (SELECT e.entity_id, e.source, l.status, e.source IN ('view', 'click') AS auth, COALESCE(l.checked_at >= {EVENTS_AT} - INTERVAL 48 HOUR, false) AS recent, l.lineage_root FROM e LEFT JOIN latest l USING (entity_id, source)),
h AS (SELECT *, recent AND (status = 'success' OR (status = 'zero' AND NOT auth)) AS healthy FROM m),
own AS (SELECT entity_id, CASE WHEN source = 'view' THEN 'ats:view' ELSE source END AS lin FROM h WHERE healthy UNION SELECT entity_id, {_LINEAGE} FROM h WHERE healthy),
n AS (SELECT entity_id, COUNT(DISTINCT lin) AS lines FROM own GROUP BY 1),
g AS (SELECT entity_id, COUNT(*) AS expected_sources, COUNT(*) FILTER (recent) AS checked_sources, COUNT(*) FILTER (auth) AS authoritative_sources, COUNT(*) FILTER (auth AND healthy) AS healthy_authoritative_sources, bool_or(healthy AND source = 'view') AS first_party_healthy FROM h GROUP BY 1),
s AS (SELECT g.*, COALESCE(lines, 0) AS independent_lineages, CAST(floor(checked_sources / expected_sources * 40 + 0.5) + floor(healthy_authoritative_sources / authoritative_sources * 35 + 0.5) AS BIGINT) + least(15, COALESCE(lines, 0) * 5) + CASE WHEN first_party_healthy THEN 10 ELSE 0 END AS raw FROM g LEFT JOIN n USING (entity_id))"""


@query(f"""{_SCORED}
SELECT entity_id, CAST(CASE WHEN healthy_authoritative_sources = 0 THEN least(raw, 45) ELSE raw END AS BIGINT) AS score, expected_sources, checked_sources, authoritative_sources, healthy_authoritative_sources, CAST(independent_lineages AS INTEGER) AS independent_lineages, first_party_healthy FROM s""")
def coverage_score(spark: SparkSession, d: str) -> DataFrame:
    now, _ = _two_latest(spark, d)
    return coverage.coverage_scores(_expected(spark, d), now, L.at(L.EVENTS_AS_OF)).drop("grade", "observed_sources", "lineages", "gaps")


@query(f"""{_SCORED}, k AS (SELECT *, CAST(CASE WHEN healthy_authoritative_sources = 0 THEN least(raw, 45) ELSE raw END AS BIGINT) AS score FROM s),
r AS (SELECT entity_id, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'strong' WHEN score >= 55 THEN 'moderate' WHEN score > 0 THEN 'limited' ELSE 'unknown' END AS grade, healthy_authoritative_sources, independent_lineages FROM k),
o AS (SELECT DISTINCT entity_id FROM latest WHERE checked_at >= {EVENTS_AT} - INTERVAL 48 HOUR AND source_class = 'verified'),
gaps AS (SELECT entity_id, CASE WHEN status IS NULL THEN 'Not checked: ' WHEN NOT recent THEN 'Stale check: ' WHEN status = 'error' THEN 'Source error: ' WHEN auth AND status = 'zero' THEN 'Unverified zero: ' END || source AS gap FROM h
UNION ALL SELECT entity_id, 'No authoritative source has a recent healthy check.' FROM r WHERE healthy_authoritative_sources = 0
UNION ALL SELECT entity_id, 'Coverage has fewer than two independent healthy hiring-source lineages.' FROM r JOIN o USING (entity_id) WHERE independent_lineages < 2)
SELECT entity_id, grade, gap FROM gaps JOIN r USING (entity_id) WHERE gap IS NOT NULL""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    now, _ = _two_latest(spark, d)
    return coverage.coverage_scores(_expected(spark, d), now, L.at(L.EVENTS_AS_OF)).select("entity_id", "grade", F.explode("gaps").alias("gap"))


# --- URLs and identity -------------------------------------------------------------------------------------------------


def _canonical(form: U.UrlForm) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: L.table(spark, d, "pages").select("page_id", U.canonical(F.col("url"), form).alias("canonical_url"))


for _name, _form in (("url_canon_a", U.JOBS), ("url_canon_b", U.TRUTH), ("url_canon_c", U.AUDIT)):
    QUERIES[_name] = _canonical(_form)
    SQL[_name] = f"SELECT page_id, {L.canonical_sql('url', _form.drop, _form.strip_www, _form.strip_slash)} AS canonical_url FROM pages"


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, array_to_string(string_split(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '.')[-2:], '.') AS registrable FROM pages")
def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.registrable_host(F.col("url")).alias("registrable"))


_IDENTITY = f"ids AS (SELECT *, lower({L.canonical_sql('url', U.JOBS.drop)}) AS identity FROM mirrored), rec AS (SELECT *, COALESCE(score > max(score) OVER (PARTITION BY identity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS record FROM ids), ord AS (SELECT *, CASE WHEN record THEN -seq ELSE 4503599627370496 + seq END AS k2 FROM rec)"


@query(f"""WITH {L.MIRRORED}, {_IDENTITY} SELECT 'url:' || identity AS identity, arg_min(source, k2) AS source, 'Job ' || arg_min(page_id, k2) AS title, arg_min(lat, k2) FILTER (lat IS NOT NULL) AS lat,
arg_min(source, k2) FILTER (k <> 0) AS department, COUNT(*) AS n_rows, MIN(seq) AS first_seq FROM ord GROUP BY identity""")
def dedupe_cross_source(spark: SparkSession, d: str) -> DataFrame:
    return identity.dedupe_jobs(L.mirrored_pages(spark, d)).select("identity", "source", "title", "lat", "department", "n_rows", F.col("_seq").alias("first_seq"))


@query(f"WITH {L.MIRRORED}, {_IDENTITY}, s AS (SELECT identity, COUNT(DISTINCT source) AS n_sources FROM ids GROUP BY 1) SELECT n_sources, COUNT(*) AS n_jobs FROM s GROUP BY 1")
def duplicate_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = identity.dedupe_jobs(L.mirrored_pages(spark, d))
    return rows.groupBy(F.size("duplicate_sources").cast("long").alias("n_sources")).agg(F.count(F.lit(1)).alias("n_jobs"))


_BRANDS = "brands AS (SELECT p_brand AS id, max(p_name) AS name FROM part GROUP BY 1)"


@query(f"""WITH {_BRANDS} SELECT p_partkey AS id, p_brand AS entity_id, CASE WHEN contains(' ' || p_name || ' ', ' ' || b.name || ' ') THEN 'employer-name:' || b.name END AS evidence FROM part p JOIN {'brands'} b ON p.p_brand = b.id""")
def employer_evidence(spark: SparkSession, d: str) -> DataFrame:
    part = L.table(spark, d, "part")
    brands = part.groupBy(F.col("p_brand").alias("id")).agg(F.max("p_name").alias("name")).withColumns({"aliases": F.array().cast("array<string>"), "career_page_url": F.lit(None).cast("string"), "ats_board_id": F.lit(None).cast("string")})
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity_id"), F.col("p_name").alias("title"), F.lit("web:langsearch").alias("source"))
    return identity.employer_evidence(rows, brands).select("id", "entity_id", "evidence")


_TITLE = "trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g'))"
_GENERIC = " OR ".join(f"regexp_matches(title, '{p}', 'i')" for p in quality.GENERIC_TITLES)
_QUALITY = f"""CASE WHEN title = '' THEN 'missing title' WHEN length(title) < 3 OR length(title) > 180 THEN 'implausible title length' WHEN regexp_matches(title, '[{{}}<>]') OR regexp_matches(title, '^(css|style|script)\\b', 'i') THEN 'markup/css text'
WHEN {_GENERIC} THEN 'generic/navigation title' END"""


@query(f"WITH t AS (SELECT doc_id, {_TITLE} AS title FROM documents) SELECT doc_id, {_QUALITY} AS quality_reason FROM t")
def job_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.lit("greenhouse").alias("source"))
    return quality.assess_quality(rows).select("doc_id", "quality_reason")


@query("""SELECT page_id, (regexp_matches(lower(regexp_replace(url, '#.*$', '')), '/jobs?/[^/?#]{4,}') OR regexp_matches(lower(url), '(jobid|job_id|gh_jid|requisitionid|reqid|postingid|jk)='))
AND NOT regexp_matches(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/(careers?|jobs?|employment|apply)/?$') AS strong_detail_url FROM pages""")
def detail_urls(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "pages").select("page_id", quality.is_detail_url(F.col("url")).alias("strong_detail_url"))


# --- dedupe and lifecycle ----------------------------------------------------------------------------------------------


@query("SELECT lang, source, text AS body, MIN(doc_id) AS first_id, COUNT(*) AS n FROM documents GROUP BY 1, 2, 3 HAVING COUNT(*) > 1")
def repeated_texts(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "documents").groupBy("lang", "source", F.col("text").alias("body")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT source, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1")
def best_of_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "documents").select("source", "doc_id", "n_chars", F.col("doc_id").alias("_seq"))
    return dedupe.best_of(rows, ["source"], F.col("n_chars")).drop("_seq")


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("_seq"))
    return dedupe.first_wins(rows, ["user_id", "event_type"]).drop("_seq")


@query("SELECT conv_id, role, arg_max(text, turn) AS text, min(turn) AS first_turn FROM conversations GROUP BY 1, 2")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "conversations").select("conv_id", "role", "text", F.col("turn").alias("_seq"))
    return dedupe.last_wins(rows, ["conv_id", "role"]).withColumnRenamed("_seq", "first_turn")


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    """Orders as an inventory: the URL is customer, month and clerk's priority, so some repeat; two priorities are authoritative."""
    j = L.jobs(spark, d)
    url = F.concat(F.lit("https://jobs.example.org/"), F.col("entity_id").cast("string"), F.lit("/"), F.date_format("posted_at", "yyyy-MM"))
    return j.withColumns({
        "url": url, "quality_ok": F.col("pay") >= 5000, "is_legacy_weak": F.col("source") == "5-LOW", "is_authoritative": F.col("source") == "1-URGENT",
        "source": F.when(F.col("source") == "3-MEDIUM", "web:langsearch").otherwise(F.col("source")), "closed_at": F.lit(None).cast("timestamp_ntz"),
    })


_STALE = "2000-01-01 00:00:00"
_RETIRE = f"""{WITH_JOBS}, inv AS (SELECT id, entity_id, posted_at, updated_at, pay, source AS p, CASE WHEN source = '3-MEDIUM' THEN 'web:langsearch' ELSE source END AS source,
'https://jobs.example.org/' || entity_id || '/' || strftime(posted_at, '%Y-%m') AS url FROM jobs WHERE is_active),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id, url ORDER BY updated_at DESC, posted_at, id) AS dr, bool_or(p = '1-URGENT') OVER (PARTITION BY entity_id) AS auth FROM inv),
reasons AS (SELECT id, entity_id, CASE WHEN dr > 1 THEN 'duplicate_url' WHEN pay < 5000 OR (auth AND p = '5-LOW') THEN 'invalid' WHEN auth AND source = 'web:langsearch' AND updated_at < TIMESTAMP '{_STALE}' THEN 'superseded'
WHEN p = '2-HIGH' AND pay < 20000 THEN 'missing' WHEN updated_at < {ORDERS_AT} - INTERVAL 365 DAY THEN 'stale' END AS close_reason FROM r)"""


@query(f"{_RETIRE} SELECT * FROM reasons")
def inventory_reconcile(spark: SparkSession, d: str) -> DataFrame:
    inv = _inventory(spark, d)
    current = inv.where((F.col("source") == "2-HIGH") & (F.col("pay") >= 20000)).select("entity_id", "source", "external_id")
    complete = inv.where(F.col("source") == "2-HIGH").select("entity_id", "source")
    return lifecycle.retire(inv, L.at(L.ORDERS_AS_OF), L.at(_STALE), current=current, complete=complete, stale_days=365).select("id", "entity_id", "close_reason")


@query(f"{_RETIRE} SELECT close_reason, COUNT(*) AS n_jobs, COUNT(DISTINCT entity_id) AS n_entities FROM reasons WHERE close_reason IS NOT NULL GROUP BY 1")
def retirement_summary(spark: SparkSession, d: str) -> DataFrame:
    return inventory_reconcile(spark, d).where("close_reason is not null").groupBy("close_reason").agg(F.count(F.lit(1)).alias("n_jobs"), F.count_distinct("entity_id").alias("n_entities"))


@query(f"""{WITH_JOBS}, o AS (SELECT entity_id, source, MIN(posted_at) AS posted_at, MIN(id) AS id FROM jobs WHERE posted_at < TIMESTAMP '1999-01-01' GROUP BY 1, 2),
n AS (SELECT entity_id, source, MAX(id) AS id FROM jobs WHERE posted_at >= TIMESTAMP '1998-01-01' GROUP BY 1, 2)
SELECT COALESCE(n.entity_id, o.entity_id) AS entity_id, COALESCE(n.source, o.source) AS source, CAST(o.posted_at AS DATE) AS posted_day, COALESCE(n.id, o.id) AS id, o.id IS NULL AS is_new, n.id IS NOT NULL AS changed
FROM o FULL JOIN n ON o.entity_id = n.entity_id AND o.source = n.source""")
def upsert_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = L.jobs(spark, d)
    old = j.where(F.col("posted_at") < L.at("1999-01-01 00:00:00")).groupBy("entity_id", "source").agg(F.min("posted_at").alias("posted_at"), F.min("id").alias("id"))
    new = j.where(F.col("posted_at") >= L.at("1998-01-01 00:00:00")).groupBy("entity_id", "source").agg(F.max("id").alias("id")).withColumn("posted_at", F.lit(None).cast("timestamp_ntz"))
    out = lifecycle.upsert(old, new, ["entity_id", "source"], {"posted_at": "fill"})
    return out.select("entity_id", "source", F.to_date("posted_at").alias("posted_day"), "id", F.col("_is_new").alias("is_new"), F.col("_changed").alias("changed"))


@query(f"""{WITH_JOBS}, u AS (SELECT entity_id, posted_at, MIN(CASE source WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 2 ELSE 0 END) AS best FROM jobs GROUP BY 1, 2)
SELECT j.id, j.entity_id FROM jobs j JOIN u USING (entity_id, posted_at) WHERE CASE j.source WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 2 ELSE 0 END > u.best""")
def supplemental_dupes(spark: SparkSession, d: str) -> DataFrame:
    j = L.jobs(spark, d).withColumn("url", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss"))
    return dedupe.supplemental_duplicates(j, ["4-NOT SPECIFIED", "5-LOW"]).select("id", "entity_id")


@query(f"""WITH {L.CHECKS}, l AS (SELECT entity_id, source, arg_max(status, id) AS status, max(checked_at) AS newest, max(checked_at) FILTER (status IN ('success', 'zero')) AS ok FROM checks GROUP BY 1, 2)
SELECT entity_id, source, status, CAST(newest AS DATE) AS last_day, CAST(ok AS DATE) AS last_success_day FROM l""")
def coverage_state(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("status").isin("success", "zero")
    rows = L.checks(spark, d).groupBy("entity_id", "source").agg(F.max_by("status", "id").alias("status"), F.max("checked_at").alias("at"), F.max(F.when(good, F.col("checked_at"))).alias("ok"))
    return rows.select("entity_id", "source", "status", F.to_date("at").alias("last_day"), F.to_date("ok").alias("last_success_day"))


@query("SELECT COUNT(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.retain(L.table(spark, d, "events"), "ts", 10, L.at(L.EVENTS_AS_OF)).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH_JOBS} SELECT id, CASE WHEN is_active THEN 'update' ELSE 'delete' END AS action FROM jobs WHERE posted_at >= TIMESTAMP '2001-01-01' OR (posted_at < TIMESTAMP '2001-01-01' AND NOT is_active)""")
def index_changes(spark: SparkSession, d: str) -> DataFrame:
    j = L.jobs(spark, d).select("id", "entity_id", "is_active", "pay", "posted_at")
    before = j.where(F.col("posted_at") < L.at("2001-01-01 00:00:00")).withColumn("is_active", F.lit(True)).unionByName(j.where((F.col("posted_at") >= L.at("2001-01-01 00:00:00")) & ~F.col("is_active")).withColumn("is_active", F.lit(True)))
    return lifecycle.index_changes(before, j)


# --- truth benchmarks --------------------------------------------------------------------------------------------------

_LANG = "regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1)"
_CANON_B = L.canonical_sql("url", U.TRUTH.drop, True, True)


@query(f"""WITH p AS (SELECT {_LANG} AS portal, {_CANON_B} AS u, html FROM pages), a AS (SELECT DISTINCT portal, u FROM p WHERE length(html) >= 1500), t AS (SELECT DISTINCT portal, u FROM p WHERE NOT contains(html, '&amp;')),
f AS (SELECT COALESCE(a.portal, t.portal) AS portal, a.u AS au, t.u AS tu FROM a FULL JOIN t ON a.portal = t.portal AND a.u = t.u),
g AS (SELECT portal, COUNT(au) AS app_urls, COUNT(tu) AS truth_urls, COUNT(*) FILTER (au IS NOT NULL AND tu IS NOT NULL) AS m, COUNT(*) FILTER (au IS NULL) AS missing, COUNT(*) FILTER (tu IS NULL) AS unexpected FROM f GROUP BY 1)
SELECT portal, app_urls, truth_urls, m AS matched, missing, unexpected, CASE WHEN app_urls > 0 THEN m / app_urls ELSE 0 END AS "precision", m / truth_urls AS recall FROM g""")
def truth_compare(spark: SparkSession, d: str) -> DataFrame:
    p = L.table(spark, d, "pages").withColumn("portal", F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1))
    tracked = F.regexp_replace("url", "#.*$", "")
    app = p.where(F.length("html") >= 1500).withColumn("url", F.concat(tracked, F.when(tracked.contains("?"), "&").otherwise("?"), F.lit("utm_term=x")))
    return benchmark.compare_truth(app, p.where(~F.col("html").contains("&amp;")), ["portal"])


_ENTITY_ROWS = """rows AS (SELECT lang AS portal, d.source, COUNT(*) AS app_count, COUNT(DISTINCT md5(text)) AS reference_count, COUNT(*) - COUNT(DISTINCT md5(text)) AS duplicate_count, COUNT(*) FILTER (n_chars < 300) AS stale_count,
COUNT(*) FILTER (n_chars < 20000) AS mapped_count, COUNT(l.doc_id) AS authoritative_total, COUNT(*) FILTER (quality = 1) AS authoritative_healthy, COUNT(*) FILTER (toxic = 1 AND quality = 0) AS high_incident_count, COUNT(l.doc_id) AS truth_urls,
COUNT(*) FILTER (quality = 1) / NULLIF(COUNT(l.doc_id), 0) AS "precision", COUNT(*) FILTER (toxic = 0) / NULLIF(COUNT(l.doc_id), 0) AS recall FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2)"""
_ASSESSED = """assessed AS (SELECT *, reference_count / app_count AS parity, duplicate_count / app_count AS duplicate_rate, stale_count / app_count AS stale_rate, mapped_count / app_count AS mapped_rate,
CASE WHEN authoritative_total > 0 THEN authoritative_healthy / authoritative_total END AS authoritative_health, CASE WHEN truth_urls > 0 THEN 'ground_truth' ELSE 'live_parity' END AS evidence_level FROM rows),
judged AS (SELECT *, (CASE WHEN truth_urls > 0 AND "precision" < 0.98 THEN 1 ELSE 0 END + CASE WHEN truth_urls > 0 AND recall < 0.9 THEN 1 ELSE 0 END + CASE WHEN parity < 0.9 THEN 1 ELSE 0 END + CASE WHEN duplicate_rate > 0.01 THEN 1 ELSE 0 END
+ CASE WHEN stale_rate > 0.03 THEN 1 ELSE 0 END + CASE WHEN mapped_rate < 0.85 THEN 1 ELSE 0 END + CASE WHEN authoritative_health < 0.95 THEN 1 ELSE 0 END + CASE WHEN high_incident_count > 0 THEN 1 ELSE 0 END) AS n_blockers FROM assessed)"""


def _assessed(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = L.table(spark, d, "documents"), L.table(spark, d, "labels").withColumnRenamed("doc_id", "labelled")
    good, n = F.count_if(F.col("quality") == 1), F.count("labelled")
    # The digest goes through the distinct count's shuffle, not the text.
    distinct = F.count_distinct(F.md5(F.col("text").cast("binary")))
    rows = docs.join(labels, docs["doc_id"] == labels["labelled"], "left").groupBy(F.col("lang").alias("portal"), "source").agg(
        F.count(F.lit(1)).alias("app_count"), distinct.alias("reference_count"), (F.count(F.lit(1)) - distinct).alias("duplicate_count"), F.count_if(F.col("n_chars") < 300).alias("stale_count"), F.count_if(F.col("n_chars") < 20000).alias("mapped_count"),
        n.alias("authoritative_total"), good.alias("authoritative_healthy"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("high_incident_count"), n.alias("truth_urls"),
        F.when(n > 0, good / n).alias("precision"), F.when(n > 0, F.count_if(F.col("toxic") == 0) / n).alias("recall"),
    )
    return benchmark.assess_entities(rows)


@query(f"""WITH {_ENTITY_ROWS}, {_ASSESSED} SELECT portal, source, evidence_level, round(parity, 6) AS parity, round(duplicate_rate, 6) AS duplicate_rate, round(stale_rate, 6) AS stale_rate, round(mapped_rate, 6) AS mapped_rate,
round(authoritative_health, 6) AS authoritative_health, CAST(n_blockers AS INTEGER) AS n_blockers, n_blockers = 0 AS passed FROM judged""")
def entity_benchmark(spark: SparkSession, d: str) -> DataFrame:
    r6 = lambda c: F.round(c, 6).alias(c)
    return _assessed(spark, d).select("portal", "source", "evidence_level", *(r6(c) for c in ("parity", "duplicate_rate", "stale_rate", "mapped_rate", "authoritative_health")), F.size("blockers").alias("n_blockers"), "passed")


@query(f"""WITH {_ENTITY_ROWS}, {_ASSESSED}, g AS (SELECT portal, COUNT(*) AS benchmark_entities, COUNT(*) FILTER (truth_urls > 0) AS truth_entities, AVG(COALESCE("precision", 0)) FILTER (truth_urls > 0) AS p, AVG(COALESCE(recall, 0)) FILTER (truth_urls > 0) AS r,
AVG(parity) AS parity, AVG(duplicate_rate) AS dup, AVG(stale_rate) AS stale, AVG(mapped_rate) AS mapped, AVG(COALESCE(authoritative_health, 0)) AS health, AVG(CASE WHEN high_incident_count > 0 THEN 1.0 ELSE 0.0 END) AS high FROM assessed GROUP BY 1)
SELECT portal, benchmark_entities, truth_entities, round(p, 6) AS "precision", round(r, 6) AS recall, round(parity, 6) AS parity, CASE WHEN benchmark_entities < 5 OR truth_entities < 3 THEN 'insufficient_evidence'
WHEN COALESCE(p < 0.98, false) OR COALESCE(r < 0.9, false) OR parity < 0.9 OR dup > 0.01 OR stale > 0.03 OR mapped < 0.85 OR health < 0.95 OR high > 0.05 THEN 'fail' ELSE 'pass' END AS status FROM g""")
def portal_release(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.release_gates(_assessed(spark, d)).select("portal", "benchmark_entities", "truth_entities", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("parity", 6).alias("parity"), "status")


@query(f"""{WITH_JOBS}, l AS (SELECT entity_id, MAX(updated_at) AS updated_at FROM jobs GROUP BY 1) SELECT portal, id, name FROM (SELECT e.*, ROW_NUMBER() OVER (PARTITION BY portal ORDER BY l.entity_id IS NOT NULL DESC, score DESC NULLS LAST, l.updated_at DESC NULLS LAST, name, id) AS rn
FROM entities e LEFT JOIN l ON l.entity_id = e.id WHERE is_active) WHERE rn <= 25""")
def cohort_select(spark: SparkSession, d: str) -> DataFrame:
    last = L.jobs(spark, d).groupBy("entity_id").agg(F.max("updated_at").alias("updated_at"))
    e = L.entities(spark, d).join(last, F.col("id") == F.col("entity_id"), "left").withColumn("has_truth", F.col("entity_id").isNotNull())
    return benchmark.select_cohort(e).select("portal", "id", "name")


@query(f"""WITH {L.LATEST}, e AS (SELECT entity_id, MAX(jobs_found) AS lower, SUM(jobs_found) AS upper FROM latest WHERE source_class = 'authoritative' AND status IN ('success', 'zero') GROUP BY 1),
a AS (SELECT entity_id, SUM(jobs_found) // 3 AS app_count FROM latest GROUP BY 1)
SELECT entity_id, CAST(app_count AS BIGINT) AS app_count, CAST(greatest(lower, least(app_count, upper)) AS BIGINT) AS reference_count FROM a LEFT JOIN e USING (entity_id)""")
def reference_envelope(spark: SparkSession, d: str) -> DataFrame:
    now, _ = _two_latest(spark, d)
    app = now.groupBy("entity_id").agg(F.expr("sum(jobs_found) div 3").alias("app_count"))
    return benchmark.reference_envelope(now, app).select("entity_id", "app_count", "reference_count")


# --- names, search, places ---------------------------------------------------------------------------------------------


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers' nations and parts as a registry; brands' words as what is looked up."""
    part = L.spread(L.table(spark, d, "part"), "p_partkey")
    kind = F.when(F.col("p_size") < 20, "county").when(F.col("p_size") < 35, "municipality").otherwise("township")
    reg = part.select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("name"), F.lit(None).cast("string").alias("canonical_name"), kind.alias("government_type"), F.lit(None).cast("string").alias("state_code"), F.lit(True).alias("is_active"))
    names = part.select(F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit("County")).alias("query")).distinct()
    return names.select(F.col("query").alias("query_id"), "query"), reg


_REG = "reg AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ' || replace(p_brand, '#', ' ') AS name, lower(p_name || ' ' || replace(p_brand, '#', ' ')) AS canonical, CASE WHEN p_size < 20 THEN 'county' WHEN p_size < 35 THEN 'municipality' ELSE 'township' END AS government_type FROM part)"
_ASKED = "asked AS (SELECT DISTINCT p_name || ' ' || replace(p_brand, '#', ' ') || ' County' AS query FROM part)"
_CANDIDATES = "cand AS (SELECT t.tok, r.* FROM (SELECT DISTINCT string_split(lower(query), ' ')[1] AS tok FROM asked) t, LATERAL (SELECT * FROM reg WHERE contains(reg.canonical, t.tok) ORDER BY length(canonical), id LIMIT 250) r)"


@query(f"""WITH {_REG}, {_ASKED}, {_CANDIDATES}, s AS (SELECT a.query, c.id, c.name, CASE WHEN c.canonical = lower(query) THEN 100 ELSE 0 END + CAST(floor(len(list_filter(list_filter(string_split(lower(query), ' '), lambda t: length(t) >= 2)[1:4], lambda t: contains(c.canonical, t))) / len(list_filter(string_split(query, ' '), lambda t: length(t) >= 2)[1:4]) * 55 + 0.5) AS BIGINT)
+ CASE WHEN contains(c.canonical, lower(query)) OR contains(lower(query), c.canonical) THEN 20 ELSE 0 END + CASE WHEN c.government_type = 'county' THEN 15 ELSE 0 END AS score FROM asked a JOIN cand c ON c.tok = string_split(lower(a.query), ' ')[1])
SELECT query, id, name, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, name, id) AS rn FROM s WHERE score >= 35) WHERE rn <= 12""")
def registry_search(spark: SparkSession, d: str) -> DataFrame:
    names, reg = _names(spark, d)
    # One-letter tokens don't search.
    return registry.search_registry(names, reg).select("query", "id", "name", "score")


@query()
def registry_match(spark: SparkSession, d: str) -> DataFrame:
    names, reg = _names(spark, d)
    return registry.resolve_registry(names, reg).select("query", "id", "name", "score")


_TOKENS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(text || ' ' || source), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> ''))"


@query(f"SELECT doc_id FROM documents WHERE list_has_all({_TOKENS}, ['the', 'src0']) ORDER BY doc_id LIMIT 50")
def search_records(spark: SparkSession, d: str) -> DataFrame:
    docs = L.table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("id"), F.col("text").alias("title"), "source", F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("posted_at"))
    return search.search_jobs(search.search_records(docs), "The, SRC0", 50).select("doc_id")


@query("SELECT n_nationkey, n_regionkey BETWEEN 1 AND 90 OR n_nationkey BETWEEN 1 AND 180 AS valid FROM nation")
def valid_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "nation").select("n_nationkey", geo.valid_coordinate(F.col("n_regionkey"), F.col("n_nationkey")).alias("valid"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 39.8283e0 WHEN c_mktsegment = 'MACHINERY' THEN 38.8816e0 WHEN c_mktsegment = 'BUILDING' THEN 31.0545e0 END AS lat,
CASE WHEN c_acctbal < 0 THEN 'remote fallback' WHEN c_mktsegment = 'MACHINERY' THEN 'job location' WHEN c_mktsegment = 'BUILDING' THEN 'state fallback' END AS note FROM customer""")
def infer_points(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("c_mktsegment")
    rows = L.table(spark, d, "customer").select("c_custkey", F.when(s == "MACHINERY", "Offices in Arlington, VA.").alias("location"), F.when(s == "BUILDING", "TX").alias("state"), (F.col("c_acctbal") < 0).alias("is_remote"))
    p = geo.infer_point(rows)
    return rows.select("c_custkey", p["lat"].alias("lat"), p["note"].alias("note"))


# --- scalar recipes ----------------------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_pick(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "events").select("event_id", N.pick(F.col("props"), "missing", "k").alias("k"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"event_type\":\"' || event_type || '\"}' AS merged FROM events")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    e = L.table(spark, d, "events")
    left = F.to_json(F.struct(F.lit(0).alias("k"), F.lit("x").alias("event_type")))
    right = N.merge_json(F.col("props"), F.to_json(F.struct("event_type")))
    return e.select("event_id", N.merge_json(left, right).alias("merged"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href=\"[^\"]*\"[^>]*>')) AS n_anchors, regexp_extract(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) AS first_href FROM pages WHERE contains(html, '<a ')")
def html_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "pages").where(F.col("html").contains("<a ")).select("page_id", T.anchors(F.col("html")).alias("a"))
    return rows.select("page_id", F.size("a").cast("long").alias("n_anchors"), F.get("a", F.lit(0))["href"].alias("first_href"))


@query()
def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return L.table(spark, d, "pages").select("page_id", N.fnv1a_base36(u).alias("fnv"), N.djb2_hash(u).alias("djb2"), N.shift31_hash(u).alias("shift31"), N.short_sha1(u, F.col("page_id").cast("string")).alias("short_id"))


@query("SELECT c_custkey, CAST(floor(c_acctbal / 100 + 0.5) AS BIGINT) AS hundreds, floor(c_acctbal / 7 * 1000 + 0.5) / 1000 AS sevenths FROM customer")
def rounding(spark: SparkSession, d: str) -> DataFrame:
    return L.table(spark, d, "customer").select("c_custkey", N.round_half_up(F.col("c_acctbal") / 100).alias("hundreds"), N.round_half_up(F.col("c_acctbal") / 7, 3).alias("sevenths"))


@query("SELECT c_custkey, trim(regexp_replace(replace(lower(c_name || ' & ' || c_mktsegment || ' Inc'), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS comparable, trim(regexp_replace(replace(lower(c_name || ' & ' || c_mktsegment), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS bare FROM customer")
def comparable_names(spark: SparkSession, d: str) -> DataFrame:
    name = T.comparable(F.concat(F.col("c_name"), F.lit(" & "), F.col("c_mktsegment"), F.lit(" Inc")))
    return L.table(spark, d, "customer").select("c_custkey", name.alias("comparable"), T.strip_legal(name).alias("bare"))


@query("WITH a AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS h, page_id % 2 AS s FROM pages) SELECT h AS host, max(CASE WHEN s = 0 THEN 1 ELSE 0 END) = 1 AS in_even, max(s) = 1 AS in_odd FROM a GROUP BY 1")
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "pages").select(U.host(F.col("url")).alias("host"), F.pmod("page_id", F.lit(2)).alias("s"))
    even, odd = rows.where("s = 0").select("host"), rows.where("s = 1").select("host")
    union = even.union(odd).distinct()
    both, only_even = even.intersect(odd).withColumn("k", F.lit("both")), even.subtract(odd).withColumn("k", F.lit("even"))
    kinds = both.union(only_even).withColumnRenamed("host", "_h")
    return union.join(kinds, F.col("host") == F.col("_h"), "left").select("host", F.col("k").isNotNull().alias("in_even"), (F.coalesce("k", F.lit("odd")) != "even").alias("in_odd"))


@query(f"{WITH_JOBS} SELECT e.id, l.id AS job_id, l.pay FROM entities e LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY posted_at DESC, id DESC) AS rn FROM jobs) WHERE rn = 1) l ON l.entity_id = e.id")
def latest_per_parent(spark: SparkSession, d: str) -> DataFrame:
    last = latest(L.jobs(spark, d).withColumnRenamed("id", "job_id"), ["entity_id"], ["job_id", "pay"], ["posted_at", "job_id"])
    return L.entities(spark, d).join(last, F.col("id") == F.col("entity_id"), "left").select("id", "job_id", "pay")


# --- payloads ----------------------------------------------------------------------------------------------------------


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS external_id, 'Page ' || page_id AS title, 'Fresno' AS city, 'CA' AS state, url AS apply_url FROM pages")
def greenhouse_payload(spark: SparkSession, d: str) -> DataFrame:
    p = L.table(spark, d, "pages")
    job = F.struct(F.col("page_id").alias("id"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.struct(F.lit("Fresno, CA").alias("name")).alias("location"), F.col("url").alias("absolute_url"), F.lit("2024-01-05T10:00:00Z").alias("updated_at"))
    pages = p.select("page_id", F.to_json(F.struct(F.array(job).alias("jobs"))).alias("payload"))
    return payloads.greenhouse(pages).select("page_id", "external_id", "title", "city", "state", "apply_url")


@query("SELECT page_id, url AS external_id, 'Page ' || page_id AS title, 'Fresno, CA' AS location, CAST('2024-01-05' AS DATE) AS posted_day FROM pages")
def rss_payload(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat(F.lit("<rss><channel><item><title><![CDATA[Page "), F.col("page_id").cast("string"), F.lit("]]></title><link>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</link><description>Location: Fresno, CA</description><pubDate>Fri, 05 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>"))
    pages = L.table(spark, d, "pages").select("page_id", item.alias("payload"))
    return payloads.neogov_rss(pages).select("page_id", "external_id", "title", "location", F.to_date("posted_at").alias("posted_day"))


def _grouped_events(spark: SparkSession, d: str) -> DataFrame:
    return first_rows(L.checks(spark, d), ["source"], [F.col("jobs_found").desc(), F.col("id")], n=10)


@query(f"WITH {L.CHECKS} SELECT source, id, jobs_found FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY jobs_found DESC, id) AS rn FROM checks) WHERE rn <= 10")
def top_checks(spark: SparkSession, d: str) -> DataFrame:
    return _grouped_events(spark, d).select("source", "id", "jobs_found")


# --- runs and sources --------------------------------------------------------------------------------------------------


@query(f"""{WITH_JOBS}, c AS (SELECT entity_id, source, COUNT(*) AS n FROM jobs GROUP BY 1, 2), u AS (SELECT DISTINCT id AS entity_id, s AS source FROM entities, (SELECT unnest(['1-URGENT', 'never']) AS s))
SELECT COALESCE(c.entity_id, u.entity_id) AS entity_id, COALESCE(c.source, u.source) AS source, CASE WHEN n > 0 THEN 'success' ELSE 'zero' END AS status, COALESCE(n, 0) AS jobs_found FROM c FULL JOIN u ON c.entity_id = u.entity_id AND c.source = u.source""")
def check_synthesis(spark: SparkSession, d: str) -> DataFrame:
    used = L.entities(spark, d).select(F.col("id").alias("entity_id"), F.array(F.lit("1-URGENT"), F.lit("never")).alias("sources"))
    return runs.synthesise_checks(L.jobs(spark, d), used, "authoritative").select("entity_id", "source", "status", "jobs_found")


@query(f"""{WITH_JOBS}, l AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY posted_at DESC, id DESC) AS rn FROM jobs) WHERE rn = 1)
SELECT e.id, CASE WHEN l.id IS NULL OR l.posted_at < TIMESTAMP '2000-01-01' THEN 'queued' ELSE l.source END AS status, COALESCE(l.id, 0) AS jobs_found FROM entities e LEFT JOIN l ON l.entity_id = e.id""")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    j, zero = L.jobs(spark, d), F.lit(0).cast("long")
    logs = j.select("id", "entity_id", F.col("source").alias("status"), "source", F.col("id").alias("jobs_found"), zero.alias("jobs_new"), zero.alias("jobs_closed"), F.lit(None).cast("string").alias("error_message"), F.col("posted_at").alias("ran_at"))
    return runs.ingest_status(L.entities(spark, d).withColumn("created_at", L.at("2000-01-01 00:00:00")), logs).select("id", "status", "jobs_found")


@query(f"""WITH {_ENTITY_ROWS}, {_ASSESSED} SELECT evidence_level, COUNT(*) AS entities, COUNT(DISTINCT portal) AS portals, COUNT(*) FILTER (n_blockers = 0) AS passed FROM judged GROUP BY 1""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_summary(_assessed(spark, d))


@query(f"{WITH_JOBS}, c AS (SELECT entity_id, COUNT(*) FILTER (source = '1-URGENT') AS authoritative_jobs FROM jobs GROUP BY 1) SELECT * FROM c WHERE authoritative_jobs < 2")
def discovery_allowed(spark: SparkSession, d: str) -> DataFrame:
    return runs.discovery_allowed(L.jobs(spark, d).withColumn("is_authoritative", F.col("source") == "1-URGENT"), minimum=2)


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'greenhouse' WHEN 'MACHINERY' THEN 'ats:icims' ELSE 'career_page' END AS connector, CASE c_mktsegment WHEN 'BUILDING' THEN 'board' || c_custkey WHEN 'MACHINERY' THEN 'site' || c_custkey END AS board FROM customer""")
def connector_dispatch(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    url = F.when(s == "BUILDING", F.concat(F.lit("https://boards.greenhouse.io/board"), k)).when(s == "MACHINERY", F.concat(F.lit("https://site"), k, F.lit(".icims.com/jobs"))).otherwise("https://example.org/careers")
    e = L.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), url.alias("career_page_url"), F.lit(None).cast("string").alias("ats_provider"))
    e = e.withColumn("ats_board_id", U.ats_board(F.col("career_page_url")))
    return runs.dispatch(e).select("c_custkey", "connector", F.col("ats_board_id").alias("board"))


@query("""WITH n AS (SELECT s_suppkey, ['Ohio', 'Texas', 'Utah', 'Maine', 'Iowa'][s_nationkey % 5 + 1] AS st, s_nationkey FROM supplier) SELECT s_suppkey, CASE WHEN s_nationkey > 20 THEN NULL ELSE CASE st WHEN 'Ohio' THEN 'OH' WHEN 'Texas' THEN 'TX' WHEN 'Utah' THEN 'UT' WHEN 'Maine' THEN 'ME' ELSE 'IA' END END AS state FROM n""")
def state_inference(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*(F.lit(x) for x in ("Ohio", "Texas", "Utah", "Maine", "Iowa"))), F.pmod("s_nationkey", F.lit(5)))
    e = L.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") > 20, "County Works").otherwise(F.concat(F.lit("County of "), name, F.lit(" Works"))).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("government_state"), F.lit(None).cast("string").alias("career_page_url"))
    return e.select("s_suppkey", runs.infer_state(e).alias("state"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 97 WHEN 'signup' THEN 96 WHEN 'purchase' THEN 55 ELSE 50 END AS priority FROM events")
def source_priorities(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    source = F.when(t == "view", " Lever").when(t == "click", "ats:x").when(t == "signup", "portal:y").when(t == "purchase", "jobapi:z").otherwise(t)
    return L.table(spark, d, "events").select("event_id", identity.source_priority(source).alias("priority"))


@query("""WITH p AS (SELECT conv_id, COUNT(*) AS n, COUNT(DISTINCT text) AS sig, COUNT(DISTINCT role) AS urls FROM conversations GROUP BY 1) SELECT conv_id, CAST(2 AS BIGINT) AS official, urls AS unique_urls, n = sig AND urls >= 2 AS complete FROM p""")
def pages_complete(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("page"), F.coalesce("text", F.lit("")).alias("signature"), F.lit(2).cast("long").alias("total"), F.lit(True).alias("exhausted"), F.array("role").alias("urls"))
    return benchmark.pages_complete(rows, ["conv_id"])


@query("""SELECT source AS entity_id, 'urls' AS kind, COUNT(DISTINCT lang) AS official_job_count FROM documents GROUP BY 1""")
def truth_promotion(spark: SparkSession, d: str) -> DataFrame:
    caps = L.table(spark, d, "documents").select(F.col("source").alias("entity_id"), F.lit("complete").alias("status"), F.array("lang").alias("job_urls"), F.lit(None).cast("long").alias("official_count"))
    return benchmark.promote_truth(caps).select("entity_id", "kind", "official_job_count")


@query("""SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS nth, href FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages))""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    rows = L.table(spark, d, "pages").select("page_id", F.posexplode(T.anchors(F.col("html"))).alias("nth", "a"))
    return rows.select("page_id", "nth", F.col("a.href").alias("href"))


@query("SELECT page_id, 'Post ' || page_id AS title, 'https://x.org/jobs/post-' || page_id AS apply_url, 'json_ld' AS parser FROM pages UNION ALL SELECT page_id, 'Link ' || page_id, 'https://x.org/jobs/link-' || page_id, 'strong_job_detail_link' FROM pages")
def career_pages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"Post '), k, F.lit('","url":"/jobs/post-'), k, F.lit('"}</script>'))
    links = F.concat(F.lit('<a href="post-'), k, F.lit('">Link '), k, F.lit('</a><a href="/jobs/link-'), k, F.lit('">Link '), k, F.lit('</a><a href="/jobs">Jobs</a>'))
    pages = L.table(spark, d, "pages").select("page_id", F.lit("https://x.org/jobs/list").alias("page_url"), F.concat(ld, links).alias("payload"))
    both = web.json_ld_jobs(pages).select("page_id", "title", "apply_url", F.lit("json_ld").alias("parser")).unionByName(web.linked_jobs(pages).where(~F.col("apply_url").contains("/post-")).select("page_id", "title", "apply_url", F.lit("strong_job_detail_link").alias("parser")))
    return both
