"""The source-health page: counts, truth coverage, candidates, latest audits; freshness of directories, summaries of runs, what has to be evaluated again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import all_of, first_rows
from .reliability import is_inventory_reliability


def health_summary(entities: DataFrame, coverage: DataFrame, incidents: DataFrame, truth: DataFrame, audits: DataFrame) -> DataFrame:
    """Eight counts in one row. Each table is aggregated on its own, so what is joined are single rows."""
    open_ = F.col("status") == "open"
    parts = [
        entities.agg(F.count_if("is_active").alias("active_entities")),
        coverage.agg(F.count(F.lit(1)).alias("latest_source_checks")),
        incidents.agg(F.count_if(open_).alias("open_incidents"), F.count_if(open_ & F.col("severity").isin("critical", "high")).alias("high_incidents")),
        truth.agg(F.count(F.lit(1)).alias("truth_snapshots"), F.count_distinct("entity_id").alias("truth_entities")),
        audits.agg(F.count(F.lit(1)).alias("official_audits"), F.count_distinct(F.when(F.col("complete"), F.col("entity_id"))).alias("independently_audited_entities")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def truth_coverage(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """Per portal: entities with truth, snapshots, the latest one."""
    per = truth.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("captured_at").alias("last"))
    rows = per.join(entities.select(F.col("id").alias("entity_id"), "portal"), "entity_id")
    return rows.groupBy("portal").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("snapshots"), F.max("last").alias("latest_snapshot"))


def truth_candidates(entities: DataFrame, truth: DataFrame, limit: int = 180) -> DataFrame:
    """Active entities to take truth of next: those without first, then by portal, score (highest first) and name."""
    last = truth.groupBy("entity_id").agg(F.max_by(F.struct("captured_at", "official_job_count"), F.struct("captured_at", "id")).alias("_t"))
    rows = entities.where("is_active").join(last, F.col("id") == F.col("entity_id"), "left")
    rows = rows.select("id", "name", "portal", F.coalesce("score", F.lit(0)).alias("coverage_score"), F.col("_t.captured_at").alias("latest_truth_at"), F.col("_t.official_job_count").alias("latest_official_count"))
    return rows.orderBy(F.col("latest_truth_at").isNull().desc(), "portal", F.col("coverage_score").desc(), "name").limit(limit)


# The order in which audits are shown.
_AUDIT_ORDER = {"error": 1, "incomplete": 2, "unsupported": 3}


def latest_audits(audits: DataFrame, limit: int = 150) -> DataFrame:
    """The newest audit of each entity's source, those with trouble first."""
    last = first_rows(audits, ["entity_id", "source_key"], [F.col("audited_at").desc(), F.col("id").desc()])
    rank = F.lit(4)
    for status, n in _AUDIT_ORDER.items():
        rank = F.when(F.col("status") == status, n).otherwise(rank)
    return last.orderBy(rank, F.col("audited_at").desc(), F.col("id")).limit(limit)


def directories_due(entries: DataFrame, minimums: DataFrame, as_of: datetime, stale_days: int = 7) -> DataFrame:
    """Directories to read again: with fewer active entries than the minimum, none, or none newer than `stale_days`. `minimums`: directory_key, minimum."""
    per = entries.groupBy("directory_key").agg(F.count_if("is_active").alias("n_active"), F.max(F.when(F.col("is_active"), F.col("last_seen_at"))).alias("newest"))
    rows = minimums.join(per, "directory_key", "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))
    due = (F.col("n_active") < F.coalesce("minimum", F.lit(1))) | F.col("newest").isNull() | (F.col("newest") < F.lit(as_of) - F.expr(f"INTERVAL {int(stale_days)} DAYS"))
    return rows.withColumn("due", due)


def ingest_summary(rows: DataFrame) -> DataFrame:
    """Per entity what a run did: jobs discovered, kept, new, rejected by quality and by employer, duplicates, closed, the sources used, and its status.

    `rows`: entity_id, source, outcome (kept, duplicate, off_target, low_quality, closed), is_new, and `claim`: whether an authoritative source
    proved the inventory, which makes a run without jobs a success.
    """
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    out = rows.groupBy("entity_id").agg(
        F.count_if(F.col("outcome") != "closed").alias("raw_discovered"), n("kept").alias("total"), F.count_if((F.col("outcome") == "kept") & F.col("is_new")).alias("new"), n("low_quality").alias("quality_rejected"),
        n("off_target").alias("off_target_rejected"), n("duplicate").alias("duplicates_removed"), n("closed").alias("closed"), F.array_sort(F.collect_set(F.when(F.col("outcome") == "kept", F.col("source")))).alias("sources_used"), F.bool_or("claim").alias("_claim"),
    )
    return out.withColumn("status", F.when((F.col("total") > 0) | F.coalesce("_claim", F.lit(False)), "success").otherwise("partial")).drop("_claim")


def stale_on_read(coverage: DataFrame, as_of: datetime, stale_hours: int = 48) -> DataFrame:
    """Entities whose incidents are evaluated again when they are read: one of their authoritative inventory sources was last checked too long ago."""
    old = F.col("last_checked_at") < F.lit(as_of) - F.expr(f"INTERVAL {int(stale_hours)} HOURS")
    return coverage.where((F.col("source_class") == "authoritative") & is_inventory_reliability(F.col("source")) & old).select("entity_id").distinct()


#: Roles and portals that a filter may name are checked by the caller's lists.
def job_filters(portal: str | None = None, entity_id: object = None, country: str | None = None, role: str | None = None, new_since: datetime | None = None, overseas: bool = False, federal: bool = False) -> Column:
    """The conjunction of the filters that are given over jobs joined with their entities' portals. A job without the day it was posted isn't new."""
    tests = []
    if portal is not None:
        tests.append(F.col("portal") == portal)
    if entity_id is not None:
        tests.append(F.col("entity_id") == entity_id)
    if country is not None:
        tests.append(F.upper("country") == country.upper())
    if role is not None:
        tests.append(F.col("role_category") == role)
    if new_since is not None:
        tests.append(F.col("posted_at").isNotNull() & (F.col("posted_at") >= F.lit(new_since)))
    if overseas:
        tests.append(F.coalesce(F.col("is_overseas"), F.lit(False)))
    if federal:
        tests.append(F.col("portal") == "federal_agencies")
    return all_of(tests)
