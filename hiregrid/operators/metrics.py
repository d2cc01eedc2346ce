"""Trend metrics, role mix, maps, snapshots and portal figures over jobs."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite, round_half_up
from .frames import column_or_null

ROLE_CATEGORIES = ("security", "logistics", "medical", "admin", "aviation", "engineering", "remote", "overseas", "other")
#: Snapshots before this day are not comparable.
BASELINE_DATE = date(2026, 8, 7)


def new_this_week(posted_at: Column, as_of: datetime) -> Column:
    """Published in the last seven days or later; the time of discovery never counts."""
    return F.coalesce(posted_at >= F.lit(as_of) - F.expr("INTERVAL 7 DAYS"), F.lit(False))


def has_real_location(jobs: DataFrame) -> Column:
    quality = F.lower(F.coalesce(F.get_json_object(column_or_null(jobs, "raw_data"), "$.normalized_location_quality"), F.lit("")))
    return jobs["lat"].isNotNull() & jobs["lng"].isNotNull() & ~quality.contains("fallback") & ~quality.contains("unmapped_no_job_location")


def percent_change(now: Column, then: Column) -> Column:
    """Rounded percent, half toward positive infinity; 0 without a base."""
    return F.when(F.coalesce(then, F.lit(0)) != 0, round_half_up((now - then) / then * 100)).otherwise(F.lit(0)).cast("long")


def snapshot_at(snapshots: DataFrame, days: tuple[int, ...], as_of: date, baseline: date = BASELINE_DATE) -> DataFrame:
    """Per entity: the total of the last snapshot at or before each of `days` ago, all in one pass; null if none."""
    day, total = F.col("snapshot_date"), F.col("total_active")
    usable = snapshots.where(day >= F.lit(baseline))
    return usable.groupBy("entity_id").agg(*(F.max_by(total, F.when(day <= F.date_sub(F.lit(as_of), n), day)).alias(f"total_{n}") for n in days))


def entity_trend(jobs: DataFrame, snapshots: DataFrame, as_of: datetime, days: tuple[int, ...] = (30, 60, 90), baseline: date = BASELINE_DATE) -> DataFrame:
    """Per entity with active jobs or snapshots: totals now, new this week, mapped jobs, and the change against each look-back."""
    active = jobs.where("is_active")
    now = active.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("total_active"), F.count_if(new_this_week(F.col("posted_at"), as_of)).alias("new_this_week"),
        (F.count_if(has_real_location(active)) if "lat" in jobs.columns else F.lit(0).cast("long")).alias("mapped_jobs"),
    )
    then = snapshot_at(snapshots, days, as_of.date() if isinstance(as_of, datetime) else as_of, baseline)
    both = now.join(then, "entity_id", "full")
    total = F.coalesce("total_active", F.lit(0))
    return both.select("entity_id", total.alias("total_active"), F.coalesce("new_this_week", F.lit(0)).alias("new_this_week"), F.coalesce("mapped_jobs", F.lit(0)).alias("mapped_jobs"), *(percent_change(total, F.col(f"total_{n}")).alias(f"trend{n}") for n in days))


def trend_history(snapshots: DataFrame, now: DataFrame, as_of: date, days: int = 90, baseline: date = BASELINE_DATE) -> DataFrame:
    """Snapshots of the last days, and a row of today's totals where the last one differs (or there is none)."""
    kept = snapshots.where((F.col("snapshot_date") >= F.date_sub(F.lit(as_of), days)) & (F.col("snapshot_date") >= F.lit(baseline))).select("entity_id", "snapshot_date", "total_active", "new_this_week", "closed_count")
    last = kept.groupBy("entity_id").agg(F.max_by("total_active", "snapshot_date").alias("_last"))
    today = now.join(last, "entity_id", "left").where(~F.col("_last").eqNullSafe(F.col("total_active"))).select("entity_id", F.lit(as_of).alias("snapshot_date"), "total_active", "new_this_week", F.lit(0).cast("long").alias("closed_count"))
    return kept.unionByName(today)


def role_breakdown(jobs: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    return jobs.where("is_active").groupBy(*keys, F.coalesce("role_category", F.lit("other")).alias("role_category")).agg(F.count(F.lit(1)).alias("n_jobs"))


# Flags of the occupational-health enrichment and the names of their counts.
HEALTH_FLAGS = {
    "preplacement_exam": "likely_preplacement_exam", "drug_testing": "likely_drug_testing", "hearing_conservation": "likely_hearing_conservation", "respirator_use": "likely_respirator_use",
    "medical_surveillance": "likely_medical_surveillance", "deployment_oconus": "deployment_oconus", "dot_cdl": "dot_cdl", "hazardous_exposure": "hazardous_exposure",
    "safety_sensitive": "safety_sensitive", "clearance_security": "clearance_security",
}


def health_signals(jobs: DataFrame, keys: tuple[str, ...] = ("entity_id",), root: str = "clarifai_oh") -> DataFrame:
    """Counts of enriched active jobs by flag, coverage percent and mean score of opportunity."""
    raw = F.col("raw_data")
    at = lambda name: F.get_json_object(raw, f"$.{root}.{name}")
    flag = lambda name: ~F.coalesce(at(name), F.lit("false")).isin("false", "0", "", "null")
    enriched = F.coalesce(F.get_json_object(raw, f"$.{root}"), F.lit("")) != ""
    score = F.coalesce(finite(at("opportunity_score")), F.lit(0.0))
    n, of = F.count_if(enriched), F.count(F.lit(1))
    return jobs.where("is_active").groupBy(*keys).agg(
        n.alias("enriched_jobs"), of.alias("total_jobs"), round_half_up(n / of * 100).alias("coverage_pct"),
        F.coalesce(round_half_up(F.sum(F.when(enriched, score)) / n), F.lit(0)).alias("average_score"),
        *(F.count_if(enriched & flag(path)).alias(name) for name, path in HEALTH_FLAGS.items()),
        F.count_if(enriched & (F.lower(at("physical_demand")) == "high")).alias("high_physical_demand"), F.count_if(enriched & (score >= 70)).alias("high_opportunity"),
    )


def location_buckets(jobs: DataFrame, keys: tuple[str, ...] = ("entity_id",), digits: int = 5) -> DataFrame:
    """Mapped active jobs by city, state, country and rounded point; the point shown is that of the smallest id."""
    rounded = lambda c: F.round(F.col(c).cast("double"), digits)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        jobs.where("is_active").where(has_real_location(jobs))
        .groupBy(*keys, blank("city").alias("city"), blank("state").alias("state"), blank("country").alias("country"), rounded("lat").alias("lat_key"), rounded("lng").alias("lng_key"))
        .agg(F.count(F.lit(1)).alias("n_jobs"), F.min_by("lat", "id").alias("lat"), F.min_by("lng", "id").alias("lng"))
    )


def map_coverage(jobs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """How many active jobs have a real location, only a fallback, or none."""
    active = jobs.where("is_active")
    point = active["lat"].isNotNull() & active["lng"].isNotNull()
    real = has_real_location(active)
    return active.groupBy(*keys).agg(F.count_if(real).alias("real"), F.count_if(point & ~real).alias("fallback"), F.count_if(~point).alias("unmapped"))


def portal_kpis(entities: DataFrame, jobs: DataFrame, as_of: datetime) -> DataFrame:
    """Per portal of active entities: entities, those hiring, open roles, new this week. Jobs are counted per entity before the join."""
    counts = jobs.where("is_active").groupBy("entity_id").agg(F.count(F.lit(1)).alias("open_roles"), F.count_if(new_this_week(F.col("posted_at"), as_of)).alias("new"))
    return (
        entities.where("is_active").join(counts, entities["id"] == counts["entity_id"], "left").groupBy("portal")
        .agg(F.count(F.lit(1)).alias("total_entities"), F.count("open_roles").alias("hiring_entities"), F.coalesce(F.sum("open_roles"), F.lit(0)).alias("open_roles"), F.coalesce(F.sum("new"), F.lit(0)).alias("new_this_week"))
    )


def entities_with_counts(entities: DataFrame, jobs: DataFrame, as_of: datetime) -> DataFrame:
    counts = jobs.where("is_active").groupBy("entity_id").agg(F.count(F.lit(1)).alias("active_jobs"), F.count_if(new_this_week(F.col("posted_at"), as_of)).alias("new_jobs"))
    return entities.where("is_active").join(counts, entities["id"] == counts["entity_id"], "left").select(entities["*"], F.coalesce("active_jobs", F.lit(0)).alias("active_jobs"), F.coalesce("new_jobs", F.lit(0)).alias("new_jobs"))


def daily_snapshot(jobs: DataFrame, as_of: datetime, roles: tuple[str, ...] = ROLE_CATEGORIES) -> DataFrame:
    """Per entity: active, new, all-time closed, and a counter of active jobs per role; all in one aggregation."""
    active = F.col("is_active")
    role = F.coalesce("role_category", F.lit("other"))
    return jobs.groupBy("entity_id").agg(
        F.count_if(active).alias("total_active"), F.count_if(active & new_this_week(F.col("posted_at"), as_of)).alias("new_this_week"), F.count_if(~active).alias("closed_count"),
        *(F.count_if(active & (role == r)).alias(f"role_{r}") for r in roles),
    ).withColumn("snapshot_date", F.to_date(F.lit(as_of)))


def jobs_page(jobs: DataFrame, accept: Column, limit: int = 100) -> DataFrame:
    """The newest acceptable jobs, nulls last: fetch four times as many (500 to 2000), filter, then cut."""
    limit = min(max(limit, 1), 500)
    order = [F.col("posted_at").desc_nulls_last(), F.col("id").asc()]
    return jobs.orderBy(*order).limit(min(max(4 * limit, 500), 2000)).where(accept).orderBy(*order).limit(limit)
