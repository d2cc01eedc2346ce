"""Source reliability: ten incident rules, learned baselines of source pairs, the order of severities."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import non_negative, round_half_up
from .dedupe import collapse_lineages, lineage_baseline, lineage_reliability
from .frames import column_or_null, first_rows
from .selection import exact_percentiles


def _prefixed(source: Column, *prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, (source.startswith(p) for p in prefixes))


def is_inventory_reliability(source: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return ~(_prefixed(x, "identity:", "registry:", "coverage:", "jobapi:") | x.isin("web:langsearch", "adzuna"))


def is_inventory_coverage(source: Column) -> Column:
    x = F.lower(F.coalesce(source, F.lit("")))
    return ~(_prefixed(x, "identity:", "coverage:", "jobapi:") | x.isin("registry:census_governments", "web:langsearch", "adzuna"))


def is_inventory_benchmark(source: Column) -> Column:
    return ~(_prefixed(source, "identity:", "registry:", "coverage:") | (source == "web:langsearch"))


def is_inventory_fleet(source: Column) -> Column:
    return ~_prefixed(source, "identity:", "registry:", "coverage:")


# Ranks of severities, highest first in every listing.
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def previous_checks(history: DataFrame, keys: tuple[str, ...] = ("entity_id", "source"), n: int = 2) -> DataFrame:
    """The n-th newest check of each key: by time, then by id."""
    from pyspark.sql import Window as W

    order = W.partitionBy(*keys).orderBy(F.col("checked_at").desc_nulls_last(), F.col("id").desc())
    return history.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == n).drop("_rn")


def source_incidents(checks: DataFrame, previous: DataFrame, as_of: datetime, stale_hours: int = 48) -> DataFrame:
    """Incidents that one source's latest check shows: entity_id, incident_key, kind, severity, source.

    `checks`: entity_id, source, source_class, status, jobs_found, authoritative_zero, checked_at, details (JSON); `previous`:
    entity_id, source, status, jobs_found.
    """
    before = previous.select(F.col("entity_id").alias("_pe"), F.col("source").alias("_ps"), F.col("status").alias("_status"), non_negative(F.col("jobs_found")).alias("_before"))
    rows = checks.where(is_inventory_reliability(checks["source"])).join(before, (F.col("entity_id") == F.col("_pe")) & (F.col("source") == F.col("_ps")), "left")
    details = column_or_null(checks, "details")
    now, was = non_negative(F.col("jobs_found")), F.col("_before")
    first = F.coalesce(F.col("source_class") == "authoritative", F.lit(False))
    high = F.when(first, "high").otherwise("medium")
    medium = F.lit("medium")
    healthy = F.col("status").isin("success", "zero") & F.col("_status").isin("success", "zero")
    truncated = (F.get_json_object(details, "$.truncated") == "true") | (F.get_json_object(details, "$.pagination_truncated") == "true")
    stale = F.col("checked_at").isNotNull() & (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("checked_at").cast("timestamp")) > stale_hours * 3_600_000_000)
    zero = healthy & (was >= 5) & (now == 0)
    rules = [
        (F.col("status") == "error", "source_error", "source-error", high),
        (first & (F.col("status") == "skipped"), "authoritative_skipped", "authoritative-skipped", medium),
        (truncated, "truncated_inventory", "truncated", high),
        (first & (F.col("status") == "zero") & ~F.coalesce(F.col("authoritative_zero"), F.lit(False)), "unverified_authoritative_zero", "unverified-zero", F.lit("high")),
        (stale & first, "stale_authoritative_source", "stale", medium),
        (zero, "zero_after_nonzero", "zero-after-nonzero", high),
        (healthy & (was >= 10) & (now > 0) & (now <= F.greatest(F.lit(1), F.floor(was * 0.25))), "sudden_inventory_drop", "sudden-drop", high),
        (healthy & (was >= 5) & (now >= was * 4) & (now - was >= 20), "sudden_inventory_spike", "sudden-spike", medium),
    ]
    issues = F.array_compact(F.array(*(F.when(test, F.struct(F.concat(F.lit(f"{key}:"), F.col("source")).alias("incident_key"), F.lit(kind).alias("kind"), severity.alias("severity"))) for test, kind, key, severity in rules)))
    return rows.select("entity_id", "source", F.explode(issues).alias("i")).select("entity_id", "i.*", "source")


def independent_pairs(checks: DataFrame, keys: list[str], lineage: Column, seq: str = "_seq") -> DataFrame:
    """Pairs of a group's independent lineages (the larger check of each), in the order of their sources: source_a, jobs_a, source_b, jobs_b.

    A group has a row per lineage, so it is small whatever the history's length; pairs with no jobs on either side go.
    """
    one = collapse_lineages(checks, keys, lineage, seq).select(*keys, "source", non_negative(F.col("jobs_found")).alias("jobs"))
    group = one.groupBy(*keys).agg(F.collect_list(F.struct("source", "jobs")).alias("_all"))
    first = group.select(*keys, "_all", F.explode("_all").alias("_a"))
    # Once as a column of its own: inside the filter it would be computed for every pair.
    first = first.withColumn("_key", F.collate(F.col("_a.source"), "UNICODE"))
    pairs = first.select(*keys, F.col("_a.source").alias("source_a"), F.col("_a.jobs").alias("jobs_a"), F.explode(F.filter("_all", lambda x: F.collate(x["source"], "UNICODE") > F.col("_key"))).alias("_b"))
    return pairs.select(*keys, "source_a", "jobs_a", F.col("_b.source").alias("source_b"), F.col("_b.jobs").alias("jobs_b")).where((F.col("jobs_a") > 0) | (F.col("jobs_b") > 0))


def cross_source_incidents(checks: DataFrame, baselines: DataFrame, min_samples: int = 5, as_of: datetime | None = None, fresh_days: int = 3) -> DataFrame:
    """Independent healthy sources of an entity that disagree: outside their learned range, or, without one, sharply.

    Baselines with an `updated_at` count for `fresh_days` up to as_of only.
    """
    if as_of is not None and "updated_at" in baselines.columns:
        baselines = baselines.where(F.col("updated_at") >= F.lit(as_of) - F.expr(f"INTERVAL {int(fresh_days)} DAYS"))
    usable = checks.where(F.col("source_class").isin("authoritative", "verified") & F.col("status").isin("success", "zero") & is_inventory_reliability(checks["source"]))
    if "details" in checks.columns:
        usable = usable.where(~F.coalesce(F.get_json_object("details", "$.shared_inventory") == "true", F.lit(False)))
    pairs = independent_pairs(usable, ["entity_id"], lineage_reliability(column_or_null(usable, "lineage_root"), usable["source"]))
    known = baselines.where(F.col("sample_count") >= min_samples).select(F.col("source_a").alias("_a"), F.col("source_b").alias("_b"), "sample_count", "p10_ratio", "p90_ratio")
    rows = pairs.join(known, (F.col("source_a") == F.col("_a")) & (F.col("source_b") == F.col("_b")), "left")
    a, b = F.col("jobs_a"), F.col("jobs_b")
    low, high = F.when(F.col("p10_ratio") > 0, F.col("p10_ratio").cast("double") * 0.5), F.when(F.col("p90_ratio") > 0, F.col("p90_ratio").cast("double") * 2)
    ratio = F.when(b > 0, a / b)
    outlier = F.coalesce(ratio < low, F.lit(False)) | F.coalesce(ratio > high, F.lit(False)) | (ratio.isNull() & high.isNotNull())
    learned = F.col("sample_count").isNotNull()
    most, least = F.greatest(a, b), F.least(a, b)
    found = (learned & outlier & (most >= 20) & (F.abs(a - b) >= 10)) | (~learned & (most >= 50) & (least <= F.floor(most * 0.1)))
    return rows.where(found).select("entity_id", F.concat_ws(":", F.lit("cross-source-disagreement"), "source_a", "source_b").alias("incident_key"), F.lit("cross_source_disagreement").alias("kind"), F.lit("medium").alias("severity"), "source_a", "jobs_a", "source_b", "jobs_b", learned.alias("learned_baseline"))


def unhealthy_entities(assessments: DataFrame) -> DataFrame:
    """Entities with authoritative sources of which none is healthy."""
    return assessments.where((F.col("authoritative_sources") > 0) & (F.coalesce("healthy_authoritative_sources", F.lit(0)) == 0)).select("entity_id", F.lit("no-healthy-authoritative-source").alias("incident_key"), F.lit("no_healthy_authoritative_source").alias("kind"), F.lit("high").alias("severity"))


def all_incidents(checks: DataFrame, previous: DataFrame, baselines: DataFrame, assessments: DataFrame, as_of: datetime, stale_hours: int = 48) -> DataFrame:
    """All incidents of all entities, one per key; a listing orders them by severity, then by key."""
    parts = [source_incidents(checks, previous, as_of, stale_hours).drop("source"), cross_source_incidents(checks, baselines, as_of=as_of), unhealthy_entities(assessments)]
    return reduce(DataFrame.unionByName, (p.select("entity_id", "incident_key", "kind", "severity") for p in parts)).dropDuplicates(["entity_id", "incident_key"])


def latest_daily_checks(history: DataFrame, as_of: datetime, window_days: int = 30) -> DataFrame:
    """The last healthy check of each entity, day and inventory source in the window."""
    usable = history.where(
        (F.col("checked_at") >= F.lit(as_of) - F.expr(f"INTERVAL {int(window_days)} DAYS")) & F.col("status").isin("success", "zero") & F.col("source_class").isin("authoritative", "verified") & is_inventory_benchmark(F.col("source"))
    )
    return first_rows(usable.withColumn("day", F.date_trunc("day", "checked_at")), ["entity_id", "day", "source"], [F.col("checked_at").desc_nulls_last(), F.col("id").desc()])


def pair_baselines(history: DataFrame, as_of: datetime, window_days: int = 30, min_samples: int = 5) -> DataFrame:
    """Per pair of sources: samples, and exact percentiles of the ratio and of the difference, by linear interpolation, to 6 places."""
    daily = latest_daily_checks(history, as_of, window_days).withColumn("_seq", F.col("id"))
    pairs = independent_pairs(daily, ["entity_id", "day"], lineage_baseline(column_or_null(daily, "lineage_root"), daily["source"]))
    a, b = F.col("jobs_a"), F.col("jobs_b")
    rows = pairs.select("source_a", "source_b", F.when(b > 0, a / b).alias("ratio"), (F.least(a, b) / F.greatest(a, b)).alias("symmetric"), F.abs(a - b).alias("delta"))
    wanted = {
        "median_ratio": ("ratio", 0.5), "p10_ratio": ("ratio", 0.1), "p90_ratio": ("ratio", 0.9), "median_abs_delta": ("delta", 0.5), "symmetric_median": ("symmetric", 0.5),
        "symmetric_p10": ("symmetric", 0.1), "symmetric_p90": ("symmetric", 0.9),
    }
    found = exact_percentiles(rows, ["source_a", "source_b"], wanted, count="sample_count").where(F.col("sample_count") >= min_samples)
    return found.select("source_a", "source_b", "sample_count", *(round_half_up(F.col(name), 6).alias(name) for name in wanted))


def source_fleet(latest: DataFrame) -> DataFrame:
    """Per inventory source: entities, healthy, errors, zeros, jobs, and the oldest and newest check."""
    s = F.col("status")
    return latest.where(is_inventory_fleet(F.col("source"))).groupBy("source").agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(s.isin("success", "zero")).alias("healthy"), F.count_if(s == "error").alias("errors"), F.count_if(s == "zero").alias("zeros"),
        F.sum("jobs_found").alias("jobs_found"), F.min("checked_at").alias("oldest_check"), F.max("checked_at").alias("newest_check"),
    )
