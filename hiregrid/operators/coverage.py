"""Coverage scores of entities: expected sources against recent checks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from .dedupe import lineage_coverage, lineage_for_source
from .frames import first_rows
from .reliability import is_inventory_coverage

_FIRST_PARTY = r"^(?:ats:|official-domain:|state-jobs:|usps$|federal-)"


def is_hiring_lineage(x: Column) -> Column:
    return ~(x.startswith("identity:") | x.startswith("registry:") | x.startswith("coverage:") | x.startswith("jobapi:") | x.isin("web:langsearch", "adzuna", ""))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 75, "strong").when(score >= 55, "moderate").when(score > 0, "limited").otherwise("unknown")


def match_checks(expected: DataFrame, checks: DataFrame) -> DataFrame:
    """Each expected source with its newest check: by source key, else, for a primary one, by its provider's names."""
    names = F.explode(F.array_distinct(F.array_compact(F.array("source_key", "source"))))
    by_key = checks.withColumn("_name", names)
    by_key = first_rows(by_key, ["entity_id", "_name"], [F.col("checked_at").desc_nulls_last(), F.col("source")])
    body = ["source", "source_class", "status", "authoritative_zero", "lineage_root", "checked_at"]
    packed = by_key.select(F.col("entity_id").alias("_e"), "_name", F.struct(*body).alias("_check"))
    provider = F.lower(F.trim(F.coalesce("ats_provider", F.lit(""))))
    aliases = F.filter(F.array(provider, F.when(provider != "", F.concat(F.lit("ats:"), provider)), F.when(F.col("source_type") == "career_page", "career_page")), lambda a: F.coalesce(a, F.lit("")) != "")
    direct = expected.join(packed, (F.col("entity_id") == F.col("_e")) & (F.col("source_key") == F.col("_name")), "left").withColumnRenamed("_check", "_direct").drop("_e", "_name")
    low = checks.select(F.col("entity_id").alias("_e"), F.lower("source").alias("_name"), F.struct(*body).alias("_check"))
    primary = expected.where("is_primary").select("entity_id", "source_key", F.explode(aliases).alias("_alias")).join(low, (F.col("entity_id") == F.col("_e")) & (F.col("_alias") == F.col("_name")))
    primary = primary.groupBy(F.col("entity_id").alias("_pe"), F.col("source_key").alias("_pk")).agg(F.max_by("_check", F.struct("_check.checked_at", "_check.source")).alias("_primary"))
    both = direct.join(primary, (F.col("entity_id") == F.col("_pe")) & (F.col("source_key") == F.col("_pk")), "left")
    return both.withColumn("check", F.coalesce("_direct", "_primary")).drop("_direct", "_primary", "_pe", "_pk")


def coverage_scores(expected: DataFrame, checks: DataFrame, as_of: datetime, stale_hours: int = 48) -> DataFrame:
    """Per entity: score 0 to 100, grade, counts, lineages and the first gaps.

    40 for the share of expected sources checked lately, 35 for the share of authoritative ones healthy, 5 for each independent lineage up to
    15, 10 for a healthy first party; at most 55 without an authoritative source, at most 45 if none of them is healthy.
    """
    recent = lambda at: F.coalesce(at >= F.lit(as_of) - F.expr(f"INTERVAL {int(stale_hours)} HOURS"), F.lit(False))
    good = lambda status, first, zero: F.coalesce((status == "success") | ((status == "zero") & (~first | F.coalesce(zero, F.lit(False)))), F.lit(False))
    rows = match_checks(expected.where(F.col("source_type") != "identity"), checks)
    first = F.col("source_class") == "authoritative"
    rows = rows.withColumn("_recent", F.col("check").isNotNull() & recent(F.col("check.checked_at")))
    rows = rows.withColumn("_healthy", F.col("_recent") & good(F.col("check.status"), first, F.col("check.authoritative_zero")))
    lineage = lineage_coverage(F.coalesce(F.nullif(F.col("lineage_root"), F.lit("")), F.col("check.lineage_root"), F.col("source_key")))
    gap = (
        F.when(F.col("check").isNull(), "Not checked: ").when(~F.col("_recent"), "Stale check: ").when(F.col("check.status") == "error", "Source error: ")
        .when(F.col("check.status") == "skipped", "Source skipped: ").when(first & (F.col("check.status") == "zero") & ~F.coalesce(F.col("check.authoritative_zero"), F.lit(False)), "Unverified zero: ")
    )
    per_source = rows.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("expected_sources"), F.count_if("_recent").alias("checked_sources"), F.count_if(first).alias("authoritative_sources"), F.count_if(first & F.col("_healthy")).alias("healthy_authoritative_sources"),
        F.bool_or(F.col("_healthy") & first & F.lower(F.coalesce("lineage_root", F.lit(""))).rlike(_FIRST_PARTY)).alias("first_party_healthy"),
        F.array_sort(F.collect_list(F.when(gap.isNotNull(), F.struct("source_key", F.concat(gap, F.col("source_key")).alias("gap"))))).alias("_gaps"), F.collect_set(F.when(F.col("_healthy"), lineage)).alias("_own"),
    )
    healthy = recent(F.col("checked_at")) & good(F.col("status"), first, F.col("authoritative_zero")) & is_inventory_coverage(F.col("source"))
    seen = lineage_coverage(F.coalesce(F.nullif(F.col("lineage_root"), F.lit("")), lineage_for_source(F.col("source"))))
    per_check = checks.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("observed_sources"), F.collect_set(F.when(healthy, seen)).alias("_seen"),
        F.bool_or(recent(F.col("checked_at")) & is_inventory_coverage(F.col("source")) & F.col("source_class").isin("verified", "supplemental")).alias("_others"),
    )
    both = per_source.join(per_check, "entity_id", "full").fillna(0, ["expected_sources", "checked_sources", "authoritative_sources", "healthy_authoritative_sources", "observed_sources"]).fillna(False, ["first_party_healthy", "_others"])
    none = F.array().cast("array<string>")
    both = both.withColumn("lineages", F.array_sort(F.filter(F.array_union(F.coalesce("_own", none), F.coalesce("_seen", none)), is_hiring_lineage)))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    score = round_half_up(ratio("checked_sources", "expected_sources") * 40) + round_half_up(ratio("healthy_authoritative_sources", "authoritative_sources") * 35) + F.least(F.lit(15), F.size("lineages") * 5) + F.when(F.col("first_party_healthy"), 10).otherwise(0)
    capped = F.when(F.col("authoritative_sources") == 0, F.least(score, F.lit(55))).when(F.col("healthy_authoritative_sources") == 0, F.least(score, F.lit(45))).otherwise(score)
    more = F.array_compact(F.array(
        F.when(F.col("authoritative_sources") == 0, "No authoritative hiring source is registered.").when(F.col("healthy_authoritative_sources") == 0, "No authoritative source has a recent healthy check."),
        F.when((F.size("lineages") < 2) & F.col("_others"), "Coverage has fewer than two independent healthy hiring-source lineages."),
    ))
    gaps = F.slice(F.concat(F.transform(F.coalesce("_gaps", F.array().cast("array<struct<source_key:string,gap:string>>")), lambda g: g["gap"]), more), 1, 12)
    both = both.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), capped)).cast("long"))
    return both.select("entity_id", "score", grade(F.col("score")).alias("grade"), "expected_sources", "checked_sources", "authoritative_sources", "healthy_authoritative_sources", F.size("lineages").alias("independent_lineages"), "first_party_healthy", "observed_sources", "lineages", gaps.alias("gaps"))
