"""Truth benchmarks: URL sets against captured truth, entity assessments, release gates of portals, cohorts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, finite
from ..functions.urls import TRUTH, canonical
from .frames import first_rows


@dataclass(frozen=True)
class ReleaseThresholds:
    min_benchmark_entities: int = 5
    min_truth_entities: int = 3
    min_precision: float = 0.98
    min_recall: float = 0.90
    min_parity: float = 0.90
    max_duplicate_rate: float = 0.01
    max_stale_rate: float = 0.03
    min_mapped_rate: float = 0.85
    min_authoritative_health: float = 0.95
    max_high_incident_rate: float = 0.05


def compare_truth(app: DataFrame, truth: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Per key: matched, missing, unexpected, precision and recall of canonical URL sets; all null where truth has none.

    The sets meet row by row in one full join, so an entity with any number of URLs needs no array.
    """
    read = lambda df, flag: df.select(*keys, canonical(df[url], TRUTH).alias("_url")).where("_url is not null").distinct().withColumn(flag, F.lit(True))
    rows = read(app, "_app").join(read(truth, "_truth"), [*keys, "_url"], "full")
    a, t = F.col("_app").isNotNull(), F.col("_truth").isNotNull()
    out = rows.groupBy(*keys).agg(F.count_if(a).alias("app_urls"), F.count_if(t).alias("truth_urls"), F.count_if(a & t).alias("_m"), F.count_if(~a).alias("_missing"), F.count_if(~t).alias("_unexpected"))
    known = F.col("truth_urls") > 0
    return out.select(
        *keys, "app_urls", "truth_urls", F.when(known, F.col("_m")).alias("matched"), F.when(known, F.col("_missing")).alias("missing"), F.when(known, F.col("_unexpected")).alias("unexpected"),
        F.when(known, F.when(F.col("app_urls") > 0, F.col("_m") / F.col("app_urls")).otherwise(0.0)).alias("precision"), F.when(known, F.col("_m") / F.col("truth_urls")).alias("recall"),
    )


def parity_score(app: Column, reference: Column) -> Column:
    """The smaller of two counts over the larger; 1 if both are 0, null without a reference."""
    a, r = F.greatest(F.coalesce(finite(app), F.lit(0.0)), F.lit(0.0)), finite(reference)
    r = F.when(r >= 0, r)
    return F.when(r.isNotNull(), F.when((a == 0) & (r == 0), 1.0).otherwise(F.least(a, r) / F.greatest(a, r)))


def _percent(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def assess_entities(rows: DataFrame, t: ReleaseThresholds | None = None) -> DataFrame:
    """Adds parity, rates, evidence_level, blockers and passed to rows with the counts of an entity and its truth comparison.

    Wants app_count, reference_count, duplicate_count, stale_count, mapped_count, authoritative_total, authoritative_healthy, high_incident_count,
    truth_urls, precision, recall.
    """
    t = t or ReleaseThresholds()
    n = F.greatest(F.coalesce(F.col("app_count"), F.lit(0)), F.lit(0))
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    rate = lambda c, empty: F.when(n > 0, clamp(count(c) / n, 0.0, 1.0)).otherwise(F.lit(empty))
    truth = F.coalesce(F.col("truth_urls"), F.lit(0)) > 0
    rows = rows.withColumns({
        "parity": parity_score(F.col("app_count"), F.col("reference_count")), "duplicate_rate": rate("duplicate_count", 0.0), "stale_rate": rate("stale_count", 0.0), "mapped_rate": rate("mapped_count", 1.0),
        "authoritative_health": F.when(count("authoritative_total") > 0, clamp(count("authoritative_healthy") / count("authoritative_total"), 0.0, 1.0)),
        "evidence_level": F.when(truth, "ground_truth").when(finite(F.col("reference_count")) >= 0, "live_parity").otherwise("insufficient"),
    })
    below = lambda c, limit, label, given=F.lit(True): F.when(given & (F.col(c) < limit), F.concat(F.lit(f"{label} "), _percent(F.col(c), 1), F.lit(f" < {limit * 100:.0f}%")))
    above = lambda c, limit, label: F.when(F.col(c) > limit, F.concat(F.lit(f"{label} "), _percent(F.col(c), 1), F.lit(f" > {limit * 100:.0f}%")))
    blockers = F.array_compact(F.array(
        below("precision", t.min_precision, "precision", truth), below("recall", t.min_recall, "recall", truth), below("parity", t.min_parity, "source parity"), above("duplicate_rate", t.max_duplicate_rate, "duplicate rate"),
        above("stale_rate", t.max_stale_rate, "stale rate"), below("mapped_rate", t.min_mapped_rate, "mapped rate"), below("authoritative_health", t.min_authoritative_health, "authoritative health"),
        F.when(count("high_incident_count") > 0, F.concat(count("high_incident_count").cast("string"), F.lit(" high-severity source incident(s)"))),
    ))
    rows = rows.withColumn("blockers", blockers)
    return rows.withColumn("passed", F.when(F.col("evidence_level") != "insufficient", F.size("blockers") == 0))


def release_gates(rows: DataFrame, t: ReleaseThresholds | None = None, keys: tuple[str, ...] = ("portal",), null_as_zero: bool = True) -> DataFrame:
    """Per portal: means over truth rows and over usable rows against the thresholds; too little evidence is a status of its own.

    A mean counts a null as 0, as the gate always did; `null_as_zero=False` leaves nulls out.
    """
    t = t or ReleaseThresholds()
    truth, usable = F.col("evidence_level") == "ground_truth", F.col("evidence_level") != "insufficient"
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if null_as_zero else F.col(c)
    mean = lambda c, given: F.avg(F.when(given, value(c))).alias(c)
    out = rows.groupBy(*keys).agg(
        F.count_if(usable).alias("benchmark_entities"), F.count_if(truth).alias("truth_entities"), mean("precision", truth), mean("recall", truth),
        *(mean(c, usable) for c in ("parity", "duplicate_rate", "stale_rate", "mapped_rate", "authoritative_health")),
        F.avg(F.when(usable, F.when(F.coalesce("high_incident_count", F.lit(0)) > 0, 1.0).otherwise(0.0))).alias("high_incident_rate"),
    )
    checks = [
        ("precision", t.min_precision, True), ("recall", t.min_recall, True), ("parity", t.min_parity, True), ("duplicate_rate", t.max_duplicate_rate, False), ("stale_rate", t.max_stale_rate, False),
        ("mapped_rate", t.min_mapped_rate, True), ("authoritative_health", t.min_authoritative_health, True), ("high_incident_rate", t.max_high_incident_rate, False),
    ]
    failed = F.array_compact(F.array(*(F.when(F.col(c) < limit if low else F.col(c) > limit, F.lit(c)) for c, limit, low in checks)))
    enough = (F.col("benchmark_entities") >= t.min_benchmark_entities) & (F.col("truth_entities") >= t.min_truth_entities)
    return out.withColumn("failed", failed).withColumn("status", F.when(~enough, "insufficient_evidence").when(F.size("failed") > 0, "fail").otherwise("pass"))


def select_cohort(entities: DataFrame, size: int = 25, keys: tuple[str, ...] = ("portal",)) -> DataFrame:
    """Up to `size` active entities of each portal: with truth first, then by score, latest update and name."""
    order = [F.col("has_truth").desc(), F.col("score").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("name"), F.col("id")]
    return first_rows(entities.where("is_active"), list(keys), order, n=size)


def promote_truth(captures: DataFrame) -> DataFrame:
    """Per entity the truth that complete captures give: the union of URL sets if all have one, a single count if exactly one has only that.

    `captures`: entity_id, status, job_urls (array), official_count. Counts of several sources are never summed.
    """
    urls = F.col("job_urls").isNotNull()
    out = captures.groupBy("entity_id").agg(
        F.bool_and((F.col("status") == "complete") & urls).alias("_all"), F.count(F.lit(1)).alias("_n"),
        F.count_if(~urls & F.col("official_count").isNotNull() & (F.col("status") == "complete")).alias("_counts"), F.max(F.when(F.col("status") == "complete", F.col("official_count"))).alias("_count"),
    )
    # Each URL once before they are collected, so an array is as long as the truth it is.
    known = captures.where(urls).select("entity_id", F.explode("job_urls").alias("_u")).distinct().groupBy("entity_id").agg(F.array_sort(F.collect_list("_u")).alias("_urls"))
    out = out.join(known, "entity_id", "left").withColumn("_urls", F.coalesce("_urls", F.array().cast("array<string>")))
    whole, single = F.col("_all"), (F.col("_n") == 1) & (F.col("_counts") == 1)
    return out.where(whole | single).select("entity_id", F.when(whole, F.col("_urls")).alias("job_urls"), F.when(whole, F.size("_urls")).otherwise(F.col("_count")).cast("long").alias("official_job_count"), F.when(whole, "urls").otherwise("count").alias("kind"))


def reference_envelope(checks: DataFrame, app: DataFrame) -> DataFrame:
    """Per entity: the app's count clamped between the largest authoritative inventory and the sum of all."""
    e = checks.where((F.col("source_class") == "authoritative") & F.col("status").isin("success", "zero")).groupBy("entity_id").agg(F.max("jobs_found").alias("lower"), F.sum("jobs_found").alias("upper"))
    return app.join(e, "entity_id", "left").withColumn("reference_count", F.greatest("lower", F.least("app_count", "upper")))


def pages_complete(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a paged inventory was read whole: the official total is known, the end was seen, no page came twice, and enough distinct URLs came.

    `pages`: keys, page, signature, total, exhausted, urls (array).
    """
    seen = pages.groupBy(*keys).agg(F.max("total").alias("official"), F.bool_or("exhausted").alias("_end"), F.count("signature").alias("_n"), F.count_distinct("signature").alias("_d"))
    urls = pages.select(*keys, F.explode("urls").alias("u")).groupBy(*keys).agg(F.count_distinct("u").alias("unique_urls"))
    rows = seen.join(urls, keys, "left").fillna(0, ["unique_urls"])
    return rows.select(*keys, "official", "unique_urls", F.coalesce(F.col("official").isNotNull() & F.col("_end") & (F.col("_n") == F.col("_d")) & (F.col("unique_urls") >= F.col("official")), F.lit(False)).alias("complete"))


def maintain_cohort(members: DataFrame, entities: DataFrame, as_of: datetime, size: int = 25) -> DataFrame:
    """The cohort after its upkeep: members whose entity is no longer active are put to rest, those whose entity is are active again, and each portal is
    filled up to `size` as `select_cohort` chooses: entity_id, portal, is_active, added_at. `members`: entity_id, portal, is_active, added_at."""
    e = entities.where("is_active").select(F.col("id").alias("_id"))
    kept = members.join(e, F.col("entity_id") == F.col("_id"), "left").withColumn("is_active", F.col("_id").isNotNull()).drop("_id")
    held = kept.where("is_active").groupBy("portal").agg(F.count(F.lit(1)).alias("_held"))
    free = entities.join(kept.where("is_active").select(F.col("entity_id").alias("_m")), F.col("id") == F.col("_m"), "left_anti").join(held, "portal", "left")
    order = [F.col("has_truth").desc(), F.col("score").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("name"), F.col("id")]
    chosen = first_rows(free.where("is_active"), ["portal"], order, out="_rn", n=size)
    # The rank is needed to stop at the number that is missing.
    from pyspark.sql import Window as W

    chosen = chosen.withColumn("_k", F.row_number().over(W.partitionBy("portal").orderBy(*order))).where(F.col("_k") <= size - F.coalesce("_held", F.lit(0)))
    return kept.unionByName(chosen.select(F.col("id").alias("entity_id"), "portal", F.lit(True).alias("is_active"), F.lit(as_of).alias("added_at")))


def truth_in_force(truth: DataFrame, as_of: datetime, max_age_hours: int = 36) -> DataFrame:
    """The latest snapshot of each entity if it is fresh: entity_id, job_urls, official_job_count, and the evidence it gives: `ground_truth` with URLs,
    `official_count` with a count alone."""
    last = first_rows(truth, ["entity_id"], [F.col("captured_at").desc_nulls_last(), F.col("id").desc()])
    fresh = last.where(F.col("captured_at") >= F.lit(as_of) - F.expr(f"INTERVAL {int(max_age_hours)} HOURS"))
    urls = F.size(F.coalesce("job_urls", F.array().cast("array<string>"))) > 0
    return fresh.select("entity_id", "job_urls", "official_job_count", F.when(urls, "ground_truth").when(F.col("official_job_count").isNotNull(), "official_count").alias("evidence"))
