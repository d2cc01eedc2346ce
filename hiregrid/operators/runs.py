"""Runs of ingestion: which connector reads an entity, what its checks say, where pages lead, states of entities, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fnv1a_base36
from ..functions.text import comparable, contains_phrase
from ..functions.urls import ats_provider, host
from .frames import first_rows
from .states import STATES

# Employers with a reader of their own, and providers that are read through their interface.
SPECIALISED = {"amentum": "amentum_careers", "jibe": "jibeapply", "jazzhr": "jazzhr"}
DIRECT = ("greenhouse", "lever", "smartrecruiters", "bamboohr", "ashby", "recruitee", "workday", "workable", "personio", "usajobs", "neogov")


def dispatch(entities: DataFrame) -> DataFrame:
    """Adds `connector`: a reader for the employer, the provider's interface (it wants a board id), the provider's page, or the career page."""
    provider = F.coalesce(F.nullif(F.lower(F.trim("ats_provider")), F.lit("unknown")), ats_provider(F.col("career_page_url")))
    special = F.lit(None).cast("string")
    for word, name in SPECIALISED.items():
        special = F.when(comparable(F.col("name")).contains(word) | (provider == word), name).otherwise(special)
    return entities.withColumn("connector", F.coalesce(special, F.when(provider.isin(*DIRECT) & F.col("ats_board_id").isNotNull(), provider), F.concat(F.lit("ats:"), provider), F.when(F.col("career_page_url").isNotNull(), "career_page")))


def synthesise_checks(jobs: DataFrame, used: DataFrame, source_class: str) -> DataFrame:
    """A check per entity and source that was used or brought jobs: success with its count, or zero (never a proven one)."""
    counts = jobs.where(F.trim("source") != "").groupBy("entity_id", F.trim("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    asked = used.select("entity_id", F.explode("sources").alias("source")).where(F.trim("source") != "").distinct()
    rows = asked.join(counts, ["entity_id", "source"], "full")
    n = F.coalesce("n", F.lit(0))
    return rows.select("entity_id", "source", F.lit(source_class).alias("source_class"), F.when(n > 0, "success").otherwise("zero").alias("status"), n.alias("jobs_found"), F.lit(False).alias("authoritative_zero"))


def supplemental_status(n_jobs: Column, used: Column, skipped: Column, zero_signal: str) -> Column:
    """The status that a supplemental source's messages (array) and results amount to."""
    low = F.transform(skipped, F.lower)
    is_zero = lambda m: m.contains(zero_signal.lower())
    return (
        F.when(F.exists(low, lambda m: m.contains("key missing")) & (n_jobs == 0), "skipped").when(n_jobs > 0, F.when(F.exists(low, lambda m: ~is_zero(m)), "error").otherwise("success"))
        .when((F.size(low) > 0) & F.forall(low, is_zero), "zero").when(F.size(low) > 0, "error").when(F.size(used) > 0, "zero").otherwise("skipped")
    )


def reconcile_source(jobs: DataFrame, seen: DataFrame, runs: DataFrame, source: str) -> DataFrame:
    """Active jobs of a supplemental source that a clean run no longer had. `runs`: entity_id, used (array), skipped (array)."""
    low = F.transform("skipped", F.lower)
    clean = runs.where(F.array_contains("used", source) & ~F.exists(low, lambda m: m.startswith(f"{source.lower()}:") & ~m.contains("0 open jobs"))).select("entity_id").distinct()
    return jobs.where(F.col("is_active") & (F.col("source") == source)).join(clean, "entity_id", "left_semi").join(seen.select("entity_id", "external_id").distinct(), ["entity_id", "external_id"], "left_anti")


def discovery_allowed(jobs: DataFrame, mode: str = "fallback", minimum: int = 1) -> DataFrame:
    """Entities whose discovery sources may run: always, never, or only if they have fewer authoritative jobs than the minimum."""
    per = jobs.groupBy("entity_id").agg(F.count_if("is_authoritative").alias("authoritative_jobs"))
    if mode not in ("off", "fallback", "always"):
        raise ValueError(f"unknown mode {mode!r}")
    return per.where({"off": F.lit(False), "always": F.lit(True), "fallback": F.col("authoritative_jobs") < minimum}[mode])


def ingest_status(entities: DataFrame, logs: DataFrame) -> DataFrame:
    """The newest log of each entity; `queued` if there is none, or none since the entity was created."""
    last = logs.groupBy("entity_id").agg(F.max_by(F.struct("status", "source", "jobs_found", "jobs_new", "jobs_closed", "error_message", "ran_at"), F.struct("ran_at", "id")).alias("l"))
    rows = entities.join(last, F.col("id") == F.col("entity_id"), "left")
    waiting = F.col("l").isNull() | (F.col("l.ran_at") < F.col("created_at"))
    return rows.select("id", F.when(waiting, "queued").otherwise(F.col("l.status")).alias("status"), "l.source", "l.ran_at", *(F.coalesce(f"l.{c}", F.lit(0)).alias(c) for c in ("jobs_found", "jobs_new", "jobs_closed")), "l.error_message")


def run_summary(results: DataFrame) -> DataFrame:
    """Benchmark results by evidence level: entities, portals, those passed."""
    return results.groupBy("evidence_level").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("portal").alias("portals"), F.count_if("passed").alias("passed"))


def infer_state(entities: DataFrame) -> Column:
    """An entity's state: stated, else named (the longest name first) or coded in its names, else the label of its .gov host."""
    codes = F.array(*(F.lit(c) for c in STATES.values()))
    stated = F.upper(F.trim(F.coalesce("government_state", F.lit(""))))
    by_name = F.element_at(F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair)), F.trim(F.regexp_replace(F.lower(stated), "[^a-z ]+", " ")))
    names = F.filter(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.coalesce(n, F.lit(""))), lambda n: n != "")

    def in_name(n: Column) -> Column:
        text, out = comparable(n), F.lit(None).cast("string")
        for name in sorted(STATES, key=len):
            out = F.when(contains_phrase(text, F.lit(name)), STATES[name]).otherwise(out)
        coded = F.filter(F.regexp_extract_all(F.upper(n), F.lit(r"(?:^|[\s,(\-])([A-Z]{2})(?=$|[\s,)\-])"), F.lit(1)), lambda c: F.array_contains(codes, c))
        return F.coalesce(out, F.get(coded, F.lit(0)))

    named = F.get(F.filter(F.transform(names, in_name), lambda x: x.isNotNull()), F.lit(0))
    gov = F.upper(F.regexp_extract(host(F.col("career_page_url")), r"\.([a-z]{2})\.gov$", 1))
    return F.coalesce(F.when(F.array_contains(codes, stated), stated), by_name, named, F.when(F.array_contains(codes, gov), gov))


def state_directories(entities: DataFrame, entries: DataFrame, portal: str = "counties_and_cities") -> DataFrame:
    """Directory entries of leagues and associations in an entity's state."""
    rows = entities.where(F.col("portal") == portal).withColumn("state_code", infer_state(entities)).where("state_code is not null").select(F.col("id").alias("entity_id"), "state_code")
    kept = entries.where(F.col("is_active") & F.col("entry_type").isin("municipal_league", "county_association"))
    return first_rows(rows.join(kept, "state_code"), ["entity_id", "directory_key", "entry_key"], [F.col("jobs_url")])


def federal_directories(entities: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries one of whose patterns stands in an entity's names. The few federal entries are exploded to patterns and matched by phrase."""
    names = entities.select(F.col("id").alias("entity_id"), comparable(F.concat_ws(" | ", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " | "))).alias("_names"))
    patterns = entries.where("is_active").select("entry_key", "jobs_url", F.explode("match_patterns").alias("_p")).select("entry_key", "jobs_url", comparable(F.col("_p")).alias("_p")).where(F.length("_p") >= 3)
    # Joined on the pattern's first word, so that no pair is formed without a word in common.
    words = names.select("entity_id", "_names", F.explode(F.array_distinct(F.split("_names", " "))).alias("_w"))
    return words.join(patterns.withColumn("_w", F.split_part("_p", F.lit(" "), F.lit(1))), "_w").where(contains_phrase(F.col("_names"), F.col("_p"))).select("entity_id", "entry_key", "jobs_url").distinct()


def seed_sources(entities: DataFrame, directory: DataFrame) -> DataFrame:
    """The source graph's first edges: an entity's own board or page (primary), and its directory entries; keys are hashes."""
    provider = F.coalesce(F.nullif(F.lower(F.trim("ats_provider")), F.lit("unknown")), ats_provider(F.col("career_page_url")))
    e = entities.withColumn("_p", provider).where(F.col("_p").isNotNull() | F.col("career_page_url").isNotNull())
    own = e.select(
        F.col("id").alias("entity_id"), F.when(F.col("_p").isNotNull(), "ats").otherwise("career_page").alias("source_type"), F.lit("authoritative").alias("source_class"), F.coalesce(F.concat(F.lit("ats:"), "_p"), F.concat(F.lit("official-domain:"), host(F.col("career_page_url")))).alias("lineage_root"),
        F.col("career_page_url").alias("source_url"), F.col("_p").alias("ats_provider"), F.col("ats_board_id").alias("board_id"), F.lit(True).alias("is_primary"),
    )
    more = directory.select("entity_id", F.lit("directory").alias("source_type"), F.lit("verified").alias("source_class"), F.concat(F.lit("directory:"), "directory_key").alias("lineage_root"), F.col("jobs_url").alias("source_url"), F.lit(None).cast("string").alias("ats_provider"), F.lit(None).cast("string").alias("board_id"), F.lit(False).alias("is_primary"))
    rows = own.unionByName(more).withColumn("source_key", fnv1a_base36(F.concat_ws("|", "source_type", "lineage_root", "source_url")))
    return first_rows(rows, ["entity_id", "source_key"], [F.col("is_primary").desc()])
