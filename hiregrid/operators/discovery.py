"""Where an entity's jobs may be found: names it goes by, boards that may be its own, pages that search found, associations' job pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..functions.text import comparable, contains_phrase, words
from ..functions.urls import host
from ..functions.values import once
from .frames import computed, first_rows
from .registry import LOCAL


def _one_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def company_aliases(name: Column) -> Column:
    """The name without legal forms, if that is another."""
    bare = _one_space(F.regexp_replace(name, r"(?i)(?<![A-Za-z0-9_])(?:inc\.?|llc|ltd\.?|corp\.?|corporation|company|co\.?|plc|holdings?|group)(?![A-Za-z0-9_])", ""))
    return F.filter(F.array(bare), lambda a: (a != "") & (F.lower(a) != F.lower(name)))


def government_aliases(name: Column, portal: Column) -> Column:
    """The name without `State of` and the like, and, of a local government, without its kind behind it."""
    whole = _one_space(name)
    bare = F.trim(F.regexp_replace(whole, r"(?i)^(?:the\s+)?(?:state|city|county)\s+of\s+", ""))
    short = F.when(portal == LOCAL, F.trim(F.regexp_replace(bare, r"(?i)\s+(?:county|city)$", "")))
    return F.array_distinct(F.filter(F.array_compact(F.array(bare, short)), lambda a: (a != "") & (F.lower(a) != F.lower(whole))))


def board_slugs(name: Column, portal: Column) -> Column:
    """At most six ids that a government's board may have: the name run together without and with its kind, and, of a local one, with county and city."""
    raw = comparable(name)
    bare = raw
    for pattern in ("^state of ", "^city of ", "^county of ", " county$", " city$", " department$"):
        bare = F.regexp_replace(bare, pattern, "")
    joined = lambda x: F.regexp_replace(x, "[^a-z0-9]+", "")
    local = (portal == LOCAL) & (bare != "")
    found = F.array_compact(F.array(joined(bare), joined(raw), F.when(local, F.concat(joined(bare), F.lit("county"))), F.when(local, F.concat(joined(bare), F.lit("city")))))
    return F.slice(F.filter(F.array_distinct(found), lambda x: F.length(x).between(3, 60)), 1, 6)


def name_evidence(name: Column, text: Column) -> Column:
    """0 to 70: the whole name in a comparable text, its core, or up to 55 by its longer words."""

    def known(whole: Column, text: Column) -> Column:
        core = F.regexp_replace(whole, "^(?:the )?(?:state|city|county) of ", "")
        core = _one_space(F.regexp_replace(F.regexp_replace(core, words("department|dept|agency|office|commission"), " "), words("of|the|for|and"), " "))
        return once(core, lambda c: once(F.filter(F.split(c, " "), lambda t: F.length(t) >= 4), lambda telling: scored(whole, text, c, telling)))

    def scored(whole: Column, text: Column, core: Column, telling: Column) -> Column:
        shared = F.size(F.filter(telling, lambda t: contains_phrase(text, t)))
        return F.when((whole == "") | (text == ""), 0).when(contains_phrase(text, whole), 70).when((F.length(core) >= 4) & contains_phrase(text, core), 60).when(F.size(telling) == 0, 0).otherwise(round_half_up(shared / F.size(telling) * 55)).cast("int")

    return once(comparable(name), lambda whole: once(text, lambda t: known(whole, t)))


def government_page_score(entity: Column, url: Column, name: Column, snippet: Column, summary: Column) -> Column:
    """How sure a search result is the government's own page of jobs: its name's evidence (40 at least) and the kind of host, at most 100; else null."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    evidence = name_evidence(entity, comparable(F.concat_ws(" ", blank(name), blank(snippet), blank(summary), url)))
    return once(evidence, lambda e: once(F.struct(F.lower(host(url)).alias("site"), F.lower(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)).alias("path")), lambda at: _page_score(e, at["site"], at["path"], blank(name), blank(snippet))))


def _page_score(evidence: Column, site: Column, path: Column, name: Column, snippet: Column) -> Column:
    board = site.rlike(r"(^|\.)governmentjobs\.com$") & path.rlike("^/careers/[^/]+")
    gov, hosted = site.endswith(".gov"), site.rlike("workday|icims|taleo|oraclecloud|jobvite|governmentjobs|neogov|dayforce|ultipro|ukg|adp|paylocity|applicantpro")
    career = F.concat_ws(" ", path, name).rlike("(?i)career|jobs?|employment|opportunit|recruit")
    score = evidence + F.when(board, 30).when(gov, 24).otherwise(20) + F.when(F.concat_ws(" ", name, snippet).rlike("(?i)job opportunities|careers|employment|open positions"), 8).otherwise(0)
    return F.when((evidence >= 40) & (board | ((gov | hosted) & career)), F.least(score, F.lit(100)))


def best_government_pages(results: DataFrame, minimum: int = 75) -> DataFrame:
    """The best scored page of each entity, if it scores enough. `results`: entity_id, entity_name, url, name, snippet, summary."""
    rows = computed(results, score=government_page_score(F.col("entity_name"), F.col("url"), F.col("name"), F.col("snippet"), F.col("summary"))).where(F.col("score") >= minimum)
    return first_rows(rows, ["entity_id"], [F.col("score").desc(), F.col("url")]).select("entity_id", "url", "score")


# Hosts of hosted boards, words of job pages and of pages that are none.
_HOSTED = r"governmentjobs\.com/careers/|myworkdayjobs\.com|workdayjobs\.com|icims\.com|taleo\.net|oraclecloud\.com|jobvite\.com|smartrecruiters\.com|greenhouse\.io|lever\.co|applytojob\.com|dayforcehcm\.com|workable\.com|personio\."
_JOB_WORDS = "career center|job board|job opportunities|job openings|careers|employment|current openings|vacancies"
_JOB_PATHS = r"/jobs?(?![A-Za-z0-9_])|/careers?(?![A-Za-z0-9_])|/employment(?![A-Za-z0-9_])|/career-center(?![A-Za-z0-9_])|/job-board(?![A-Za-z0-9_])"
_OTHER_WORDS = "member jobs|classifieds|rfp|vendor|conference|event"


def association_link_score(url: Column, text: Column, home: Column) -> Column:
    """How much a link of an association's home page looks like its job board."""
    target = F.lower(F.concat_ws(" ", url, F.coalesce(text, F.lit(""))))
    bare = lambda x: F.regexp_replace(F.lower(host(x)), r"^www\.", "")
    return (
        F.when(target.rlike(_HOSTED), 90).otherwise(0) + F.when(target.rlike(_JOB_WORDS), 55).otherwise(0) + F.when(url.rlike(f"(?i){_JOB_PATHS}"), 25).otherwise(0)
        + F.when(bare(url) == bare(home), 10).otherwise(0) - F.when(target.rlike(_OTHER_WORDS), 25).otherwise(0)
    )


def associations_due(entries: DataFrame, as_of: datetime, stale_days: int = 30) -> DataFrame:
    """Active leagues and associations with a page of their own that were never checked, or not for `stale_days`."""
    due = F.col("checked_at").isNull() | (F.col("checked_at") < F.lit(as_of) - F.expr(f"INTERVAL {int(stale_days)} DAYS"))
    return entries.where(F.col("is_active") & F.col("entry_type").isin("municipal_league", "county_association") & F.col("source_url").isNotNull() & due)


def discovery_due(entities: DataFrame, markers: DataFrame, as_of: datetime, stale_days: int = 14) -> DataFrame:
    """Entities whose discovery left no marker, or one older than `stale_days`. `markers`: entity_id, discovered_at."""
    fresh = markers.where(F.col("discovered_at") >= F.lit(as_of) - F.expr(f"INTERVAL {int(stale_days)} DAYS")).select(F.col("entity_id").alias("_e")).distinct()
    return entities.join(fresh, F.col("id") == F.col("_e"), "left_anti")


def annotate_graph(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs with what the source graph knows of the source that brought them, as JSON fields beside those of raw_data: key, lineage, class, whether it is
    verified for the entity, shared, and whether the employer has to be verified. `sources`: source_key, lineage_root, source_class, is_verified, is_shared."""
    from ..functions.numbers import merge_json

    s = sources.select(F.col("source_key").alias("_k"), "lineage_root", "source_class", F.coalesce("is_verified", F.lit(False)).alias("_v"), F.coalesce("is_shared", F.lit(False)).alias("_s"))
    rows = jobs.join(s, F.col("source_key") == F.col("_k"), "left")
    needs = F.col("_s") | ~F.col("_v")
    own = F.struct(
        F.col("_k").alias("source_graph_key"), F.coalesce("lineage_root", "_k").alias("source_graph_lineage"), F.coalesce("source_class", F.lit("authoritative")).alias("source_graph_class"), (F.col("_v") | (F.col("source_class") == "authoritative") | needs).alias("source_graph_verified_for_entity"),
        F.col("_s").alias("source_graph_shared_inventory"), needs.alias("source_graph_required_employer_verification"),
    )
    return rows.withColumn("raw_data", F.when(F.col("_k").isNotNull(), merge_json(F.col("raw_data"), F.to_json(own))).otherwise(F.col("raw_data"))).select(*jobs.columns)


# --- employers that a paid index watches -------------------------------------------------------------------------------


def watched_employers(assignments: DataFrame) -> DataFrame:
    """Assignments of employers to key slots, each employer once a slot, the first to come: name, slot, portal, _seq. Rows that lack one go."""
    rows = assignments.where((F.trim("name") != "") & F.col("slot").isNotNull() & F.col("portal").isNotNull()).withColumn("_key", comparable(F.col("name")))
    return first_rows(rows, ["slot", "_key"], [F.col("_seq")]).drop("_key")


def sync_watched(assignments: DataFrame, entities: DataFrame) -> DataFrame:
    """What the registry of watched employers changes in the entities: per employer (once, whatever its slots) its entity and the action, insert, reactivate or none."""
    rows = watched_employers(assignments).withColumn("_key", comparable(F.col("name")))
    one = first_rows(rows, ["_key"], [F.col("_seq")]).drop("_key")
    from .registry import match_aliases

    found = match_aliases(one, entities)
    state = entities.select(F.col("id").alias("_id"), F.col("is_active").alias("_active"))
    found = found.join(state, F.col("entity_id") == F.col("_id"), "left")
    return found.select("name", "slot", "portal", "entity_id", F.when(F.col("entity_id").isNull(), "insert").when(~F.col("_active"), "reactivate").otherwise("none").alias("action"))
