"""Which employer a job belongs to, and which rows are the same job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pick
from ..functions.text import comparable, contains_phrase, strip_legal
from ..functions.urls import same_site
from .frames import column_or_null
from .quality import apply_url, source_key

# How far a source is trusted when rows are merged.
SOURCE_PRIORITY = {
    "greenhouse": 100, "lever": 100, "smartrecruiters": 100, "bamboohr": 100, "ashby": 100, "recruitee": 100, "workday": 100, "workable": 100, "personio": 100, "usajobs": 100,
    "gov:neogov_rss": 99, "nlx": 90, "career_page": 80, "official_sitemap": 82, "board:icma": 72, "board:naco": 72, "board:careersingovernment": 70, "adzuna": 65, "web:langsearch": 45,
}
_PREFIX_PRIORITY = (("ats:", 97), ("portal:", 96), ("gov:", 96), ("scrapy:", 78), ("jobapi:", 55))
DEFAULT_PRIORITY = 50


def source_priority(source: Column) -> Column:
    key = source_key(source)
    by_prefix = F.lit(DEFAULT_PRIORITY)
    for prefix, score in reversed(_PREFIX_PRIORITY):
        by_prefix = F.when(key.startswith(prefix), score).otherwise(by_prefix)
    known = F.create_map(*(F.lit(v) for pair in SOURCE_PRIORITY.items() for v in pair))
    return F.coalesce(F.element_at(known, key), by_prefix)


_TEXT_PATHS = (
    "langsearch_title", "langsearch_snippet", "langsearch_summary", "employer_name", "company_name", "company", "company.display_name", "company.name", "hiring_company",
    "organization", "organization.name", "employer.name", "job_publisher", "normalized_employer", "normalized_apply_url", "url", "job_apply_link", "job_url",
)


def employer_evidence(jobs: DataFrame, entities: DataFrame) -> DataFrame:
    """Jobs (entity_id) joined to their entity (id, name, aliases, career_page_url, ats_board_id), with `evidence`: null if nothing ties them.

    In order: a verified node of the source graph, the career site, the board's id in the URL, the entity's names in the row's texts.
    """
    raw = column_or_null(jobs, "raw_data")
    own = jobs.withColumn("_url", apply_url(jobs)).withColumn("_text", comparable(F.concat_ws(" ", *(column_or_null(jobs, c) for c in ("title", "department")), *(F.get_json_object(raw, f"$.{p}") for p in _TEXT_PATHS))))
    e = entities.select(F.col("id").alias("_entity"), F.col("name").alias("_name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")).alias("_aliases"), F.col("career_page_url").alias("_career"), comparable(F.col("ats_board_id")).alias("_board"))
    both = own.join(e, own["entity_id"] == F.col("_entity"))
    raw_col = F.col("raw_data") if "raw_data" in jobs.columns else F.lit(None).cast("string")
    verified = (F.get_json_object(raw_col, "$.source_graph_verified_for_entity") == "true") & ~F.coalesce(F.get_json_object(raw_col, "$.source_graph_shared_inventory") == "true", F.lit(False))
    url_text = comparable(F.regexp_replace(F.col("_url"), r"^https?://", ""))

    def named(name: Column) -> Column:
        full, text = comparable(name), F.col("_text")
        bare = strip_legal(full)
        return ((F.length(full) >= 3) & contains_phrase(text, full)) | ((F.length(bare) >= 4) & (bare != full) & contains_phrase(text, bare))

    names = F.filter(F.transform(F.concat(F.array("_name"), F.col("_aliases")), lambda n: F.trim(F.coalesce(n, F.lit("")))), lambda n: n != "")
    match = F.get(F.filter(names, named), F.lit(0))
    evidence = (
        F.when(verified, "verified-source-graph-node")
        .when(same_site(F.col("_url"), F.col("_career")), "career-domain")
        .when((F.length("_board") >= 3) & contains_phrase(url_text, F.col("_board")), "ats-board-id")
        .when(match.isNotNull(), F.concat(F.lit("employer-name:"), match))
    )
    return both.withColumn("evidence", evidence).drop("_url", "_text", "_entity", "_name", "_aliases", "_career", "_board")


def in_scope(source: Column, scope: str) -> Column:
    """Sources that an evidence filter applies to: web, job_api, adzuna or all."""
    key = source_key(source)
    return {"web": key == "web:langsearch", "job_api": key.startswith("jobapi:"), "adzuna": key == "adzuna", "all": F.lit(True)}[scope]


def filter_by_evidence(jobs: DataFrame, entities: DataFrame, scope: str = "all") -> DataFrame:
    """Jobs outside the scope, and those in it with evidence."""
    return employer_evidence(jobs, entities).where(~in_scope(F.col("source"), scope) | F.col("evidence").isNotNull())


#: Fields that skip blank values when rows merge, and those that skip only nulls.
_NON_BLANK = ("department", "location", "city", "state", "country", "posted_at")
_NON_NULL = ("lat", "lng")


def dedupe_jobs(jobs: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """One row per identity (canonical URL, else source and external id, else the row itself), merged in arrival order `_seq`.

    A row takes precedence over those before it only with a strictly greater source priority; so the order is: strict record setters,
    latest first, then all others as they arrived. The first row gives title, external_id, source and the flags; other fields
    come from the first row that has them. Adds duplicate_sources, duplicate_lineages, n_rows.
    """
    key = list(keys)
    external = F.lower(F.trim(F.coalesce(jobs["external_id"].cast("string"), F.lit(""))))
    rows = jobs.withColumn("normalized_apply_url", apply_url(jobs)).withColumn("_score", source_priority(jobs["source"]))
    identity = (
        F.when(F.col("normalized_apply_url").isNotNull(), F.concat(F.lit("url:"), F.lower("normalized_apply_url")))
        .when((source_key(F.col("source")) != "") & (external != ""), F.concat(F.lit("source:"), source_key(F.col("source")), F.lit(":"), external))
        .otherwise(F.concat(F.lit("row:"), F.col("_seq").cast("string")))
    )
    raw = pick(F.col("raw_data"), "source_graph_lineage") if "raw_data" in jobs.columns else F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.withColumns({"identity": identity, "_source": filled(F.col("source")), "_lineage": filled(raw)})
    fields = [c for c in jobs.columns if c not in (*key, "_seq", "normalized_apply_url")] + ["normalized_apply_url"]

    def usable(c: str) -> Column:
        if c in _NON_BLANK:
            return F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        return F.col(c).isNotNull() if c in (*_NON_NULL, "normalized_apply_url") else F.lit(True)

    # First per identity, priority, source and lineage, combined before the shuffle: each field's first usable value. So however many rows
    # an identity has, it goes on as one row for each of its few sources.
    firsts = rows.groupBy(*key, "identity", "_score", "_source", "_lineage").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_seq"), *(F.min_by(F.struct("_seq", F.col(c).alias("v")), F.when(usable(c), F.col("_seq"))).alias(f"_{i}") for i, c in enumerate(fields)))
    group = firsts.groupBy(*key, "identity").agg(F.sum("_n").alias("n_rows"), F.min("_seq").alias("_seq"), F.collect_list(F.struct("_score", "_seq", "_source", "_lineage", *(f"_{i}" for i in range(len(fields))))).alias("_g"))
    # A row sets a record if no earlier one has as high a priority; only the first of a priority can.
    setters = F.transform(F.filter("_g", lambda x: ~F.exists("_g", lambda y: (y["_score"] >= x["_score"]) & (y["_seq"] < x["_seq"]))), lambda x: x["_seq"])
    group = group.withColumn("_setters", setters)

    def chosen(i: int) -> Column:
        """The value of least rank: of record setters the latest, of all others the first."""
        held = F.filter(F.transform("_g", lambda x: x[f"_{i}"]), lambda x: x.isNotNull())
        ranked = F.transform(held, lambda x: F.struct(F.when(F.array_contains("_setters", x["_seq"]), -x["_seq"]).otherwise(F.lit(1 << 52) + x["_seq"]).alias("rank"), x["v"].alias("v")))
        return F.aggregate(ranked, F.lit(None).cast(firsts.select(F.struct(F.lit(0).cast("long").alias("rank"), F.col(f"_{i}.v").alias("v")).alias("s")).schema["s"].dataType), lambda a, x: F.when(a.isNull() | (x["rank"] < a["rank"]), x).otherwise(a))["v"]

    in_order = lambda c: F.array_distinct(F.transform(F.array_sort(F.transform(F.filter("_g", lambda x: x[c].isNotNull()), lambda x: F.struct(x["_seq"], x[c].alias("v")))), lambda x: x["v"]))
    return group.select(
        *key, "identity", *(chosen(i).alias(c) for i, c in enumerate(fields)), in_order("_lineage").alias("duplicate_lineages"), "n_rows", "_seq", F.when(F.col("n_rows") > 1, in_order("_source")).alias("duplicate_sources"),
    )
