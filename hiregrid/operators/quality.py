"""Credibility of job rows: reasons for rejection, strong detail URLs, navigation titles, authoritative rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import first_apply_url
from .frames import column_or_null

# Sources by what their rows prove.
STRUCTURED_SOURCES = ("greenhouse", "lever", "smartrecruiters", "bamboohr", "ashby", "recruitee", "workday", "workable", "personio", "usajobs", "official_sitemap", "jazzhr", "jibeapply", "amentum_careers")
LEGACY_WEAK_SOURCES = ("serper", "linkedin", "monster", "talent", "simplyhired", "indeed", "glassdoor", "ziprecruiter")

# Titles that are navigation, not jobs.
GENERIC_TITLES = [
    r"^(?:careers?|jobs?|job search|search jobs|find jobs|current openings?|open positions?|job openings?)$",
    r"^(?:see|view|browse|explore)\s+(?:all\s+)?(?:jobs?|openings?|opportunities|positions)$",
    r"^(?:see|view)\s+all\s+opportunities$",
    r"^(?:join (?:our|the) team|join our talent community|talent community)$",
    r"^(?:learn more|click here to learn more|click to learn more|load more|show more)$",
    r"^(?:go|back|return)(?:\s+back)?\s+to\s+(?:our\s+|the\s+)?(?:career|careers|job|jobs)(?:\s+(?:portal|page|site))?$",
    r"^(?:career|careers|job|jobs)\s+(?:portal|page|site)$",
    r"^(?:about|about us|services|experience|veterans|early careers?|career paths?|our military commitment)$",
    r"^(?:labor law posters?|privacy|terms|cookie policy|skip to content|sign in|login)$",
    r"^(?:top searches|by location|by category|categories|locations)$",
    r"^(?:part[- ]time|student|work from home|remote jobs?)$",
    r"^careers?\s*[-–—|:]\s*.+$",
    r"^.+\s*[-–—|:]\s*careers?$",
    r"^.+\s+jobs?\s*(?:&|and)\s*careers?(?:\s+profile)?$",
    r"^.+\s+inc\.?\s*:\s*jobs?$",
    r"^\d+\s+.+\s+jobs?\s+(?:hiring|available|openings?)\s+in\b",
    r"^\$?\d+[^ ]*\s*[-–—]\s*\$?\d+[^ ]*\/hr\s+.+\s+jobs?\b",
    r"^.+\s+jobs?\s+in\s+[^,]+(?:,\s*[A-Z]{2})?$",
]

# Shapes of URLs that show one job.
DETAIL_URLS = [
    r"/why-gov2x/jobs/\d{3,}(?:$|[/?#])",
    r"amentumcareers\.com/jobs/(?!search(?:[/?#]|$))[^/?#]{5,}",
    r"applytojob\.com/apply/jobs/details/[A-Za-z0-9_-]{4,}",
    r"applytojob\.com/apply/[A-Za-z0-9_-]{4,}(?:/[^/?#]+)?",
    r"(?:boards|job-boards)\.greenhouse\.io/[^/]+/jobs/\d+",
    r"jobs\.lever\.co/[^/]+/[^/?#]+",
    r"jobs\.ashbyhq\.com/[^/]+/[^/?#]+",
    r"recruitee\.com/o/[^/?#]+",
    r"(?:myworkdayjobs|myworkdaysite|workdayjobs)\.com/.+/job/",
    r"smartrecruiters\.com/[^/]+/\d+",
    r"bamboohr\.com/careers/\d+",
    r"icims\.com/jobs/\d+",
    r"taleo\.net/.+(?:jobdetail|requisition)",
    r"jobvite\.com/.+(?:job|position)",
    r"usajobs\.gov/job/\d+",
    r"governmentjobs\.com/careers/[^/]+/jobs/\d+",
    r"apply\.workable\.com/[^/]+/j/[A-Za-z0-9]+",
    r"jobs\.personio\.(?:com|de)/.+/job/\d+",
    r"linkedin\.com/jobs/view/\d+",
    r"indeed\.com/viewjob",
    r"/jobs?/(?!search(?:/|$)|categories(?:/|$)|locations(?:/|$))[^/?#]{4,}",
    r"(?:jobid|job_id|gh_jid|requisitionid|reqid|postingid|jk)=",
]
# Paths of listings.
_LISTING_PATHS = [
    r"^/(?:careers?|jobs?|employment|join-us|join-our-team|work-with-us|apply|jobs/search)$",
    r"/(?:jobs?|careers?)/(?:search|categories|locations|saved|alerts?|favorites?)$",
]

#: Where a row's apply URL may stand, in order.
URL_COLUMNS = ("normalized_apply_url", "apply_url", "applyUrl", "url", "job_url", "job_apply_link")
URL_PATHS = ("normalized_apply_url", "absolute_url", "hostedUrl", "applyUrl", "apply_url", "url", "jobUrl", "job_url", "job_apply_link", "PositionURI", "positionURI", "canonicalPositionUrl", "ref")


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))


def source_key(source: Column) -> Column:
    return F.lower(F.trim(F.coalesce(source, F.lit(""))))


def _any_match(text: Column, patterns: list[str]) -> Column:
    """Two expressions at most: those bound to the text's beginning, and the others."""
    bound, free = [p[1:] for p in patterns if p.startswith("^")], [p for p in patterns if not p.startswith("^")]
    tests = [text.rlike(f"(?i){edge}(?:{'|'.join(f'(?:{p})' for p in some)})") for edge, some in (("^", bound), ("", free)) if some]
    return reduce(lambda a, b: a | b, tests)


def is_generic_title(title: Column) -> Column:
    """Navigation or listing text; an empty title counts."""
    title = clean_title(title)
    return (title == "") | _any_match(title, GENERIC_TITLES)


def is_markup(title: Column) -> Column:
    # Marks of style sheets and scripts.
    return title.rlike(r"(?i)[{}<>]|(?:^|\s)\.[a-z0-9_-]+\s*\{|display\s*:\s*(?:inline|block)|vertical-align\s*:") | title.rlike(r"(?i)^(?:css|style|script)\b")


def is_detail_url(url: Column) -> Column:
    """The URL of one job: not a listing path, and of a known shape."""
    host = F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1)
    path = F.regexp_replace(F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    target = F.lower(F.concat(host, path, query))
    return F.coalesce((host != "") & ~_any_match(path, _LISTING_PATHS) & _any_match(target, DETAIL_URLS), F.lit(False))


def apply_url(jobs: DataFrame) -> Column:
    """The first valid URL among the columns that `jobs` has and the keys of its raw_data, in canonical form."""
    raw = column_or_null(jobs, "raw_data")
    return first_apply_url([*(jobs[c] for c in URL_COLUMNS if c in jobs.columns), *(F.get_json_object(raw, f"$.{p}") for p in URL_PATHS)])


def structured_parser(raw: Column) -> Column:
    parser = F.lower(F.coalesce(F.get_json_object(raw, "$.parser"), F.lit("")))
    return parser.contains("json_ld") | parser.contains("jsonld") | parser.contains("structured")


def assess_quality(jobs: DataFrame) -> DataFrame:
    """Adds quality_ok, quality_reason, quality_url, strong_detail_url, is_authoritative to rows with title, source and raw_data (JSON text)."""
    raw = column_or_null(jobs, "raw_data")
    title, source = clean_title(jobs["title"]), source_key(jobs["source"])
    url = apply_url(jobs)
    jobs = jobs.withColumn("quality_url", url)
    strong = is_detail_url(F.col("quality_url"))
    listed = source.isin(*STRUCTURED_SOURCES) | source.startswith("portal:") | source.startswith("gov:")
    evidence = structured_parser(raw) | (F.coalesce(F.get_json_object(raw, "$.normalized_employer_source"), F.lit("")) != "") | listed
    reason = (
        F.when(title == "", "missing title")
        .when((F.length(title) < 3) | (F.length(title) > 180), "implausible title length")
        .when(is_markup(title), "markup/css text")
        .when(is_generic_title(title), "generic/navigation title")
        .when(((source == "career_page") | source.startswith("ats:")) & ~evidence & ~strong, "career-page row lacks job-detail evidence")
        .when(source.isin(*LEGACY_WEAK_SOURCES) & ~strong, "legacy discovery row lacks a direct job-detail URL")
        .when((source.startswith("web:") | source.startswith("jobapi:")) & ~strong, "discovery row lacks a direct job-detail URL")
    )
    jobs = jobs.withColumn("strong_detail_url", strong).withColumn("quality_reason", reason).withColumn("quality_ok", F.col("quality_reason").isNull())
    verified = (F.get_json_object(raw, "$.source_graph_class") == "authoritative") & (F.get_json_object(raw, "$.source_graph_verified_for_entity") == "true")
    own = ((source == "career_page") | source.startswith("ats:")) & (F.col("strong_detail_url") | structured_parser(raw))
    return jobs.withColumn("is_authoritative", F.col("quality_ok") & (F.coalesce(verified, F.lit(False)) | listed | own))
