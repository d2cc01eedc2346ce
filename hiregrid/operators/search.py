"""Search records of jobs and token search over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable
from .frames import column_or_null


def search_text(jobs: DataFrame) -> Column:
    """The phrases of a job that a search should find, joined; missing ones leave no gap."""
    part = lambda c, before="", after="": F.when(F.coalesce(column_or_null(jobs, c).cast("string"), F.lit("")) != "", F.concat(F.lit(before), column_or_null(jobs, c).cast("string"), F.lit(after)))
    flag = lambda c, text: F.when(column_or_null(jobs, c, "boolean"), F.lit(text))
    parts = F.array(part("title"), part("entity_name"), part("department"), part("role_category"), part("location"), part("city"), part("state"), part("country"), flag("is_remote", "remote work from home"), flag("is_overseas", "overseas oconus"), part("source"))
    return F.array_join(F.array_compact(parts), " ")


def search_records(jobs: DataFrame) -> DataFrame:
    """Active jobs with search_text and the distinct tokens of it."""
    return jobs.where("is_active").withColumn("search_text", search_text(jobs)).withColumn("tokens", F.array_distinct(F.filter(F.split(comparable(F.col("search_text")), " "), lambda t: t != "")))


def search_jobs(records: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Records that have every token of the query, newest first; 1 to 100 of them."""
    tokens = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()]
    if not tokens:
        return records.limit(0)
    wanted = F.array(*(F.lit(t) for t in dict.fromkeys(tokens)))
    return records.where(F.size(F.array_except(wanted, F.col("tokens"))) == 0).orderBy(F.col("posted_at").desc_nulls_last(), "id").limit(min(max(limit, 1), 100))
