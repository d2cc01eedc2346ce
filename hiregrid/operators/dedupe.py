"""First-wins, last-wins, best-of and lineage dedupe, and the order-dependent fold of source checks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .frames import checkpointed, first_rows


def first_wins(df: DataFrame, keys: list[str], seq: str = "_seq") -> DataFrame:
    """The first row of each key to arrive."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def last_wins(df: DataFrame, keys: list[str], seq: str = "_seq") -> DataFrame:
    """The last row of each key to arrive, with the place of the first."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r"), F.min(seq).alias(seq)).select(*keys, "_r.*", seq)


def best_of(df: DataFrame, keys: list[str], score: Column, seq: str = "_seq") -> DataFrame:
    """The row with the highest score; the earlier of equals."""
    rest = [c for c in df.columns if c not in keys]
    return df.withColumn("_score", score).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_score", -F.col(seq))).alias("_r")).select(*keys, "_r.*")


def evidence_score(url: Column, lat: Column, lng: Column, posted_at: Column, updated_at: Column) -> Column:
    """4 for a URL, 2 for a point, 1 for a date, and the time of update as a tie-break."""
    return F.when(url.isNotNull(), 4).otherwise(0) + F.when(lat.isNotNull() & lng.isNotNull(), 2).otherwise(0) + F.when(posted_at.isNotNull(), 1).otherwise(0) + F.coalesce(F.unix_millis(updated_at), F.lit(0)) / F.lit(1e15)


def duplicate_urls(jobs: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """The rows of each URL but the best one: the newest update, of equals the oldest creation, then the least id. Rows without URL aren't compared.

    The best is combined before the shuffle, so a URL that very many rows share is one row of the join.
    """
    rows = jobs.where(F.col(url).isNotNull())
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0))
    order = F.struct(F.col("updated_at").isNull(), -micros("updated_at"), F.col("created_at").isNull(), micros("created_at"), "id")
    best = rows.groupBy(*keys, url).agg(F.min_by("id", order).alias("_best"))
    return rows.join(best, [*keys, url]).where(F.col("id") != F.col("_best")).drop("_best")


def supplemental_duplicates(jobs: DataFrame, supplemental: list[str], url: str = "url") -> DataFrame:
    """Rows of supplemental sources (best first) whose URL another, better source of the entity also has."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in supplemental)), F.col("source")), F.lit(0))
    ranked = jobs.where(F.col(url).isNotNull()).withColumn("_rank", rank)
    best = ranked.groupBy("entity_id", url).agg(F.min("_rank").alias("_best"))
    return ranked.join(best, ["entity_id", url]).where(F.col("_rank") > F.col("_best")).drop("_rank", "_best")


def lineage_reliability(lineage: Column, source: Column) -> Column:
    """Mirrors of one index share a root: exact names and the `nlx-mirror:` prefix."""
    x = F.lower(F.trim(F.coalesce(F.nullif(F.trim(lineage), F.lit("")), source)))
    return F.when((x == "careeronestop") | x.startswith("nlx-mirror:") | (x == "careeronestop:nlx_mirror"), "nlx").otherwise(x)


def lineage_coverage(lineage: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(lineage, F.lit(""))))
    return F.when((x == "careeronestop") | x.startswith("nlx-mirror:"), "nlx").otherwise(x)


def lineage_baseline(lineage: Column, source: Column) -> Column:
    x = F.lower(F.coalesce(F.nullif(lineage, F.lit("")), source))
    return F.when((x == "careeronestop") | x.contains("nlx_mirror"), "nlx").otherwise(x)


# Hosted boards whose lineage is their provider.
ATS_SOURCES = ("greenhouse", "lever", "workday", "smartrecruiters", "bamboohr", "ashby", "recruitee", "workable", "personio")


def lineage_for_source(source: Column) -> Column:
    """The lineage that a source has by default; null for a blank one."""
    x = F.nullif(F.lower(F.trim(source)), F.lit(""))
    return F.when(x == "gov:neogov_rss", "neogov").when(x.isin(*ATS_SOURCES), F.concat(F.lit("ats:"), x)).otherwise(x)


def collapse_lineages(checks: DataFrame, keys: list[str], lineage: Column, seq: str = "_seq") -> DataFrame:
    """One check per lineage: the one with most jobs, the earlier of equals. Blank lineages go."""
    rows = checks.withColumn("lineage", lineage).where(F.coalesce("lineage", F.lit("")) != "")
    return first_rows(rows, [*keys, "lineage"], [F.greatest(F.coalesce("jobs_found", F.lit(0)), F.lit(0)).desc(), F.col(seq)])


STATUS_RANK = {"success": 4, "zero": 3, "error": 2}


def _ends(ranks: list[int], jobs: list[int | None]) -> tuple[list[int], list[tuple[str, int | None, int, int]]]:
    """What a run of checks does to whichever check is kept before it: (kind, number, place, end) for "start" (nothing was kept), "rank" (the first
    check that ranks above the number) and "jobs" (the first with more jobs than any number below this one); the end is the check kept at last.
    """
    n = len(ranks)
    end, above, larger = [0] * n, {1: n, 2: n, 3: n}, []
    for i in range(n - 1, -1, -1):
        found = jobs[i]
        while larger and found is not None and jobs[larger[-1]] <= found:
            larger.pop()
        after = min(above.get(ranks[i], n), larger[-1] if larger and found is not None else n)
        end[i] = end[after] if after < n else i
        for r in range(1, ranks[i]):
            above[r] = i
        if found is not None:
            larger.append(i)
    out: list[tuple[str, int | None, int, int]] = [("start", None, 0, end[0])]
    out += [("rank", r, i, end[i]) for r, i in above.items() if i < n]
    # What is left on the stack are the records; those with one end and the same ranks behind them are one step.
    steps: dict[tuple, tuple] = {}
    for i in reversed(larger):
        key = (end[i], sum(k < i for k in above.values()))
        steps[key] = ("jobs", jobs[i], steps[key][2] if key in steps else i, end[i])
    return end, out + list(steps.values())


def fold_checks(checks: DataFrame, keys: tuple[str, ...] = ("entity_id", "source"), seq: str = "_seq") -> DataFrame:
    """The check kept per key when each later one replaces it if its status ranks higher or it found more jobs.

    That relation isn't an order, so the result depends on arrival. But a run of checks can be summed up: the check that is kept before it matters
    only by its rank and its jobs, so the run's effect is a check for each rank and for each step of jobs, a handful whatever its length. The
    checks are dealt out by ranges of key and place, so one key goes through many tasks; runs of a key that reach the edge of a batch are summed
    up, and their sums are applied in order. Other keys are whole in their batch. Ties of `seq` are in any order.
    """
    rest = [c for c in checks.columns if c not in (*keys, seq)]
    rows = checks.select(*keys, seq, *rest)
    names, arrow = rows.columns, to_arrow_schema(rows.schema)
    sums = T.StructType([*rows.schema, T.StructField("_part", rows.schema[seq].dataType), T.StructField("_run", T.LongType()), T.StructField("_kind", T.StringType()), T.StructField("_number", T.LongType()), T.StructField("_at", T.LongType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, batch in enumerate(batches, TaskContext.get().partitionId() << 32):
            if not batch.num_rows:
                continue
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            ranks, found = [STATUS_RANK.get(x, 1) for x in batch.column("status").to_pylist()], batch.column("jobs_found").to_pylist()
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            take, part, kind, number, place = [], [], [], [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                end, effect = _ends(ranks[a:b], found[a:b])
                for k, x, at, last in effect if a == 0 or b == len(own) else [("whole", None, 0, end[0])]:
                    take.append(a + last), part.append(a), kind.append(k), number.append(x), place.append(at)
            columns = [*batch.take(pa.array(take, pa.int64())).columns, batch.column(seq).take(pa.array(part, pa.int64())), pa.array([run] * len(take), pa.int64()), pa.array(kind), pa.array(number, pa.int64()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=sums.names)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, done = None, None, []
        for (own, _), run in groupby((r for batch in batches for r in batch.to_pylist()), lambda r: (tuple(r[k] for k in keys), r["_run"])):
            effect = list(run)
            if own != key and kept:
                done.append(kept)
            if own != key:
                key, kept = own, next(r for r in effect if r["_kind"] == "start")
            else:
                rank, jobs = STATUS_RANK.get(kept["status"], 1), kept["jobs_found"]
                hits = [r for r in effect if (r["_kind"] == "rank" and r["_number"] == rank) or (r["_kind"] == "jobs" and jobs is not None and r["_number"] > jobs)]
                kept = min(hits, key=lambda r: r["_at"], default=kept)
            if len(done) >= 1024:
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in done], schema=arrow)
                done = []
        if kept:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in [*done, kept]], schema=arrow)

    found = checkpointed(rows.repartitionByRange(*keys, seq).sortWithinPartitions(*keys, seq).mapInArrow(summed, sums))
    edges = found.where("_kind <> 'whole'").repartition(*keys).sortWithinPartitions(*keys, "_part", "_run", "_at")
    return found.where("_kind = 'whole'").select(*names).unionByName(edges.mapInArrow(applied, rows.schema))


def collapse_graph_sources(sources: DataFrame) -> DataFrame:
    """One source per entity and lineage, none shared: primary counts 10, verified 4, a board 2, a URL 1."""
    score = F.when(F.col("is_primary"), 10).otherwise(0) + F.when(F.col("is_verified"), 4).otherwise(0) + F.when(F.col("board_id").isNotNull(), 2).otherwise(0) + F.when(F.col("source_url").isNotNull(), 1).otherwise(0)
    rows = sources.where(~F.coalesce("is_shared", F.lit(False))).withColumn("_score", score)
    return first_rows(rows, ["entity_id", "lineage_root"], [F.col("_score").desc(), F.col("source_key")]).drop("_score")
