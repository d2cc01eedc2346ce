"""State: upserts with a policy per column, retirement of jobs, incidents, history, retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import merge_json
from .dedupe import duplicate_urls
from .frames import all_of

#: What a column becomes where a key is on both sides: the new value; the new one if it isn't null; the old one if it isn't null;
#: either flag; both JSON objects merged; or the old value where it says `authoritative`.
POLICIES = {
    "new": lambda old, new: new,
    "fill": lambda old, new: F.coalesce(new, old),
    "keep": lambda old, new: F.coalesce(old, new),
    "or": lambda old, new: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "json": merge_json,
    "sticky": lambda old, new: F.when(old == "authoritative", old).otherwise(new),
}


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], policies: dict[str, str] | None = None, default: str = "new") -> DataFrame:
    """The target after the updates (one per key), with `_is_new` and `_changed`. Columns that updates lack stay."""
    policies = policies or {}
    old, new = target.withColumn("_old", F.lit(True)).alias("o"), updates.withColumn("_new", F.lit(True)).alias("n")
    on = all_of([F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    both = F.col("_old") & F.col("_new")

    def column(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        if c not in updates.columns:
            return F.col(f"o.{c}")
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(both, POLICIES[policies.get(c, default)](a, b)).when(F.col("_new"), b).otherwise(a)

    return old.join(new, on, "full").select(*(column(c).alias(c) for c in target.columns), F.col("_old").isNull().alias("_is_new"), F.col("_new").isNotNull().alias("_changed"))


def upsert_jobs(jobs: DataFrame, items: DataFrame, as_of: datetime) -> DataFrame:
    """Jobs by entity, external id and source: all columns overwritten, but a known date of publication stays if none comes; a returning job opens again."""
    now = F.lit(as_of)
    items = items.withColumns({"is_active": F.lit(True), "closed_at": F.lit(None).cast("timestamp"), "updated_at": now})
    if "created_at" in jobs.columns:
        items = items.withColumn("created_at", now)
    return upsert(jobs, items.select(*(c for c in items.columns if c in jobs.columns)), ["entity_id", "external_id", "source"], {"posted_at": "fill", "created_at": "keep"})


# Sources whose rows give way once an entity has an authoritative one.
DISCOVERY_SOURCES = ("web:langsearch", "web:keenable", "adzuna", "serper", "linkedin", "indeed", "glassdoor", "ziprecruiter", "monster", "simplyhired", "talent")


def retire(
    jobs: DataFrame, as_of: datetime, run_started: datetime, *, current: DataFrame | None = None, complete: DataFrame | None = None, stale_days: int = 30, fresh: DataFrame | None = None
) -> DataFrame:
    """Active jobs (url, quality_ok, is_legacy_weak, is_authoritative, ...) with `close_reason`: the first rule that closes them, or null.

    In order: duplicate_url, invalid, superseded, missing, stale. A job that one rule closes is not seen by the next; duplicates are ranked
    before anything is closed. `current` (entity_id, source, external_id) is the inventory just read, `complete` (entity_id, source) the
    sources that were read to the end, `fresh` (entity_id) the entities whose run had results.
    """
    active = jobs.where("is_active")
    ranks = duplicate_urls(active, ["entity_id"]).select(F.col("id").alias("_dup"))
    authoritative = active.groupBy("entity_id").agg(F.bool_or("is_authoritative").alias("_has_authoritative"))
    rows = active.join(ranks, F.col("id") == F.col("_dup"), "left").join(authoritative, "entity_id")
    missing = F.lit(False)
    if current is not None and complete is not None:
        seen = current.select(F.col("entity_id").alias("_se"), F.col("source").alias("_ss"), F.col("external_id").alias("_sx"), F.lit(True).alias("_seen")).distinct()
        whole = complete.select(F.col("entity_id").alias("_ce"), F.col("source").alias("_cs"), F.lit(True).alias("_complete")).distinct()
        rows = rows.join(seen, (F.col("entity_id") == F.col("_se")) & (F.col("source") == F.col("_ss")) & (F.col("external_id") == F.col("_sx")), "left")
        rows = rows.join(whole, (F.col("entity_id") == F.col("_ce")) & (F.col("source") == F.col("_cs")), "left")
        missing = F.col("_complete").isNotNull() & F.col("_seen").isNull()
    days = min(max(stale_days, 7), 365)
    stale = F.col("updated_at") < F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")
    if fresh is not None:
        rows = rows.join(fresh.select(F.col("entity_id").alias("_fe")).distinct(), F.col("entity_id") == F.col("_fe"), "left")
        stale &= F.col("_fe").isNotNull()
    reason = (
        F.when(F.col("_dup").isNotNull(), "duplicate_url")
        .when(~F.col("quality_ok") | (F.col("_has_authoritative") & F.col("is_legacy_weak")), "invalid")
        .when(F.col("_has_authoritative") & (F.col("source").isin(*DISCOVERY_SOURCES) | F.col("source").startswith("jobapi:")) & (F.col("updated_at") < F.lit(run_started)), "superseded")
        .when(missing, "missing")
        .when(stale, "stale")
    )
    return rows.withColumn("close_reason", reason).select(*jobs.columns, "close_reason")


def close_jobs(jobs: DataFrame, retired: DataFrame, as_of: datetime) -> DataFrame:
    """Jobs after retirement: closed rows keep an earlier closing time."""
    gone = retired.where(F.col("close_reason").isNotNull()).select(F.col("id").alias("_id"))
    rows = jobs.join(gone, jobs["id"] == F.col("_id"), "left")
    closed = F.col("_id").isNotNull()
    return rows.withColumn("closed_at", F.when(closed, F.coalesce("closed_at", F.lit(as_of))).otherwise(F.col("closed_at"))).withColumn("is_active", F.col("is_active") & ~closed).drop("_id")


def incident_states(known: DataFrame, found: DataFrame, as_of: datetime, keys: tuple[str, ...] = ("entity_id", "incident_key")) -> DataFrame:
    """The incident table after an evaluation: found keys are open (first_seen kept, resolved ones reopened), the others resolved."""
    now = F.lit(as_of)
    k, f = known.alias("k"), found.withColumn("_found", F.lit(True)).alias("f")
    on = all_of([F.col(f"k.{c}") == F.col(f"f.{c}") for c in keys])
    open_ = F.col("_found").isNotNull()
    extra = [c for c in found.columns if c not in keys]
    return k.join(f, on, "full").select(
        *(F.coalesce(F.col(f"f.{c}"), F.col(f"k.{c}")).alias(c) for c in keys), *(F.when(open_, F.col(f"f.{c}")).otherwise(F.col(f"k.{c}")).alias(c) for c in extra if c in known.columns),
        F.when(open_, "open").otherwise("resolved").alias("status"), F.coalesce(F.col("k.first_seen"), now).alias("first_seen"), F.when(open_, now).otherwise(F.col("k.last_seen")).alias("last_seen"),
        F.when(~open_, F.coalesce(F.col("k.resolved_at"), now)).alias("resolved_at"),
    )


def update_coverage(coverage: DataFrame, checks: DataFrame, as_of: datetime) -> DataFrame:
    """The latest state per entity and source; the time of success only moves on success or zero."""
    good = F.col("status").isin("success", "zero")
    rows = checks.withColumns({"last_checked_at": F.lit(as_of), "last_success_at": F.when(good, F.lit(as_of))})
    return upsert(coverage, rows.select(*(c for c in rows.columns if c in coverage.columns)), ["entity_id", "source"], {"lineage_root": "fill", "source_key": "fill", "last_success_at": "fill"}).drop("_is_new", "_changed")


def retain(df: DataFrame, column: str, days: int, as_of: datetime) -> DataFrame:
    """Rows of the last days."""
    return df.where(F.col(column) >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def mark_and_sweep(table: DataFrame, loaded: DataFrame, keys: list[str], minimum_rows: int) -> DataFrame:
    """The table with the loaded rows active and all others inactive; refused as a whole if fewer than the minimum were loaded."""
    n = loaded.count()
    if n < minimum_rows:
        raise ValueError(f"refused: {n} rows loaded, at least {minimum_rows} are expected")
    out = upsert(table, loaded.withColumn("is_active", F.lit(True)), keys)
    return out.withColumn("is_active", F.col("_changed")).drop("_is_new", "_changed")


def index_changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """What a search index has to do: `update` active rows that are new or different, `delete` those no longer active."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != key))), 256)
    b = before.select(F.col(key).alias("_k"), digest(before).alias("_d"), F.col("is_active").alias("_was"))
    a = after.withColumn("_now", digest(after))
    rows = a.join(b, a[key] == F.col("_k"), "full")
    active = F.coalesce("is_active", F.lit(False))
    action = F.when(active & ~F.col("_now").eqNullSafe(F.col("_d")), "update").when(~active & F.coalesce("_was", F.lit(False)), "delete")
    return rows.select(F.coalesce(key, "_k").alias(key), action.alias("action")).where(F.col("action").isNotNull())


def detected_metadata(entities: DataFrame, detected: DataFrame, replace_existing: bool) -> DataFrame:
    """Entities with detected fields filled in, or put in the place of what is there; aliases are united."""
    policy = "fill" if replace_existing else "keep"
    fields = [c for c in detected.columns if c not in ("id", "aliases")]
    out = entities.join(detected.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in detected.columns if c != "id")), F.col("id") == F.col("_id"), "left")
    for c in fields:
        out = out.withColumn(c, POLICIES[policy](F.col(c), F.col(f"_{c}")))
    if "aliases" in detected.columns:
        out = out.withColumn("aliases", F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("_aliases", F.array().cast("array<string>")))))
    return out.select(*entities.columns)


def needs_enrichment(jobs: DataFrame, done: DataFrame, inputs: list[str], version: str, most: int = 12) -> DataFrame:
    """Jobs whose input digest isn't known yet, at most so many an entity, newest first."""
    from .frames import first_rows

    rows = jobs.withColumn("input_sha256", F.sha2(F.concat_ws("\x1f", F.lit(version), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in inputs)), 256))
    rows = rows.join(done.select("id", "input_sha256"), ["id", "input_sha256"], "left_anti")
    return first_rows(rows, ["entity_id"], [F.col("posted_at").desc_nulls_last(), F.col("id")], n=most)


def append_once(history: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The history with the rows appended; a row whose keys it has already, or that the rows have twice, is refused as a whole."""
    both = rows.select(*keys).unionByName(history.join(rows.select(*keys).distinct(), keys, "left_semi").select(*keys))
    twice = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"refused: {tuple(twice[0][k] for k in keys)} is there already")
    return history.unionByName(rows)


def prune_after_rebuild(table: DataFrame, rebuilt: DataFrame, keys: list[str], started: datetime) -> DataFrame:
    """The table after a rebuild: rebuilt rows replace theirs, and rows that the rebuild didn't touch go."""
    out = upsert(table, rebuilt, keys).drop("_is_new", "_changed")
    return out.where(F.col("updated_at") >= F.lit(started))


# Fields of an entity that a patch may set.
PATCHABLE = ("name", "aliases", "portal", "career_page_url", "ats_provider", "ats_board_id", "industry", "category", "is_active")


def patch_entities(entities: DataFrame, patches: DataFrame, as_of: datetime) -> DataFrame:
    """Entities with patched fields and the time of the patch. `patches`: id, `fields` (map of names to texts; null sets a null); other names are ignored, and a
    patch without an allowed one changes nothing."""
    allowed = F.map_filter("fields", lambda k, _: k.isin(*(c for c in PATCHABLE if c in entities.columns)))
    p = patches.select(F.col("id").alias("_id"), allowed.alias("_f")).where(F.size("_f") > 0)
    rows = entities.join(p, F.col("id") == F.col("_id"), "left")
    for c in (c for c in PATCHABLE if c in entities.columns):
        kind = entities.schema[c].dataType
        value = F.col("_f")[c]
        new = F.coalesce(F.from_json(value, kind.simpleString()), F.array().cast(kind)) if kind.typeName() == "array" else value.cast(kind)
        rows = rows.withColumn(c, F.when(F.coalesce(F.map_contains_key("_f", c), F.lit(False)), new).otherwise(F.col(c)))
    return rows.withColumn("updated_at", F.when(F.col("_id").isNotNull(), F.lit(as_of)).otherwise(F.col("updated_at"))).select(*entities.columns)
