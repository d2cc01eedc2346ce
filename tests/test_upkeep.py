from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hiregrid.functions import numbers as N
from hiregrid.functions import urls as U
from hiregrid.operators import discovery, health, lifecycle, registry, reliability

REGISTRY = "id string, name string, canonical_name string, government_type string, state_code string, is_active boolean"
AS_OF = datetime(2026, 8, 8, 12)


def test_kind_and_state_come_before_the_limit(spark):
    """Three hundred shorter names of other kinds or states don't crowd out the county that is meant."""
    rows = [("1", "San Longertown County", None, "county", "TX", True)] + [(f"9{k}", f"san {k:03d}", None, "special_district", "CA", True) for k in range(300)] + [(f"8{k}", f"san {k:03d} c", None, "municipality", "CA", True) for k in range(300)]
    reg = spark.createDataFrame(rows, REGISTRY)
    q = spark.createDataFrame([(0, "San Longertown County, TX")], "query_id int, query string")
    # Municipalities of another state still compete in resolving, which knows no state before the limit; they don't in searching.
    assert registry.resolve_registry(q, reg.where("government_type <> 'municipality'")).select("id", "score").collect()[0].asDict() == {"id": "1", "score": 103}
    assert [r.id for r in registry.search_registry(q, reg).collect()] == ["1"]
    state = q.select("query_id", "query", F.lit("state_agencies").alias("portal"))
    assert registry.search_registry(state, reg.where("state_code = 'CA'")).count() == 0


@pytest.mark.parametrize(("url", "provider", "board"), [("https://BOARDS.greenhouse.io/Acme?x=1", "greenhouse", "Acme"), ("https://jobs.lever.co/acme#top", "lever", "acme"), ("https://acme.wd1.myworkdayjobs.com/Careers", "workday", "https://acme.wd1.myworkdayjobs.com/Careers"), ("https://acme.bamboohr.com/", None, None), ("javascript:void(0)", None, None), ("", None, None), (None, None, None)])
def test_hosted_boards(spark, url, provider, board):
    r = spark.createDataFrame([(url,)], "u string").select(U.hosted_board(F.col("u")).alias("b")).first().b
    assert (r and (r.provider, r.board)) == (provider and (provider, board))


def test_links_and_markup_of_a_page(spark):
    df = spark.createDataFrame([("https://x.org/jobs", ["https://x.org/a", "https://acme.taleo.net/x", "https://jobs.lever.co/z"], "powered by iCIMS"), ("https://x.org/jobs", [], "powered by iCIMS"), ("https://x.org/jobs", None, None)], "u string, l array<string>, h string")
    assert [r[0] and r[0].provider for r in df.select(U.detect_ats(F.col("u"), F.col("l"), F.col("h"))).collect()] == ["taleo", "icims", None]


def test_append_refuses_what_is_there(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    more = spark.createDataFrame([(3, "c")], df.schema)
    assert lifecycle.append_once(df, more, ["id"]).count() == 3
    for bad in (df, more.union(more)):
        with pytest.raises(ValueError, match="refused"):
            lifecycle.append_once(df, bad, ["id"])
    assert lifecycle.append_once(df.limit(0), df, ["id"]).count() == 2


def test_patch_takes_allowed_fields_only(spark):
    e = spark.createDataFrame([(1, "a", ["x"], True, AS_OF), (2, "b", None, True, AS_OF)], "id int, name string, aliases array<string>, is_active boolean, updated_at timestamp")
    p = spark.createDataFrame([(1, {"name": None, "aliases": "no list", "id": "7"}), (2, {"id": "7"}), (3, {"name": "none"})], "id int, fields map<string,string>")
    got = {r.id: r for r in lifecycle.patch_entities(e, p, datetime(2026, 9, 1)).collect()}
    assert got[1].name is None and got[1].aliases == [] and got[1].updated_at == datetime(2026, 9, 1)
    assert got[2].name == "b" and got[2].aliases is None and got[2].updated_at == AS_OF and set(got) == {1, 2}


def test_old_baselines_do_not_count(spark):
    checks = spark.createDataFrame([("e", k, s, "authoritative", "success", n, s) for k, (s, n) in enumerate([("nlx", 90), ("workday", 400)])], "entity_id string, _seq int, source string, source_class string, status string, jobs_found long, lineage_root string")
    baseline = lambda day: spark.createDataFrame([("nlx", "workday", 30, 0.8, 1.2, datetime(2026, 8, day))], "source_a string, source_b string, sample_count long, p10_ratio double, p90_ratio double, updated_at timestamp")
    found = lambda day: [r.learned_baseline for r in reliability.cross_source_incidents(checks, baseline(day), as_of=AS_OF).collect()]
    assert found(7) == [True] and found(1) == []


def test_watched_employers_keep_a_row_for_each_slot(spark):
    rows = [("Acme, Inc", "k1", "prospects", 0), ("ACME inc", "k1", "prospects", 1), ("Acme Inc", "k2", "prospects", 2), (" ", "k1", "prospects", 3), ("Zed", None, "prospects", 4), ("Other", "k1", "prospects", 5)]
    df = spark.createDataFrame(rows, "name string, slot string, portal string, _seq int")
    assert sorted((r.name, r.slot) for r in discovery.watched_employers(df).collect()) == [("Acme Inc", "k2"), ("Acme, Inc", "k1"), ("Other", "k1")]
    e = spark.createDataFrame([(1, "other", None, False, 0)], "id int, name string, aliases array<string>, is_active boolean, created_at int")
    assert sorted((r.name, r.action) for r in discovery.sync_watched(df, e).collect()) == [("Acme, Inc", "insert"), ("Other", "reactivate")]


def test_answers_of_a_model(spark):
    df = spark.createDataFrame([('x {"safety_sensitive": "no", "opportunity_score": 250, "reason": "' + "r" * 500 + '"} y',), ("{broken",), (None,), ("none",)], "t string")
    got = [r[0] for r in df.select(N.enrichment_answer(F.col("t"))).collect()]
    assert (got[0].safety_sensitive, got[0].dot_cdl, got[0].physical_demand, got[0].opportunity_score, len(got[0].reason)) == (True, False, "unknown", 100, 400) and got[1:] == [None] * 3


def test_filters_of_jobs(spark):
    df = spark.createDataFrame([(1, "p", "e", "us", "security", AS_OF, True), (2, "p", "e", "US", "security", None, None)], "id int, portal string, entity_id string, country string, role_category string, posted_at timestamp, is_overseas boolean")
    ids = lambda **f: [r.id for r in df.where(health.job_filters(**f)).collect()]
    assert ids() == ids(country="us", role="security", portal="p") == [1, 2] and ids(new_since=datetime(2026, 8, 1)) == ids(overseas=True) == [1] and ids(federal=True) == []


def test_fold_over_many_small_batches(spark):
    import random

    from hiregrid.operators import dedupe

    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.choice(["a", None]), k, rng.choice(["success", "zero", "error", "skipped", None]), rng.choice([None, 0, 1, 5, 9])) for k in range(300)]
    rank = {"success": 4, "zero": 3, "error": 2}
    want = {}
    for e, s, k, status, n in rows:
        old = want.get((e, s))
        if old is None or rank.get(status, 1) > rank.get(old[1], 1) or (n is not None and old[2] is not None and n > old[2]):
            want[e, s] = (k, status, n)
    df = spark.createDataFrame(rows, "entity_id int, source string, _seq int, status string, jobs_found int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(r.entity_id, r.source): (r._seq, r.status, r.jobs_found) for r in dedupe.fold_checks(df).collect()} == want
        assert dedupe.fold_checks(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://boards.greenhouse.io/acme%2Fjobs", ("greenhouse", "acme", "high")), ("https://x.org/jobs?for=acme&via=greenhouse", ("greenhouse", "acme", "high")), ("https://jobs.lever.co/a%20b+c/1", ("lever", "a b+c", "high")),
        ("https://x.icims.com/?ref=https://jobs.lever.co/acme", ("lever", "acme", "high")), ("https://x.org/%zz/icims.com", None), ("https://x.org/?u=acme.icims.com", None), ("https://www.example.org", None), (None, None), ("", None),
    ],
)
def test_boards_behind_escapes_and_parameters(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(U.hosted_board(F.col("u")).alias("b")).first().b
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a class=Greenhouse>", ("greenhouse", "acmeandsons")), ("icims and lever-jobs", ("lever", "acmeandsons")), ("x icims", ("icims", None)), ("oraclecloud then hcm", ("oracle", None)), ("oraclecloud alone, phenom", ("phenom", None)),
        ("a workday page", ("workday", "https://x.org/Careers")), ("nothing", None), (None, None),
    ],
)
def test_markup_gives_the_first_provider_and_its_board(spark, html, want):
    df = spark.createDataFrame([("https://x.org/en-US/Careers/1", html, "The Acme & Sons Holdings, Inc.")], "u string, h string, c string")
    got = df.select(U.detect_ats(F.col("u"), None, F.col("h"), F.col("c")).alias("b")).first().b
    assert (tuple(got)[:2] if got else None) == want
