"""The domain operators on small tables with known answers."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hiregrid.operators import benchmark, coverage, dedupe, geo, identity, lifecycle, metrics, quality, registry, reliability, search
from hiregrid.sources import payloads

AS_OF = datetime(2026, 8, 8, 22)


def test_quality_reasons(spark):
    rows = [
        ("", "lever", None, "missing title"), ("ab", "lever", None, "implausible title length"), ("x" * 181, "lever", None, "implausible title length"), ("a { color }", "lever", None, "markup/css text"), ("See all jobs", "lever", None, "generic/navigation title"),
        ("Acme | Careers", "lever", None, "generic/navigation title"), ("Welder", "career_page", "https://x.com/about", "career-page row lacks job-detail evidence"), ("Welder", "career_page", "https://x.com/jobs/welder-1", None), ("Welder", "indeed", "https://x.com/", "legacy discovery row lacks a direct job-detail URL"),
        ("Welder", "web:langsearch", "https://x.com/jobs/search", "discovery row lacks a direct job-detail URL"), ("Welder", "jobapi:x", "https://jobs.lever.co/acme/1", None), ("x" * 180, "lever", None, None), ("Nurse", None, None, None),
    ]
    df = spark.createDataFrame([(i, t, s, u) for i, (t, s, u, _) in enumerate(rows)], "id int, title string, source string, apply_url string")
    got = quality.assess_quality(df).orderBy("id").collect()
    assert [r.quality_reason for r in got] == [r[3] for r in rows]
    assert [r.is_authoritative for r in got][-3:] == [False, True, False]


ENTITY = [("e", "V2X", ["Vectrus"], "https://www.gov2x.com/careers", "v2x-board")]
ENTITIES = "id string, name string, aliases array<string>, career_page_url string, ats_board_id string"
JOBS = "entity_id string, _seq long, source string, external_id string, title string, department string, lat double, posted_at string, apply_url string, raw_data string"


def test_employer_evidence(spark):
    rows = [
        ("other", {"employer_name": "Other Corporation"}, None, None), ("alias", {"employer_name": "Vectrus Systems Corporation"}, None, "employer-name:Vectrus"), ("node", {"source_graph_verified_for_entity": True}, None, "verified-source-graph-node"),
        ("shared", {"source_graph_verified_for_entity": True, "source_graph_shared_inventory": True}, None, None), ("site", {}, "https://jobs.gov2x.com/1", "career-domain"), ("board", {}, "https://boards.greenhouse.io/v2x-board/jobs/1", "ats-board-id"),
    ]
    df = spark.createDataFrame([("e", i, "nlx", k, "Welder", None, None, None, u, json.dumps(raw)) for i, (k, raw, u, _) in enumerate(rows)], JOBS)
    got = {r.external_id: r.evidence for r in identity.employer_evidence(df, spark.createDataFrame(ENTITY, ENTITIES)).collect()}
    assert got == {k: e for k, _, _, e in rows}
    kept = identity.filter_by_evidence(df, spark.createDataFrame(ENTITY, ENTITIES), "web")
    assert kept.count() == len(rows)


SCORE = {"greenhouse": 100, "nlx": 90, "career_page": 80, "adzuna": 65, "web:langsearch": 45, "x": 50}


def fold(rows):
    """The merge, one row after the other."""
    left = None
    for r in rows:
        if left is None:
            left = dict(r)
            continue
        first, second = (r, left) if SCORE[r["source"]] > SCORE[left["source"]] else (left, r)
        left = {**second, **first, "department": first["department"] or second["department"], "posted_at": first["posted_at"] or second["posted_at"], "lat": first["lat"] if first["lat"] is not None else second["lat"]}
    return left


def test_merge_equals_a_sequential_fold(spark):
    rng = random.Random(3)
    rows = [("e", i, rng.choice(list(SCORE)), str(i), f"t{i}", rng.choice([None, "", "d1", "d2"]), rng.choice([None, 0.0, 1.5]), rng.choice([None, "", "p"]), f"https://x.com/{rng.randint(0, 30)}?utm_x={i}", "{}") for i in range(300)]
    names = [c.split()[0] for c in JOBS.split(", ")]
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r[8].split("?")[0], []).append(dict(zip(names, r, strict=True)))
    got = {r.normalized_apply_url: r for r in identity.dedupe_jobs(spark.createDataFrame(rows, JOBS)).collect()}
    assert set(got) == set(groups)
    for url, own in groups.items():
        want, r = fold(own), got[url]
        assert (r.source, r.external_id, r.title, r.lat) == (want["source"], want["external_id"], want["title"], want["lat"])
        assert (r.department or None, r.posted_at or None) == (want["department"] or None, want["posted_at"] or None)
        assert r.n_rows == len(own) and r.duplicate_sources == (list(dict.fromkeys(x["source"] for x in own)) if len(own) > 1 else None)


def test_cross_source_lineages(spark):
    raw = lambda x: json.dumps({"source_graph_lineage": x})
    rows = [("e", 0, "workday", "1", "t", None, None, None, "https://x.com/1?utm_source=a", raw("ats:workday")), ("e", 1, "nlx", "2", "t", None, None, None, "https://x.com/1", raw("nlx"))]
    got = identity.dedupe_jobs(spark.createDataFrame(rows, JOBS)).collect()
    assert len(got) == 1 and got[0].duplicate_sources == ["workday", "nlx"] and got[0].duplicate_lineages == ["ats:workday", "nlx"] and got[0].n_rows == 2


def test_trend(spark):
    jobs = spark.createDataFrame([("a", i, True, AS_OF, None, None, None) for i in range(39)] + [("a", 50, False, AS_OF, None, None, None)], "entity_id string, id int, is_active boolean, posted_at timestamp, lat double, lng double, raw_data string")
    snaps = spark.createDataFrame([("a", date(2026, 8, 7), 40), ("a", date(2026, 8, 1), 10), ("b", date(2026, 8, 7), 5)], "entity_id string, snapshot_date date, total_active long")
    got = {r.entity_id: (r.total_active, r.trend0, r.trend30) for r in metrics.entity_trend(jobs, snaps, AS_OF, (0, 30)).collect()}
    assert got == {"a": (39, -2, 0), "b": (0, -100, 0)}  # -2.5 % rounds toward positive infinity


@pytest.mark.parametrize(("posted", "new"), [(datetime(2026, 8, 1, 22), True), (datetime(2026, 8, 1, 21, 59, 59), False), (datetime(2027, 1, 1), True), (None, False)])
def test_new_this_week(spark, posted, new):
    df = spark.createDataFrame([(posted,)], "t timestamp")
    assert df.select(metrics.new_this_week(F.col("t"), AS_OF)).first()[0] is new


def plain_fold(order):
    kept = None
    for row in order:
        if kept is None or dedupe.STATUS_RANK.get(row[0], 1) > dedupe.STATUS_RANK.get(kept[0], 1) or (row[1] is not None and kept[1] is not None and row[1] > kept[1]):
            kept = row
    return kept


def test_a_run_is_summed_up_by_ranks_and_records():
    rng = random.Random(8)
    for _ in range(300):
        run = [(rng.choice(["success", "zero", "error", "skipped", None]), rng.choice([None, *range(12)]), i) for i in range(rng.randint(1, 14))]
        end, effect = dedupe._ends([dedupe.STATUS_RANK.get(x[0], 1) for x in run], [x[1] for x in run])
        assert run[end[0]] == plain_fold(run)
        for before in [(s, j, -1) for s in ("success", "zero", "error", "skipped") for j in (None, *range(13))]:
            rank = dedupe.STATUS_RANK.get(before[0], 1)
            hits = [e for e in effect if (e[0] == "rank" and e[1] == rank) or (e[0] == "jobs" and before[1] is not None and e[1] > before[1])]
            got = run[min(hits, key=lambda e: e[2])[3]] if hits else before
            assert got == plain_fold([before, *run])


def test_fold_of_a_hot_key_goes_through_many_tasks(spark):
    rng = random.Random(9)
    rows = []
    for i in range(6000):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b"]) + str(rng.randint(0, 900)) if rng.random() < 0.95 else None
        rows.append((key, "s", i, rng.choice(["success", "zero", "error", "x", None]), rng.choice([None, rng.randint(0, 50), rng.randint(0, 5000)]), datetime(2024, 1, 1) + timedelta(hours=i)))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.createDataFrame(rows, "entity_id string, source string, _seq long, status string, jobs_found long, checked_at timestamp").repartition(5)
        got = {r.entity_id: (r.status, r.jobs_found, r._seq, r.checked_at) for r in dedupe.fold_checks(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    by_key: dict = {}
    for k, _, i, st, n, at in rows:
        by_key.setdefault(k, []).append((st, n, i, at))
    assert got == {k: plain_fold(v) for k, v in by_key.items()}
    assert dedupe.fold_checks(df.limit(0)).count() == 0


def test_fold_depends_on_arrival(spark):
    def run(order):
        df = spark.createDataFrame([("e", "s", i, st, n) for i, (st, n) in enumerate(order)], "entity_id string, source string, _seq long, status string, jobs_found long")
        r = dedupe.fold_checks(df).first()
        return r.status, r.jobs_found

    assert run([("success", 5), ("error", 10), ("zero", 3)]) == ("zero", 3)
    assert run([("error", 10), ("zero", 3), ("success", 5)]) == ("success", 5)
    assert run([("success", 5), ("error", 10)]) == ("error", 10)


CHECKS = "entity_id string, _seq long, id long, source string, source_class string, status string, jobs_found long, authoritative_zero boolean, checked_at timestamp, lineage_root string, source_key string, details string"
PREVIOUS = "entity_id string, source string, status string, jobs_found long"


def check(i, source, kind, status, n, at=AS_OF, lineage=None, details=None, zero=False):
    return ("e", i, i, source, kind, status, n, zero, at, lineage or source, source, details)


def test_incidents(spark):
    old = datetime(2026, 8, 5, 21)
    rows = [
        check(0, "workday", "authoritative", "zero", 0, old), check(1, "mirror", "verified", "error", 7, details='{"truncated":true}'), check(2, "identity:sam", "authoritative", "error", 0, old), check(3, "lever", "authoritative", "success", 2),
        check(4, "nlx", "verified", "success", 40), check(5, "usajobs", "authoritative", "skipped", 0), check(6, "adzuna", "supplemental", "error", 0),
    ]
    before = [("e", "workday", "success", 40), ("e", "lever", "success", 10), ("e", "nlx", "success", 10), ("e", "mirror", "success", 7)]
    got = {r.incident_key: r.severity for r in reliability.source_incidents(spark.createDataFrame(rows, CHECKS), spark.createDataFrame(before, PREVIOUS), AS_OF).collect()}
    assert got == {
        "unverified-zero:workday": "high", "stale:workday": "medium", "zero-after-nonzero:workday": "high", "source-error:mirror": "medium", "truncated:mirror": "medium", "sudden-drop:lever": "high", "sudden-spike:nlx": "medium", "authoritative-skipped:usajobs": "medium",
    }


@pytest.mark.parametrize(("jobs", "samples", "found"), [(100, 30, None), (400, 30, True), (1000, 2, False)])
def test_learned_pairs(spark, jobs, samples, found):
    rows = [check(0, "nlx", "verified", "success", 90), check(1, "workday", "authoritative", "success", jobs)]
    base = spark.createDataFrame([("nlx", "workday", samples, 0.8, 1.1)], "source_a string, source_b string, sample_count int, p10_ratio double, p90_ratio double")
    got = reliability.cross_source_incidents(spark.createDataFrame(rows, CHECKS), base).collect()
    assert [r.learned_baseline for r in got] == ([] if found is None else [found])


def test_incident_states(spark):
    known = spark.createDataFrame([("e", "a", "k", "open", datetime(2026, 8, 1), datetime(2026, 8, 2), None), ("e", "b", "k", "open", datetime(2026, 8, 1), datetime(2026, 8, 2), None), ("e", "c", "k", "resolved", datetime(2026, 7, 1), datetime(2026, 7, 2), datetime(2026, 7, 3))], "entity_id string, incident_key string, kind string, status string, first_seen timestamp, last_seen timestamp, resolved_at timestamp")
    found = spark.createDataFrame([("e", "a", "k"), ("e", "c", "k"), ("e", "d", "k")], "entity_id string, incident_key string, kind string")
    got = {r.incident_key: (r.status, r.first_seen.month, r.first_seen.day, r.resolved_at) for r in lifecycle.incident_states(known, found, AS_OF).collect()}
    assert got == {"a": ("open", 8, 1, None), "b": ("resolved", 8, 1, AS_OF), "c": ("open", 7, 1, None), "d": ("open", 8, 8, None)}


def test_coverage_caps(spark):
    expected = "entity_id string, source_key string, source_class string, source_type string, lineage_root string, ats_provider string, is_primary boolean"
    rows = [("a", "ats:lever", "authoritative", "ats", "ats:lever", "lever", True), ("b", "board", "verified", "job_board", "board:x", None, False), ("c", "career", "authoritative", "career_page", "official-domain:c", None, False)]
    checks = [("a", 0, 0, "lever", "authoritative", "success", 5, False, AS_OF, "ats:lever", None, None), ("b", 1, 1, "board", "verified", "success", 5, False, AS_OF, "board:x", "board", None), ("c", 2, 2, "career", "authoritative", "success", 5, False, datetime(2026, 8, 1), "x", "career", None)]
    got = {r.entity_id: (r.score, r.grade, r.gaps) for r in coverage.coverage_scores(spark.createDataFrame(rows, expected), spark.createDataFrame(checks, CHECKS), AS_OF).collect()}
    assert got["a"] == (90, "excellent", [])
    assert got["b"][0] == 45 and got["b"][2][0] == "No authoritative hiring source is registered."
    assert got["c"] == (0, "unknown", ["Stale check: career", "No authoritative source has a recent healthy check."])


def test_truth_and_gates(spark):
    app = spark.createDataFrame([("e", u) for u in ("https://www.x.com/1?utm_source=a", "https://x.com/2/", "https://x.com/3")], "entity_id string, url string")
    truth = spark.createDataFrame([("e", u) for u in ("https://x.com/1", "https://x.com/2", "https://x.com/4")], "entity_id string, url string")
    r = benchmark.compare_truth(app, truth, ["entity_id"]).first()
    assert (r.matched, r.missing, r.unexpected) == (2, 1, 1) and r.precision == r.recall == pytest.approx(2 / 3)
    row = (3, 3, 0, 0, 3, 1, 1, 0, 3, r.precision, r.recall)
    cols = "app_count long, reference_count long, duplicate_count long, stale_count long, mapped_count long, authoritative_total long, authoritative_healthy long, high_incident_count long, truth_urls long, precision double, recall double"
    got = benchmark.assess_entities(spark.createDataFrame([row], cols)).first()
    assert got.blockers == ["precision 66.7% < 98%", "recall 66.7% < 90%"] and got.passed is False and got.evidence_level == "ground_truth"
    gate = "portal string, evidence_level string, precision double, recall double, parity double, duplicate_rate double, stale_rate double, mapped_rate double, authoritative_health double, high_incident_count long"
    live = [("live", "live_parity", None, None, 1.0, 0.0, 0.0, 1.0, 1.0, 0)] * 12
    good = [("good", "ground_truth", 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0)] * 5
    null = [*[("null", "ground_truth", 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0)] * 4, ("null", "ground_truth", 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, None, 0)]
    df = spark.createDataFrame(live + good + null, gate)
    assert {r.portal: r.status for r in benchmark.release_gates(df).collect()} == {"live": "insufficient_evidence", "good": "pass", "null": "fail"}
    assert {r.portal: r.status for r in benchmark.release_gates(df, null_as_zero=False).collect()}["null"] == "pass"


def test_pages_and_truth_promotion(spark):
    pages = "s string, page int, signature string, total int, exhausted boolean, urls array<string>"
    rows = [("whole", 1, "a", 2, False, ["1"]), ("whole", 2, "b", 2, True, ["2"]), ("loop", 1, "a", 2, False, ["1"]), ("loop", 2, "a", 2, True, ["2"]), ("short", 1, "a", 3, True, ["1"]), ("unknown", 1, "a", None, True, ["1"])]
    assert {r.s: r.complete for r in benchmark.pages_complete(spark.createDataFrame(rows, pages), ["s"]).collect()} == {"whole": True, "loop": False, "short": False, "unknown": False}
    caps = [("a", "complete", ["1", "2"], None), ("a", "complete", ["2", "3"], None), ("b", "complete", None, 7), ("c", "complete", None, 7), ("c", "complete", None, 8), ("d", "incomplete", ["1"], None)]
    got = {r.entity_id: (r.kind, r.official_job_count) for r in benchmark.promote_truth(spark.createDataFrame(caps, "entity_id string, status string, job_urls array<string>, official_count long")).collect()}
    assert got == {"a": ("urls", 3), "b": ("count", 7)}


def test_registry(spark):
    reg = [("1", "Fresno County", None, "county", "CA", True), ("2", "City of Fresno", None, "municipality", "CA", True), ("3", "Orange County", None, "county", "CA", True), ("4", "Orange County", None, "county", "FL", True), ("5", "Orange County", None, "county", "TX", False)]
    df = spark.createDataFrame(reg, "id string, name string, canonical_name string, government_type string, state_code string, is_active boolean")
    names = ["Fresno County, CA", "Orange County", "Orange County, FL", "The County of", "City of Fresno"]
    q = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "query_id int, query string")
    got = {r["query"]: r.id for r in registry.resolve_registry(q, df).collect()}
    assert got == {"Orange County, FL": "4", "City of Fresno": "2", "Fresno County, CA": "1"}
    found = registry.search_registry(spark.createDataFrame([(0, "fresno county")], "query_id int, query string"), df).orderBy(F.desc("score")).collect()
    assert (found[0].id, found[0].score) == ("1", 190)
    a = lambda x, y: spark.createDataFrame([(x, y)], "a string, b string").select(registry.agency_score(F.col("a"), F.col("b"))).first()[0]
    assert [a("Dept of Energy", "Energy Department"), a("NASA", "nasa"), a("Energy", "US Energy Board"), a("", "x")] == [97, 100, 90, 0]
    c = lambda n, x: spark.createDataFrame([(n, x)], "n array<string>, x string").select(registry.contractor_score(F.col("n"), F.col("x"))).first()[0]
    assert [c(["Acme Inc"], "ACME, Inc."), c(["Acme Inc"], "Acme LLC"), c(["Acme Rockets"], "Acme Rockets International")] == [1.0, 0.96, 0.9]


def test_retirement_order(spark):
    cols = "id int, entity_id string, source string, external_id string, url string, quality_ok boolean, is_legacy_weak boolean, is_authoritative boolean, is_active boolean, updated_at timestamp, created_at timestamp"
    new, old = datetime(2026, 8, 8), datetime(2026, 7, 1)
    rows = [
        (1, "e", "lever", "1", "u1", True, False, True, True, new, old), (2, "e", "nlx", "2", "u1", False, False, False, True, old, old), (3, "e", "indeed", "3", "u3", True, True, False, True, new, old), (4, "e", "adzuna", "4", "u4", True, False, False, True, old, old),
        (5, "e", "lever", None, "u5", True, False, True, True, old, old), (6, "e", "career_page", "6", "u6", True, False, False, True, old, old), (7, "f", "career_page", "7", "u7", True, False, False, True, old, old), (8, "e", "lever", "8", "u8", True, False, True, False, old, old),
    ]
    jobs = spark.createDataFrame(rows, cols)
    current, complete = spark.createDataFrame([("e", "lever", "1")], "entity_id string, source string, external_id string"), spark.createDataFrame([("e", "lever")], "entity_id string, source string")
    got = lifecycle.retire(jobs, AS_OF, datetime(2026, 8, 8, 20), current=current, complete=complete, fresh=spark.createDataFrame([("e",)], "entity_id string"))
    assert {r.id: r.close_reason for r in got.collect()} == {1: None, 2: "duplicate_url", 3: "invalid", 4: "superseded", 5: "missing", 6: "stale", 7: None}
    closed = lifecycle.close_jobs(jobs.withColumn("closed_at", F.lit(None).cast("timestamp")), got, AS_OF)
    assert {r.id for r in closed.where("is_active").collect()} == {1, 7}


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", datetime(2026, 1, 1), "authoritative", '{"x":1}'), (2, "b", None, "verified", "{}")], "k int, v string, posted_at timestamp, kind string, raw string")
    new = spark.createDataFrame([(1, "A", None, "verified", '{"y":2}'), (3, "c", None, "verified", "{}")], "k int, v string, posted_at timestamp, kind string, raw string")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    got = {r.k: tuple(r)[1:] for r in lifecycle.upsert(old, new, ["k"], {"posted_at": "fill", "kind": "sticky", "raw": "json"}).collect()}
    assert got == {1: ("A", datetime(2026, 1, 1), "authoritative", '{"x":1,"y":2}', False, True), 2: ("b", None, "verified", "{}", False, False), 3: ("c", None, "verified", "{}", True, True)}
    with pytest.raises(ValueError, match="refused"):
        lifecycle.mark_and_sweep(old, new, ["k"], 3)


def test_geo(spark):
    rows = [(None, "tx", "Remote", False, 1.0, 2.0), ("Reston", "VA", None, False, None, None), (None, None, "Near Dallas, TX.", False, 0.0, 0.0), (None, "TX", "x", False, None, None), (None, None, None, True, None, None), (None, None, "Nowhere", False, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, city string, state string, location string, is_remote boolean, lat double, lng double")
    cache = spark.createDataFrame([("nowhere", 5.0, 6.0)], "query_key string, lat double, lng double")
    got = [(r.point_lat, r.location_quality) for r in geo.locate(df, cache).orderBy("id").collect()]
    assert got == [(1.0, "source_coordinates"), (38.9586, "job location"), (32.7767, "job location"), (31.0545, "state fallback"), (39.8283, "remote fallback"), (5.0, "geocoded")]
    coords = spark.createDataFrame([(None, None), (None, 5.0), (0.0, 0.0), (91.0, 0.0), (5.0, 5.0)], "a double, b double")
    assert [r[0] for r in coords.select(geo.valid_coordinate(F.col("a"), F.col("b"))).collect()] == [False, True, False, False, True]


def test_search(spark):
    df = spark.createDataFrame([(1, "Diesel Mechanic", True, True, AS_OF), (2, "Mechanic", False, True, AS_OF), (3, "Mechanic", True, False, AS_OF)], "id int, title string, is_remote boolean, is_active boolean, posted_at timestamp")
    records = search.search_records(df)
    assert [r.id for r in search.search_jobs(records, "MECHANIC!").collect()] == [1, 2]
    assert [r.id for r in search.search_jobs(records, "mechanic remote").collect()] == [1] and search.search_jobs(records, " ? ").count() == 0


def test_payloads(spark):
    page = lambda x, **more: spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x), *more.values())], ", ".join(["payload string", *(f"{k} string" for k in more)]))
    w = payloads.workday(page({"total": 2, "jobPostings": [{"title": "A", "externalPath": "/job/Fresno/A_R1001", "locationsText": "Fresno, CA", "postedOn": "Posted Today", "bulletFields": ["R1001"]}, {"title": "B", "externalPath": "/job/B_R1002", "locationsText": "Berlin, Germany", "bulletFields": []}]}, base_url="https://acme.wd5.myworkdayjobs.com/ext")).orderBy("_seq").collect()
    assert [r.external_id for r in w] == ["R1001", "R1002"] and (w[0].city, w[0].state, w[0].lat) == ("Fresno", "CA", None) and w[1].country == "DE" and "R1002" in w[1].apply_url
    valid = "<rss><channel>" + "".join(f"<item><title><![CDATA[Job {i}]]></title><link>https://x.com/{i}</link><description>Location: Fresno, CA</description></item>" for i in range(2)) + "</channel></rss>"
    partial = valid.replace("<link>https://x.com/1</link>", "")
    assert [(r.city, r.state) for r in payloads.neogov_rss(page(valid)).collect()] == [("Fresno", "CA")] * 2
    assert [tuple(payloads.neogov_status(page(x)).first()) for x in (valid, partial, "<html>Login</html>", "<rss></rss>")] == [(2, 0, "success", False), (2, 1, "error", False), (0, 0, "error", False), (0, 0, "zero", True)]
    assert payloads.neogov_rss(page(partial)).count() == 1
    assert payloads.personio(page("<workzag-jobs><position><id>7</id><name>Cook</name></position></workzag-jobs>", base_url="https://acme.jobs.personio.de/xml")).first().apply_url == "https://acme.jobs.personio.de/job/7"
    assert payloads.greenhouse(page({"jobs": [{"id": 1}, {"id": 2, "absolute_url": "u"}]})).count() == 2
    assert payloads.greenhouse(page("no json")).count() == 0
    lever = payloads.lever(page([{"id": "x", "text": "T", "createdAt": 1704448800000, "categories": {"location": "Austin, TX"}}])).first()
    assert lever.posted_at == datetime(2024, 1, 5, 10) and lever.country == "US" and lever.city == "Austin"
    feed = payloads.feed(page({"data": {"jobs": [{"job_id": 5, "job_title": "Cook", "job_country": "United States", "latitude": "x"}, {"job_id": 6}]}}), "jobapi:x").collect()
    assert [(r.external_id, r.country, r.lat, r.source) for r in feed] == [("5", "US", None, "jobapi:x")]
    assert [r.url for r in payloads.sitemap_urls(page("<urlset><url><loc> https://x.com/a?b&amp;c </loc></url><url><loc>bad</loc></url></urlset>")).collect()] == ["https://x.com/a?b&c"]
    assert [r.cells for r in payloads.table_rows(page("<table><tr><th>A</th></tr><tr><td><a href='/j'>x</a></td><td>y</td></tr></table>")).orderBy("_seq").collect()] == [["A"], ["x", "y"]]
    good, bad = payloads.json_lines(spark.createDataFrame([('{"title":"T","url":"https://x.com/jobs/1"}',), ("{oops",), ("",), ("[1]",)], "value string"))
    assert good.count() == 1 and bad.count() == 2
    mixed = spark.createDataFrame([("lever", json.dumps([{"id": "1", "text": "T"}])), ("other", json.dumps([{"id": "2", "title": "U"}]))], "provider string, payload string")
    assert sorted((r.provider, r.source, r.title) for r in payloads.normalise(mixed).collect()) == [("lever", "lever", "T"), ("other", "jobapi:generic", "U")]
