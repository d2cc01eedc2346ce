from __future__ import annotations

import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hiregrid.operators import runs
from hiregrid.sources import web

BASE = "https://x.com/careers/list.html?p=1"


def page(spark, html, url=BASE):
    return spark.createDataFrame([(html, url)], "payload string, page_url string")


def test_absolute(spark):
    links = ["/a", "b?c", "?q=2", "//y.com/z", "https://z.com/#top", "mailto:x", "", "#f"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(web.absolute(F.col("x"), F.lit(BASE))).collect()]
    assert got == ["https://x.com/a", "https://x.com/careers/b?c", "https://x.com/careers/list.html?q=2", "https://y.com/z", "https://z.com/", None, BASE, BASE]


def test_career_page(spark):
    node = {"@type": "JobPosting", "title": "Welder &amp; Cutter", "url": "/jobs/welder-7", "identifier": {"value": "7"}, "validThrough": "2024-01-05", "jobLocation": {"address": {"addressLocality": "Fresno", "addressRegion": "CA", "addressCountry": {"name": "US"}}}}
    graph = {"@graph": [{"@type": "Organization", "name": "X"}, {"@type": ["Thing", "JobPosting"], "title": "Cook", "url": "/jobs/cook-8", "jobLocationType": "TELECOMMUTE"}]}
    html = f'<script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">[{json.dumps(graph)}]</script><script type="application/ld+json">{{bad</script>'
    html += '<a href="/jobs/welder-7">Welder</a><a href="/jobs/nurse-9">Nurse - Austin, TX</a><a href="/jobs/search">Search jobs</a><a href="/about">About our work</a><a href="/jobs/abcd">See all jobs</a>'
    got = {r.apply_url: r for r in web.career_page(page(spark, html)).collect()}
    assert set(got) == {"https://x.com/jobs/welder-7", "https://x.com/jobs/cook-8", "https://x.com/jobs/nurse-9"}
    w, c, n = got["https://x.com/jobs/welder-7"], got["https://x.com/jobs/cook-8"], got["https://x.com/jobs/nurse-9"]
    assert (w.title, w.external_id, w.location, w.country, w.posted_at) == ("Welder & Cutter", "7", "Fresno, CA, US", "US", datetime(2024, 1, 5)) and json.loads(w.raw_data)["parser"] == "json_ld"
    assert c.location == "Remote" and c.is_remote and n.state == "TX"


def test_search_and_aggregators(spark):
    results = {"data": {"webPages": {"value": [{"name": "Welder | Acme", "url": "https://x.com/jobs/welder?utm_source=a", "snippet": "in Austin, TX, remote"}, {"name": "Careers", "url": "https://x.com/careers"}, {"name": "News", "url": "ftp://x"}]}}}
    got = web.search_results(spark.createDataFrame([(json.dumps(results), "Acme")], "payload string, employer string")).collect()
    assert [(r.title, r.apply_url, r.location, r.is_remote) for r in got] == [("Welder", "https://x.com/jobs/welder?utm_source=a", "Remote", True)] and got[0].external_id.startswith("langsearch-")
    rows = {"data": [{"id": 1, "job_title": "A", "url": "https://x.com/1"}, {"id": 2, "job_title": "B", "final_url": "https://x.com/1"}, {"id": 3, "job_title": "", "url": "https://x.com/3"}, {"job_title": "C", "url": "https://x.com/4"}]}
    got = web.theirstack(spark.createDataFrame([(json.dumps(rows), "Acme")], "payload string, employer string")).collect()
    assert [(r.external_id, r.department) for r in got] == [("theirstack-1", "Acme")]
    j = web.jibe(spark.createDataFrame([(json.dumps({"jobs": [{"data": {"title": "T", "slug": "9"}}]}), "https://b.com/")], "payload string, base_url string")).first()
    assert j.apply_url == "https://b.com/jobs/9"
    t = web.table_jobs(page(spark, "<table><tr><th>Job</th></tr><tr><td><a href='/apply/abcd1'>Cook</a></td><td>Reno, NV</td></tr></table>"), "jazzhr").collect()
    assert [(r.title, r.external_id, r.state, r.source) for r in t] == [("Cook", "abcd1", "NV", "jazzhr")]
    urls = {"https://www.naco.org/jobs/1": "board:naco", "https://jobs.icma.org/job-posts/2": "board:icma", "https://careersingovernment.com/job/77/clerk": "board:careersingovernment", "https://icma.org/jobs-search": None, "https://x.com/job": None}
    b = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.b for r in b.select("u", web.board_of(F.col("u")).alias("b")).collect()} == urls
    found = [{"url": "https://www.naco.org/jobs/1", "name": "Clerk | NACo Career Center", "snippet": "Fresno County is hiring. Location: Fresno, CA; apply"}, {"url": "https://www.naco.org/jobs/1", "name": "Clerk again", "snippet": "Fresno County"}, {"url": "https://www.naco.org/jobs/2", "name": "Cook", "snippet": "Kern County"}]
    pages = spark.createDataFrame([(json.dumps({"data": {"webPages": {"value": found}}}), "County of Fresno", ["Fresno County"])], "payload string, entity_name string, aliases array<string>")
    assert [(r.title, r.source, r.city, r.state) for r in web.public_boards(pages).collect()] == [("Clerk", "board:naco", "Fresno", "CA")]
    with pytest.raises(ValueError, match="portal"):
        web.portal_feed(page(spark, "[]"), "galactic")


def test_zipped_registry(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "gov.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("units.txt", 'CENSUS_ID PID6|UNIT NAME|TYPE_CODE|FIPS_STATE|FIPS_COUNTY|STATE|"odd,name"\n000123|Fresno County|1|06|19|ca|x\n|nameless|1|06|19|ca|x\n000124|"City | Fresno"|2|6|019|CA|y\n')
    got = web.census_governments(web.zipped_tables(spark, str(tmp_path / "*.zip")), 2024).orderBy("id").collect()
    assert [(r.id, r.name, r.government_type, r.state_fips, r.county_fips, r.state_code) for r in got] == [("000123", "Fresno County", "county", "06", "019", "CA"), ("000124", "City | Fresno", "municipality", "06", "019", "CA")]


def test_bad_registry_lines_are_named(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "gov.zip", "w") as z:
        z.writestr("units.csv", b"ID,NAME\n1,One\n2,Two,more\n3\n\n4,Fa\xff\n")
    rows = web.zipped_tables(spark, str(tmp_path / "*.zip")).orderBy("line").collect()
    assert [(r.line, r.fields.get("id"), r.fields.get("name"), r.problem) for r in rows] == [(0, "1", "One", None), (1, None, None, "fields"), (2, "3", "", None), (3, "4", "Fa\ufffd", "encoding")]


def test_directory_gate(spark):
    html = "<a href='/one'>League One</a><a href='/uno'>League One</a><a href='/two'>League Two</a><a href='/x'>jobs</a>"
    got = {r.organization_name: r.jobs_url for r in web.directory_entries(page(spark, html), "leagues", 2).collect()}
    assert got == {"League One": "https://x.com/uno", "League Two": "https://x.com/two"}
    with pytest.raises(ValueError, match="refused"):
        web.directory_entries(page(spark, html), "leagues", 3)


ENTITY = "id int, name string, aliases array<string>, portal string, government_state string, career_page_url string, ats_provider string, ats_board_id string"


def test_dispatch_states_and_seeds(spark):
    rows = [
        (1, "Acme", None, "private", None, "https://boards.greenhouse.io/acme", None, "acme"), (2, "Amentum Services", [], "private", None, "https://x.com", "unknown", None), (3, "City of West Virginia Beach", ["Beach, TX"], "counties_and_cities", None, "https://x.com/careers", None, None),
        (4, "Fresno", ["Fresno, CA"], "counties_and_cities", None, None, None, None), (5, "Reno", None, "counties_and_cities", None, "https://www.reno.nv.gov/jobs", "icims", None), (6, "Dover", None, "counties_and_cities", "Delaware", None, None, None),
    ]
    e = spark.createDataFrame(rows, ENTITY)
    assert {r.id: r.connector for r in runs.dispatch(e).collect()} == {1: "greenhouse", 2: "amentum_careers", 3: "career_page", 4: None, 5: "ats:icims", 6: None}
    assert {r.id: r.s for r in e.select("id", runs.infer_state(e).alias("s")).collect()} == {1: None, 2: None, 3: "WV", 4: "CA", 5: "NV", 6: "DE"}
    entries = spark.createDataFrame([("d", "ca-league", "municipal_league", "CA", "https://l.org", True), ("d", "nv", "other", "NV", "https://n.org", True)], "directory_key string, entry_key string, entry_type string, state_code string, jobs_url string, is_active boolean")
    own = runs.state_directories(e, entries)
    assert [(r.entity_id, r.entry_key) for r in own.collect()] == [(4, "ca-league")]
    seeds = runs.seed_sources(e, own).collect()
    assert sorted((s.entity_id, s.lineage_root) for s in seeds) == [(1, "ats:greenhouse"), (2, "official-domain:x.com"), (3, "official-domain:x.com"), (4, "directory:d"), (5, "ats:icims")]
    fed = spark.createDataFrame([("usps", "u", ["Postal Service", "x"], True)], "entry_key string, jobs_url string, match_patterns array<string>, is_active boolean")
    e2 = spark.createDataFrame([(1, "U.S. Postal Service", None), (2, "Postal Tools", None)], "id int, name string, aliases array<string>")
    assert [r.entity_id for r in runs.federal_directories(e2, fed).collect()] == [1]


def test_checks_and_statuses(spark):
    jobs = spark.createDataFrame([("e", "lever", "1", True, True), ("e", "lever", "2", True, False), ("f", " ", "3", True, False), ("e", "theirstack", "9", True, False)], "entity_id string, source string, external_id string, is_active boolean, is_authoritative boolean")
    used = spark.createDataFrame([("e", ["lever", "nlx"]), ("f", ["nlx"])], "entity_id string, sources array<string>")
    got = {(r.entity_id, r.source): (r.status, r.jobs_found) for r in runs.synthesise_checks(jobs, used, "authoritative").collect()}
    assert got == {("e", "lever"): ("success", 2), ("e", "nlx"): ("zero", 0), ("f", "nlx"): ("zero", 0), ("e", "theirstack"): ("success", 1)}
    cases = [(0, [], ["Key missing"], "skipped"), (3, ["x"], [], "success"), (3, ["x"], ["x: timeout"], "error"), (0, ["x"], ["x: 0 open jobs"], "zero"), (0, ["x"], ["x: timeout"], "error"), (0, ["x"], [], "zero"), (0, [], [], "skipped")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, used array<string>, skipped array<string>, want string")
    assert all(r.s == r.want for r in df.select("want", runs.supplemental_status(F.col("n"), F.col("used"), F.col("skipped"), "0 open jobs").alias("s")).collect())
    ran = spark.createDataFrame([("e", ["theirstack"], ["theirstack: 0 open jobs"])], "entity_id string, used array<string>, skipped array<string>")
    bad = spark.createDataFrame([("e", ["theirstack"], ["theirstack: timeout"])], "entity_id string, used array<string>, skipped array<string>")
    none = spark.createDataFrame([], "entity_id string, external_id string")
    assert [runs.reconcile_source(jobs, none, r, "theirstack").count() for r in (ran, bad)] == [1, 0]
    assert [sorted(r.entity_id for r in runs.discovery_allowed(jobs, m).collect()) for m in ("off", "fallback", "always")] == [[], ["f"], ["e", "f"]]
    e = spark.createDataFrame([(1, datetime(2024, 1, 2)), (2, datetime(2024, 1, 2)), (3, datetime(2024, 1, 2))], "id int, created_at timestamp")
    logs = spark.createDataFrame([(1, 1, "error", "a", 1, 0, 0, "x", datetime(2024, 1, 3)), (2, 1, "success", "b", 5, 2, 1, None, datetime(2024, 1, 4)), (3, 2, "success", "b", 5, 2, 1, None, datetime(2024, 1, 1))], "id int, entity_id int, status string, source string, jobs_found int, jobs_new int, jobs_closed int, error_message string, ran_at timestamp")
    assert {r.id: (r.status, r.jobs_found) for r in runs.ingest_status(e, logs).collect()} == {1: ("success", 5), 2: ("queued", 5), 3: ("queued", 0)}
