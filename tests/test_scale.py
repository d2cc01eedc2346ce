"""Queries on tables larger than the given ones: their keys, and that work is spread and done once."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hiregrid.functions import numbers
from hiregrid.operators import crawl
from hiregrid.operators import registry as government
from hiregrid.plans import registry
from hiregrid.sources import payloads, web

DATA = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@needs_tables
def test_census_keys_of_seven_digits(spark, tmp_path):
    part = spark.read.parquet(f"{DATA}/part.parquet").where("p_size <> 13").limit(5)
    part.withColumn("p_partkey", (F.col("p_partkey") + 1_234_000).cast(part.schema["p_partkey"].dataType)).write.parquet(str(tmp_path / "part.parquet"))
    got = registry.queries()["census_registry"](spark, str(tmp_path)).select("p_partkey", "id").collect()
    assert len(got) == 5
    assert all(r.p_partkey >= 1_234_000 and r.id == str(r.p_partkey)[:6] for r in got)


def _parses(df) -> int:
    """How often the optimised plan takes a value out of a JSON text."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(")


def test_each_path_is_read_a_few_times(spark):
    pages = spark.createDataFrame([(1, "{}", "Co", ["Co"])], "p int, payload string, employer string, aliases array<string>").withColumn("entity_name", F.col("employer"))
    assert _parses(web.theirstack(pages)) <= 60
    assert _parses(web.search_results(pages)) <= 30
    assert _parses(web.public_boards(pages)) <= 20
    assert _parses(payloads.usajobs(pages)) <= 60
    assert _parses(payloads.feed(pages, "x")) <= 200


def test_a_search_result_is_read_in_one_pass(spark):
    """Keys are read together, a surrogate that is cut in half costs its own text only, and fields that nobody reads aren't worked out."""
    results = [{"url": "https://x.org/job/1234", "name": "Welder", "snippet": "in Austin, TX"}, {"url": "https://x.org/job/1235", "name": "Cook", "snippet": "cut \ud83d", "summary": "in Reno, NV"}]
    pages = spark.createDataFrame([(json.dumps({"results": results}), "Co")], "payload string, employer string")
    out = web.search_results(pages)
    assert [(r.title, r.location, r.country) for r in out.orderBy("_seq").collect()] == [("Welder", "Austin, TX", "US"), ("Cook", "Reno, NV", "US")]
    plan = out.select("title", "country")._jdf.queryExecution().optimizedPlan().toString()
    assert "json_tuple" in plan and "16777619" not in plan  # the hash of the id
    assert _parses(out.select("title", "location", "country")) <= 13  # of pages, and of items with surrogates


def test_a_board_result_is_chosen_before_its_fields(spark):
    found = [{"url": "https://www.naco.org/jobs/1", "name": "Clerk - Fresno County jobs", "snippet": "Fresno is hiring"}, {"url": "https://WWW.naco.org/jobs/1", "name": "Clerk again", "snippet": "Fresno County"}]
    pages = spark.createDataFrame([(json.dumps({"data": {"webPages": {"value": found}}}), "County of Fresno", ["Fresno County"])], "payload string, entity_name string, aliases array<string>")
    out = web.public_boards(pages)
    assert [(r.title, r.apply_url, r.aliases, r._seq) for r in out.collect()] == [("Clerk", "https://www.naco.org/jobs/1", ["Fresno County"], 0)]
    plan = out.select("title", "state")._jdf.queryExecution().optimizedPlan().toString()
    assert "16777619" not in plan and "min_by" not in plan  # neither the hash of the id nor whole rows


def test_a_federal_job_is_chosen_before_its_fields(spark):
    """The first item of an id holds, each object is read in one pass, and a text that holds JSON is no object."""
    described = {"PositionTitle": "Nurse", "PositionLocation": [{"CityName": "Reno, Nevada", "Latitude": "39.5"}], "ApplyURI": ["https://x.org/1"], "DepartmentName": "cut \ud83d"}
    items = [{"MatchedObjectId": "1", "MatchedObjectDescriptor": described}, {"MatchedObjectId": "1", "MatchedObjectDescriptor": {"PositionTitle": "again"}}, {"MatchedObjectId": "2", "MatchedObjectDescriptor": json.dumps(described)}, {"MatchedObjectDescriptor": {"PositionID": "3", "PositionLocation": ['{"CityName": "X"}']}}]
    out = payloads.usajobs(spark.createDataFrame([(json.dumps({"SearchResult": {"SearchResultItems": items}}),)], "payload string"))
    got = [(r.external_id, r.title, r.city, r.lat, r.apply_url, r._seq) for r in out.orderBy("external_id").collect()]
    assert got == [("1", "Nurse", "Reno", 39.5, "https://x.org/1", 0), ("2", None, None, None, None, 2), ("3", None, None, None, None, 3)]
    plan = out.select("external_id", "title", "lat")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple(") >= 3 and plan.index("json_tuple(") < plan.index("row_number") and "Aggregate" not in plan


@needs_tables
def test_pages_are_dealt_out_before_executors_join(spark, monkeypatch):
    from hiregrid.plans import lens

    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert lens.spread(lens.table(spark, str(DATA), "part"), "p_partkey").rdd.getNumPartitions() == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("text", ["2024-01-05T10:00:00Z", "2024-01-05t10:00:00.123+02:00", "2024-01-05 10:00:00", "Fri, 5 Jan 2024 10:00:00 +0000", "5 Jan 2024 10:00:00 GMT", "2024-01-05", "+12024-01-05", "01/05/2024", "Jan 5, 2024", "2024-01", "10:00", "-", ""])
def test_signs_of_times_skip_only_formats_that_fail(spark, text):
    one = spark.createDataFrame([(text,)], "t string").select(F.regexp_replace(F.trim("t"), r"^[A-Za-z]{3,9},\s+", "").alias("t"))
    for form, signs in numbers.TIME_FORMATS:
        read = F.try_to_timestamp(F.col("t"), F.lit(form))
        assert one.where(read.isNotNull() & ~F.col("t").rlike(f"(?s){signs}")).isEmpty()


@needs_tables
def test_pages_are_dealt_out(spark):
    from hiregrid.plans import lens

    part = lens.spread(lens.table(spark, str(DATA), "part"), "p_partkey")
    assert part.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert len({r.k for r in part.select(F.spark_partition_id().alias("k")).distinct().collect()}) > 1


def test_candidates_are_limited_before_the_join(spark):
    """A token in more rows than a word, kind and state may bring gives the same first rows, and the plan limits each word's rows before any shuffle."""
    rows = [(f"{k:03d}", f"Alpha{'x' * (k % 7)} Town {'abc'[k % 3] * (1 + k % 5)} County", None, ("county", "municipality", "township", "state")[k % 4], ("CA", "NV", None)[k % 3], True) for k in range(200)]
    reg = spark.createDataFrame(rows, "id string, name string, canonical_name string, government_type string, state_code string, is_active boolean")
    asked = spark.createDataFrame([("q1", "alpha town"), ("q2", "alphax, NV county")], "query_id string, query string")
    q = asked.select("query_id", "query", F.lit("counties_and_cities").alias("_portal"), F.when(F.col("query").contains("NV"), "NV").alias("_only"), F.regexp_extract("query", "^[a-z]+", 0).alias("_token"))
    found = government._candidates(q, reg.withColumn("canonical", F.lower("name")), 5)
    for query, token, state in (("q1", "alpha", None), ("q2", "alphax", "NV")):
        want = sorted((len(name), key) for key, name, _, kind, code, _ in rows if kind != "state" and (state is None or code == state) and any(token in w for w in name.lower().split()))[:5]
        assert sorted((len(r.canonical), r.id) for r in found.where(F.col("query_id") == query).collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("_word" in line and "WindowGroupLimit" in line and "Partial" in line for line in plan.splitlines())


def test_a_crawl_reads_its_links_once(spark, monkeypatch):
    """Links and keys are worked out once, however many waves a crawl has."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    links = spark.createDataFrame([("s", str(k), str(k + 1), 0) for k in range(6)], "site string, url string, target string, position int").mapInArrow(counted, "site string, url string, target string, position int")
    start = spark.createDataFrame([("s", "0")], "site string, url string")
    keys = spark.createDataFrame([("s", str(k), k) for k in range(7)], "site string, url string, key int")
    assert crawl.crawl(start, links, keys, most_pages=10).count() == 7
    assert seen.value == 6
