from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from hiregrid.functions import numbers as N
from hiregrid.functions import text as T
from hiregrid.functions import urls as U


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


URLS = [
    "https://WWW.Example.com/Jobs/1?b=2&utm_source=a&a=1#top", "http://example.com", "https://x.com/a/?ref=1&gh_src=z", "https://x.com:443/a?q=a%20b+c", "http://x.com:8080/?k", "ftp://x.com/a", "javascript:void(0)", " https://x.com/a?a=2&a=1 ",
    "", None, "not a url", "https://user:pw@x.com/p?Source=1&UTM_x=2",
]


def test_three_canonical_forms(spark):
    assert values(spark, lambda x: U.canonical(x, U.JOBS), URLS) == [
        "https://www.example.com/Jobs/1?a=1&b=2", "http://example.com/", "https://x.com/a/?ref=1", "https://x.com/a?q=a+b+c", "http://x.com:8080/?k=", None, None, "https://x.com/a?a=2&a=1", None, None, None, "https://x.com/p",
    ]
    assert values(spark, lambda x: U.canonical(x, U.TRUTH), URLS[:3]) == ["https://example.com/Jobs/1?a=1&b=2", "http://example.com", "https://x.com/a"]
    assert values(spark, lambda x: U.canonical(x, U.AUDIT), [*URLS[:3], "https://x.com/?referral=1"]) == ["https://www.example.com/Jobs/1?a=1&b=2", "http://example.com", "https://x.com/a", "https://x.com/?referral=1"]


def test_sites(spark):
    rows = [("https://www.a.com/x", "https://jobs.a.com"), ("https://a.com", "https://www.a.com"), ("https://ba.com", "https://a.com"), (None, "https://a.com")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(U.same_site(F.col("a"), F.col("b"))).collect()] == [True, True, False, None]


@pytest.mark.parametrize(("url", "provider", "board"), [
    ("https://boards.greenhouse.io/acme/jobs/1", "greenhouse", "acme"), ("https://jobs.lever.co/acme/1", "lever", "acme"), ("https://jobs.ashbyhq.com/acme", "ashby", "acme"), ("https://acme.wd5.myworkdayjobs.com/ext", "workday", "acme"),
    ("https://acme.bamboohr.com/careers/1", "bamboohr", "acme"), ("https://www.governmentjobs.com/careers/fresno", "neogov", "fresno"), ("https://acme.applytojob.com/apply", "jazzhr", "acme"), ("https://example.com/jobs", None, None),
])
def test_ats(spark, url, provider, board):
    assert values(spark, U.ats_provider, [url]) == [provider] and values(spark, U.ats_board, [url]) == [board]


def test_roles(spark):
    titles = ["Security Engineer", "RN - Night", "IT Manager", "HR Lead", "Pilot", "Baker", "Datacenter hand", None, "cyber security"]
    assert values(spark, T.role_category, titles) == ["security", "medical", "engineering", "admin", "aviation", "other", "other", "other", "security"]
    df = spark.createDataFrame([("Cook", "Kuwait"), ("Cook", None)], "t string, l string")
    assert [r[0] for r in df.select(T.role_category(F.col("t"), F.col("l"))).collect()] == ["overseas", "other"]


def test_names(spark):
    assert values(spark, T.comparable, ["A&B, Inc.", "  Ünit-7 ", None]) == ["a and b inc", "nit 7", ""]
    assert values(spark, lambda x: T.strip_legal(T.comparable(x)), ["Acme Holdings LLC", "Incorporated Ideas Group"]) == ["acme", "ideas"]
    df = spark.createDataFrame([("a big acme b", "acme"), ("acmeco", "acme"), ("", ""), ("x", "")], "t string, p string")
    assert [r[0] for r in df.select(T.contains_phrase(F.col("t"), F.col("p"))).collect()] == [True, False, False, False]
    assert values(spark, T.country_code, ["United States", "de", "Atlantis", None]) == ["US", "DE", None, None]
    assert values(spark, T.city_part, ["Fresno, CA", "Remote, US", ""]) == ["Fresno", None, None]


def test_markup(spark):
    assert values(spark, T.strip_markup, ["<b>A &amp;&nbsp;B</b>\n<i>c</i>", "<![CDATA[x <y>]]>"]) == ["A & B c", "x"]
    got = values(spark, T.anchors, ['<a class=x href="/a?b">One <b>two</b></a><A HREF=\'/c\'>3</A>'])[0]
    assert [(a.href, a.text) for a in got] == [("/a?b", "One two"), ("/c", "3")]


def test_rounding(spark):
    assert values(spark, N.round_half_up, [2.5, -2.5, 0.49, -0.51, None], "double") == [3, -2, 0, -1, None]
    assert values(spark, lambda x: N.round_half_up(x, 3), [1.0005, -1.0005], "double") == [1.001, -1.0]
    assert values(spark, N.non_negative, ["3.9", "-1", None], "string") == [3, 0, 0]
    assert values(spark, N.finite, ["1.5", " ", "x", "NaN", None]) == [1.5, None, None, None, None]
    assert values(spark, N.truthy, ["Yes", "1", "no", None]) == [True, True, False, False]


def fnv(s):
    h = 2166136261
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out


def fold32(s, h, by):
    for c in s:
        h = (h * by + ord(c)) & 0xFFFFFFFF
        h -= (h >= 1 << 31) << 32
    return abs(h)


def test_hashes(spark):
    texts = ["abc", "", "https://example.com/a?b=c", "zz" * 40]
    assert values(spark, N.fnv1a_base36, texts) == [fnv(s) for s in texts] and fnv("abc") == "7aigaz"
    assert values(spark, N.shift31_hash, texts) == [fold32(s, 0, 31) for s in texts]
    assert values(spark, N.djb2_hash, texts) == [fold32(s, 5381, 33) for s in texts]


def test_times(spark):
    d = datetime.datetime
    texts = ["2024-01-05T10:00:00Z", "Fri, 05 Jan 2024 10:00:00 +0000", "1704448800", "1704448800000", "2024-01-05", "soon", None]
    assert values(spark, N.lenient_time, texts) == [d(2024, 1, 5, 10)] * 4 + [d(2024, 1, 5), None, None]
    as_of = F.lit("2024-01-31").cast("timestamp")
    said = ["Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "Posted 9999 Days Ago", "n/a"]
    day = datetime.date
    assert values(spark, lambda x: N.relative_date(x, as_of), said) == [day(2024, 1, 31), day(2024, 1, 30), day(2024, 1, 28), day(2024, 1, 1), day(2024, 1, 31) - datetime.timedelta(3650), None]


def test_json(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    df = spark.createDataFrame([('{"a":1,"b":{"c":2}}', '{"b":null,"d":[1]}'), (None, '{"x":1}')], "a string, b string")
    assert [r[0] for r in df.select(N.merge_json(F.col("a"), F.col("b"))).collect()] == ['{"a":1,"b":null,"d":[1]}', '{"x":1}']
    assert values(spark, lambda x: N.pick(x, "a.b", "c"), ['{"a":{"b":"1"},"c":"2"}', '{"a":{"b":""},"c":"2"}', "{}"]) == ["1", "2", None]
