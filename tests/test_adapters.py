"""Adapters as rows of a table, against a plain reading of each payload."""

from __future__ import annotations

import json
import random
import urllib.parse

from hiregrid.sources import adapters as A

TABLE = "adapter string, host string, path string, source string, params map<string,string>, results_path string, keys map<string,array<string>>, enabled boolean"


def at(value, way):
    for key in way.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def rows_of(payload, preferred):
    for way in ([preferred] if preferred else []) + list(A.ROW_PATHS):
        if isinstance(found := at(payload, way), list):
            return found
    return payload if isinstance(payload, list) else []


def text_of(row, keys):
    value = next((v for k in keys if (v := at(row, k)) is not None and v != ""), None)
    if isinstance(value, bool):
        return str(value).lower()
    return str(value).strip() or None if isinstance(value, str | int) else None


def hashed(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def plain(pages, table):
    known = {t[0]: t for t in table if t[1].strip() and t[2] and t[7] is not False}
    out = {}
    for name, entity, payload in pages:
        if name not in known:
            continue
        _, _, _, source, _, preferred, keys, _ = known[name]
        source = source or f"jobapi:{name}"
        try:
            payload = json.loads(payload or "")
        except ValueError:
            continue
        for i, row in enumerate(rows_of(payload, preferred)):
            f = lambda k: text_of(row, [*(keys or {}).get(k, []), *A.FIELD_KEYS[k]])  # noqa: B023, E731
            if not (title := f("title")):
                continue
            country = f("country") or "US"
            place = f("location") or ", ".join(x for x in (f("city"), f("state"), country) if x)
            key = f("external_id") or f"generated-{hashed(f'{source}:{entity}:{title}:{place}:' + (f('apply_url') or str(i)))}"
            remote = (f("is_remote") or "").lower() in ("true", "1", "yes", "y") or "remote" in f"{title} {place}".lower().replace(",", " ").split()
            out.setdefault((entity, source, key), (title, f("department") or f("employer"), place, country.upper(), remote, country.upper() != "US", f("apply_url")))
    return out


def table():
    rows = [(f"a{k}", f"https://h{k}.example.org/x", "search", f"jobapi:a{k}", {"query": "{entity} jobs"}, [None, "page.rows", "data.jobs", "not[a]way"][k % 4], None, None) for k in range(20)]
    rows[7] = (*rows[7][:6], {"title": ["role.text"], "external_id": ["role.no"]}, True)
    return [*rows, ("off", "h.example.org", "/s", "jobapi:off", None, None, None, False), ("hostless", " ", "/s", "jobapi:none", None, None, None, None), ("own", "h.example.org", "/s", None, None, None, None, None)]


def payload(rng):
    value = lambda key: rng.choice([f"{key} {rng.randint(1, 9)}", rng.randint(1, 9), "", " ", None, True, {"a": 1}, "Remote, work"])
    every = sorted({k for keys in A.FIELD_KEYS.values() for k in keys} - {*A.FIELD_KEYS["lat"], *A.FIELD_KEYS["lng"], *A.FIELD_KEYS["posted_at"]})
    item = lambda: rng.choice([7, "x", None, []]) if rng.random() < 0.1 else {"role": {"text": "Own title", "no": rng.randint(1, 3)}} | {k: value(k) for k in rng.sample(every, rng.randint(0, 12))}
    items = [item() for _ in range(rng.randint(0, 5))]
    for key in reversed(rng.choice([*A.ROW_PATHS, "page.rows", ""]).split(".")):
        items = {key: items, "total": 3} if key else items
    if isinstance(items, dict) and rng.random() < 0.3:
        items["data"] = rng.choice([[item()], "none", items.get("data")])
    return json.dumps(items)


def test_equal_plain_reading(spark):
    rng = random.Random(17)
    known = table()
    pages = [(rng.choice(known)[0], f"e{i}", payload(rng)) for i in range(400)]
    pages += [("a0", "e-null", None), ("a1", "e-bad", "{"), ("a2", "e-zero", "[]"), ("nobody", "e-x", "[]")]
    df = spark.createDataFrame(pages, "adapter string, entity_name string, payload string").repartition(3)
    adapters = spark.createDataFrame(known, TABLE)
    got = A.adapter_jobs(df, adapters).collect()
    want = plain(pages, known)
    assert len(want) > 150 and len({k[1] for k in want}) == 21
    assert {(r.entity_name, r.source, r.external_id): (r.title, r.department, r.location, r.country, r.is_remote, r.is_overseas, r.apply_url) for r in got} == want
    assert len(got) == len(want)
    use = {(r.entity_name, r.source): (r.used, r.note) for r in A.adapter_use(df, adapters).collect()}
    assert use[("e-bad", "jobapi:a1")] == (False, "jobapi:a1 (0 jobs returned)") and ("e-x", "nobody") not in use
    assert {k for k, (used, _) in use.items() if used} == {k[:2] for k in want}


def test_a_new_adapter_is_a_row(spark):
    pages = spark.createDataFrame([("new", '{"deep":{"er":[{"Titel":{"de":"Arbeit"},"nr":12,"posted_at":1700000000,"lat":"48.5"},{"nr":12,"title":"again"}]}}')], "adapter string, payload string")
    row = ("new", "h.example.org", "/s", None, None, "deep.er", {"title": ["Titel.de"], "external_id": ["nr"]}, None)
    (job,) = A.adapter_jobs(pages, spark.createDataFrame([row], TABLE)).collect()
    assert (job.external_id, job.source, job.title, job.location, job.lat) == ("12", "jobapi:new", "Arbeit", "US", 48.5)
    assert job.posted_at.year == 2023
    assert A.adapter_jobs(pages, spark.createDataFrame([], TABLE)).count() == 0


def test_requests(spark):
    rows = [("x", "HTTPS://api.example.org/v1", "find", None, {"q": "{entity} jobs", "as": "{alias}", "where": "{location}", "n": "{limit}", "c": "{category}"}, None, None, None), ("bare", "b.example.org", "/all", None, None, None, None, None)]
    asked = spark.createDataFrame([("x", "Town & Co", ["TC é"], None), ("x", "Alone", [], "it"), ("bare", "Alone", None, None), ("unknown", "Alone", None, None)], "adapter string, entity_name string, aliases array<string>, category string")
    got = {(r.adapter, r.entity_name): r.url for r in A.requests(asked, spark.createDataFrame(rows, TABLE)).collect()}
    assert len(got) == 3 and got[("bare", "Alone")] == "https://b.example.org/all"
    ask = lambda url: (url.split("?")[0], dict(urllib.parse.parse_qsl(url.split("?")[1])))
    assert ask(got[("x", "Town & Co")]) == ("https://api.example.org/find", {"q": "Town & Co jobs", "as": "TC é", "n": "25"})
    assert ask(got[("x", "Alone")]) == ("https://api.example.org/find", {"q": "Alone jobs", "as": "Alone", "n": "25", "c": "it"})
