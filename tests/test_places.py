"""Place candidates against a plain recursive walk."""

from __future__ import annotations

import json
import random
import re
import urllib.parse

from hiregrid.operators import places as P


def clean(x):
    return re.sub(r"^[-–—,\s]+|[-–—,\s]+$", "", re.sub(r"\s+", " ", x)).strip()


def plain(row: dict) -> list[str]:
    found = []
    joined = lambda *x: ", ".join(p.strip() for p in x if isinstance(p, str) and p.strip())
    spoken = lambda v: str(v).strip() or None if isinstance(v, str | int | float) and not isinstance(v, bool) else None
    pick = lambda o, keys: next((s for k in keys if k in o and (s := spoken(o[k]))), None)

    def like(x):
        t = x.strip()
        return bool(t) and len(t) <= 140 and not re.match("(?i)https?://", t) and bool(re.search(rf"(?i)\b(?:{P.PLACE_WORDS})\b", t) or re.search(r"\b[A-Z][a-zA-Z .'-]+,\s*[A-Z]{2}\b", t))

    def scan(v, depth):
        if depth > P.DEPTH:
            return
        if isinstance(v, str) and like(v):
            found.append(v)
        elif isinstance(v, list):
            for x in v[: P.ITEMS]:
                scan(x, depth + 1)
        elif isinstance(v, dict):
            city, state, country = (pick(v, k) for k in (P.CITY_KEYS, P.STATE_KEYS, P.COUNTRY_KEYS))
            found.extend([joined(city, state, country), joined(city, state)])
            for k in sorted(v):
                if re.search(P.PLACE_KEYS, k):
                    if s := spoken(v[k]):
                        found.append(s)
                    elif not isinstance(v[k], str | int | float) or isinstance(v[k], bool):
                        scan(v[k], depth + 1)
                elif depth < 2 and isinstance(v[k], dict) and len(v[k]) <= P.SMALL:
                    scan(v[k], depth + 1)

    c = {k: v.strip() if isinstance(v, str) else v for k, v in row.items()}
    found += [c["location"] or "", joined(c["city"], c["state"], c["country"]), joined(c["city"], c["state"]), c["state"] or "", c["country"] or ""]
    try:
        raw = json.loads(row["raw_data"]) if row["raw_data"] else None
    except ValueError:
        raw = None
    if isinstance(raw, dict | list):
        scan(raw, 0)
    for key in P.URL_KEYS:
        if isinstance(raw, dict) and isinstance(raw.get(key), str):
            m = re.search(P.URL_PLACES, re.sub("[+_%/-]+", " ", urllib.parse.unquote_plus(raw[key]).lower()))
            found.append(m[0] if m else "")
    out = {}
    for x in map(clean, found):
        if x:
            out.setdefault(x.lower(), x)
    return [x for x in out.values() if len(x) >= 2][: P.MOST]


def made(rng: random.Random, depth: int = 0):
    kind = rng.random()
    texts = ["Reston, VA", "remote", "see https", "https://x.com/remote", "Kuwait City", "a", " Rome ", "", "- Dallas -", "x" * 150 + " remote", "new  york", "REMOTE"]
    if depth > 7 or kind < 0.3:
        return rng.choice([*texts, None, True, 7])
    if kind < 0.5:
        return [made(rng, depth + 1) for _ in range(rng.choice([0, 1, 3, 30]))]
    keys = ["city", "cityName", "state", "stateCode", "country", "location", "job_location", "address", "meta", "data", "other", "LOC", "region"]
    return {rng.choice(keys) + (str(i) if rng.random() < 0.1 else ""): made(rng, depth + 1) for i in range(rng.choice([0, 1, 3, 6]))}


def test_candidates_equal_a_recursive_walk(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        raw = made(rng)
        if isinstance(raw, dict) and rng.random() < 0.5:
            raw[rng.choice(P.URL_KEYS)] = rng.choice(["https://x.com/jobs/fort-worth%2Ctx", "https://x.com/San_Diego", "https://x.com/%zz/remote", 5])
        text = rng.choice([None, "{bad", '"remote"', json.dumps(raw), json.dumps(raw), json.dumps(raw), json.dumps(raw)])
        rows.append((i, *(rng.choice([None, "", " Reston ", "VA", "remote", "x"]) for _ in range(4)), text))
    deep = {"location": "L0"}
    for k in range(8):
        deep = {"location": {"location": f"L{k + 1}", "address": deep}}
    rows.append((900, None, None, None, None, json.dumps(deep)))
    rows.append((901, None, None, None, None, json.dumps({"data": {f"k{i}": {"city": f"C{i}"} for i in range(21)}, "meta": {f"k{i}": {"city": f"D{i}"} for i in range(20)}, "locations": [f"Town{chr(97 + i % 26)}{chr(97 + i // 26)}, VA" for i in range(60)]})))
    names = ["id", "location", "city", "state", "country", "raw_data"]
    df = spark.createDataFrame(rows, "id long, location string, city string, state string, country string, raw_data string")
    got = {r.id: r.candidates for r in P.location_candidates(df).collect()}
    want = {r[0]: plain(dict(zip(names, r, strict=True))) for r in rows}
    assert got == want
    assert max(map(len, want.values())) == P.MOST and sum(len(x) > 3 for x in want.values()) > 40


def test_awkward_frames(spark):
    df = spark.createDataFrame([(1, '{"location": "Reston, VA"}', "x"), (2, None, "y")], "id long, raw_data string, _raw string")
    assert sorted((r.id, r._raw, r.candidates) for r in P.location_candidates(df.withColumnRenamed("_raw", "keep").withColumnRenamed("keep", "_raw")).collect()) == [(1, "x", ["Reston, VA"]), (2, "y", [])]
    assert P.location_candidates(df.limit(0)).count() == 0
    got = {r.id: (r.point_name, r.point_lat) for r in P.locate_by_candidates(df.drop("_raw")).collect()}
    assert got == {1: ("Reston, VA", 38.9586), 2: (None, None)}
