"""Exact fuzzy joins against the scores of all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hiregrid.operators import matching, registry

COMMON = "federal regional operations service center office of the bureau department state us u.s. commission national".split()
RARE = "alpha bravo delta parks fish wildlife mint census navy coast oak elm transport aviation".split()


def made(rng: random.Random, n: int, aliases: bool = False) -> list[tuple]:
    def name() -> str:
        words = [rng.choice(COMMON) for _ in range(rng.randint(0, 4))] + [rng.choice(RARE) for _ in range(rng.randint(0, 3))]
        rng.shuffle(words)
        if words and rng.random() < 0.2:
            words.append(rng.choice(words))
        text = rng.choice([" ", "  ", "-", " & "]).join(words) + rng.choice(["", ".", ", Inc", " LLC", " Group"])
        return text.title() if rng.random() < 0.5 else text

    return [(i, name(), [name() for _ in range(rng.randint(0, 2))] if rng.random() < 0.5 else None) if aliases else (i, name()) for i in range(n)]


@pytest.mark.parametrize("minimum", [82, 90, 60])
def test_agencies_equal_all_pairs(spark, minimum):
    rng = random.Random(minimum)
    asked = [*made(rng, 120, True), (900, None, None), (901, " ", [None, "Fish and Wildlife Service"]), (902, "Department of the", None), (903, "center", None), (903, "center", None)]
    listed = [*made(rng, 150), (500, None), (501, "--"), (502, "Department of the"), (7, "navy navy navy coast")]
    q, a = spark.createDataFrame(asked, "query_id long, query string, aliases array<string>"), spark.createDataFrame(listed, "id long, name string")
    names = q.withColumn("_n", F.explode(F.concat(F.array("query"), F.coalesce("aliases", F.array().cast("array<string>")))))
    scored = names.crossJoin(a).withColumn("score", registry.agency_score(F.col("_n"), F.col("name"))).where(F.col("score") >= minimum).where(F.length(F.trim("name")) > 0)
    want = {}
    for r in scored.collect():
        key = (-r.score, len(r["name"]), r.id)
        want[r.query_id] = min(want.get(r.query_id, key), key)
    got = matching.resolve_agencies(q, a, minimum).collect()
    assert {r.query_id: (-r.score, len(r["name"]), r.id) for r in got} == want and len(want) > 40
    assert len(got) == len(want) + (903 in want)


@pytest.mark.parametrize("minimum", [0.82, 0.95, 0.5])
def test_contractors_equal_all_pairs(spark, minimum):
    rng = random.Random(int(minimum * 100))
    entities = [(i, [n, *(more or [])]) for i, n, more in made(rng, 90, True)] + [(700, None), (701, []), (702, [None, ""]), (703, ["Inc."]), (704, ["viation cen"])]
    listed = [*made(rng, 130), (500, None), (501, "!"), (502, "LLC"), (503, " ".join(RARE + ["x1x", "y1y", "z1z"])), (504, " ".join(RARE[1:]))]
    e, c = spark.createDataFrame(entities, "id long, names array<string>"), spark.createDataFrame(listed, "id long, name string")
    scored = e.withColumnRenamed("id", "entity").crossJoin(c).withColumn("score", registry.contractor_score(F.col("names"), F.col("name"))).where(F.col("score") >= minimum)
    want = {}
    for r in scored.collect():
        key = (-round(r.score, 9), r.id)
        want[r.entity] = min(want.get(r.entity, key), key)
    got = {r.entity_id: (-round(r.score, 9), r.id) for r in matching.resolve_contractors(e, c, minimum).collect()}
    assert got == want and len(want) > 5


def test_common_words_bring_no_lists(spark):
    """Thousands of agencies of the same few words; a query of nothing but those finds its equal."""
    names = [f"service center {i}" for i in range(601)] + [f"{w} x{i}" for w in ("federal", "regional", "operations") for i in range(600)]
    names.append("Federal Service Center of Regional Operations")
    a = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    q = spark.createDataFrame([(1, "The Federal Service Center of Regional Operations"), (2, "service center of x5 federal regional operations")], "query_id long, query string")
    got = {r.query_id: (r["name"], r.score) for r in matching.resolve_agencies(q, a).collect()}
    assert got[1] == (names[-1], 97) and got[2][1] >= 82
    assert matching.resolve_agencies(q.limit(0), a).count() == 0 and matching.resolve_agencies(q, a.limit(0)).count() == 0


def test_bounds_are_told():
    with pytest.raises(ValueError):
        matching.agency_matches(None, None, 40)
    with pytest.raises(ValueError):
        matching.contractor_matches(None, None, 0)


STEMS = "fresno orange san sanger santa lake new newport park oak".split()
KINDS = {"county": "county", "municipality": "city", "township": "township", "state": "state agency", "special_district": "district"}
REGISTRY = "id string, name string, canonical_name string, government_type string, state_code string, is_active boolean"


def _government_score(asked: str, portal: str, name: str, kind: str, code: str | None) -> tuple[int, int] | None:
    """Score and minimum's kind (1 if typed) of one pair, plainly; None where the row is no candidate. Names are small letters and spaces, a state comes as `, XX`."""
    state = asked[-2:] if asked[-4:-2] == ", " else None
    canon, low = asked.lower().replace(",", ""), asked.lower()
    token = next((t for t in canon.split() if len(t) >= 3 and t not in registry.STOP_WORDS), None)
    if token is None or kind not in registry.PORTAL_TYPES[portal] or token not in name:
        return None
    told = low.replace(",", "").split()
    hint = next((k for k, words in (("county", ["county"]), ("municipality", ["city"]), ("township", ["town", "township"]), ("state", ["state"] * (portal == "state_agencies"))) if any(w in told for w in words)), None)
    a, b = ({t for t in x.split() if len(t) >= 2 and t not in registry.STOP_WORDS} for x in (canon, name))
    score = 100 if canon == name else int(len(a & b) / max(len(a | b), 1) * 80 + 0.5) + 15 * (canon in name or name in canon)
    score += 0 if state is None or code is None else 20 if code == state else -15
    score += 0 if hint is None else 15 if kind == hint else -8
    return score, int(hint is not None and portal == registry.LOCAL)


@pytest.mark.parametrize("minimum", [(75, 65), (51, 51), (90, 99), (20, 30), (0, 0)])
def test_governments_equal_all_pairs(spark, minimum):
    """Every row that holds the token is a candidate, whatever the minimum; ties of two ids give nothing, repeated rows and queries count once and are all answered."""
    rng = random.Random(sum(minimum))

    def name(kind: str) -> str:
        told = [rng.choice(STEMS) for _ in range(rng.randint(0, 3))] + [rng.choice([KINDS[kind], KINDS[kind], "", "of the", f"no {rng.randint(1, 9)}"])]
        return " ".join(t for t in told if t)

    kinds = list(KINDS)
    listed = [(f"{i:03d}", name(k), None, k, rng.choice(["CA", "TX", None]), True) for i in range(260) for k in [rng.choice(kinds)]]
    listed += [*listed[:20], ("900", "fresno county", None, "county", "CA", False), ("901", None, None, "county", "CA", True), ("902", "sanger park lake county", None, None, "CA", True)]
    asked = [(i, name(rng.choice(kinds)) + rng.choice(["", "", ", CA", ", TX"]), rng.choice(list(registry.PORTAL_TYPES))) for i in range(150)]
    asked += [asked[0], (700, None, "state_agencies"), (701, "county of the", registry.LOCAL), (702, "", registry.LOCAL), (703, "nowhere county", registry.LOCAL), (704, asked[1][1], None)]
    want = {}
    for key, query, portal in asked:
        found = set()
        for id_, n, _, kind, code, active in listed if query else []:
            scored = _government_score(query, portal or registry.LOCAL, n or "", kind, code) if active and kind else None
            if scored and scored[0] >= minimum[scored[1]]:
                found.add((scored[0], id_, n))
        top = [f for f in found if f[0] == max(f[0] for f in found)]
        if len(top) == 1:
            want[key] = (query, top[0][1], top[0][2], top[0][0])
    reg = spark.createDataFrame(listed, REGISTRY).repartition(3)
    got = registry.resolve_registry(spark.createDataFrame(asked, "query_id long, query string, portal string"), reg, *minimum).collect()
    assert {r.query_id: tuple(r)[1:] for r in got} == want and len(want) > 5
    assert len(got) == len(want) + (asked[0][0] in want)


def test_the_longest_of_many_names_is_found(spark):
    """Four hundred shorter names with the token, of the same kind and state, don't crowd out the one that is meant."""
    rows = [(f"9{k:03d}", f"San {k:03d}", None, "county", "TX", True) for k in range(400)] + [("1", "San Longertown County", None, "county", "TX", True)]
    q = spark.createDataFrame([(0, "San Longertown County, TX")], "query_id int, query string")
    assert [tuple(r) for r in registry.resolve_registry(q, spark.createDataFrame(rows, REGISTRY)).collect()] == [(0, "San Longertown County, TX", "1", "San Longertown County", 103)]
