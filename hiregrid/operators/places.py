"""Place names anywhere in a captured record: its own columns, then whatever its payload says, of any shape.

The payload is read as VARIANT and descended level by level, with array functions in the record's own row: a level's nodes are the children that the
level before asks for, each with the way to it, so nothing is shuffled and the candidates come in the order of a depth-first walk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import column_or_null
from .geo import place_point

# Keys whose values are places, those of an object's city, state and country, words of places in texts and URLs, and where URLs stand.
PLACE_KEYS = r"(?i)(?:location|loc|city|state|province|region|country|address|workplace|work_location|job_location|formattedlocation)"
CITY_KEYS = ("city", "cityName", "job_city", "locationCity", "formattedWorkLocationCity")
STATE_KEYS = ("state", "stateCode", "province", "region", "job_state", "locationState", "formattedWorkLocationState")
COUNTRY_KEYS = ("country", "countryCode", "job_country", "locationCountry", "formattedWorkLocationCountry")
PLACE_WORDS = "remote|hybrid|onsite|united states|usa|kuwait|qatar|bahrain|iraq|germany"
URL_PLACES = "remote|kuwait|qatar|bahrain|iraq|germany|washington|mclean|reston|herndon|arlington|chantilly|norfolk|fort worth|dallas|houston|san antonio|colorado springs|huntsville|orlando|tampa|jacksonville|atlanta|charleston|raleigh|san diego|los angeles|seattle|chicago|new york"
URL_KEYS = ("url", "normalized_apply_url", "job_apply_link", "job_url", "posting_url", "careerPageUrl")
#: Levels below the record, items of an array, keys of an object that is entered whatever its key, and candidates.
DEPTH, ITEMS, SMALL, MOST = 5, 25, 20, 40

_EDGE = r"[-–—,\s]+"


def _clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), f"^{_EDGE}|{_EDGE}$", ""))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, NUMBER or another."""
    told = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(told.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(told)


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _spoken(v: Column) -> Column:
    """A string's or a number's text; null for anything else and for blanks."""
    return F.nullif(F.when(_kind(v).isin("STRING", "NUMBER"), F.trim(_get(v, "string"))), F.lit(""))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *(F.nullif(F.trim(p), F.lit("")) for p in parts)), F.lit(""))


def _like_place(x: Column) -> Column:
    """Whether a text names a place: a word of PLACE_WORDS, or a name, a comma and two capitals; short, and no URL."""
    text = F.trim(x)
    named = text.rlike(rf"(?i)\b(?:{PLACE_WORDS})\b") | text.rlike(r"\b[A-Z][a-zA-Z .'-]+,\s*[A-Z]{2}\b")
    return (text != "") & (F.length(text) <= 140) & ~text.rlike("(?i)^https?://") & named


def _children(depth: int) -> Callable[[Column], Column]:
    """What gives the nodes that a node asks for: items of an array, values of an object under a place's key, and on the first levels its small objects."""
    def of(node: Column) -> Column:
        way, v, kind = node["way"], node["v"], node["kind"]
        child = lambda x, i: F.struct(F.concat(way, F.array(i.cast("int"))).alias("way"), x.alias("v"), _kind(x).alias("kind"))
        items = F.transform(F.slice(_get(v, "array<variant>"), 1, ITEMS), child)
        pairs = F.transform(F.map_entries(_get(v, "map<string,variant>")), lambda e, i: F.struct(e["key"].alias("key"), child(e["value"], i).alias("node")))
        asked = lambda p: F.when(p["key"].rlike(PLACE_KEYS), ~p["node"]["kind"].isin("STRING", "NUMBER")).otherwise(F.lit(depth < 2) & (p["node"]["kind"] == "OBJECT") & (F.size(_get(p["node"]["v"], "map<string,variant>")) <= SMALL))
        values = F.transform(F.filter(pairs, asked), lambda p: p["node"])
        none = F.slice(F.array(node), 2, 1)
        return F.when(kind == "ARRAY", items).when(kind == "OBJECT", values).otherwise(none)

    return of


def _names(node: Column) -> Column:
    """(way, text) of the places that a node names itself: a text like a place; an object's city, state and country, and its texts under a place's key."""
    way, v, kind = node["way"], node["v"], node["kind"]
    said = lambda text, *at: F.struct(F.concat(way, F.array(*(x.cast("int") if isinstance(x, Column) else F.lit(x) for x in at))).alias("way"), text.alias("text"))
    def of_object(held: Column) -> Column:
        pick = lambda keys: F.coalesce(*(_spoken(F.element_at(held, F.lit(k))) for k in keys))
        parts = F.array(F.struct(pick(CITY_KEYS).alias("city"), pick(STATE_KEYS).alias("state"), pick(COUNTRY_KEYS).alias("country")))
        own = F.transform(parts, lambda p: F.array(said(_joined(p["city"], p["state"], p["country"]), -1, 0), said(_joined(p["city"], p["state"]), -1, 1)))
        return F.concat(F.flatten(own), F.transform(F.map_entries(held), lambda e, i: said(F.when(e["key"].rlike(PLACE_KEYS), _spoken(e["value"])), i)))

    # The map is made once, as an array's only element.
    own = F.flatten(F.transform(F.array(_get(v, "map<string,variant>")), of_object))
    text = _get(v, "string")
    none = F.slice(F.array(said(F.lit(""))), 2, 1)
    return F.when(kind == "OBJECT", own).when(kind == "STRING", F.array(said(F.when(_like_place(text), text)))).otherwise(none)


def location_candidates(rows: DataFrame, raw_col: str = "raw_data") -> DataFrame:
    """Adds `candidates`: at most MOST place names of each row, cleaned, each once whatever its case, in order.

    First the columns location, city with state and country, city with state, state, country; then those of the payload (JSON text) by a walk of at
    most DEPTH levels; then places in its URLs. VARIANT keeps keys in alphabetical order, so that is the order of an object's values.

    Defined cases: columns that are missing, null and malformed payloads name nothing; of an array the first ITEMS are read, deeper levels aren't; an empty
    table gives an empty table; other columns are returned untouched.
    """
    c = lambda name: F.trim(column_or_null(rows, name).cast("string"))
    own = F.array(c("location"), _joined(c("city"), c("state"), c("country")), _joined(c("city"), c("state")), c("state"), c("country"))
    root = F.try_parse_json(column_or_null(rows, raw_col).cast("string"))
    out = rows.select(F.struct("*").alias("_row"), root.alias("_raw"), own.alias("_own"))
    nothing = F.array().cast("array<int>")
    out = out.withColumn("_n0", F.when(F.schema_of_variant("_raw").rlike("^(?:OBJECT|ARRAY)"), F.array(F.struct(nothing.alias("way"), F.col("_raw").alias("v"), _kind(F.col("_raw")).alias("kind")))))
    for depth in range(DEPTH):
        out = out.withColumn(f"_n{depth + 1}", F.flatten(F.transform(f"_n{depth}", _children(depth))))
    # Nodes of a level without any are null where the payload is.
    nodes = F.coalesce(F.concat(*(f"_n{d}" for d in range(DEPTH + 1))), F.slice("_n0", 2, 1))
    told = F.coalesce(F.flatten(F.transform(nodes, _names)), F.slice(F.array(F.struct(nothing.alias("way"), F.lit("").alias("text"))), 2, 1))
    out = out.withColumn("_told", F.transform(F.array_sort(F.filter(told, lambda x: x["text"].isNotNull())), lambda x: x["text"]))

    def in_url(key: str) -> Column:
        v = F.try_variant_get("_raw", f"$.{key}", "variant")
        url = F.when(_kind(v) == "STRING", _get(v, "string"))
        return F.nullif(F.regexp_extract(F.regexp_replace(F.lower(F.coalesce(F.try_url_decode(url), url)), r"[+_%/-]+", " "), f"({URL_PLACES})", 1), F.lit(""))

    every = F.concat("_own", "_told", F.array(*map(in_url, URL_KEYS)))
    out = out.withColumn("_every", F.filter(F.transform(F.array_compact(every), _clean), lambda x: x != ""))
    # The first of names that differ in case only.
    small = F.transform("_every", lambda x: F.lower(x))
    first = F.filter(F.transform(F.array_distinct(small), lambda x: F.element_at(F.col("_every"), F.array_position(small, x).cast("int"))), lambda x: F.length(x) >= 2)
    return out.select("_row.*", F.slice(first, 1, MOST).alias("candidates"))


def locate_by_candidates(rows: DataFrame, raw_col: str = "raw_data") -> DataFrame:
    """Adds `candidates`, and the point (point_lat, point_lng) and name (point_name) of the first candidate that has one."""
    found = location_candidates(rows, raw_col)
    points = F.transform("candidates", lambda x: F.struct(x.alias("name"), place_point(x).alias("p")))
    found = found.select(F.struct("*").alias("_row"), F.get(F.filter(points, lambda x: x["p"].isNotNull()), F.lit(0)).alias("_p"))
    return found.select("_row.*", F.col("_p.p.lat").alias("point_lat"), F.col("_p.p.lng").alias("point_lng"), F.col("_p.name").alias("point_name"))
