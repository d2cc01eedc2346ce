"""Points of jobs from place names: a small dictionary, precedence of sources, quality labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import column_or_null

# Places with their points, in the order in which they are tried.
POINTS = [
    ("washington, dc", 38.9072, -77.0369), ("mclean, va", 38.9339, -77.1773), ("reston, va", 38.9586, -77.3570), ("herndon, va", 38.9696, -77.3861), ("falls church, va", 38.8823, -77.1711),
    ("arlington, va", 38.8816, -77.0910), ("chantilly, va", 38.8943, -77.4311), ("norfolk, va", 36.8508, -76.2859), ("fort worth, tx", 32.7555, -97.3308), ("dallas, tx", 32.7767, -96.7970),
    ("houston, tx", 29.7604, -95.3698), ("san antonio, tx", 29.4252, -98.4946), ("colorado springs, co", 38.8339, -104.8214), ("huntsville, al", 34.7304, -86.5861), ("orlando, fl", 28.5383, -81.3792),
    ("tampa, fl", 27.9506, -82.4572), ("jacksonville, fl", 30.3322, -81.6557), ("atlanta, ga", 33.7490, -84.3880), ("charleston, sc", 32.7765, -79.9311), ("raleigh, nc", 35.7796, -78.6382),
    ("san diego, ca", 32.7157, -117.1611), ("los angeles, ca", 34.0522, -118.2437), ("seattle, wa", 47.6062, -122.3321), ("chicago, il", 41.8781, -87.6298), ("new york, ny", 40.7128, -74.0060),
    ("kuwait", 29.3759, 47.9774), ("qatar", 25.2854, 51.5310), ("bahrain", 26.2235, 50.5876), ("iraq", 33.3152, 44.3661), ("germany", 50.1109, 8.6821), ("remote", 39.8283, -98.5795),
]
STATE_POINTS = [
    ("va", 37.7693, -78.1700), ("tx", 31.0545, -97.5635), ("fl", 27.7663, -81.6868), ("ca", 36.1162, -119.6816), ("co", 39.0598, -105.3111),
    ("al", 32.8067, -86.7911), ("ga", 33.0406, -83.6431), ("sc", 33.8569, -80.9450), ("nc", 35.6301, -79.8064), ("dc", 38.9072, -77.0369),
]
#: Where employers sit, for jobs that name no place.
ENTITY_POINTS = [("v2x", "mclean, va"), ("vectrus", "mclean, va"), ("vertex", "mclean, va"), ("amentum", "chantilly, va"), ("peraton", "reston, va"), ("leidos", "reston, va"), ("caci", "reston, va"), ("gdit", "falls church, va")]


def _clean(x: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit("."), F.lit("")), r"\s+", " ")


def _point(lat: float, lng: float, note: Column | str) -> Column:
    return F.struct(F.lit(lat).alias("lat"), F.lit(lng).alias("lng"), (F.lit(note) if isinstance(note, str) else note).alias("note"))


def place_point(name: Column) -> Column:
    """struct(lat, lng, note) of a place by its whole name, else of the first known place in it, else of its state alone; else null."""
    states = F.create_map(*(x for state, lat, lng in STATE_POINTS for x in (F.lit(state), _point(lat, lng, "state fallback"))))
    known = F.array(*(F.struct(F.lit(place).alias("name"), _point(lat, lng, "job location").alias("p")) for place, lat, lng in POINTS))

    def of(place: Column) -> Column:
        return F.coalesce(F.get(F.filter(known, lambda k: place.contains(k["name"])), F.lit(0))["p"], F.element_at(states, place))

    return F.get(F.transform(F.array(_clean(name)), of), F.lit(0))


def infer_point(jobs: DataFrame) -> Column:
    """struct(lat, lng, note) by: remote, city and state, the place, a place named inside it, the state, the country, the employer's seat; else null."""
    city, state, place, country = (_clean(column_or_null(jobs, c)) for c in ("city", "state", "location", "country"))
    entity = _clean(column_or_null(jobs, "entity_name"))
    table = lambda rows, note: F.create_map(*(x for name, lat, lng in rows for x in (F.lit(name), _point(lat, lng, note))))
    places, states = table(POINTS, "job location"), table(STATE_POINTS, "state fallback")
    lookup = dict((name, (lat, lng)) for name, lat, lng in POINTS)
    inside, seat = F.lit(None), F.lit(None)
    for name, lat, lng in reversed(POINTS):
        inside = F.when(place.contains(name), _point(lat, lng, "job location")).otherwise(inside)
    for name, at in reversed(ENTITY_POINTS):
        seat = F.when(entity.contains(name), _point(*lookup[at], "entity fallback")).otherwise(seat)
    return F.coalesce(
        F.when(column_or_null(jobs, "is_remote", "boolean"), _point(*lookup["remote"], "remote fallback")), F.when((city != "") & (state != ""), F.element_at(places, F.concat(city, F.lit(", "), state))),
        F.element_at(places, place), inside, F.element_at(states, state), F.element_at(places, country), seat,
    )


def locate(jobs: DataFrame, geocoded: DataFrame | None = None) -> DataFrame:
    """Adds point_lat, point_lng, location_quality: the source's own point (never 0, 0), an inferred one that is no fallback, the geocoder's cached one, then a fallback.

    `geocoded`: query_key (cleaned place), lat, lng. It is a lookup; Spark broadcasts it if it is small.
    """
    rows = jobs.withColumn("_inferred", infer_point(jobs)).withColumn("_key", _clean(column_or_null(jobs, "location")))
    if geocoded is not None:
        known = geocoded.select(F.col("query_key").alias("_q"), F.col("lat").alias("_glat"), F.col("lng").alias("_glng"))
        rows = rows.join(known, F.col("_key") == F.col("_q"), "left")
    else:
        rows = rows.withColumns({"_q": F.lit(None).cast("string"), "_glat": F.lit(None).cast("double"), "_glng": F.lit(None).cast("double")})
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    exact = F.col("_inferred").isNotNull() & ~F.coalesce(F.col("_inferred.note").contains("fallback"), F.lit(False))
    pick = lambda own_c, i, g: F.when(own, F.col(own_c).cast("double")).when(exact, F.col(f"_inferred.{i}")).when(F.col(g).isNotNull(), F.col(g)).otherwise(F.col(f"_inferred.{i}"))
    quality = F.when(own, "source_coordinates").when(exact, F.col("_inferred.note")).when(F.col("_glat").isNotNull(), "geocoded").when(F.col("_inferred").isNotNull(), F.col("_inferred.note")).otherwise("unmapped_no_job_location")
    return rows.withColumns({"point_lat": pick("lat", "lat", "_glat"), "point_lng": pick("lng", "lng", "_glng"), "location_quality": quality}).drop("_inferred", "_key", "_q", "_glat", "_glng")


def valid_coordinate(lat: Column, lng: Column) -> Column:
    """Within the globe and not (0, 0); a null counts as 0."""
    a, b = F.coalesce(lat.cast("double"), F.lit(0.0)), F.coalesce(lng.cast("double"), F.lit(0.0))
    return (F.abs(a) <= 90) & (F.abs(b) <= 180) & ~((a == 0) & (b == 0)) & ~F.isnan(a) & ~F.isnan(b)


def map_locations(jobs: DataFrame, keys: tuple[str, ...] = ("entity_name", "portal"), include_fallback: bool = True, digits: int = 4) -> DataFrame:
    """Places of jobs on the map, with their number: by point, city, state, country, the keys, and whether the point is a fallback.

    A stored point that raw_data calls a fallback, or none of the job, isn't taken for the source's: it is inferred again, and so are its city and
    state. Other jobs keep their source's point and are inferred only without one. Jobs without any point aren't on the map.
    """
    raw = lambda path: F.lower(F.coalesce(F.get_json_object(column_or_null(jobs, "raw_data"), path), F.lit("")))
    stored = raw("$.normalized_location_quality")
    rows = jobs.withColumn("_was", stored.contains("fallback") | stored.contains("unmapped_no_job_location") | ~raw("$.normalized_fallback_point").isin("", "false", "0", "null")).withColumn("_point", infer_point(jobs))
    own = ~F.col("_was") & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    at = lambda c: F.when(own, F.col(c).cast("double")).otherwise(F.col(f"_point.{c}"))
    note = F.coalesce(F.col("_point.note"), F.when(F.col("_was"), "entity fallback").when(own, "source coordinates").otherwise("location match"))
    kept = lambda c: F.coalesce(F.when(~F.col("_was"), column_or_null(jobs, c)), F.lit(""))
    rows = rows.withColumns({"_lat": at("lat"), "_lng": at("lng"), "_note": note}).where(F.col("_lat").isNotNull() & F.col("_lng").isNotNull())
    rows = rows.withColumn("is_fallback", F.col("_note").contains("fallback"))
    if not include_fallback:
        rows = rows.where(~F.col("is_fallback"))
    groups = [kept("city").alias("city"), kept("state").alias("state"), F.coalesce(column_or_null(jobs, "country"), F.lit("US")).alias("country"), F.round("_lat", digits).alias("lat_key"), F.round("_lng", digits).alias("lng_key")]
    return rows.groupBy(*keys, *groups, "is_fallback").agg(F.count(F.lit(1)).alias("n_jobs"), F.min_by("_note", "id").alias("location_quality"))
