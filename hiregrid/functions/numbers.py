"""Number, date, JSON and hash recipes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import filled, once


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half toward positive infinity, also for negative numbers."""
    scale = F.lit(10.0**digits)
    out = F.floor(x * scale + 0.5)
    return out.cast("long") if not digits else out / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def non_negative(x: Column) -> Column:
    """A finite positive number's floor, else 0."""
    n = x.cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n) & (n > 0) & (n < float("inf")), F.floor(n)).otherwise(F.lit(0)).cast("long")


def truthy(x: Column) -> Column:
    """true, 1, yes and y in any case."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def finite(x: Column) -> Column:
    """A finite number or null; a blank text is null."""
    return once(filled(F.trim(x.cast("string"))).try_cast("double"), lambda n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n))


def fnv1a_base36(x: Column) -> Column:
    """32-bit FNV-1a of the characters, unsigned, in base 36."""
    code = lambda c: F.ascii(c).cast("long")
    mixed = F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), lambda h, c: ((h.bitwiseXOR(code(c))) * 16777619).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(mixed.cast("string"), 10, 36))


def _int32(x: Column) -> Column:
    low = x.bitwiseAND(F.lit(4294967295))
    return F.when(low >= 2147483648, low - 4294967296).otherwise(low)


def shift31_hash(x: Column) -> Column:
    """31 * h + c in signed 32 bits, as an absolute value."""
    return F.abs(F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: _int32(h * 31 + F.ascii(c).cast("long"))))


def djb2_hash(x: Column) -> Column:
    """33 * h + c from 5381 in signed 32 bits, as an absolute value."""
    return F.abs(F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(5381).cast("long"), lambda h, c: _int32(h * 33 + F.ascii(c).cast("long"))))


def short_sha1(*parts: Column) -> Column:
    """24 hex digits of the SHA-1 of parts joined by a bar."""
    return F.substring(F.sha1(F.concat_ws("|", *parts).cast("binary")), 1, 24)


def relative_date(text: Column, as_of: Column) -> Column:
    """`Posted Today`, `Posted Yesterday`, `Posted 3 Days Ago`, `Posted 30+ Days Ago`; at most 3650 days back, else null."""
    low = F.lower(text)
    days = F.nullif(F.regexp_extract(low, r"(\d+)\+?\s*day", 1), F.lit("")).cast("int")
    return F.when(low.contains("today") | low.contains("just posted"), F.to_date(as_of)).when(low.contains("yesterday"), F.date_sub(F.to_date(as_of), 1)).when(days.isNotNull(), F.date_sub(F.to_date(as_of), F.least(days, F.lit(3650))))


# Formats in which payloads write times, each with signs that every text in it has, so that others aren't tried in vain.
TIME_FORMATS = (
    ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", r"[Tt].*:.*(?:[Zz]|[+-]\d\d:\d\d)$"), ("yyyy-MM-dd'T'HH:mm:ss[.SSS]", "[Tt].*:"), ("yyyy-MM-dd HH:mm:ss", " .*:"), ("d MMM yyyy HH:mm:ss Z", " .*:"), ("d MMM yyyy HH:mm:ss z", " .*:"), ("yyyy-MM-dd", "^[^:]*-[^:]*$"),
    ("MM/dd/yyyy", "/"), ("MMM d, yyyy", ","),
)


def lenient_time(x: Column) -> Column:
    """ISO, RFC-1123, common date forms, or epoch seconds or milliseconds; null if none."""

    def read(text: Column) -> Column:
        epoch = F.when(text.rlike(r"^\d{9,13}$"), text.cast("double"))
        return F.coalesce(F.timestamp_millis(F.when(epoch >= 1e11, epoch).otherwise(epoch * 1000).cast("long")), *(F.when(text.rlike(f"(?s){signs}"), F.try_to_timestamp(text, F.lit(f))) for f, signs in TIME_FORMATS))

    return once(F.regexp_replace(F.trim(x.cast("string")), r"^[A-Za-z]{3,9},\s+", ""), read)


def pick(json: Column, *paths: str) -> Column:
    """The first path of a JSON text whose value isn't null or blank."""
    return F.coalesce(*(filled(F.get_json_object(json, f"$.{p}")) for p in paths))


def merge_json(left: Column, right: Column) -> Column:
    """Shallow merge of JSON objects: the right side wins, also with an explicit null. Wants spark.sql.mapKeyDedupPolicy=LAST_WIN."""
    read = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>")
    return F.to_json(F.map_concat(read(left), read(right)))


# Yes-or-no fields of the enrichment's answer.
ENRICHMENT_FLAGS = (
    "safety_sensitive", "likely_preplacement_exam", "likely_drug_testing", "likely_hearing_conservation", "likely_respirator_use", "likely_medical_surveillance", "deployment_oconus", "dot_cdl", "hazardous_exposure",
    "clearance_security",
)


def enrichment_answer(text: Column) -> Column:
    """A model's answer as a struct of known fields: the JSON object in it, whatever stands around; null if there is none that can be read.

    A flag is true unless its value is absent, null, false, 0 or blank; the demand is one of three or unknown; the score is a whole number from 0 to
    100; the reason has one space between words and at most 400 characters.
    """
    cleaned = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"(?i)\s*```$", "")
    body = F.regexp_extract(cleaned, r"(?s)(\{.*\})", 1)
    body = F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)
    at = lambda name: F.get_json_object(body, f"$.{name}")
    flag = lambda name: F.coalesce(~at(name).isin("", "false", "0", "null"), F.lit(False)).alias(name)
    demand = F.lower(at("physical_demand"))
    score = clamp(F.floor(F.coalesce(at("opportunity_score").try_cast("double"), F.lit(0.0)) + 0.5), 0, 100).cast("long")
    reason = F.substring(F.trim(F.regexp_replace(F.coalesce(at("reason"), F.lit("")), r"\s+", " ")), 1, 400)
    known = F.struct(*(flag(f) for f in ENRICHMENT_FLAGS), F.when(demand.isin("low", "moderate", "high"), demand).otherwise("unknown").alias("physical_demand"), score.alias("opportunity_score"), reason.alias("reason"))
    return F.when(body.isNotNull(), known)
