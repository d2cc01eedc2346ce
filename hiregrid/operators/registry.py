"""Names against registries: fuzzy resolution and search, agency and contractor scores, aliases.

Candidates come from an equi-join on tokens, never from all pairs; registry searches look at the best CANDIDATES rows of a token, as they are defined.
Names are resolved without such a limit, agencies and contractors in `matching`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from ..functions.text import comparable, contains_phrase, words
from .frames import checkpointed, first_rows
from .states import STATES

# Words of government names that identify nothing.
STOP_WORDS = ("of", "the", "and", "government", "state", "city", "county", "town", "township", "municipality")
#: Candidates that one token of a search brings, shortest names first.
CANDIDATES = 250
# Kinds of governments that a portal looks among.
PORTAL_TYPES = {"counties_and_cities": ("county", "municipality", "township"), "state_agencies": ("state", "county", "municipality", "township", "special_district")}
LOCAL = "counties_and_cities"
# Names that give a state beside those of STATES.
TERRITORIES = {"puerto rico": "PR", "guam": "GU"}


def canonical_government(name: Column) -> Column:
    low = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(low, words("the|government of"), " "), "[^a-z0-9]+", " "))


def type_hint(name: Column, portal: Column | None = None) -> Column:
    """The kind that a name states; the word state counts for state agencies only."""
    low = F.lower(name)
    out = F.when(low.rlike(words("county")), "county").when(low.rlike(words("city|municipality|village|borough")), "municipality").when(low.rlike(words("town(?:ship)?")), "township")
    return out if portal is None else F.coalesce(out, F.when(low.rlike(words("state")) & (portal == "state_agencies"), "state"))


def state_code_hint(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"[,\s]\s*([A-Z]{2})(?![A-Za-z0-9_])", 1), F.lit(""))


def state_hint(name: Column) -> Column:
    """Two capitals behind a comma or space, else the first state whose name stands in the text."""
    out, low = F.lit(None).cast("string"), F.lower(name)
    for state, code in reversed((STATES | TERRITORIES).items()):
        out = F.when(low.contains(state), code).otherwise(out)
    return F.coalesce(state_code_hint(name), out)


def _state_of(rows: DataFrame) -> Column:
    """A registry row's state: its code, else that of its state's name."""
    code = F.nullif(F.upper(F.trim(F.coalesce("state_code", F.lit("")))), F.lit(""))
    if "state_name" not in rows.columns:
        return code
    known = F.create_map(*(F.lit(x) for pair in (STATES | TERRITORIES).items() for x in pair))
    return F.coalesce(code, F.element_at(known, F.lower(F.trim("state_name"))))


def _tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))


def _telling(x: Column) -> Column:
    return F.filter(_tokens(x), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def _holding(registry: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of `asked` with each word (_word) of a canonical name that holds their _token.

    The words are found by the first two letters of a token, so no word is compared with tokens that it shares nothing with.
    """
    vocabulary = registry.select(F.explode(_tokens(F.col("canonical"))).alias("_word")).distinct().where(F.length("_word") >= 2)
    grams = vocabulary.select("_word", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_word") - 1), lambda i: F.substring(F.col("_word"), i, F.lit(2))))).alias("_gram"))
    return grams.join(asked.withColumn("_gram", F.substring("_token", 1, 2)), "_gram").where(F.col("_word").contains(F.col("_token"))).drop("_gram")


def _candidates(queries: DataFrame, registry: DataFrame, most: int) -> DataFrame:
    """Query rows (query_id, query, _token, _portal, _only: a state or null) with registry rows (id, canonical, ...) whose canonical name holds the
    token and that are of the portal's kinds and, if one is asked for, of that state: of these the first `most` by length and id.

    A row among the first of a token is among the first of its word, kind and state (ids are unique), so each task keeps no more than these before any shuffle.
    """
    asked = queries.where(F.length("_token") >= 2).withColumn("_ask", F.concat_ws("|", "_token", "_portal", F.coalesce("_only", F.lit(""))))
    kinds = F.create_map(*(x for portal, types in PORTAL_TYPES.items() for x in (F.lit(portal), F.array(*map(F.lit, types)))))
    needed = asked.select("_ask", "_token", "_only", F.element_at(kinds, F.col("_portal")).alias("_kinds")).dropDuplicates(["_ask"])
    held = _holding(registry, needed)
    order = [F.length("canonical"), F.col("id")]
    rows = first_rows(registry.withColumn("_word", F.explode(_tokens(F.col("canonical")))), ["_word", "government_type", "state_code"], order, n=most).join(held, "_word")
    rows = rows.where(F.array_contains("_kinds", F.col("government_type")) & (F.col("_only").isNull() | (F.col("_only") == F.upper(F.coalesce("state_code", F.lit(""))))))
    rows = rows.drop("_word", "_token", "_only", "_kinds").dropDuplicates(["_ask", "id"])
    return asked.drop("_token", "_only").join(first_rows(rows, ["_ask"], order, n=most), "_ask").drop("_ask")


def resolve_registry(queries: DataFrame, registry: DataFrame, minimum: int = 75, minimum_typed: int = 65) -> DataFrame:
    """The one registry row that a name resolves to: query_id, query, id, name, score. No row if none scores enough or rows of two ids tie for the best score.

    100 for equal canonical names, else 80 by the Jaccard share of telling tokens and 15 for containment; 20 more for the named state, 15 less for another;
    15 more for the named type, 8 less for another. `queries` may name the portal it looks for, whose kinds alone are candidates; else it is the local one.

    Candidates are all rows whose canonical name holds the name's first telling token of three letters or more. Rows of one canonical name, kind and state score alike and are
    one. A score of the minimum needs a share of the telling tokens: with a name's tokens rarest first, one of its first ones is also a token
    of every name that has enough in common, and the more tokens that one has, the fewer are looked for, so tokens of very many names are looked
    for only among names that they can bring over the minimum. Where the minimum asks for no token in common (below 51), all words that hold the first token are keys.
    Names without such a token, and null, resolve to nothing; repeated queries are all answered, repeated rows count once.
    """
    reg = registry.where("is_active").withColumn("canonical", canonical_government(F.coalesce("canonical_name", "name")))
    portals = F.array_compact(F.array(*(F.when(F.col("government_type").isin(*types), portal) for portal, types in PORTAL_TYPES.items())))
    alike = reg.withColumn("_code", _state_of(reg)).groupBy("canonical", "government_type", "_code")
    held = alike.agg(F.min(F.struct(F.length("name").alias("length"), "id", "name")).alias("_best"), F.min(F.struct("id")).alias("_low"), F.max(F.struct("id")).alias("_high"))
    # Written once, for the tokens' counts and the join read it.
    held = checkpointed(held.withColumns({"_portal": F.explode(portals), "_b": _telling(F.col("canonical"))}))

    portal = F.coalesce("portal", F.lit(LOCAL)) if "portal" in queries.columns else F.lit(LOCAL)
    asked = queries.select("query_id", "query", portal.alias("_portal"))
    q = asked.select("query", "_portal").distinct().withColumns({"_canon": canonical_government(F.col("query")), "_state": state_hint(F.col("query")), "_type": type_hint(F.col("query"), F.col("_portal"))})
    least = F.when(F.col("_type").isNotNull() & (F.col("_portal") == LOCAL), minimum_typed).otherwise(minimum)
    q = q.withColumns({"_token": F.get(F.filter(F.split("_canon", " "), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS)), F.lit(0)), "_a": _telling(F.col("_canon")), "_least": least}).where("_token IS NOT NULL")
    if min(minimum, minimum_typed) >= 51:
        # The least share of all tokens of both names that two names have in common if all else speaks for them.
        share = F.least((F.col("_least") - 15.5 - F.when(F.col("_state").isNotNull(), 20).otherwise(0) - F.when(F.col("_type").isNotNull(), 15).otherwise(0)) / 80, F.lit(1.0))
        often = held.select(F.explode("_b").alias("_word")).groupBy("_word").agg(F.count(F.lit(1)).alias("_times"))
        each = q.withColumns({"_share": share, "_word": F.explode("_a")}).join(often, "_word", "left")
        place, n = F.row_number().over(W.partitionBy("query", "_portal").orderBy(F.coalesce("_times", F.lit(0)), "_word")), F.size("_a")
        common = lambda m: F.ceil(F.col("_share") / (F.col("_share") + 1) * (n + m) - 1e-9)
        sizes = F.filter(F.sequence(F.lit(1), F.floor(n / F.col("_share") + 1e-9).cast("int")), lambda m: F.col("_place") <= n - common(m) + 1)
        keyed = each.withColumn("_place", place).where("_times IS NOT NULL").withColumn("_size", F.explode(sizes)).drop("_share", "_times", "_place")
        pairs = keyed.join(held.withColumns({"_word": F.explode("_b"), "_size": F.size("_b")}), ["_word", "_size", "_portal"])
    else:
        pairs = _holding(held, q).join(held.withColumn("_word", F.explode(_tokens(F.col("canonical")))), ["_word", "_portal"])
    pairs = pairs.where(F.col("canonical").contains(F.col("_token")))
    same = round_half_up(F.size(F.array_intersect("_a", "_b")) / F.greatest(F.size(F.array_union("_a", "_b")), F.lit(1)) * 80) + F.when(F.col("canonical").contains(F.col("_canon")) | F.col("_canon").contains(F.col("canonical")), 15).otherwise(0)
    score = F.when(F.col("canonical") == F.col("_canon"), 100).otherwise(same)
    score += F.when(F.col("_state").isNull() | F.col("_code").isNull(), 0).when(F.col("_code") == F.col("_state"), 20).otherwise(-15)
    score += F.when(F.col("_type").isNull(), 0).when(F.col("government_type") == F.col("_type"), 15).otherwise(-8)
    scored = pairs.withColumn("score", score).where(F.col("score") >= F.col("_least"))
    tied = scored.groupBy("query", "_portal", "score").agg(F.min("_best").alias("_best"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    top = tied.groupBy("query", "_portal").agg(F.max_by(F.struct("_best", "_low", "_high"), "score").alias("_r"), F.max("score").alias("score")).where("_r._low = _r._high")
    return asked.join(top, ["query", "_portal"]).select("query_id", "query", F.col("_r._best.id").alias("id"), F.col("_r._best.name").alias("name"), "score")


def search_registry(queries: DataFrame, registry: DataFrame, minimum: int = 35, limit: int = 12, most: int = CANDIDATES) -> DataFrame:
    """The best registry rows of each search text, ranked: 100 for an equal name, 55 by the share of its tokens found, 20 for containment, 15 for the type.

    Only rows of the portal's kinds, and of the state whose code the text names, are candidates.
    """
    reg = registry.where("is_active").withColumn("canonical", canonical_government(F.col("name")))
    tokens = F.slice(F.filter(F.split(F.trim(F.regexp_replace(F.lower("query"), "[^a-z0-9]+", " ")), " "), lambda t: F.length(t) >= 2), 1, 4)
    portal = F.coalesce("portal", F.lit(LOCAL)) if "portal" in queries.columns else F.lit(LOCAL)
    q = queries.select("query_id", "query", portal.alias("_portal")).withColumns({"_canon": canonical_government(F.col("query")), "_tokens": tokens, "_type": type_hint(F.col("query")), "_only": state_code_hint(F.col("query"))})
    rows = _candidates(q.withColumn("_token", F.get("_tokens", F.lit(0))), reg, most)
    c = F.col("canonical")
    hits = F.size(F.filter("_tokens", lambda t: c.contains(t)))
    score = F.when(c == F.col("_canon"), 100).otherwise(0) + round_half_up(hits / F.greatest(F.size("_tokens"), F.lit(1)) * 55)
    score += F.when(c.contains(F.col("_canon")) | F.col("_canon").contains(c), 20).otherwise(0) + F.when(F.col("_type") == F.col("government_type"), 15).otherwise(0)
    rows = rows.withColumn("score", score).where(F.col("score") >= minimum)
    return first_rows(rows, ["query_id"], [F.col("score").desc(), F.collate(F.col("name"), "UNICODE"), F.col("id")], n=limit).select("query_id", "query", "id", "name", "score")


# Words of agency names that identify nothing.
_AGENCY = (r"united states|u s|us", "department|dept|agency|administration|office|bureau|service|services|commission", "of|the|for|and")


def canonical_agency(x: Column) -> Column:
    for pattern in _AGENCY:
        x = F.regexp_replace(x, words(pattern), " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def agency_tokens(x: Column, core: Column) -> Column:
    """The words of a comparable name's core, or of itself if it has none."""
    return F.filter(F.split(F.when(core != "", core).otherwise(x), " "), lambda t: F.length(t) >= 2)


def agency_score_of(a: Column, ca: Column, ta: Column, b: Column, cb: Column, tb: Column) -> Column:
    """The score of two comparable names with their cores and tokens."""
    both = F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    recall, precision = both / F.size(ta), both / F.size(tb)
    return (
        F.when((a == "") | (b == ""), 0).when(a == b, 100).when((ca != "") & (ca == cb), 97).when((F.length(ca) >= 5) & contains_phrase(b, ca), 90).when((F.length(cb) >= 5) & contains_phrase(a, cb), 88)
        .when((F.size(ta) == 0) | (F.size(tb) == 0), 0).when((recall == 1) & (precision >= 0.6), 86).when((recall >= 0.8) & (precision >= 0.6), 82)
        .otherwise(round_half_up((recall + precision) / 2 * 80))
    )


def agency_score(left: Column, right: Column) -> Column:
    """0 to 100: equal names, equal cores, a core inside the other name, else by the tokens in common (a repeated left token counts again)."""
    a, b = comparable(left), comparable(right)
    ca, cb = canonical_agency(a), canonical_agency(b)
    return agency_score_of(a, ca, agency_tokens(a, ca), b, cb, agency_tokens(b, cb))


# Legal forms in contractor names.
_CONTRACTOR_LEGAL = "inc|incorporated|llc|ltd|limited|corp|corporation|company|co|holdings|group|lp|plc"


def bare_contractor(x: Column) -> Column:
    """A comparable name without legal forms."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, words(_CONTRACTOR_LEGAL), " "), r"\s+", " "))


def contractor_score(names: Column, candidate: Column) -> Column:
    """The best of an entity's names (array) against a candidate: 1 equal, .96 equal without legal form, .88 contained, else .9 by tokens in common."""
    bare = bare_contractor
    tokens = lambda x: F.array_distinct(F.filter(F.split(bare(x), " "), lambda t: F.length(t) > 2))
    c = comparable(candidate)

    def one(name: Column) -> Column:
        n = comparable(name)
        ta, tb = tokens(c), tokens(n)
        least = F.least(F.size(ta), F.size(tb))
        shared = F.when(least > 0, F.size(F.array_intersect(ta, tb)) / least).otherwise(0.0) * 0.9
        inside = (c.contains(n) | n.contains(c)) & (F.least(F.length(c), F.length(n)) >= 6)
        return F.when(n == "", 0.0).when(c == n, 1.0).when(bare(c) == bare(n), 0.96).otherwise(F.greatest(F.when(inside, 0.88).otherwise(0.0), shared))

    return F.when(c == "", 0.0).otherwise(F.coalesce(F.array_max(F.transform(names, one)), F.lit(0.0)))


def registry_aliases(rows: DataFrame) -> Column:
    """Names that a matched registry row (name, government_type, state_code) goes by: of a county and of a municipality only, never its state's."""
    base = canonical_government(F.col("name"))
    code = F.nullif(F.trim("state_code"), F.lit(""))
    county = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(base, " county$", ""), "^county of ", "")))
    place = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(base, "^(?:city|town|village|borough) of ", ""), " (?:city|town|village|borough)$", "")))
    more = F.when((F.col("government_type") == "county") & (county != ""), F.array(F.concat(county, F.lit(" County")), F.concat(county, F.lit(" County, "), code)))
    more = more.when((F.col("government_type") == "municipality") & (place != ""), F.array(place, F.concat(F.lit("City of "), place), F.concat(place, F.lit(", "), code)))
    return F.array_distinct(F.array_compact(F.concat(F.array(F.trim("name")), F.coalesce(more, F.array().cast("array<string>")))))


def geographic_fips(kind: Column, state: Column, county: Column, place: Column) -> Column:
    """State, county or place code of a government; null where its kind has no such code."""
    return F.when(kind == "state", state).when(kind == "county", F.concat(state, county)).when(kind == "municipality", F.concat(state, place))


def match_aliases(names: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity that a name is the name or an alias of: active ones first, then the oldest. `names`: name; case and outer space don't count."""
    key = lambda c: F.lower(F.trim(c))
    known = entities.select("id", "is_active", "created_at", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), key))).alias("_key"))
    best = known.groupBy("_key").agg(F.min_by("id", F.struct(~F.col("is_active"), F.col("created_at"), F.col("id"))).alias("entity_id"))
    return names.join(best, key(names["name"]) == F.col("_key"), "left").drop("_key")
