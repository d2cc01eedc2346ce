"""Fuzzy name resolution as exact joins: the best match of every name, no pair at the threshold lost, no cap on candidates.

Each reason for a score is a join of its own, on a key that only pairs of that reason share: equal names, equal cores, a core that is a
phrase of the other name (its phrases are keys), a name inside another (the rarest six letters of the shorter one are the key). Reasons with
one score keep only the best row of a key before they are joined, so a word in very many names is one row. Names with most tokens in common
are found by a prefix filter: with tokens in one order, rarest first, two sets that share enough have one of their first tokens in common,
and the common tokens at the end are never keys. Pairs of the filter are verified on their tokens. Both sides are brought to normal forms once, and equal names are one.

Defined cases: null and blank names match nothing; ties go to the shorter name (agencies) and then to the least id; repeated rows count once, repeated queries are
all answered; empty tables give empty tables. Phrases of a name grow with the square of its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable
from .frames import checkpointed
from .registry import agency_score_of, agency_tokens, bare_contractor, canonical_agency


def _split(x: Column, least: int) -> Column:
    return F.filter(F.split(x, " "), lambda t: F.length(t) >= least)


def _phrases(x: Column) -> Column:
    """All runs of consecutive words."""
    words = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), " "))))
    return F.array_distinct(F.get(F.transform(F.array(F.split(x, " ")), words), F.lit(0)))


def _grams(x: Column, size: int) -> Column:
    return F.when(F.length(x) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substring(x, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _often(*sides: DataFrame) -> DataFrame:
    """How many sets (column `set`) of the sides hold each token."""
    tokens = reduce(DataFrame.unionAll, [s.select(F.explode("set").alias("token")) for s in sides])
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"))


def _first_tokens(rows: DataFrame, often: DataFrame, name: str, most: Column) -> DataFrame:
    """The rows (one for each `name`) once for each of their `most` rarest tokens (column `token`)."""
    kept = [c for c in rows.columns if c != name]
    each = rows.withColumn("token", F.explode("set")).join(often, "token")
    ranked = each.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("_order"), *(F.first(c).alias(c) for c in kept))
    return ranked.withColumn("token", F.explode(F.slice(F.col("_order.token"), F.lit(1), most))).drop("_order")


def _by_keys(left: DataFrame, right: DataFrame, kinds: dict[str, tuple[float, Column, Column]]) -> DataFrame:
    """_a, score, best: for each kind (score, keys of the left, keys of the right: arrays) the best row of each key that both have, in one join."""
    tagged = lambda kind: lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = lambda side: F.explode(F.concat(*(F.transform(columns[side], tagged(kind)) for kind, (_, *columns) in kinds.items())))
    asked = left.select("_a", keys(0).alias("k"))
    held = right.select("best", keys(1).alias("k")).groupBy("k").agg(F.min("best").alias("best"))
    scores = F.create_map(*(F.lit(x) for kind, (score, *_) in kinds.items() for x in (kind, score)))
    return asked.join(held, "k").select("_a", F.element_at(scores, F.col("k.kind")).alias("score"), "best")


def _if(test: Column, value: Column) -> Column:
    return F.array_compact(F.array(F.when(test, value)))


def _ceil(share: float, n: Column) -> Column:
    return F.ceil(n * share - 1e-9).cast("int")


def _pick(found: DataFrame, key: str) -> DataFrame:
    """Per key the highest score, and of its rows the least `best`."""
    each = found.groupBy(key, "score").agg(F.min("best").alias("best"))
    return each.groupBy(key).agg(F.max_by("best", "score").alias("best"), F.max("score").alias("score"))


def _asked(queries: DataFrame, id_: str, names: Column) -> DataFrame:
    return queries.select(F.col(id_).alias("_q"), F.explode(F.array_distinct(F.transform(names, comparable))).alias("_a")).where(F.col("_a") != "")


def agency_matches(left: DataFrame, right: DataFrame, minimum: int) -> DataFrame:
    """_a, score, best: the best of `right` (b, best) for every comparable name of `left` (_a), of a score of `minimum` (41 or more) at least."""
    if minimum <= 40:
        raise ValueError("below 41 even pairs with hardly a token in common count")
    forms = lambda rows, name: rows.withColumn("core", canonical_agency(F.col(name))).withColumn("tokens", agency_tokens(F.col(name), F.col("core"))).withColumn("set", F.array_distinct("tokens"))
    # Written once, for every reason reads them.
    left, right = checkpointed(forms(left, "_a")), checkpointed(forms(right, "b"))
    core, told = F.col("core"), F.length("core") >= 5
    kinds = {
        "equal": (100, F.array("_a"), F.array("b")), "core": (97, _if(core != "", core), _if(core != "", core)),
        "within": (90, _if(told, core), _phrases(F.col("b"))), "around": (88, _phrases(F.col("_a")), _if(told, core)),
    }
    found = [_by_keys(left, right, kinds)]

    # Shares of the tokens that a score of the minimum needs on either side.
    floor = 2 * (minimum - 0.5) / 80 - 1
    recall, precision = (0.8, 0.6) if minimum > 80 else (min(0.8, floor), min(0.6, floor))
    # Names with the same tokens are one set.
    sets = right.where("size(tokens) > 0").groupBy(F.array_sort("tokens").alias("tokens")).agg(F.min("best").alias("best")).withColumns({"set": F.array_distinct("tokens"), "name": F.array_join("tokens", " ")})
    own = left.where("size(tokens) > 0").select("_a", "core", "tokens", "set")
    often = _often(own, sets)
    n = F.size("tokens")
    once = _first_tokens(own.where(n == F.size("set")), often, "_a", n - _ceil(recall, n) + 1)
    first = _first_tokens(sets.where(F.size("set") >= _ceil(precision, n)), often, "name", F.size("set") - _ceil(precision, n) + 1)
    # A repeated token of the left counts again on both sides, so the score by tokens can pass those above: such names need fewer tokens in
    # common, least beside a name of one token, look at all tokens of all names, and take the first reason that holds.
    few = F.ceil((minimum - 0.5) / 40 * n / (n + 1) - 1e-9).cast("int")
    again = _first_tokens(own.where(n > F.size("set")), often, "_a", n - F.least(_ceil(recall, n), few) + 1)
    once = once.select("_a", F.col("tokens").alias("ta"), "token")
    pairs = once.join(first.select("token", F.col("tokens").alias("tb"), "best"), "token")
    both = F.size(F.filter("ta", lambda t: F.array_contains("tb", t)))
    r, p = both / F.size("ta"), both / F.size("tb")
    score = F.when((r == 1) & (p >= 0.6), 86).when((r >= 0.8) & (p >= 0.6), 82).otherwise(F.floor((r + p) / 2 * 80 + 0.5)).cast("int")
    found.append(pairs.select("_a", score.alias("score"), "best"))
    again = again.select("_a", F.col("core").alias("ca"), F.col("tokens").alias("ta"), "token")
    pairs = again.join(right.select("b", F.col("core").alias("cb"), F.col("tokens").alias("tb"), "best", F.explode("set").alias("token")), "token")
    found.append(pairs.select("_a", agency_score_of(*(F.col(c) for c in ("_a", "ca", "ta", "b", "cb", "tb"))).cast("int").alias("score"), "best"))
    return _pick(reduce(DataFrame.unionAll, found).where(F.col("score") >= minimum), "_a")


def resolve_agencies(queries: DataFrame, agencies: DataFrame, minimum: int = 82) -> DataFrame:
    """The agency of the code list that a name stands for: query_id, query, id, name, score of at least `minimum`.

    `queries`: query_id, query and perhaps aliases (array), of which the best counts; `agencies`: id, name. Of equal scores the shorter name, then the least id.
    """
    names = F.array("query")
    if "aliases" in queries.columns:
        names = F.concat(names, F.coalesce("aliases", F.array().cast("array<string>")))
    asked = _asked(queries, "query_id", names)
    best = F.min(F.struct(F.length("name").alias("length"), "id", "name")).alias("best")
    right = agencies.select("id", "name", comparable(F.col("name")).alias("b")).where("b != ''").groupBy("b").agg(best)
    found = _pick(asked.join(agency_matches(asked.select("_a").distinct(), right, minimum), "_a"), "_q")
    return queries.select("query_id", "query").join(found, F.col("query_id") == F.col("_q")).select("query_id", "query", F.col("best.id").alias("id"), F.col("best.name").alias("name"), "score")


def _inside(short: DataFrame, s: str, long: DataFrame, t: str, size: int = 6) -> DataFrame:
    """Pairs (s, t) of distinct names where s (of `size` letters or more) stands in t, found by the rarest letters of s."""
    grams = long.select(t, F.explode(_grams(F.col(t), size)).alias("gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    rarest = short.select(s, F.explode(_grams(F.col(s), size)).alias("gram")).join(often, "gram").groupBy(s).agg(F.min_by("gram", F.struct("times", "gram")).alias("gram"))
    return rarest.join(grams, "gram").where(F.col(t).contains(F.col(s))).select(s, t)


def contractor_matches(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """_a, score, best: the best of `right` (b, best) for every comparable name of `left` (_a), of a score of at least `minimum` (above zero)."""
    if minimum <= 0:
        raise ValueError("every pair has a score of zero")
    forms = lambda rows, name: rows.withColumn("bare", bare_contractor(F.col(name))).withColumn("set", F.array_distinct(_split(F.col("bare"), 3)))
    left, right = forms(left, "_a"), forms(right, "b")
    left, right = checkpointed(left), checkpointed(right)
    found = [_by_keys(left, right, {"equal": (1.0, F.array("_a"), F.array("b")), "bare": (0.96, F.array("bare"), F.array("bare"))})]
    if minimum <= 0.88:
        a, b = left.select("_a"), right.select("b", "best")
        for pairs in (_inside(a, "_a", b.select("b"), "b"), _inside(b.select("b"), "b", a, "_a")):
            found.append(pairs.join(b, "b").select("_a", F.lit(0.88).alias("score"), "best"))
    if minimum <= 0.9:
        # The smaller set has this share of its tokens in the other; the rarest of them are looked for among all of the other's.
        share = minimum / 0.9
        own, sets = left.where("size(set) > 0").select("_a", "set"), right.where("size(set) > 0").groupBy(F.array_sort("set").alias("set")).agg(F.min("best").alias("best")).withColumn("b", F.array_join("set", " "))
        few = F.size("set") - _ceil(share, F.size("set")) + 1
        often = _often(own, sets)
        rare, all_ = lambda rows, name: _first_tokens(rows, often, name, few), lambda rows: rows.withColumn("token", F.explode("set"))
        a, b = (lambda rows: rows.select("token", "_a", F.col("set").alias("ta"))), (lambda rows: rows.select("token", F.col("set").alias("tb"), "best"))
        pairs = a(rare(own, "_a")).join(b(all_(sets)), "token").where("size(ta) <= size(tb)").unionAll(a(all_(own)).join(b(rare(sets, "b")), "token").where("size(ta) > size(tb)"))
        overlap = F.size(F.array_intersect("ta", "tb")) / F.least(F.size("ta"), F.size("tb"))
        found.append(pairs.select("_a", (overlap * 0.9).alias("score"), "best"))
    return _pick(reduce(DataFrame.unionAll, found).where(F.col("score") >= minimum), "_a")


def resolve_contractors(entities: DataFrame, candidates: DataFrame, minimum: float = 0.82) -> DataFrame:
    """The recipient that an entity's names (array `names`) stand for: entity_id, id, name, score of at least `minimum`; of equal scores the least id."""
    asked = _asked(entities, "id", F.col("names"))
    best = F.min(F.struct("id", "name")).alias("best")
    right = candidates.select("id", "name", comparable(F.col("name")).alias("b")).where("b != ''").groupBy("b").agg(best)
    found = _pick(asked.join(contractor_matches(asked.select("_a").distinct(), right, minimum), "_a"), "_q")
    return found.select(F.col("_q").alias("entity_id"), F.col("best.id").alias("id"), F.col("best.name").alias("name"), "score")
