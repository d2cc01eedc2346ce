"""Line dedup with a log-template tree, in DataFrame operations alone.

A line's path in the tree has a fixed depth: its number of tokens, then its leading tokens. The rest is cut into STRETCHES stretches
(single tokens in short lines), and a line that shares none of them with other lines of its leaf has no template of its own kind: with
fewer variable tokens than stretches, one of them is always constant. In the others every token is counted by its place. The line's
support is the count that its required share of constant tokens reaches; tokens counted at least half as often are constant, all
others variable fields, any number of them anywhere in a line, and tokens with digits are variable everywhere (`<*>`). A line whose
tokens are mostly constant has so one generalised template; besides, every line of any length is its own exact template. A template
that recurs in at least `min_docs` different host documents is boilerplate, and lines under it are dropped from all documents.
Generalised ones of few tokens need more hosts, for they also recur by chance.

Votes are counted by distinct texts, so copies of a text count once and a document's own repeats don't count. A text of which little is
left without what it shares with others, by exact or generalised templates, is an edited copy, not a host: it doesn't vote. So groups of copied
documents keep their text, and lose only what documents of other content have in common.

Only keys are shuffled until the last join, which brings each text the keys of its lines that go, and once each different line whose
leaf enough lines have; keys that occur once are left out before their shuffle by a filter of fixed size. Counts are combined before their shuffle, so a line in a third of all documents is a
counter, not a group.

Defined cases: very long texts and lines are taken whole, their tokens as rows of their own; a null or empty text is returned as it is, as are lines of nothing but white space or variable fields; a document that
loses all lines keeps an empty text; repeated rows and ids are treated alike and all returned; an empty table gives an empty table;
other columns are returned untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, checkpointed, masks

#: Stretches of a line behind its leading tokens.
STRETCHES = 12


@dataclass(frozen=True)
class LineRules:
    #: Host documents in which a template recurs.
    min_docs: int = 5
    #: The same for generalised templates of fewer than `short` tokens.
    min_docs_short: int = 20
    short: int = 8
    #: Leading tokens on the tree's path.
    leading: int = 2
    #: Share of a line's tokens that a generalised template keeps, and the same for short lines.
    min_constant: float = 0.6
    min_constant_short: float = 0.75
    #: A host has at least this share of its words in lines that it doesn't share.
    min_own: float = 0.3


def _even(line: Column) -> Column:
    """One space between tokens."""
    uneven = line.contains("  ")
    for sign in "\t\r\x0b\f":
        uneven |= line.contains(sign)
    return F.trim(F.when(uneven, F.regexp_replace(line, r"[ \t\r\x0B\f]+", " ")).otherwise(line))


def _mask(line: Column) -> Column:
    """Fields with digits masked."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)


def _normal(lines: Column) -> Column:
    """The normal forms of an array of lines, in two steps so that each is computed once."""
    return F.transform(F.transform(lines, _even), _mask)


def _exact(normal: Column) -> Column:
    return F.xxhash64(normal)


def _tokens(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _normal_lines(docs: DataFrame) -> DataFrame:
    """_doc, total (words of the text) and l, per text and distinct normal line."""
    lines = docs.select("_doc", F.filter(F.array_distinct(_normal(F.split("_text", "\n"))), lambda x: F.trim(F.replace(x, F.lit("<*>"), F.lit(""))) != "").alias("ls"))
    total = F.aggregate("ls", F.lit(0), lambda acc, x: acc + _tokens(x))
    # Not `explode`, before which Spark would compute the array again to leave out empty ones.
    return lines.withColumn("total", total).select("_doc", "total", F.explode_outer("ls").alias("l")).where("l IS NOT NULL")


def _leaf(rules: LineRules) -> Column:
    return F.xxhash64("n", F.expr(f"substring_index(l, ' ', {rules.leading})"))


def line_keys(docs: DataFrame, rules: LineRules) -> DataFrame:
    """Per text and distinct normal line: _doc, total (words of the text), n (tokens), line (its key), leaf (null for a line that is all leading tokens)."""
    lines = _normal_lines(docs).withColumn("n", _tokens(F.col("l")))
    return lines.select("_doc", "total", "n", _exact(F.col("l")).alias("line"), F.when(F.col("n") > rules.leading + 1, _leaf(rules)).alias("leaf"))


def _stretches(rules: LineRules) -> Column:
    """Keys of a line's stretches (of tokens, n and leaf); null for an empty one."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES)), lambda j: (F.lit(rules.leading + 1) + F.floor((F.col("n") - rules.leading) * j / STRETCHES)).cast("int"))
    # As an array's only element, so that the places are computed once.
    return F.flatten(F.transform(F.array(starts), lambda at: F.transform(F.slice(at, 1, STRETCHES), lambda start, j: F.when(F.get(at, j + 1) > start, F.xxhash64("leaf", j, F.slice("tokens", start, F.get(at, j + 1) - start))))))


def _only(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows whose hash `on` is among `ids` (a checkpoint with a column of that name)."""
    return among(rows, masks(ids, on), on).where("_among").drop("_among").join(ids, on, "left_semi")


def _often(keys: DataFrame, weight: Column, rules: LineRules) -> DataFrame:
    """key and times of those that enough lines have."""
    return checkpointed(keys.groupBy("key").agg(F.sum(weight).alias("times")).where(F.col("times") >= rules.min_docs))


def _template(found: DataFrame, rules: LineRules) -> DataFrame:
    """Of lines with n, masked and `found` (place, key and times of tokens that recur): template of those that are mostly constant."""
    least = F.when(F.col("n") < rules.short, rules.min_constant_short).otherwise(rules.min_constant)
    needed = F.greatest(F.ceil(least * F.col("n")) - rules.leading + F.col("masked"), F.lit(1)).cast("int")
    found = found.withColumn("needed", needed).where(F.size("found") >= F.col("needed"))
    found = found.withColumn("support", F.sort_array("found.times", asc=False)[F.col("needed") - 1])
    constant = F.filter("found", lambda x: 2 * x["times"] >= F.col("support"))
    return found.withColumn("template", F.xxhash64(F.transform(constant, lambda x: x["key"]))).drop("found", "needed", "support")


def templates(lines: DataFrame, docs: DataFrame, rules: LineRules) -> DataFrame:
    """_doc, line, n, total and template of every line that has a generalised one."""
    leaves = _often(lines.where("leaf IS NOT NULL").select(F.col("leaf").alias("key")), F.lit(1), rules)
    # The different lines of leaves that enough lines have, with their own text and the number of texts that have them.
    again = _normal_lines(docs).withColumn("n", _tokens(F.col("l"))).where(F.col("n") > rules.leading + 1).withColumn("leaf", _leaf(rules))
    again = among(again, masks(leaves, "key"), "leaf").where("_among").withColumn("line", _exact(F.col("l")))
    again = again.groupBy("line", "n", "leaf").agg(F.max("l").alias("l"), F.count(F.lit(1)).alias("weight"))
    masked = (F.octet_length("l") - F.octet_length(F.replace(F.col("l"), F.lit("<*>"), F.lit("")))) / 3
    again = checkpointed(again.select("line", "n", "leaf", "weight", masked.cast("int").alias("masked"), "l"))
    split = again.withColumn("tokens", F.split("l", " "))

    stretches = split.select("line", "weight", F.explode(_stretches(rules)).alias("key")).where("key IS NOT NULL")
    shares = checkpointed(_only(stretches, _often(stretches, F.col("weight"), rules), "key").select("line").distinct())
    tokens = _only(split, shares, "line").select("line", "n", "masked", "weight", "leaf", F.posexplode("tokens").alias("j", "token")).where(F.col("j") >= rules.leading)
    tokens = checkpointed(tokens.select("line", "n", "masked", "weight", "j", F.xxhash64("leaf", "j", "token").alias("key")))
    constant = _often(tokens, F.col("weight"), rules)
    counted = among(tokens, masks(constant, "key"), "key").where("_among").drop("_among").join(constant, "key")
    found = counted.groupBy("line", "n", "masked").agg(F.array_sort(F.collect_list(F.struct("j", "key", "times"))).alias("found"))
    told = checkpointed(_template(found, rules).select("line", "template"))
    own = among(lines.where("leaf IS NOT NULL").select("_doc", "line", "n", "total"), masks(told, "line"), "line").where("_among").drop("_among")
    return own.join(told, "line")


def recurring_lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """_doc and line of every line under a boilerplate template."""
    lines = checkpointed(line_keys(docs, rules))
    texts = lambda rows, *keys: rows.groupBy(*keys).agg(F.count_distinct("_doc").alias("texts"), F.min("n").alias("n"))
    own = lines.select("_doc", "line", "n", "total")
    # Written first, so that each join's exchanges are its own and Spark can split the partition of a very common line.
    again = checkpointed(texts(own, "line").where("texts > 1").select("line"))
    general = checkpointed(templates(lines, docs, rules))
    alike = checkpointed(texts(general, "template").where("texts > 1").select("template"))
    shared = [_only(own, again, "line").select("_doc", "line", "n", "total", F.col("line").alias("key"), F.lit(False).alias("general")), _only(general, alike, "template").select("_doc", "line", "n", "total", F.col("template").alias("key"), F.lit(True).alias("general"))]
    shared = checkpointed(reduce(DataFrame.unionByName, shared).distinct())
    hosts = shared.select("_doc", "line", "n", "total").distinct().groupBy("_doc", "total").agg(F.sum("n").alias("words"))
    hosts = hosts.where(F.col("total") - F.col("words") >= rules.min_own * F.col("total")).select("_doc")
    votes = texts(shared.join(hosts, "_doc", "left_semi"), "key", "general")
    boiler = checkpointed(votes.where(F.col("texts") >= F.when(F.col("general") & (F.col("n") < rules.short), rules.min_docs_short).otherwise(rules.min_docs)).select("key"))
    return checkpointed(shared.join(boiler, "key", "left_semi").select("_doc", "line").distinct())


def drop_recurring_lines(docs: DataFrame, rules: LineRules | None = None, text_col: str = "text", count_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns, without the lines of recurring templates.

    `count_col`, if named, is added with the number of lines dropped; `length_col`, if named, is a column of `docs` that gets
    the new number of characters where lines were dropped.
    """
    rules = rules or LineRules()
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = f"c{names.index(text_col)}"
    inner = inner.withColumn("_doc", F.xxhash64(text))
    lines = F.split(text, "\n")

    def out(rows: DataFrame, kept: Column | None) -> DataFrame:
        columns = [F.col(f"c{i}") for i in range(len(names))]
        n_dropped = F.lit(0).cast("long")
        if kept is not None:
            rows = rows.withColumn("_kept", F.coalesce(kept, lines)).withColumn("_text", F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n")))
            columns[names.index(text_col)] = F.col("_text")
            dropped = F.size("_kept") < F.size(lines)
            n_dropped = F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0)).cast("long")
            if length_col:
                at = names.index(length_col)
                columns[at] = F.when(dropped, F.length("_text")).otherwise(columns[at]).cast(docs.schema[length_col].dataType)
        return rows.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)), *([n_dropped.alias(count_col)] if count_col else []))

    recurring = recurring_lines(inner.select("_doc", F.col(text).alias("_text")), rules)
    gone = recurring.groupBy("_doc").agg(F.collect_set("line").alias("_gone")).withColumnRenamed("_doc", "_of")
    # Only texts that may lose a line are shuffled.
    marked = among(inner, masks(recurring, "_doc"), "_doc")
    found = marked.where("_among").join(gone, F.col("_doc") == F.col("_of"), "left")
    pairs = F.filter(F.arrays_zip(lines.alias("raw"), F.transform(_normal(lines), _exact).alias("key")), lambda x: ~F.array_contains(F.col("_gone"), x["key"]))
    kept = F.when(F.col("_gone").isNotNull(), pairs["raw"])
    return out(found, kept).unionByName(out(marked.where("NOT coalesce(_among, false)"), None))
