"""Exact percentiles by distributed selection: no group's values come together in one buffer but a bounded number of them.

Equal values are counted first. A sketch of the distinct values cuts each group into ranges, whose counts tell which range holds each rank asked
for; only the values of those ranges are ordered, each range by itself. The sketch decides where the cuts lie, not the result. It depends on the order in
which its parts arrive, so it is drawn once and kept: ranges and the ranks before them have to come from the same cuts. Where all groups together
have no more distinct values than BUFFERED, their counts go through Spark's own percentile, whose buffers then are bounded by it; results are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import checkpointed

#: Ranges of a group, and distinct values of all groups that one buffer may hold.
RANGES = 256
BUFFERED = 1 << 18


def exact_percentiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], ranges: int = RANGES, buffered: int = BUFFERED, count: str = "n_rows") -> DataFrame:
    """Per key the number of its rows (`count`) and the percentiles `wanted` (name: column, share from 0 to 1), by linear interpolation between the two nearest ranks.

    Nulls and NaN don't count; a group without values has null; repeated rows count again; keys may be null; an empty table gives an empty table.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    # Every row also counts under no column, so that keys without values are there.
    each = F.explode(F.array(F.struct(F.lit("").alias("c"), F.lit(0.0).alias("v")), *(F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns)))
    counts = rows.select(F.struct(*keys).alias("k"), each.alias("x")).select("k", "x.c", F.col("x.v").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("k", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)
    all_ = F.sum(F.when(F.col("c") == "", F.col("n"))).alias(count)
    if counts.limit(buffered + 1).count() <= buffered:
        of = lambda c, p: F.percentile(F.when(F.col("c") == c, F.col("v")), F.lit(float(p)), F.col("n"))
        return counts.groupBy("k").agg(all_, *(of(c, p).alias(name) for name, (c, p) in wanted.items())).select("k.*", count, *wanted)
    whole, counts = counts.groupBy("k").agg(all_), counts.where("c <> ''")
    # Cuts among distinct values: ranges hold about as many of those, however often one occurs. Drawn again, they would lie elsewhere.
    cuts = checkpointed(counts.groupBy("k", "c").agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 4 * ranges).alias("cuts"), F.sum("n").alias("total")))
    dealt = counts.join(cuts, ["k", "c"]).select("k", "c", "v", "n", F.size(F.filter("cuts", lambda x: x < F.col("v"))).alias("range"))
    # At most `ranges` rows of a key and column.
    sizes = dealt.groupBy("k", "c", "range").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(W.partitionBy("k", "c").orderBy("range")) - F.col("size")
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(c).alias("c"), F.lit(float(p)).alias("p")) for name, (c, p) in wanted.items()))
    asks = cuts.select("k", "c", "total", F.explode(F.filter(asked, lambda a: a["c"] == F.col("c"))).alias("a")).withColumn("at", F.col("a.p") * (F.col("total") - 1))
    asks = asks.select("k", "c", "a.name", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    held = sizes.withColumn("before", before).join(asks, ["k", "c"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size")))
    held = checkpointed(held.select("k", "c", "range", "before", "name", "at", "rank"))
    values = dealt.join(held.select("k", "c", "range", "before").distinct(), ["k", "c", "range"])
    own = W.partitionBy("k", "c", "range").orderBy("v")
    values = values.withColumn("low", F.col("before") + F.sum("n").over(own) - F.col("n")).select("k", "c", "range", "v", "n", "low")
    found = held.join(values, ["k", "c", "range"]).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    out = found.groupBy("k", "name").agg(F.when(F.floor(F.first("at")) == F.first("at"), low).otherwise((F.ceil(F.first("at")) - F.first("at")) * low + (F.first("at") - F.floor(F.first("at"))) * high).alias("v"))
    wide = out.groupBy(F.col("k").alias("_k")).agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in wanted))
    return whole.join(wide, F.col("k").eqNullSafe(F.col("_k")), "left").select("k.*", count, *wanted)
