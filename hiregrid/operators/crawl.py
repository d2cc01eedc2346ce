"""Captured pages in the order in which a client would have read them: pagers from page to page, continuations from token to token.

Sites and chains are all walked at once. Neither walk holds a site in one task: a wave of a crawl is a join of the last wave's pages with their
links, and a chain is ranked by pointer doubling, in as many rounds as the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import checkpointed, first_rows


def crawl(start: DataFrame, links: DataFrame, keys: DataFrame, most_pages: int = 75, empty_stop: int = 3) -> DataFrame:
    """Pages of each site in the order of a queue: site, url, place (0 is the start), fresh (whether it has a job key that no page before it has).

    `start`: site, url; `links`: site, url, target and position (the link's place on its page; links to pages that weren't captured are left out by
    the caller); `keys`: site, url, key. A page's links join the queue in their order, unless they are in it or were read. A site ends with
    the first page that is the `empty_stop`-th one after another without a new key, or at `most_pages`; what the queue holds then isn't read.

    First in, first out means wave by wave, and in a wave by the place of the page that named a page first and the link's position on it. A page is fresh if
    one of its keys has no page of a smaller place, so that the count of stale pages before it is its place less the last fresh one's. Sites
    have at most `most_pages` rows in a window. Defined cases: a null url or target leads nowhere; repeated links and keys count once, at their first position; the loop
    runs over depth, not over rows.
    """
    seen = checkpointed(start.where("url IS NOT NULL").groupBy("site").agg(F.min("url").alias("url")).withColumns({"place": F.lit(0), "fresh": F.lit(True), "wave": F.lit(0), "live": F.lit(True)}))
    # What the caller made links and keys of is worked out and dealt out once, not in every wave.
    links = links.where("target IS NOT NULL").select("site", F.col("url").alias("_from"), F.col("target").alias("url"), "position").repartition("site", "_from").persist()
    keys = keys.repartition("site", "url").persist()
    for wave in range(1, most_pages):
        front = seen.where((F.col("wave") == wave - 1) & F.col("live")).select("site", F.col("url").alias("_from"), "place")
        named = front.join(links, ["site", "_from"]).groupBy("site", "url").agg(F.min(F.struct("place", "position")).alias("_by"))
        found = named.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        size = seen.groupBy("site").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("fresh"), F.col("place"))).alias("_last"))
        # Only pages that still have room are ranked.
        found = first_rows(found, ["site"], [F.col("_by"), F.col("url")], n=most_pages).join(size, "site")
        found = found.withColumn("place", (F.row_number().over(W.partitionBy("site").orderBy("_by", "url")) - 1 + F.col("_n")).cast("int")).where(F.col("place") < most_pages)
        found = checkpointed(found.select("site", "url", "place", "_last"))
        if found.isEmpty():
            break
        known = seen.join(keys, ["site", "url"]).select("site", "key").distinct()
        first = found.join(keys, ["site", "url"]).groupBy("site", "key").agg(F.min("place").alias("place")).join(known, ["site", "key"], "left_anti")
        found = found.join(first.select("site", "place").distinct().withColumn("fresh", F.lit(True)), ["site", "place"], "left").fillna(False, ["fresh"])
        last = F.greatest("_last", F.max(F.when(F.col("fresh"), F.col("place"))).over(W.partitionBy("site").orderBy("place")))
        found = found.withColumn("_idle", F.col("place") - F.coalesce(last, "_last"))
        # The page that ends the site is read; those behind it aren't.
        found = found.withColumn("_end", F.min(F.when(F.col("_idle") >= empty_stop, F.col("place"))).over(W.partitionBy("site"))).where(F.col("_end").isNull() | (F.col("place") <= F.col("_end")))
        seen = checkpointed(seen.unionByName(found.select("site", "url", "place", "fresh", F.lit(wave).alias("wave"), F.col("_end").isNull().alias("live"))))
    links.unpersist()
    keys.unpersist()
    return seen.select("site", "url", "place", "fresh")


def chain_places(pages: DataFrame, most_pages: int = 250) -> DataFrame:
    """Pages that a chain's continuations lead to from its first page: chain, page, place, next.

    `pages`: chain, page (an id; of repeated ones the least row), next (null at the end), is_first. In round k all places below 2 ** k are known, and where each page leads in 2 ** k steps; so a chain of n pages
    takes log n rounds. A page reached twice keeps its first place, and a chain that leads back ends there. Places from `most_pages` on aren't read.
    """
    pages = checkpointed(pages.groupBy("chain", "page").agg(F.min("next").alias("next"), F.max("is_first").alias("is_first")))
    known = pages.select("chain", "page")
    reach = checkpointed(pages.where("is_first").groupBy("chain").agg(F.min("page").alias("page")).withColumn("place", F.lit(0)))
    jump = pages.where("next IS NOT NULL").select("chain", "page", F.col("next").alias("to")).join(known.withColumnRenamed("page", "to"), ["chain", "to"], "left_semi")
    step, size = 1, reach.count()
    while step < most_pages:
        more = reach.join(jump, ["chain", "page"]).select("chain", F.col("to").alias("page"), (F.col("place") + step).alias("place"))
        reach = checkpointed(reach.unionByName(more).groupBy("chain", "page").agg(F.min("place").alias("place")).where(F.col("place") < most_pages))
        before, size = size, reach.count()
        if size == before:
            break
        jump = checkpointed(jump.join(jump.select("chain", F.col("page").alias("to"), F.col("to").alias("_to")), ["chain", "to"]).select("chain", "page", F.col("_to").alias("to")))
        step *= 2
    return reach.join(pages.select("chain", "page", "next"), ["chain", "page"])


def audit_chains(pages: DataFrame, ids: DataFrame, page_size: int = 50, most_pages: int = 250) -> DataFrame:
    """Whether each chain's inventory was read whole, and why not: chain, complete, official, unique_ids, n_pages, exhausted, repeated_page, looped, broken, hit_page_cap.

    `pages`: chain, page, next, is_first, signature (a digest of the page's rows), n_rows, total (null if the page tells none); `ids`: chain, page, id.
    Pages are read in the chain's order until one has rows that an earlier page had (repeated), is empty, brings the rows up to the total, or is shorter than
    a page (all three: exhausted). The official count is the last total told, or without one the ids of an exhausted chain; complete is a chain
    that was exhausted without repetition and has as many different ids. `looped`: the last page read leads to one before it; `broken`: to one that
    wasn't captured.
    """
    pages = checkpointed(pages)
    facts = pages.groupBy("chain", "page").agg(F.min(F.struct("next", "signature", "n_rows", "total")).alias("_r")).select("chain", "page", "_r.signature", F.coalesce("_r.n_rows", F.lit(0)).alias("n_rows"), "_r.total")
    rows = chain_places(pages, most_pages).join(facts, ["chain", "page"])
    order = W.partitionBy("chain").orderBy("place")
    rows = rows.withColumn("_again", (F.col("n_rows") > 0) & (F.row_number().over(W.partitionBy("chain", "signature", F.col("n_rows") > 0).orderBy("place")) > 1))
    rows = rows.withColumns({"_told": F.last("total", ignorenulls=True).over(order), "_offset": F.sum("n_rows").over(order)})
    done = (F.col("n_rows") == 0) | (F.col("n_rows") < page_size) | F.coalesce(F.col("_offset") >= F.col("_told"), F.lit(False))
    rows = rows.withColumn("_stop", F.min(F.when(F.col("_again") | done, F.col("place"))).over(W.partitionBy("chain")))
    rows = checkpointed(rows.where(F.col("_stop").isNull() | (F.col("place") <= F.col("_stop"))).withColumn("_done", done & ~F.col("_again")))
    read = rows.where(~F.col("_again"))
    unique = read.select("chain", "page").join(ids.where("id IS NOT NULL"), ["chain", "page"]).groupBy("chain").agg(F.count_distinct("id").alias("unique_ids"))
    last = rows.groupBy("chain").agg(
        F.max_by("next", "place").alias("next"), F.max_by("_told", "place").alias("_told"), F.bool_or("_done").alias("exhausted"), F.bool_or("_again").alias("repeated_page"), F.count_if(~F.col("_again")).alias("n_pages"), F.max("place").alias("_last"),
    )
    leads = rows.select("chain", F.col("page").alias("next"), F.lit(True).alias("_back"))
    there = pages.select("chain", F.col("page").alias("next"), F.lit(True).alias("_there")).distinct()
    out = last.join(unique, "chain", "left").fillna(0, ["unique_ids"]).join(leads, ["chain", "next"], "left").join(there, ["chain", "next"], "left")
    ended = F.col("exhausted") | F.col("repeated_page")
    official = F.coalesce(F.col("_told"), F.when(F.col("exhausted"), F.col("unique_ids")))
    complete = F.coalesce(official.isNotNull() & F.col("exhausted") & ~F.col("repeated_page") & (F.col("unique_ids") >= official), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)) & ~ended
    return out.select(
        "chain", complete.alias("complete"), official.cast("long").alias("official"), "unique_ids", "n_pages", "exhausted", "repeated_page", flag(F.col("_back")).alias("looped"),
        flag(F.col("next").isNotNull() & F.col("_there").isNull()).alias("broken"), flag(F.col("_last") == most_pages - 1).alias("hit_page_cap"),
    )
