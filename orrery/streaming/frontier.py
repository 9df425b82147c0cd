"""Paged categories followed to their ends, over captured pages, with a resumable frontier.

Where a category stands (its next page and how many are done) is a table of the
same store as the products, and each round commits both together: a round that
fails leaves neither, and one that is run again starts where the last one ended.
Finished categories are never looked at again.

A round follows each open category for some pages at once, and each round for
twice as many as the one before, so that a list of n pages takes about log2(n)
commits. Within a round pages are found by doubling: a small table of links
(page, next page, number of items), which is made once, gives tables of where
2, 4, 8 ... pages on lead, and each of these doubles the pages that are known to
be reached. The pages themselves are read once a round, those that were reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.merge import merge_products
from orrery.sources.captured import LISTING, item_records, listing_items
from orrery.sources.shared import written
from orrery.sources.snapshots import Store, Transaction

FRONTIER = "category string, next_url string, pages long, finished boolean"
#: Pages of a category that the first round follows.
PAGES_A_ROUND = 8


def links(captured: DataFrame) -> DataFrame:
    """(url, next_url, items) of captured pages (url, body); of a page that isn't a listing, no items. Pages that were captured twice count once."""
    page = F.from_json("body", LISTING)
    found = captured.select("url", page.alias("p")).select("url", F.col("p.data.pagination.nextPageUrl").alias("next_url"), F.coalesce(F.size("p.data.list"), F.lit(0)).alias("items"))
    return found.groupBy("url").agg(F.max_by(F.struct("next_url", "items"), F.struct("items", "next_url")).alias("l")).select("url", "l.next_url", "l.items")


def start(store: Store, categories: DataFrame, buckets: int = 8) -> None:
    """Categories (category, url of the first page) that the store doesn't know yet join its frontier."""
    with store.transaction() as t:
        if "frontier" not in t.tables:
            t.create("frontier", store.spark.createDataFrame([], FRONTIER), ["category"], buckets)
        known = t.read("frontier").select("category")
        new = categories.join(known, "category", "left_anti").groupBy("category").agg(F.min("url").alias("next_url"))
        t.upsert("frontier", new.select("category", "next_url", F.lit(0).cast("long").alias("pages"), F.lit(False).alias("finished")))


class Links:
    """Links with the tables of where 2^k pages on lead, each made when it is first asked for."""

    def __init__(self, links: DataFrame):
        self.links = links
        on = (F.col("items") > 0) & (F.coalesce(F.col("next_url"), F.lit("")) != "")  # only these lead anywhere
        self._steps = [links.where(on).select("url", F.col("next_url").alias("to"))]

    def step(self, k: int) -> DataFrame:
        """(url, to): the page 2^k pages after each one that has so many."""
        while len(self._steps) <= k:
            last = self._steps[-1]
            further = last.select("url", F.col("to").alias("over")).join(last.select(F.col("url").alias("over"), "to"), "over")
            self._steps.append(written(further.select("url", "to"), "leap"))
        return self._steps[k]


def reached(frontier: DataFrame, links: Links, most: int = PAGES_A_ROUND) -> tuple[DataFrame, DataFrame]:
    """The pages (category, url, number) that open categories come to, and their new frontier.

    A category ends at its first page that is empty or isn't captured, or after a page without a next one. ``most`` pages
    are followed; a chain that comes back to itself goes on for ever, as it would on the site, ``most`` pages a round.
    """
    at = frontier.where("not finished").select("category", F.col("next_url").alias("url"), "pages", F.lit(0).cast("long").alias("place"))
    for k in range((most - 1).bit_length()):  # at holds the places below 2^k
        far = F.col("place") + (1 << k)
        further = at.where(far < most).join(links.step(k), "url").select("category", F.col("to").alias("url"), "pages", far.alias("place"))
        at = written(at.unionByName(further), "step")
    full = F.coalesce(F.col("items"), F.lit(0)) > 0
    last = F.coalesce(F.col("next_url"), F.lit("")) == ""
    number = F.col("pages") + F.col("place")
    at = at.join(links.links, "url", "left").select("category", "url", number.alias("pages"), "place", "next_url", full.alias("full"), last.alias("last"))
    at = written(at, "reached")
    pages = at.where("full").select("category", "url", (F.col("pages") + 1).alias("number"))
    over = F.when(F.col("full") & ~F.col("last"), F.col("next_url")).when(~F.col("full"), F.col("url"))
    done = F.col("pages") + F.col("full").cast("long")
    moved = at.where(~F.col("full") | F.col("last") | (F.col("place") == most - 1))
    return pages, moved.select("category", over.alias("next_url"), done.alias("pages"), (~F.col("full") | F.col("last")).alias("finished"))


def crawl(store: Store, captured: DataFrame, most_rounds: int | None = None, pages_a_round: int = PAGES_A_ROUND, buckets: int = 64) -> int:
    """Rounds until every category of the frontier is finished, or ``most_rounds``; how many were made.

    The first follows ``pages_a_round`` pages of a category, each other one twice as many as the one before, but never
    more than there are pages: a category's list is no longer, unless it comes back to itself.

    Items go into the table ``products`` as they would one by one: pages in their order, within a page by place, of several
    categories by name.
    """
    known = Links(written(links(captured), "links"))
    made, most, there = 0, pages_a_round, None
    while most_rounds is None or made < most_rounds:
        with store.transaction() as t:
            open_ = t.read("frontier").where("not finished")
            if open_.isEmpty():
                return made
            pages, moved = reached(open_, known, most)
            _merged(t, written(pages, "pages"), captured, buckets)
            t.upsert("frontier", written(moved, "moved"))
        made += 1
        there = known.links.count() if there is None else there
        most = max(pages_a_round, min(2 * most, there))
    return made


def _merged(t: Transaction, pages: DataFrame, captured: DataFrame, buckets: int) -> None:
    page = F.from_json("body", LISTING)["data"]
    order = F.struct(F.coalesce(F.size(page["list"]), F.lit(0)), page["pagination"]["nextPageUrl"], "body")  # of a page's captures the one that ``links`` has
    wanted = captured.join(pages.select("url").distinct(), "url", "left_semi")
    bodies = pages.join(wanted.groupBy("url").agg(F.max_by("body", order).alias("body")), "url")
    rows = listing_items(bodies.select(F.struct("number", "category").alias("page"), "body"))
    items = item_records(rows, keep=["page", "at"]).withColumn("seq", F.struct("page", "at")).drop("page", "at")
    if "products" not in t.tables:
        t.create("products", items.drop("seq").limit(0), ["source_url"], buckets)
    merge_products(t, items, seq="seq")

