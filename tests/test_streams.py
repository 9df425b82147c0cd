"""Search fan-out: each result once on arrival, the end once, errors between; paged categories followed to their ends and resumed."""

import pytest
from pyspark.sql import functions as F

from orrery.sources.snapshots import Store, Transaction
from orrery.streaming import fanout, frontier


def report(search, site, kind="item", product=None, place=0, second=0, sites=2):
    import datetime as dt

    return (search, search + 100, 1, sites, site, kind, product, f"p-{product}", place, dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=second))


@pytest.fixture
def sites(spark, tmp_path):
    """Adds a file of rows to a site, and runs all there is."""

    class Sites:
        def add(self, site, *rows):
            spark.createDataFrame(list(rows), fanout.REPORT).coalesce(1).write.mode("append").parquet(str(tmp_path / site))

        def run(self):
            streams = [spark.readStream.schema(fanout.REPORT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / s)) for s in ("a", "b")]
            fanout.send(fanout.messages(streams), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
            rows = spark.read.schema(fanout.MESSAGE).parquet(str(tmp_path / "out")).orderBy("search_id", "position").collect()
            assert all((r["user_id"], r["page"]) == (r["search_id"] + 100, 1) for r in rows)
            return [(r["search_id"], r["position"], r["type"].removeprefix("SEARCH_"), r["product_id"]) for r in rows]

    for s in ("a", "b"):
        (tmp_path / s).mkdir()
    return Sites()


def test_results_once_and_the_end_when_all_have_ended(sites):
    sites.add("a", report(1, "a", product="x"), report(1, "a", product="y", place=1), report(2, "a", product="x"))
    sites.add("b", report(1, "b", product="y", second=1), report(1, "b", product="z", place=1, second=1))
    first = sites.run()
    assert first == [(1, 0, "SUCCESS", "x"), (1, 1, "SUCCESS", "y"), (1, 2, "SUCCESS", "z"), (2, 0, "SUCCESS", "x")]
    assert sites.run() == first  # a restart without anything new
    sites.add("a", report(1, "a", product="x", second=2), report(1, "a", "end", second=3), report(2, "a", "error", second=3))
    assert sites.run() == [*first[:3], (2, 0, "SUCCESS", "x"), (2, 1, "ERROR", None)]
    sites.add("b", report(1, "b", product="w", second=4), report(1, "b", "end", second=5), report(1, "b", "end", second=5), report(2, "b", "end", second=5))
    sites.add("a", report(1, "a", product="late", second=9))  # after the end
    want = [*first[:3], (1, 3, "SUCCESS", "w"), (1, 4, "FINISHED", None), (2, 0, "SUCCESS", "x"), (2, 1, "ERROR", None), (2, 2, "FINISHED", None)]
    assert sites.run() == want and sites.run() == want


def test_a_site_that_never_ends(sites):
    """The others' time goes on; the search is over when its own has passed."""
    sites.add("a", report(1, "a", product="x"), report(1, "a", "end", second=1))
    assert sites.run() == [(1, 0, "SUCCESS", "x")]
    sites.add("a", report(3, "a", product="q", second=3600))
    sites.add("b", report(3, "b", product="r", second=3600))
    sites.run()
    sites.add("b", report(3, "b", product="s", second=3601))
    sites.add("a", report(3, "a", product="t", second=3601))
    got = sites.run()
    assert [m for m in got if m[0] == 1] == [(1, 0, "SUCCESS", "x"), (1, 1, "FINISHED", None)]
    assert sorted(m[3] for m in got if m[0] == 3) == ["q", "r", "s", "t"]


def test_reports_show_what_has_an_image(spark):
    df = spark.createDataFrame([("p", "i", 1), ("q", "", 2), ("r", None, 3)], "product_id string, image_url string, n int")
    rows = fanout.reports(df, "s", F.lit(5), F.lit(6), F.lit(1), 2, F.col("n"), F.current_timestamp()).collect()
    assert [(r["search_id"], r["product_id"], r["payload"]) for r in rows] == [(5, "p", '{"product_id":"p","image_url":"i","n":1}')]


def captured_page(url, items, following=None):
    import json

    listed = [{"goodsLinkUrl": u, "goodsName": n, "price": "1,000원"} for u, n in items]
    return url, json.dumps({"data": {"list": listed, "pagination": {"nextPageUrl": following}}})


@pytest.fixture
def captured(spark):
    rows = [captured_page(f"a{i}", [(f"p{i}", "x"), ("same", f"a{i}")], f"a{i + 1}") for i in range(5)]
    rows += [captured_page("a5", [], "a6"), captured_page("a6", [("hidden", "x")])]  # nothing beyond an empty page counts
    rows += [captured_page("b0", [("q0", "x"), ("same", "b0")], "gone")]  # a next page that wasn't captured
    rows += [captured_page("c0", [("r0", "x"), ("", "no link")]), ("d0", "not a listing"), ("d0", None)]
    rows += [captured_page("c0", [("r0", "x"), ("", "no link")]), captured_page("e0", [("s0", "first")], "e1"), captured_page("e1", [("s1", "x")], "")]
    return spark.createDataFrame(rows, "url string, body string")


WANT = {"a": (5, True), "b": (1, True), "c": (1, True), "d": (0, True), "e": (2, True)}


def stands(store):
    return {r["category"]: (r["pages"], r["finished"]) for r in store.read("frontier").collect()}


@pytest.mark.parametrize("pages_a_round", [1, 2, 8])
def test_categories_are_followed_to_their_ends(spark, tmp_path, captured, pages_a_round):
    store = Store(spark, str(tmp_path / "store"))
    categories = spark.createDataFrame([(c, f"{c}0") for c in "abcde"], "category string, url string")
    frontier.start(store, categories, 2)
    assert frontier.crawl(store, captured, most_rounds=1, pages_a_round=pages_a_round, buckets=2) == 1
    first = stands(store)
    assert first["a"] == ((min(5, pages_a_round)), pages_a_round > 5) and first["d"] == (0, True)
    frontier.start(store, categories, 2)  # those that are known stay where they are
    assert stands(store) == first
    frontier.crawl(store, captured, pages_a_round=pages_a_round, buckets=2)  # resumed
    assert stands(store) == WANT
    rows = {r["source_url"]: r["title"] for r in store.read("products").collect()}
    assert rows == {**{f"p{i}": "x" for i in range(5)}, "q0": "x", "r0": "x", "s0": "first", "s1": "x", "same": "a4"}
    assert frontier.crawl(store, captured, buckets=2) == 0


def test_a_round_that_fails_leaves_products_and_frontier(spark, tmp_path, captured, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    frontier.start(store, spark.createDataFrame([("a", "a0")], "category string, url string"), 2)
    frontier.crawl(store, captured, most_rounds=1, pages_a_round=2, buckets=2)
    before, products = stands(store), store.read("products").count()
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(Transaction, "commit", lambda self: (_ for _ in ()).throw(RuntimeError()))
        frontier.crawl(store, captured, pages_a_round=2, buckets=2)
    assert stands(store) == before and store.read("products").count() == products
    frontier.crawl(store, captured, pages_a_round=2, buckets=2)
    assert stands(store) == {"a": (5, True)}


def test_finished_categories_are_not_read_again(spark, tmp_path, captured):
    store = Store(spark, str(tmp_path / "store"))
    frontier.start(store, spark.createDataFrame([("c", "c0")], "category string, url string"), 2)
    frontier.crawl(store, captured, buckets=2)
    frontier.start(store, spark.createDataFrame([("c", "c0"), ("e", "e0")], "category string, url string"), 2)
    watched = captured.withColumn("body", F.when(F.col("url") == "c0", F.lit(None)).otherwise(F.col("body")))  # would end c with no page, were it read
    frontier.crawl(store, watched, buckets=2)
    assert stands(store) == {"c": (1, True), "e": (2, True)}


def test_rounds_grow_with_the_logarithm_of_a_list(spark, tmp_path):
    """Each round takes twice as many pages; a list that comes back to itself goes on, bounded by the pages that there are."""
    rows = [captured_page(f"l{i}", [(f"p{i}", str(i)), ("same", f"l{i}")], f"l{i + 1}" if i < 40 else None) for i in range(41)]
    rows += [captured_page("x0", [("q0", "x")], "x1"), captured_page("x1", [("q1", "x")], "x0")]
    df = spark.createDataFrame(rows, "url string, body string")
    store = Store(spark, str(tmp_path / "store"))
    frontier.start(store, spark.createDataFrame([("l", "l0")], "category string, url string"), 2)
    assert frontier.crawl(store, df, most_rounds=1, pages_a_round=3, buckets=2) == 1 and stands(store) == {"l": (3, False)}
    assert frontier.crawl(store, df, pages_a_round=3, buckets=2) == 4  # 3, 6, 12 and 24 pages; one by one it would be 13
    assert stands(store) == {"l": (41, True)}
    assert {r["source_url"]: r["title"] for r in store.read("products").collect()} == {**{f"p{i}": str(i) for i in range(41)}, "same": "l40"}
    loop = frontier.Links(frontier.links(df))
    begun = spark.createDataFrame([("x", "x1", 5, False)], frontier.FRONTIER)
    pages, moved = frontier.reached(begun, loop, 5)
    assert sorted((r["number"], r["url"]) for r in pages.collect()) == [(6, "x1"), (7, "x0"), (8, "x1"), (9, "x0"), (10, "x1")]
    assert list(map(tuple, moved.collect())) == [("x", "x0", 10, False)]
