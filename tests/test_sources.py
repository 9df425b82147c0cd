"""Facts from hand-written pages."""

import json

import pytest

from orrery.functions import hooks
from orrery.operators import brands, notices, sites
from orrery.sources import captured, html, selectors

MARKED = '<h1 class="Product-title"> A <b>b</b></h1><div class="big Product-price">₩1,000</div><h2 class="Product-brand">X</h2><img class="Product-image" src="i.png"><div class="Product-buy">구매하기</div>'
LINKED = '<script type="application/ld+json">%s</script>'
PRODUCT = {"@type": "Product", "name": "L", "brand": {"name": "LB"}, "image": ["a.png", "b.png"], "offers": [{"price": 12.0, "availability": "https://schema.org/OutOfStock"}], "category": "c"}
GRAPH = '<meta property="og:title" content="G"><meta property="og:title" content=" G2 "><meta property="og:image" content="g.png"><meta property="product:price:amount" content="9.50"><meta property="og:availability" content="in stock">'
STATE = '<script id="pdp-data">window.__MSS_FE__.product.state = {"goodsNm": "S", "brandInfo": {"brandName": "SB"}, "goodsPrice": {"salePrice": 0, "normalPrice": 700}, "isOutOfStock": true};</script>'


def facts(spark, *pages, lenient=False):
    """By the site's label; the page with the state is one of the state's site."""
    url = lambda i, p: f"https://www.shop{i}.co.kr/{'musinsa.com' if p and 'pdp-data' in p else 'p'}"
    df = spark.createDataFrame([(url(i, p), p) for i, p in enumerate(pages)], "url string, html string")
    return {r["shop"]: r for r in html.products(df, lenient).collect()}


def test_readers(spark):
    got = facts(spark, MARKED, LINKED % json.dumps([{"@type": "Thing"}, PRODUCT]), GRAPH, STATE, None, "<p>nothing", LINKED % "{broken" + LINKED % json.dumps(PRODUCT))
    a, b, c, d, e, f, g = (got[f"shop{i}"] for i in range(7))
    assert (a["title"], a["price"], a["brand"], a["image_url"], a["is_soldout"]) == ("Ab", "1000", "X", "i.png", False)
    assert (b["title"], b["price"], b["brand"], b["image_url"], b["is_soldout"], b["category"]) == ("L", "12", "LB", "a.png", True, "c")
    assert (c["title"], c["price"], c["is_soldout"]) == ("G2", None, False)
    assert (d["title"], d["price"], d["brand"], d["is_soldout"], d["gender"]) == ("S", "700", "SB", True, "UNKNOWN")
    assert e["title"] is None and f["title"] is None and g["title"] == "L"


def test_the_url_decides_and_numbers_stay(spark):
    linked = LINKED % json.dumps(PRODUCT | {"offers": {"price": 12.5}})
    rows = [("https://x.example/2", STATE + linked), ("https://www.musinsa.com/3", linked), ("https://www.musinsa.com/4", STATE.replace("__MSS_FE__", "other")), ("https://www.musinsa.com/5", STATE.replace("700", "700.5")),
            ("https://www.musinsa.com/6", STATE.replace('{"brandName": "SB"}', "null")), ("https://x.example/7", LINKED % json.dumps(PRODUCT | {"offers": {"price": "12.5"}})), (None, linked)]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {r["url"]: (r["title"], r["price"]) for r in html.products(df).collect()}
    assert [got[u] for u, _ in rows] == [("L", "12.5"), (None, None), (None, None), ("S", "700.5"), (None, None), ("L", "125"), ("L", "12.5")]


def test_public_suffixes(spark):
    rules = spark.createDataFrame([("com",), ("kr",), ("co.kr",), ("*.ck",), ("!www.ck",), ("*.kobe.jp",), ("jp",), ("!city.kobe.jp",), ("com",)], "rule string")
    want = {"http://a.b.example.com/x": ("example", "com"), "https://shop.co.kr": ("shop", "co.kr"), "https://x.shop.kr": ("shop", "kr"), "https://foo.ck": (None, "foo.ck"), "https://a.foo.ck": ("a", "foo.ck"), "https://www.ck": ("www", "ck"),
            "https://a.b.kobe.jp": ("a", "b.kobe.jp"), "https://city.kobe.jp": ("city", "kobe.jp"), "https://a.zz": ("a", "zz"), "https://localhost/": (None, "localhost"), "https://1.2.3.4/x": ("1.2.3.4", None), "": (None, None), None: (None, None)}
    got = sites.site_labels(spark.createDataFrame([(u, 1) for u in want] * 2, "url string, n int"), rules).collect()
    assert len(got) == 2 * len(want) and {r["url"]: (r["site"], r["suffix"]) for r in got} == want
    assert sites.site_labels(spark.createDataFrame([("https://a.b.com",)], "url string"), rules.limit(0)).first()["site"] == "b"


def test_lenient_price_and_merge(spark):
    got = facts(spark, GRAPH, MARKED.replace("₩1,000", "") + GRAPH, lenient=True)
    assert got["shop0"]["price"] == "950"
    assert (got["shop1"]["title"], got["shop1"]["price"]) == ("Ab", "950")


def test_records_fill_in(spark):
    df = html.products(spark.createDataFrame([("https://musinsa.com/1", "<p>")], "url string, html string"))
    assert html.records(df).select("title", "brand", "category", "shop").first()[:] == ("Unknown", "UNKNOWN", "PRODUCT", "MUSINSA")


def test_state_items(spark):
    page = {"data": {"list": [{"goodsLinkUrl": "u", "goodsName": "n", "price": 0, "normalPrice": 5000, "isSoldOut": True}]}}
    state = {"props": {"pageProps": {"dehydratedState": {"queries": [{"state": {"data": {"pages": [page]}}}]}}}}
    df = spark.createDataFrame([(json.dumps(state),), (None,), ("{}",)], "body string")
    row = captured.item_records(captured.state_items(df)).collect()
    assert [(r["source_url"], int(r["price"]), r["is_soldout"]) for r in row] == [("u", 5000, True)]


def test_brand_anchors(spark):
    page = '<ul><li class="menu"><a class="view" href="/b1">비<br>B</a></li><li class="menu"><a href="/no">x</a></li><li><a class="view" href="/no">y</a></li></ul>'
    got = html.anchors(spark.createDataFrame([("u", page), ("v", None)], "url string, html string"))
    assert [tuple(r) for r in got.collect()] == [("u", "비\nB", "/b1")]
    assert tuple(brands.from_lines(got, "https://x").first()) == ("비", "B", "https://x/b1")


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "index int, t string")
    v = {r[0]: r[1] for r in df.select("index", hooks.encoder(hooks.hashed_encoder(8))("t")).collect()}
    assert len(v[1]) == 8 and v[1] == v[3] and v[2] is None

    def upper(text):
        if text == "bad":
            raise RuntimeError
        return text.upper()

    words = spark.createDataFrame([("a",), ("bad",), (None,)], "t string")
    assert [r[0] for r in words.select(hooks.translator(upper)("t")).collect()] == ["A", "bad", None]
    assert [r[0] for r in words.select(hooks.translator()("t")).collect()] == ["a", "bad", None]
    vectors = spark.createDataFrame([(1, [1.0])], "index int, vector array<double>")
    assert {r["index"]: r["vector"] for r in hooks.scattered(df, vectors).collect()} == {1: [1.0], 2: None, 3: None}


def test_notices(spark):
    items = spark.createDataFrame([("p", "i"), ("q", "")], "product_id string, image_url string")
    assert [r["type"] for r in notices.search_notices(items, 1, 2, failed=True).orderBy("position").collect()] == ["SEARCH_SUCCESS", "SEARCH_ERROR", "SEARCH_FINISHED"]
    results = spark.createDataFrame([(-1, None, 5), (-2, "gone", None)], "placeholder_id long, error string, product_id int")
    assert {r["placeholder_id"]: (r["type"], r["payload"]) for r in notices.crawl_notices(results).collect()} == {-1: ("CRAWL_SUCCESS", '{"product_id":5}'), -2: ("CRAWL_ERROR", '{"error":"gone"}')}


def test_selectors():
    page = ('<ul><li class="menu x"><a class="view" href="/b1">비<br>B</a></li><li class="menu"><p><a class="view" href="/deep">d</a></p></li><li class="menu"><a href="/no">x</a></li>'
            '<li class="menu" id="last"><a class="view big" href="/open">o &amp; p</ul><div data-a="og:t" class="menu">z')  # fmt: skip
    assert selectors.records(page, "li.menu > a.view", {"t": "", "h": "@href"}) == [{"t": "비\nB", "h": "/b1"}, {"t": "o & p", "h": "/open"}]
    assert selectors.records(page, "li.menu", {"t": "a.view", "h": "a@href", "n": "b"}) == [
        {"t": "비\nB", "h": "/b1", "n": None}, {"t": "d", "h": "/deep", "n": None}, {"t": None, "h": "/no", "n": None}, {"t": "o & p", "h": "/open", "n": None}]
    assert [r["t"] for r in selectors.records(page, "#last a, div[data-a^='og:']", {"t": ""})] == ["o & p", "z"]
    assert [r["t"] for r in selectors.records(page, "ul .view.big", {"t": ""})] == ["o & p"] and selectors.records(page, "ul > a", {"t": ""}) == []
    nested = '<div class="i"><b>1</b><div class="i"><b>2</b></div></div><img class="i" src="s"><b>3</b>'
    assert selectors.records(nested, ".i", {"t": "b", "s": "@src"}) == [{"t": "1", "s": None}, {"t": "2", "s": None}, {"t": None, "s": "s"}]
    assert selectors.records(None, "*", {"t": ""}) == [] and selectors.records("</p><<<b", "p", {"t": ""}) == []
    for wrong in ("", ">", "a >", "a:hover", "a[", "a + b"):
        with pytest.raises(ValueError):
            selectors.compiled(wrong)


def test_titles_are_those_of_the_sql(spark, tmp_path):
    """References other than three, some left open, gaps, blanks and a null page."""
    import duckdb

    from orrery.plans import catalog

    texts = ["a &quot;b&quot; &amp;lt; &lt;i&gt;", "x&amp;&amp;&amp", "  &nbsp; y  ", ""]
    rows = [(i, f"u{i}", f"<html><title>{t}</title><body><h1>{t}</h1><h1>later</h1>") for i, t in enumerate(texts)] + [(8, "u8", "<p>none</p>"), (9, "u9", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = duckdb.sql(f"WITH pages AS (FROM '{tmp_path}/pages.parquet/*.parquet') {catalog.ORACLES['html_extract'].strip().replace('WITH t AS', ', t AS', 1)}").fetchall()
    assert sorted(map(tuple, catalog.QUERIES["html_extract"](spark, str(tmp_path)).collect())) == sorted(want)


def test_pages_are_dealt_to_all_tasks(spark):
    """Pages that a scan gives as one part are parsed by as many tasks as shuffles have."""
    df = spark.range(400).coalesce(1).selectExpr("concat('u', id) AS url", "concat('<title>', id, '</title><p class=x>', id, '</p>') AS html")
    for rows in (selectors.selected(df, "p.x", {"t": ""}, keep=["url"]), html.parsed(df), html.anchors(df)):
        assert rows.rdd.getNumPartitions() >= 4
    assert {(r["url"], r["t"]) for r in selectors.selected(df, "p.x", {"t": ""}, keep=["url"]).collect()} == {(f"u{i}", str(i)) for i in range(400)}


def test_a_model_is_given_few_values_at_a_time(spark):
    """However large an Arrow batch is: texts and vectors are held in pieces, and each row keeps its own."""
    seen = lambda texts: [[float(len(texts)), float(t[1:] or 0)] for t in texts]
    df = spark.range(5000).coalesce(1).selectExpr("id", "CASE WHEN id % 7 <> 3 THEN concat('t', id) END AS t")
    plain = df.select("id", "t", hooks.encoder(lambda: seen)("t").alias("vector"))
    tried = hooks.encoded(df, "t", lambda: seen, hooks.Patience(batch=4096))
    for rows, most in ((plain, hooks.PIECE), (tried, 4096)):
        got = rows.collect()
        assert len(got) == 5000 and all((r["vector"] is None) == (r["t"] is None) for r in got)
        assert all(r["vector"][1] == r["id"] and r["vector"][0] <= most for r in got if r["t"])
    import pyarrow as pa

    lengths = list(map(len, hooks.pieces(pa.array(["x" * 10_000] * 5000), 2048)))
    assert sum(lengths) == 5000 and max(lengths) < 450  # 4 MB at a time
    assert max(map(len, hooks.pieces(pa.array(["x"] * 5000), 2048))) == 2048
