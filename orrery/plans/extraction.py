"""Registered queries on raw pages and captured responses, each made from table columns so that SQL can give what a reader must find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import normalize as N
from orrery.operators import brands, federated, sites
from orrery.plans.catalog import LISTING, query
from orrery.sources import html, selectors
from orrery.sources.captured import item_records, state_items, table


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def parts(spark: SparkSession, sf: str, url: str = "https://shop.example/p/") -> DataFrame:
    return table(spark, sf, "part").withColumn("url", F.concat(F.lit(url), text("p_partkey")))


def tag(name: str, body: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{' ' + attributes if attributes else ''}>"), body, F.lit(f"</{name}>"))


def linked(json: Column) -> Column:
    return tag("script", json, 'type="application/ld+json"')


def meta(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'<meta property="{name}" content="'), value, F.lit('">'))


def case(*pages: Column) -> Column:
    """One of the pages, by the part's number."""
    kind = F.col("p_partkey") % len(pages)
    out = F.when(kind == 0, pages[0])
    for i, p in enumerate(pages[1:], 1):
        out = out.when(kind == i, p)
    return out


@query("""
SELECT p_partkey, CASE WHEN k <> 0 THEN p_name || ' & more' END AS title, CASE WHEN k <> 0 THEN '₩' || p_size || ',000' END AS price, CASE WHEN k IN (1, 3) THEN p_brand END AS brand,
CASE WHEN k IN (1, 2) THEN 'https://i.example/' || p_partkey || '.png' END AS image_url, CASE WHEN k = 1 THEN false END AS is_soldout FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def page_marked(spark: SparkSession, sf: str) -> DataFrame:
    """Marked elements; a page without a title gives nothing, a button to buy says that the product is there."""
    heading, cost = tag("h1", F.concat("p_name", F.lit(" &amp; more")), 'class="Product-title"'), tag("div", F.concat(F.lit("₩"), text("p_size"), F.lit(",000")), 'class="big Product-price"')
    brand, buy = tag("h2", F.col("p_brand"), 'class="Product-brand"'), F.lit('<div class="Product-buy">구매하기</div>')
    image = F.concat(F.lit('<img class="Product-image" src="https://i.example/'), text("p_partkey"), F.lit('.png"><img class="Product-image" src="second.png">'))
    page = case(F.concat(cost, brand, image, buy), F.concat(heading, cost, brand, image, buy), F.concat(heading, cost, image), F.concat(F.lit("<div>"), heading, cost, brand))
    found = html.parsed(parts(spark, sf).withColumn("html", page), keep=["p_partkey"])
    return found.select("p_partkey", *(F.col(f"marked.{c}").alias(c) for c in ("title", "price", "brand", "image_url", "is_soldout")))


def product(name: str, **more: Column) -> Column:
    return F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias(name), *(c.alias(k) for k, c in more.items())))


@query("""
SELECT p_partkey, CASE WHEN k IN (0, 1, 2, 4) THEN p_name END AS title, CASE WHEN k IN (0, 1) THEN p_brand END AS brand,
CASE WHEN k = 0 THEN 'a' || p_partkey WHEN k = 1 THEN 'b' || p_partkey END AS image_url, CASE WHEN k IN (0, 2) THEN p_type END AS category,
CASE WHEN k IN (0, 1) THEN p_size::VARCHAR END AS price, CASE WHEN k = 0 THEN 'https://schema.org/InStock' END AS availability FROM (SELECT *, p_partkey % 7 AS k FROM part)""")
def page_linked(spark: SparkSession, sf: str) -> DataFrame:
    """JSON-LD: brands and images in both forms, the first offer, the first product of a list, and scripts that are passed over."""
    whole = product(
        "name", brand=F.struct(F.col("p_brand").alias("name")), image=F.array(F.concat(F.lit("a"), text("p_partkey")), F.lit("x")), category=F.col("p_type"),
        offers=F.array(F.struct(text("p_size").alias("price"), F.lit("https://schema.org/InStock").alias("availability")), F.struct(F.lit("9").alias("price"), F.lit("x").alias("availability"))),
    )
    short = product("headline", brand=F.col("p_brand"), image=F.concat(F.lit("b"), text("p_partkey")), offers=F.struct(F.col("p_size").alias("price")))
    in_list = F.concat(F.lit('[{"@type": "Thing", "name": "no"}, '), product("name", category=F.col("p_type")), F.lit("]"))
    later = F.concat(linked(F.lit('{"@type": "Product", ')), linked(F.lit('{"@type": "Thing"}')), linked(product("name")))
    odd = F.concat(F.lit('["no object", '), product("name"), F.lit("]"))
    page = case(linked(whole), linked(short), linked(in_list), linked(F.lit('[{"@type": "Thing"}]')), later, linked(odd), tag("script", product("name"), 'type="text/plain"'))
    found = html.parsed(parts(spark, sf).withColumn("html", page), keep=["p_partkey"])
    return found.select("p_partkey", *(F.col(f"linked.{c}").alias(c) for c in ("title", "brand", "image_url", "category", "price", "availability")))


@query("""
SELECT p_partkey, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 4 THEN p_name END AS title, CASE k WHEN 2 THEN p_brand END AS shop,
CASE k WHEN 0 THEN 'https://i.example/' || p_partkey WHEN 1 THEN NULL END AS image_url, CASE k WHEN 0 THEN p_size || '00' WHEN 1 THEN p_size || '50' END AS price,
CASE k WHEN 0 THEN 'instock' WHEN 1 THEN 'sold out' END AS availability FROM (SELECT *, p_partkey % 5 AS k FROM part)""")
def page_graph(spark: SparkSession, sf: str) -> DataFrame:
    """OpenGraph: the last of each property, the site's name where a title is missing; properties of other kinds aren't read."""
    first = F.concat(meta("og:title", F.lit("first")), meta("og:title", F.col("p_name")), meta("og:image", F.concat(F.lit(" https://i.example/"), text("p_partkey"))),
                     meta("og:price:amount", F.concat(text("p_size"), F.lit("00"))), meta("og:availability", F.lit("instock")))
    second = F.concat(meta("og:title", F.col("p_name")), meta("og:price:amount", F.lit("1")), meta("og:product:price:amount", F.concat(text("p_size"), F.lit("50"))), meta("og:product:availability", F.lit("sold out")))
    other = F.concat(meta("product:price:amount", F.lit("7")), meta("twitter:title", F.col("p_name")), F.lit('<meta name="description" content="d">'))
    page = case(first, second, meta("og:site_name", F.col("p_brand")), other, F.concat(meta("og:title", F.col("p_name")), other))
    found = html.parsed(parts(spark, sf).withColumn("html", page), keep=["p_partkey"])
    return found.select("p_partkey", *(F.col(f"graph.{c}").alias(c) for c in ("title", "shop", "image_url", "price", "availability")))


def state(sale: Column, normal: Column, soldout: Column, gender: Column) -> Column:
    json = F.to_json(F.struct(
        F.col("p_name").alias("goodsNm"), F.struct(F.col("p_brand").alias("brandName")).alias("brandInfo"), F.col("p_type").alias("baseCategoryFullPath"),
        F.struct(sale.alias("salePrice"), normal.alias("normalPrice")).alias("goodsPrice"), F.lit("//i.example/s.png").alias("thumbnailImageUrl"), soldout.alias("isOutOfStock"), gender.alias("displayGenderText"),
    ))
    return tag("script", F.concat(F.lit("var product = {}; other.product.state = {\"goodsNm\": \"no\"}; window.__MSS_FE__.product.state = "), json, F.lit("; product.done = {};")), 'id="pdp-data"')


PRODUCTS = """
SELECT p_partkey, CASE WHEN k <> 7 THEN p_name END AS title, CASE k WHEN 0 THEN p_size || '00' WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_size || '000' WHEN 3 THEN p_size::VARCHAR WHEN 4 THEN p_size || '25'
WHEN 5 THEN p_size || '.5' WHEN 6 THEN p_size::VARCHAR END AS price,
CASE WHEN k NOT IN (4, 6, 7) THEN p_brand END AS brand, CASE k WHEN 0 THEN '//i.example/s.png' WHEN 1 THEN '//i.example/s.png' WHEN 2 THEN 'm.png' WHEN 3 THEN 'l.png' WHEN 4 THEN 'g.png' WHEN 5 THEN 'l.png' END AS image_url,
CASE WHEN k IN (0, 1, 3, 5) THEN p_type END AS category, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN true END AS is_soldout,
CASE k WHEN 0 THEN 'MEN' ELSE 'UNKNOWN' END AS gender, CASE WHEN k IN (0, 1, 7) THEN 'musinsa' ELSE 'label' || p_partkey % 3 END AS shop
FROM (SELECT *, p_partkey % 8 AS k FROM part)"""


def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of eight kinds: embedded state with texts and with numbers for prices, marked elements, JSON-LD, OpenGraph, each with
    gaps that others fill, JSON-LD with a fraction and with a whole number beside a state that is another site's, and a page of the
    state's site that has none."""
    none = F.lit(None).cast("string")
    first = state(F.concat(text("p_size"), F.lit("00")), F.lit("1"), F.lit(True), F.lit("MEN"))
    second = state(F.lit(0), F.col("p_size") + F.lit(0.5), F.lit(None).cast("boolean"), none)
    graph = F.concat(meta("og:title", F.lit("graph")), meta("og:image", F.lit("g.png")), meta("og:availability", F.lit("in stock")))
    marked = F.concat(tag("h1", F.col("p_name"), 'class="Product-title"'), tag("div", F.concat(F.lit("₩"), text("p_size"), F.lit(",000")), 'class="Product-price"'),
                      tag("h2", F.col("p_brand"), 'class="Product-brand"'), F.lit('<img class="Product-image" src="m.png"><div class="Product-buy">구매하기</div>'))
    offer = lambda price, there: F.struct(price.alias("price"), F.lit(there).alias("availability"))
    json = linked(product("name", brand=F.col("p_brand"), image=F.lit("l.png"), category=F.col("p_type"), offers=offer(text("p_size"), "https://schema.org/OutOfStock")))
    low = F.concat(meta("og:title", F.col("p_name")), meta("og:image", F.lit("g.png")), meta("og:price:amount", F.concat(text("p_size"), F.lit(".25"))), meta("og:availability", F.lit("in stock")))
    half = linked(product("name", brand=F.col("p_brand"), image=F.lit("l.png"), category=F.col("p_type"), offers=offer(F.col("p_size") + F.lit(0.5), "instock")))
    whole = F.concat(linked(product("name", offers=offer(F.col("p_size").cast("double"), "sold out"))), state(F.lit("1"), F.lit("1"), F.lit(False), F.lit("MEN")))
    host = F.when((F.col("p_partkey") % 8).isin(0, 1, 7), F.lit("https://www.musinsa.com/p/")).otherwise(F.concat(F.lit("https://a.label"), text(F.col("p_partkey") % 3), F.lit(".co.kr/p/")))
    page = case(first, second, F.concat(graph, marked), F.concat(json, graph), low, half, whole, F.concat(json, graph, marked))
    return table(spark, sf, "part").withColumn("url", F.concat(host, text("p_partkey"))).withColumn("html", page)


@query(PRODUCTS)
def page_products(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded state by itself, else all readers together, field by field; the shop is the site's label."""
    found = html.products(product_pages(spark, sf), keep=["p_partkey"])
    return found.select("p_partkey", "title", "price", "brand", "image_url", "category", "is_soldout", "gender", "shop")


@query(f"""
SELECT p_partkey, coalesce(title, 'Unknown') AS title, price::DOUBLE AS price, 'KRW' AS currency, coalesce(brand, 'UNKNOWN') AS brand, coalesce(category, 'PRODUCT') AS category, is_soldout,
coalesce(image_url, CASE WHEN p_partkey % 16 = 7 THEN 'own.png' END, '') AS image_url,
CASE WHEN shop = 'musinsa' THEN 'MUSINSA' ELSE 'UNKNOWN' END AS shop, gender, 'feed_add' AS source FROM ({PRODUCTS})""")
def page_product_records(spark: SparkSession, sf: str) -> DataFrame:
    facts = html.marked(html.products(product_pages(spark, sf), keep=["p_partkey"])).withColumn("local_path", F.when(F.col("p_partkey") % 16 == 7, "own.png"))
    out = html.records(facts, keep=["_source"]).withColumn("p_partkey", F.regexp_extract("source_url", r"(\d+)$", 1).cast("long"))
    return out.drop("source_url").withColumn("price", F.col("price").cast("double")).withColumnRenamed("_source", "source")


@query("""
SELECT s_name AS brand_name, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'EN ' || s_suppkey END AS brand_name_eng,
CASE WHEN s_suppkey % 2 = 0 THEN 'https://b.example/brand/' || s_suppkey ELSE 'https://other.example/' || s_suppkey END AS link FROM supplier""")
def brand_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Links of brand lists, the local name on one line and the English one on the next; links elsewhere don't count."""
    key = text("s_suppkey")
    href = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("/brand/"), key)).otherwise(F.concat(F.lit("https://other.example/"), key))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("<br> EN "), key, F.lit(" ")))
    page = F.concat(F.lit('<ul><li class="menu"><a class="view" href="'), href, F.lit('">'), name, F.lit('</a><a href="/no">no</a></li><li class="other"><a class="view" href="/no">no</a></li></ul>'))
    pages = table(spark, sf, "supplier").select(F.concat(F.lit("https://b.example/"), key).alias("url"), page.alias("html"))
    return brands.from_lines(html.anchors(pages), "https://b.example")


@query("""SELECT p_name AS brand_name, p_brand AS brand_name_eng, CASE WHEN p_size > 25 THEN 'https://b.example/' || p_partkey END AS link FROM part""")
def brand_json(spark: SparkSession, sf: str) -> DataFrame:
    """Brand lists captured as JSON, one a brand."""
    entry = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("englishName"), F.when(F.col("p_size") > 25, F.concat(F.lit("https://b.example/"), text("p_partkey"))).alias("linkUrl"))
    bodies = table(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 500).alias("page")).agg(F.to_json(F.collect_list(entry)).alias("body"))
    return brands.from_json(brands.listed(bodies))


@query("SELECT DISTINCT p_brand AS brand_name FROM part")
def brand_popular(spark: SparkSession, sf: str) -> DataFrame:
    """Names of captured answers on popular brands."""
    names = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 500).alias("page")).agg(F.collect_set(F.struct(F.col("p_brand").alias("name"))).alias("popularBrands"))
    bodies = names.select(F.to_json(F.struct(F.struct(F.struct("popularBrands").alias("getPopularKeywordsByFilterCached")).alias("data"))).alias("body"))
    return brands.popular(bodies).distinct()


@query(LISTING)
def state_records(spark: SparkSession, sf: str) -> DataFrame:
    """Listing items of the state that a server rendered into a first page."""
    item = F.struct(
        F.concat(F.lit("https://shop.example/p/"), text("p_partkey")).alias("goodsLinkUrl"), F.col("p_name").alias("goodsName"), F.col("p_retailprice").cast(N.PRICE).cast("string").alias("price"),
        F.col("p_brand").alias("brand"), F.when(F.col("p_size") > 25, "true").otherwise("no").alias("isSoldOut"),
    )
    pages = table(spark, sf, "part").groupBy("p_brand", F.floor(F.col("p_partkey") / 200).alias("page")).agg(F.struct(F.struct(F.collect_list(item).alias("list")).alias("data")).alias("first"))
    other = F.struct(F.lit(None).cast("string").alias("data"))
    queries = F.array(F.struct(F.struct(F.struct(F.array("first").alias("pages")).alias("data")).alias("state")))
    body = F.to_json(F.struct(F.struct(F.struct(F.struct(queries.alias("queries")).alias("dehydratedState")).alias("pageProps"), other.alias("rest")).alias("props")))
    out = item_records(state_items(pages.select(body.alias("body"))))
    return out.select("source_url", "title", F.col("price").cast("double").alias("price"), "brand", "is_soldout")


@query("""
WITH i AS (SELECT 'https://l.example/' || p_partkey % 150 AS link, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS title,
CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR WHEN p_size > 25 THEN p_size::VARCHAR END AS price, CASE WHEN p_partkey % 2 = 0 THEN 'KRW' ELSE 'USD' END AS currency,
CASE WHEN p_size % 5 <> 0 THEN 't' || p_partkey ELSE '' END AS thumbnail, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 0 THEN 'o' || p_partkey END AS original, p_brand, p_partkey FROM part),
s AS (SELECT *, coalesce(original, thumbnail) AS image_url FROM i), f AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY p_partkey) AS n FROM s WHERE image_url <> '')
SELECT sha256(link) AS product_id, coalesce(title, '상품명 없음') AS title, coalesce(price, 'snip ' || p_partkey) AS price, currency, p_brand AS shop, image_url, link AS source_url FROM f WHERE n = 1""")
def captured_search(spark: SparkSession, sf: str) -> DataFrame:
    """Captured answers of two kinds to results with an image, each link once."""
    key, odd = text("p_partkey"), F.col("p_partkey") % 2 == 1
    shared = [
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("title"), F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("t"), key)).otherwise("").alias("thumbnail"),
        F.concat(F.lit("https://l.example/"), text(F.col("p_partkey") % 150)).alias("link"), F.concat(F.lit("snip "), key).alias("snippet"), F.col("p_brand").alias("source"),
    ]
    image = F.struct(*shared, F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("o"), key)).alias("original"), text("p_size").alias("price"))
    match = F.struct(*shared, F.struct(F.when(F.col("p_size") > 25, F.col("p_size")).alias("value"), F.lit("USD").alias("currency")).alias("price"))
    body = F.when(odd, F.to_json(F.struct(F.array(match).alias("visual_matches")))).otherwise(F.to_json(F.struct(F.array(image).alias("images_results"), F.array(match).alias("visual_matches"))))
    raw = table(spark, sf, "part").select(body.alias("body"), F.lit("l.example").alias("site_domain"), F.lit("L").alias("site_name"), F.col("p_partkey").alias("position"))
    found = [federated.with_image(federated.normalized(federated.responses(r), "position")) for r in (raw.where("position % 2 = 0"), raw.where("position % 2 = 1"))]
    return federated.unique(federated.union(found)).select("product_id", "title", "price", "currency", "shop", "image_url", "source_url")


@query("""
SELECT s_suppkey, CASE s_suppkey % 7 WHEN 5 THEN '10.0.0.' || s_suppkey % 250 ELSE CASE WHEN s_suppkey % 7 <> 4 THEN 's' || s_suppkey END END AS site,
CASE s_suppkey % 7 WHEN 0 THEN 'com' WHEN 1 THEN 'co.uk' WHEN 2 THEN 'x.ck' WHEN 3 THEN 'ck' WHEN 4 THEN 'co.uk' WHEN 6 THEN 'unknown' END AS suffix FROM supplier""")
def site_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts under names, wildcards, exceptions and unknown endings, a bare suffix, and addresses."""
    name, k = F.concat(F.lit("s"), text("s_suppkey")), F.col("s_suppkey") % 7
    rules = table(spark, sf, "supplier").select(F.concat(F.lit("!s"), text("s_suppkey"), F.lit(".ck")).alias("rule")).where("rule IS NOT NULL")
    rules = rules.where(F.regexp_extract("rule", "[0-9]+", 0).cast("long") % 7 == 3).unionByName(spark.createDataFrame([(r,) for r in ("com", "UK", "co.uk", "*.ck")], "rule string"))
    host = F.when(k == 0, F.concat(F.lit("www."), name, F.lit(".COM"))).when(k == 1, F.concat(F.lit("a.b."), name, F.lit(".co.uk"))).when(k == 2, F.concat(name, F.lit(".x.ck")))
    host = host.when(k == 3, F.concat(name, F.lit(".ck."))).when(k == 4, "co.uk").when(k == 5, F.concat(F.lit("10.0.0."), text(F.col("s_suppkey") % 250))).otherwise(F.concat(F.lit("shop."), name, F.lit(".unknown")))
    urls = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("https://"), host, F.lit("/p?q=1")).alias("url"))
    return sites.site_labels(urls, rules).select("s_suppkey", "site", "suffix")


@query("""
SELECT p_partkey, place, CASE place WHEN 0 THEN '/b/' || p_partkey WHEN 2 THEN '/c?x=1&y=' || p_size END AS link, CASE place WHEN 0 THEN p_brand || chr(10) || p_type WHEN 1 THEN 'only & name' END AS name,
CASE place WHEN 2 THEN 'k' || p_size END AS mark FROM part, range(3) t(place)""")
def page_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Items and their fields by selectors: children, descendants, attributes by their start, elements that are left open, and gaps."""
    first = F.concat(F.lit('<div class="x brand_con"><p>no</p><div class="brand_image"><span><a href="/b/'), text("p_partkey"), F.lit('">i</a></span></div><div class="brand_dec"><p> '),
                     F.col("p_brand"), F.lit("<br>"), F.col("p_type"), F.lit("</p><p>later</p></div></div>"))
    second = F.lit('<div class="brand_con"><a href="/no">x</a><div class="brand_dec"><p>only &amp; name</div></div><div class="brand"><div class="brand_image"><a href="/no">y</a></div></div>')
    third = F.concat(F.lit('<section><div id="z" class="brand_con"><div class="brand_image"><a href="/c?x=1&amp;y='), text("p_size"), F.lit('"></a></div><b data-kind="mark:1" data-v="k'), text("p_size"), F.lit('"></b>'))
    pages = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("<html><body>"), first, second, third).alias("html"))
    fields = {"link": ".brand_image a@href", "name": ".brand_dec > p", "mark": 'b[data-kind^="mark:"]@data-v'}
    return selectors.selected(pages, "div.brand_con", fields, keep=["p_partkey"]).select("p_partkey", F.col("at").cast("long").alias("place"), *fields)
