"""Registered queries of what a client shows and sends: filters, folders, keys, payloads, notices and batches."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import hooks
from orrery.functions import normalize as N
from orrery.functions import vectors as V
from orrery.operators import brands, federated, feed, merge, notices, paging, search, titles
from orrery.plans.catalog import USER, products, query, saves, shops
from orrery.schemas import BRANDS, LIST_COLUMNS
from orrery.sources.captured import images, table
from orrery.sources.shared import new_folder


@query("SELECT p_partkey AS product_id, p_type AS category FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey + 1000000, p_type FROM part")
def category_filter(spark: SparkSession, sf: str) -> DataFrame:
    """One category by exact match, and "All", which keeps everything."""
    items = products(spark, sf).select("product_id", "category")
    return feed.by_category(items, "PROMO").union(feed.by_category(items, "All").withColumn("product_id", F.col("product_id") + 1_000_000))


@query("SELECT p_partkey AS product_id FROM part WHERE lower(p_type) = 'promo'")
def folder_items(spark: SparkSession, sf: str) -> DataFrame:
    items = products(spark, sf).select("product_id", "category")
    return feed.in_folder(items, "promo").union(feed.in_folder(items, None)).select("product_id")


@query("SELECT p_partkey AS product_id, p_size % 4 = 0 OR p_size % 5 = 0 AS processing FROM part")
def processing_flag(spark: SparkSession, sf: str) -> DataFrame:
    """By the category, whatever its case and blanks, or by a mark."""
    category = F.when(F.col("p_size") % 4 == 0, " Processing ").when(F.col("p_size") % 3 == 0, None).otherwise(F.col("p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), N.is_processing(category, F.when(F.col("p_size") % 5 == 0, True)).alias("processing"))


@query("""SELECT -170000000 AS product_id, 'https://shop.example/new' AS source_url, 'PROCESSING' AS category, 0 AS part
UNION ALL SELECT p_partkey, 'https://shop.example/p/' || p_partkey, p_type, 1 FROM part WHERE p_partkey <> 3""")
def placeholder_shown(spark: SparkSession, sf: str) -> DataFrame:
    """A row for a page that is being read, before the others; a deleted item is gone."""
    items = feed.without(products(spark, sf).select("product_id", "source_url", "category"), 3)
    waiting = feed.placeholder(spark, USER, "https://shop.example/new", 170_000_000).drop("user_id")
    return waiting.withColumn("part", F.lit(0)).unionByName(items.withColumn("part", F.lit(1)))


@query("""SELECT 5000000 + p_partkey AS product_id, p_name AS title, 0 AS part FROM part WHERE p_size = 7
UNION ALL SELECT p_partkey, p_name, 1 FROM part WHERE p_partkey <> 1""")
def placeholder_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """New items come before the others, and the placeholder (here, item 1) goes."""
    items = products(spark, sf).select("product_id", "title")
    new = table(spark, sf, "part").where("p_size = 7").select((F.col("p_partkey") + 5_000_000).alias("product_id"), F.col("p_name").alias("title"))
    return feed.prepended(new, items, 1)


@query(f"""
SELECT product_id, source_url FROM (SELECT DISTINCT l_partkey AS product_id, 'https://shop.example/p/' || l_partkey AS source_url FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = p_partkey % 10 WHERE o_custkey = {USER}) WHERE product_id = (SELECT min(l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = p_partkey % 10 WHERE o_custkey = {USER})""")
def saved_by_url(spark: SparkSession, sf: str) -> DataFrame:
    """The saved item of one page: the filter on its address reaches the scan of products."""
    lines, items, names = saves(spark, sf), products(spark, sf), shops(spark, sf)
    first = feed.saved_feed(lines, items, names, USER).agg(F.min("product_id")).first()[0]
    found = feed.saved_item(lines, items, names, USER, f"https://shop.example/p/{first}")
    return found.select("product_id", "source_url").distinct()


@query("SELECT 0 AS n_text, 0 AS n_vector, 0 AS n_blank, (SELECT count(*) FROM part) AS n_all")
def blank_searches(spark: SparkSession, sf: str) -> DataFrame:
    """Blank queries and empty vectors find nothing; a blank filter keeps all."""
    items = products(spark, sf)
    found = [search.text_search(items, None), search.vector_search(table(spark, sf, "embeddings"), [], 20, "vec_id", "embedding"), search.text_search(items, "  "), search.any_field_contains(items, " ")]
    names = ["n_text", "n_vector", "n_blank", "n_all"]
    out = found[0].agg(F.count("*").alias(names[0]))
    for f, n in zip(found[1:], names[1:]):
        out = out.crossJoin(f.agg(F.count("*").alias(n)))  # one row each
    return out


@query("SELECT least(6, count(*)) AS n, least(6, count(*)) AS n_known, least(6, count(*)) AS n_distinct FROM (SELECT DISTINCT p_name FROM part)")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Six of the names at random: how many, how many of them known, and how many different."""
    names = table(spark, sf, "part").select("p_name").distinct()
    some = search.suggestions(names, 6, seed=4)
    return some.join(names.withColumn("known", F.lit(1)), "p_name", "left").agg(F.count("*").alias("n"), F.sum("known").alias("n_known"), F.count_distinct("p_name").alias("n_distinct"))


@query("SELECT p_partkey, p_name, p_brand FROM part")
def dialog_fields(spark: SparkSession, sf: str) -> DataFrame:
    """What a detail view shows: neither title nor id, nor any field with "source" in its name."""
    items = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("id"), F.col("p_name").alias("title"), "p_name", F.col("p_type").alias("Source_url"), "p_brand", F.lit(1).alias("datasource"))
    return items.select(*search.dialog_fields(items.columns))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'https://site.example/api/images/' || p_partkey || '.png' WHEN p_size % 5 = 1 THEN 'https://i.example/' || p_partkey WHEN p_size % 5 = 2 THEN p_name
ELSE 'https://i.example/l' || p_partkey END AS query, p_name AS secondhand FROM part""")
def similar_query(spark: SparkSession, sf: str) -> DataFrame:
    """What similar items are looked for with: the absolute address of the image shown, else the title; and the second-hand search."""
    key = F.col("p_partkey").cast("string")
    kind = F.col("p_size") % 5
    image = F.when(kind == 0, F.concat(F.lit("/images/"), key, F.lit(".png"))).when(kind == 1, F.concat(F.lit("https://i.example/"), key)).when(kind == 3, "other.png").when(kind == 4, None)
    local = F.when(kind >= 3, F.concat(F.lit("https://i.example/l"), key))
    return table(spark, sf, "part").select("p_partkey", feed.similar_query(image, local, F.col("p_name"), "https://site.example").alias("query"), feed.secondhand_query(F.col("p_name")).alias("secondhand"))


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey END::VARCHAR AS product_id, p_name AS title, p_brand AS brand, p_type AS category, p_partkey AS k FROM part")
def save_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that aren't numbers become null."""
    items = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("f-"), F.col("p_partkey").cast("string"))).alias("product_id"),
        F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_partkey").alias("price"), F.lit("x").alias("text_rank"),
    )
    return feed.save_payload(items).withColumnRenamed("price", "k").select(F.col("product_id").cast("string").alias("product_id"), "title", "brand", "category", "k")


@query("""SELECT c_custkey AS id, c_name || '@example.com' AS email, c_name AS username, c_mktsegment AS profile_image FROM customer
UNION ALL SELECT 0, 'guest@example.invalid', 'Guest', NULL""")
def user_views(spark: SparkSession, sf: str) -> DataFrame:
    """Users as they're shown, and the row that guests share, which is there once however often it is upserted."""
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("oauth_user_id"), F.concat("c_name", F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("profile_image"),
    )
    guest = feed.guest(spark)
    twice = merge.upsert_users(merge.upsert_users(users, guest.withColumn("id", F.lit(0).cast("long"))), guest)
    return feed.user_view(twice)


@query("""
WITH p AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 's' || n_nationkey % 3 || '.example' END AS d FROM nation)
SELECT d AS domain, arg_max(n_name, n_nationkey) AS name, 'coat site:' || d || ' (> products) -inurl:search -inurl:category -inurl:snap' AS query FROM p GROUP BY d""")
def shop_domains(spark: SparkSession, sf: str) -> DataFrame:
    """The domains of selected shops, none for shops that aren't known; of one domain the last selected counts."""
    nation = table(spark, sf, "nation")
    known = nation.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://www.s"), (F.col("n_nationkey") % 3).cast("string"), F.lit(".example/shop")).alias("url"))
    found = federated.shop_domains(nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position")), known.union(known.select(F.col("id") + 100, "name", F.lit("https://later.example"))))
    return found.join(federated.site_queries("coat", found), "domain").select("domain", "name", "query")


@query("SELECT s_suppkey, coalesce(nullif(CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE s_name END, ''), '제목 없음') AS title FROM supplier")
def title_fallback(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("s_suppkey") % 3
    return table(spark, sf, "supplier").select("s_suppkey", N.title(F.when(kind == 0, "").when(kind == 2, F.col("s_name"))).alias("title"))


@query("""
SELECT page_id, CASE WHEN url LIKE 'http%' AND page_id % 2 = 0 THEN url ELSE 'https://' || regexp_replace(url, '^https?://', '') END AS url, page_id || '::' || url AS key,
'₩' || CASE WHEN page_id < 1000 THEN page_id::VARCHAR ELSE page_id // 1000 || ',' || lpad((page_id % 1000)::VARCHAR, 3, '0') END AS amount FROM pages""")
def presented(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses with a scheme, keys of items, and amounts as they're shown."""
    bare = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf, "pages").select("page_id", N.with_scheme(bare).alias("url"), N.item_key(F.col("page_id"), F.lit(None).cast("string"), F.col("url")).alias("key"), N.won(F.col("page_id")).alias("amount"))


@query("SELECT doc_id, text AS decoded FROM documents")
def image_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Data addresses to the bytes in them, here texts."""
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "UTF-8")))
    return table(spark, sf, "documents").select("doc_id", F.decode(N.image_bytes(uri), "UTF-8").alias("decoded"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_text(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors unwrapped from a list of one, as text and back."""
    shown = table(spark, sf, "embeddings").select("vec_id", N.vector_text(N.vector_unwrapped(F.array(V.doubles(F.col("embedding"))))).alias("t"))
    v = F.from_json("t", "array<double>")
    return shown.select("vec_id", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"), F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query("""SELECT vec_id, i - 1 AS at, round(embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS value FROM embeddings, range(1, 65) t(i)""")
def vector_normalized_whole(spark: SparkSession, sf: str) -> DataFrame:
    """All elements of vectors of length one."""
    found = table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.normalized(F.col("embedding"))).alias("at", "value"))
    return found.select("vec_id", F.col("at").cast("long").alias("at"), F.round("value", 6).alias("value"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS translated FROM documents")
def translated(spark: SparkSession, sf: str) -> DataFrame:
    """A translator that fails on some texts leaves them as they are."""

    def upper(text: str) -> str:
        if not text.startswith("en "):
            raise ValueError(text)
        return text[3:].upper()

    marked = F.when(F.col("lang") == "en", F.concat(F.lit("en "), F.col("source"))).otherwise(F.col("source"))
    return table(spark, sf, "documents").select("doc_id", hooks.translator(upper)(marked).alias("translated"))


@query("SELECT doc_id, length(source)::DOUBLE AS first, CASE WHEN lang = 'en' THEN NULL ELSE 1.0::DOUBLE END AS second FROM documents")
def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a model that is loaded once a worker; nulls aren't encoded."""
    docs = table(spark, sf, "documents")
    length = hooks.encoder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    return docs.select("doc_id", length("source")[0].cast("double").alias("first"), length(F.when(F.col("lang") != "en", F.col("source")))[1].cast("double").alias("second"))


@query("SELECT d.doc_id, CASE WHEN doc_id % 3 = 0 THEN 'q' || quality END AS vector FROM documents d LEFT JOIN labels l USING (doc_id)")
def scattered(spark: SparkSession, sf: str) -> DataFrame:
    """What was made for some rows goes back to them, null to the others."""
    made = table(spark, sf, "labels").where("doc_id % 3 = 0").select(F.col("doc_id").alias("index"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("vector"))
    return hooks.scattered(table(spark, sf, "documents").select(F.col("doc_id").alias("index")), made).select(F.col("index").alias("doc_id"), "vector")


@query("SELECT o_orderkey, i AS at, l_partkey AS item, l_linenumber AS line FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem) JOIN orders ON o_orderkey = l_orderkey")
def aligned_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Results that a batch returns as separate lists, put together by their places."""
    lines = table(spark, sf, "lineitem")
    batch = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("rows"))
    lists = batch.select(F.col("l_orderkey").alias("o_orderkey"), F.col("rows.l_partkey").alias("item"), F.col("rows.l_linenumber").alias("line"))
    out = merge.aligned(lists, ["item", "line"]).join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return out.select("o_orderkey", F.col("at").cast("long").alias("at"), "item", "line")


@query("SELECT event_type AS batch, count(*) AS n_items, sum(count(*)) OVER ()::BIGINT AS n_total FROM events GROUP BY event_type")
def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Items of each batch and of all."""
    return merge.batch_totals(table(spark, sf, "events").select(F.col("event_type").alias("batch")), "batch")


@query("""SELECT (SELECT count(*) FROM events) AS processed, (SELECT count(*) FROM events WHERE value > 90) AS failed, event_type || ': value ' || event_id AS error FROM events WHERE value > 90""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a run beside each of its errors."""
    error = F.when(F.col("value") > 90, F.concat(F.lit("value "), F.col("event_id").cast("string")))
    results = table(spark, sf, "events").select(F.col("event_type").alias("brand_name"), error.alias("error"))
    return brands.run_summary(results).crossJoin(brands.run_errors(results))  # one row of counts


@query("""SELECT event_id AS placeholder_id, CASE WHEN event_type = 'error' THEN 'CRAWL_ERROR' ELSE 'CRAWL_SUCCESS' END AS type,
CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error, CASE WHEN event_type <> 'error' THEN event_type END AS title FROM events""")
def crawl_notices(spark: SparkSession, sf: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    results = table(spark, sf, "events").select(
        F.col("event_id").alias("placeholder_id"), F.when(failed, F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error"), F.when(~failed, F.col("event_type")).alias("title")
    )
    out = notices.crawl_notices(results)
    return out.select("placeholder_id", "type", F.get_json_object("payload", "$.error").alias("error"), F.get_json_object("payload", "$.title").alias("title"))


@query("""SELECT event_id, event_type IN ('click', 'view') AS saved_now, CASE WHEN event_type IN ('click', 'view') THEN 'click,view' ELSE 'click,' || event_type || ',view' END AS saved,
CASE event_type WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE 'click,' || event_type || ',view' END AS toggled FROM events""")
def saved_sets(spark: SparkSession, sf: str) -> DataFrame:
    """A set that an item is put into if it isn't there, and one that it is put into or taken from."""
    start, item = F.array(F.lit("click"), F.lit("view")), F.col("event_type")
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return table(spark, sf, "events").select("event_id", F.array_contains(start, item).alias("saved_now"), listed(feed.with_saved(start, item)).alias("saved"), listed(feed.toggled(start, item)).alias("toggled"))


@query("SELECT p_partkey AS product_id, p_name AS title, coalesce(len(embedding), 0) AS n_title_vector, p_partkey % 10 AS shop_id, s_name AS shop FROM part LEFT JOIN embeddings ON vec_id = p_partkey JOIN supplier ON s_suppkey = p_partkey % 10")
def wide_list(spark: SparkSession, sf: str) -> DataFrame:
    """The list with vectors and shop ids, in its own column order."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("title_vector"))
    items = products(spark, sf).join(vectors, "product_id", "left").withColumn("image_vector", F.lit(None).cast("array<float>"))
    out = feed.newest_first(items, shops(spark, sf)).select(*LIST_COLUMNS)
    return out.select("product_id", "title", F.when(F.col("title_vector").isNotNull(), F.size("title_vector")).otherwise(0).alias("n_title_vector"), "shop_id", "shop")


@query("SELECT p_brand AS brand_name, 'https://brands.example/' || min(p_partkey) AS link, count(*)::VARCHAR AS keywords, 8 AS columns FROM part GROUP BY p_brand")
def brand_schema(spark: SparkSession, sf: str) -> DataFrame:
    """An empty table of brands takes those of the parts: columns that they lack are null, all have the schema's types."""
    found = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand_name")).agg(
        F.concat(F.lit("https://brands.example/"), F.min("p_partkey").cast("string")).alias("link"), F.count("*").cast("string").alias("keywords")
    )
    whole = spark.createDataFrame([], BRANDS).unionByName(found, allowMissingColumns=True)
    return whole.select("brand_name", "link", "keywords", F.lit(len(whole.columns)).alias("columns"))


@query("""SELECT doc_id, CASE WHEN doc_id % 97 <> 5 THEN length(text)::DOUBLE WHEN doc_id % 2 = 0 THEN -1.0 END AS first, doc_id % 97 = 5 AS failed FROM documents WHERE text IS NOT NULL
UNION ALL SELECT -1, count(*)::DOUBLE, true FROM documents WHERE text IS NOT NULL AND doc_id % 97 = 5 HAVING count(*) > 0""")
def encoded_with_failures(spark: SparkSession, sf: str) -> DataFrame:
    """A model that refuses some texts, whatever they are sent with: only these have a fallback or nothing, and are counted."""

    def load():
        def model(texts: list) -> list:
            if any(t.startswith("5#") for t in texts):
                raise RuntimeError("refused")
            return [[float(len(t.partition("#")[2]) - 1)] for t in texts]

        return model

    marked = F.concat((F.col("doc_id") % 97).cast("string"), F.lit("#"), (F.col("doc_id") % 2).cast("string"), "text")
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", marked.alias("t"))
    made = hooks.encoded(docs, "t", load, hooks.Patience(retries=1, base_delay=0.0, batch=16, calls=2), fallback=lambda t: [-1.0] if t[2] == "0" else None)
    each = made.select("doc_id", F.col("vector")[0].cast("double").alias("first"), F.col("vector_error").isNotNull().alias("failed"))
    total = hooks.failures(made).select(F.lit(-1).cast("long").alias("doc_id"), F.col("n").cast("double").alias("first"), F.lit(True).alias("failed"))
    return each.unionByName(total)


WORDS_ASKED = """SELECT n_nationkey AS query_id, CASE n_nationkey % 6 WHEN 0 THEN ' ' || upper(w) || ' ' WHEN 1 THEN substr(w, 1, 2) WHEN 2 THEN substr(w, 1, 1) || '_' || substr(w, 3) WHEN 3 THEN substr(w, 1, 3) || '%e'
WHEN 4 THEN 'no such title' END AS query FROM (SELECT n_nationkey, string_split((SELECT p_name FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part) + n_nationkey), ' ')[1] AS w FROM nation)"""


@query(f"""
SELECT query_id, p_partkey AS key, title, text_rank, rank FROM (SELECT query_id, p_partkey, p_name AS title, CASE WHEN lower(p_name) = q THEN 0 WHEN lower(p_name) LIKE q || '%' THEN 1 ELSE 2 END AS text_rank,
row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lower(p_name) = q THEN 0 WHEN lower(p_name) LIKE q || '%' THEN 1 ELSE 2 END, p_size DESC, p_partkey)::INT AS rank
FROM part JOIN (SELECT query_id, lower(trim(query)) AS q FROM ({WORDS_ASKED})) ON lower(p_name) LIKE '%' || q || '%') WHERE rank <= 20""")
def text_search_many(spark: SparkSession, sf: str) -> DataFrame:
    """A table of queries: whole words, two characters, wildcards, what no title has, and nulls."""
    names = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ")[0].alias("w"))
    low = table(spark, sf, "part").agg(F.min("p_partkey").alias("low"))
    nation = table(spark, sf, "nation").crossJoin(low)  # one row
    w, k = F.col("w"), F.col("n_nationkey") % 6
    cut = lambda a, n: F.substring(w, a, n)
    text = F.when(k == 0, F.concat(F.lit(" "), F.upper("w"), F.lit(" "))).when(k == 1, cut(1, 2)).when(k == 2, F.concat(cut(1, 1), F.lit("_"), cut(3, 100))).when(k == 3, F.concat(cut(1, 3), F.lit("%e"))).when(k == 4, "no such title")
    queries = nation.join(names, F.col("p_partkey") == F.col("low") + F.col("n_nationkey"), "left").select(F.col("n_nationkey").alias("query_id"), text.alias("query"))
    folder = new_folder(spark, "titles")
    titles.write_index(products(spark, sf), folder)
    return titles.search_many(queries, products(spark, sf), spark.read.parquet(folder))


@query("""SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) // 50 + 1 AS page FROM orders QUALIFY page <= 5""")
def list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Five pages of a list, each from where the last one ended."""
    folder = new_folder(spark, "list")
    paging.write_list(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), folder, "o_orderdate", "o_orderkey")
    found = [rows.select("o_orderkey", F.lit(number).cast("long").alias("page")) for number, rows, _ in paging.pages(spark, folder, 50, 5, "o_orderdate", "o_orderkey")]
    return reduce(DataFrame.unionByName, found)


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 3 = 1 THEN false END AS is_soldout FROM part")
def soldout_typed(spark: SparkSession, sf: str) -> DataFrame:
    """A flag passes as it is; texts and numbers give null."""
    kind = F.col("p_size") % 3
    raw = F.when(kind == 0, F.lit("true")).when(kind == 1, F.lit("false")).otherwise(F.lit('"yes"'))
    return table(spark, sf, "part").select("p_partkey", N.soldout_flag(raw).alias("is_soldout"))


@query("""
WITH o AS (SELECT user_id % 50 AS k, event_id, event_type, value FROM events), f AS (SELECT k, arg_min(value, event_id) AS made, arg_min(event_id, event_id) AS created,
arg_max(event_type, event_id) AS title, max_by(value, event_id) FILTER (WHERE event_type = 'purchase') AS image FROM o GROUP BY k),
e AS (SELECT vec_id AS k, 'label ' || label AS title, embedding[1]::DOUBLE AS made, embedding[2]::DOUBLE AS image, -1 AS created FROM embeddings WHERE vec_id % 2 = 0)
SELECT coalesce(e.k, f.k) AS source_url, coalesce(f.title, e.title) AS title, round(coalesce(e.made, f.made), 6) AS title_first, round(coalesce(f.image, e.image), 6) AS image_first,
coalesce(e.created, f.created) AS created FROM e FULL JOIN f ON e.k = f.k""")
def product_batch_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A batch with many rows a key, new keys too, as if its rows were applied one by one: what updates don't touch is the first row's."""
    existing = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(
        F.col("vec_id").alias("source_url"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("title"), F.array(F.col("embedding")[0].cast("double")).alias("title_vector"),
        F.array(F.col("embedding")[1].cast("double")).alias("image_vector"), F.lit(-1).cast("long").alias("created_at"),
    )
    incoming = table(spark, sf, "events").select(
        (F.col("user_id") % 50).alias("source_url"), F.col("event_type").alias("title"), F.array("value").alias("title_vector"),
        F.when(F.col("event_type") == "purchase", F.array("value")).alias("image_vector"), F.col("event_id").alias("created_at"), F.col("event_id").alias("seq"),
    )
    out = merge.upsert_products(existing, incoming, seq="seq")
    return out.select("source_url", "title", F.round(F.col("title_vector")[0], 6).alias("title_first"), F.round(F.col("image_vector")[0], 6).alias("image_first"), F.col("created_at").alias("created"))


@query("""SELECT position, message, count(*) AS n FROM (SELECT 0 AS position, '{"type":"SEARCH_SUCCESS","results":[{"event_id":' || event_id || ',"image_url":"i"}],"is_append":true,"page":3}' AS message FROM events WHERE event_type <> 'error'
UNION ALL SELECT 1, '{"type":"SEARCH_ERROR","message":"a \\"b\\""}' UNION ALL SELECT 2, '{"type":"SEARCH_FINISHED"}') GROUP BY ALL""")
def search_messages(spark: SparkSession, sf: str) -> DataFrame:
    """What goes to a user's channel, word for word."""
    items = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", "").otherwise("i").alias("image_url"))
    sent = notices.messages(notices.search_notices(items, USER, 3, failed=True), 'a "b"')
    return sent.groupBy("position", "message").agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT p_partkey AS k, p_name, p_brand, p_partkey % 5 AS kind FROM part)
SELECT 'found' AS part, p_name || k AS brand_name, CASE WHEN kind IN (0, 4) THEN k::VARCHAR END AS value, kind IN (2, 3) AS failed FROM p
UNION ALL SELECT 'edge', p_name || k, k + 1 || ' ' || p_brand || ' ' || coalesce(CASE WHEN k % 2 = 0 THEN 'k' END, '-'), false FROM p WHERE kind = 0""")
def brand_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with a brand, with another code, with errors, broken and, for the last kind, with a brand whose similar ones couldn't be had."""
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 5
    body = lambda code, brand: F.to_json(F.struct(F.struct(F.struct(F.lit(code).alias("code"), brand.alias("brand")).alias("getBrandByNameResponse")).alias("data")))
    brand = F.struct(k.cast("string").alias("id"))
    text = F.when(kind.isin(0, 4), body(200, brand)).when(kind == 1, body(404, brand)).when(kind == 2, F.lit('{"errors": ["x"], "data": null}')).otherwise(F.lit('{"data": '))
    parts = table(spark, sf, "part").withColumn("brand_name", F.concat("p_name", k.cast("string")))
    found = brands.found_ids(parts.select("brand_name", text.alias("body")))
    near = F.array(F.struct((k + 1).alias("id"), F.col("p_brand").alias("name"), F.when(k % 2 == 0, "k").alias("name_kr")))
    similar = F.when(kind == 4, F.lit('{"errors": ["y"]}')).otherwise(F.to_json(F.struct(F.struct(near.alias("getSimilarBrands")).alias("data"))))
    linked = brands.edges(found, parts.select(k.cast("string").alias("brand_id"), similar.alias("body")))
    shown = F.concat_ws(" ", F.col("id").cast("string"), "name", F.coalesce("name_kr", F.lit("-")))
    first = found.select(F.lit("found").alias("part"), "brand_name", F.col("brand_id").alias("value"), F.col("error").isNotNull().alias("failed"))
    return first.unionByName(linked.select(F.lit("edge").alias("part"), "brand_name", shown.alias("value"), F.lit(False).alias("failed")))


@query("SELECT p_partkey, p_name AS title FROM part")
def binary_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of bytes read whole, as images are: here each has the lines of some parts."""
    folder = new_folder(spark, "files")
    lines = table(spark, sf, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name").alias("value"))
    lines.repartition(8, "value").write.text(folder)
    content = images(spark, f"{folder}/part-*").select(F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    return content.select(F.split_part("line", F.lit("|"), F.lit(1)).cast("long").alias("p_partkey"), F.split_part("line", F.lit("|"), F.lit(2)).alias("title"))
