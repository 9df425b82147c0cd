"""Results of many search sites in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.normalize import domain, falsy, site_query

COLUMNS = ["product_id", "title", "price", "currency", "brand", "category", "is_soldout", "image_url", "shop", "source_url", "image_vector"]
#: What is shown where a result lacks something.
NO_TITLE, NO_PRICE, NO_SHOP, NO_CATEGORY = "상품명 없음", "가격 미상", "알 수 없는 샵", "알 수 없는 카테고리"
ITEM = "title string, thumbnail string, original string, link string, source string, snippet string, price string, currency string, category string"


def responses(raw: DataFrame, body: str = "body") -> DataFrame:
    """A row for each result of captured responses: ``images_results``, or ``visual_matches`` where that is missing or empty."""
    parsed = F.from_json(body, f"struct<images_results: array<struct<{ITEM.replace(' string', ': string')}>>, visual_matches: array<struct<{ITEM.replace(' string', ': string')}>>>")
    rows = raw.withColumn("__all", parsed)
    items = F.when(F.size("__all.images_results") > 0, F.col("__all.images_results")).otherwise(F.col("__all.visual_matches"))
    return rows.withColumn("__item", F.explode(items)).select(*(c for c in raw.columns if c != body), "__item.*")


def normalized(items: DataFrame, *more: str) -> DataFrame:
    """Results (columns of ``ITEM``, site_domain, site_name) in the common schema.

    A price may be text or a JSON object with value and currency. The id is a
    hash of the link, so that a result fetched twice is known as the same.
    Columns named in ``more`` stay.
    """
    amount, unit = F.get_json_object("price", "$.value"), F.get_json_object("price", "$.currency")
    is_object = F.coalesce(F.trim("price").startswith("{"), F.lit(False))
    image = F.when(~F.coalesce(F.col("site_domain"), F.lit("")).contains("instagram"), falsy(F.col("original"), F.col("thumbnail"))).otherwise(F.col("thumbnail"))
    shop = falsy(F.col("source"), F.col("site_name"), F.lit(NO_SHOP))
    return items.select(
        F.sha2(F.coalesce("link", F.lit("")), 256).alias("product_id"),
        F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
        falsy(F.when(is_object, amount).otherwise(F.col("price")), F.col("snippet"), F.lit(NO_PRICE)).alias("price"),
        falsy(F.when(is_object, unit), F.col("currency"), F.lit("KRW")).alias("currency"),
        shop.alias("brand"),
        falsy(F.col("category"), F.lit(NO_CATEGORY)).alias("category"),
        F.lit(None).cast("boolean").alias("is_soldout"),
        F.coalesce(image, F.lit("")).alias("image_url"),
        shop.alias("shop"),
        F.coalesce("link", F.lit("")).alias("source_url"),
        F.lit(None).cast("string").alias("image_vector"),
        *more,
    )


def with_image(items: DataFrame) -> DataFrame:
    return items.where(F.col("image_url").isNotNull() & (F.col("image_url") != ""))


def union(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def unique(items: DataFrame, key: str = "product_id", order: str = "position") -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in items.columns if c != key]
    return items.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(key, "__row.*")


def site_queries(query: str, shops: DataFrame) -> DataFrame:
    """(domain, query) for each row of ``shops``, which has a domain once (``shop_domains``)."""
    return shops.select("domain", site_query(F.lit(query), F.col("domain")).alias("query"))


def shop_domains(selected: DataFrame, shops: DataFrame) -> DataFrame:
    """(domain, name) of selected shops (name, position), an empty domain for those that aren't known.

    A name has the address of its first shop (id, name, url); of the names with one domain the last selected counts.
    """
    known = shops.groupBy("name").agg(F.min_by("url", "id").alias("url"))
    named = selected.join(known, "name", "left").withColumn("domain", F.coalesce(domain(F.col("url")), F.lit("")))
    return named.groupBy("domain").agg(F.max_by("name", "position").alias("name"))
