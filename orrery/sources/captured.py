"""Listing pages captured as JSON or as server-rendered state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import normalize as N

ITEM = "goodsLinkUrl: string, goodsName: string, thumbnail: string, price: string, normalPrice: string, brand: string, isSoldOut: string, displayGenderText: string"
LISTING = f"struct<data: struct<list: array<struct<{ITEM}>>, pagination: struct<nextPageUrl: string>>>"
STATE = f"struct<props: struct<pageProps: struct<dehydratedState: struct<queries: array<struct<state: struct<data: struct<pages: array<{LISTING}>>>>>>>>>"


def listing_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """A row for each item of listing pages, with the other columns of ``pages`` and its place ``at`` in the list."""
    rest = [c for c in pages.columns if c != body]
    return pages.withColumn("__page", F.from_json(body, LISTING)).select(*rest, F.posexplode("__page.data.list").alias("at", "__item")).select(*rest, "at", "__item.*")


def state_items(pages: DataFrame, body: str = "body") -> DataFrame:
    """The same of the state that a server rendered into a first page: the first page of any query in it."""
    rest = [c for c in pages.columns if c != body]
    queries = pages.withColumn("__state", F.from_json(body, STATE)).select(*rest, F.explode("__state.props.pageProps.dehydratedState.queries").alias("__q"))
    return queries.select(*rest, F.explode(F.get(F.col("__q.state.data.pages"), 0)["data"]["list"]).alias("__item")).select(*rest, "__item.*")


def item_records(items: DataFrame, category: str = "PRODUCT", shop: str = "UNKNOWN", keep: list[str] = ()) -> DataFrame:
    """Product records of listing items, with the columns in ``keep``; those without a link fall out. A price of zero gives way to the normal price."""
    amount = F.coalesce(F.nullif(N.price_batch(F.col("price")), F.lit(0).cast(N.PRICE)), N.price_batch(F.col("normalPrice")))
    return items.where(F.nullif("goodsLinkUrl", F.lit("")).isNotNull()).select(
        F.col("goodsLinkUrl").alias("source_url"), N.falsy(F.col("goodsName"), F.lit("Unknown")).alias("title"), amount.alias("price"), F.lit("KRW").alias("currency"),
        N.falsy(F.col("brand"), F.lit("UNKNOWN")).alias("brand"), F.lit(category).alias("category"), N.soldout(F.col("isSoldOut")).alias("is_soldout"),
        F.coalesce("thumbnail", F.lit("")).alias("image_url"), F.lit(shop).alias("shop"), N.falsy(F.col("displayGenderText"), F.lit("UNKNOWN")).alias("gender"), *keep,
    )


def images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
