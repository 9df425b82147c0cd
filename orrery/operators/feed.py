"""Saved-item feeds: joins, order, folders and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.normalize import display_image, falsy

#: Folders by the furniture that they're shown in.
HANGING, DRAWER, SIDE = ["outer", "top", "outerwear", "tops"], ["bottom", "bottoms", "pants"], ["shoes", "accessories", "jewelry"]


def with_shops(products: DataFrame, shops: DataFrame) -> DataFrame:
    """Products with the name of their shop; products without one fall out.

    The planner broadcasts the shops if they are small, and else joins by key.
    """
    names = shops.select(F.col("id").alias("__shop"), F.col("name").alias("shop"))
    return products.join(names, products["shop_id"] == names["__shop"]).drop("__shop")


def saved_feed(saves: DataFrame, products: DataFrame, shops: DataFrame, user_id: int) -> DataFrame:
    """A user's saved products, the newest save first; ``created_at`` is the save's."""
    own = saves.where(F.col("user_id") == user_id).select("product_id", F.col("created_at").alias("__saved"))
    joined = own.join(products.drop("created_at"), "product_id").withColumnRenamed("__saved", "created_at")
    return with_shops(joined, shops).orderBy(F.desc("created_at"), "product_id")


def saved_item(saves: DataFrame, products: DataFrame, shops: DataFrame, user_id: int, source_url: str) -> DataFrame:
    """A user's save of one page; the filter goes before the joins, so that it reaches the scan."""
    return saved_feed(saves, products.where(F.col("source_url") == source_url), shops, user_id)


def newest_first(products: DataFrame, shops: DataFrame) -> DataFrame:
    return with_shops(products, shops).orderBy(F.desc("created_at"), "product_id")


def save_count(saves: DataFrame, user_id: int) -> DataFrame:
    return saves.where(F.col("user_id") == user_id).agg(F.count("*").alias("n_saves"))


def by_category(items: DataFrame, category: str) -> DataFrame:
    """Exact match; "All" and "FOLDER" keep everything."""
    return items if category in ("All", "FOLDER") else items.where(F.col("category") == category)


def in_folder(items: DataFrame, folder: str | None) -> DataFrame:
    """Items of a folder; none where no folder is chosen."""
    return items.where(F.lower("category") == folder) if folder else items.limit(0)


def folders(items: DataFrame, position: str) -> DataFrame:
    """(folder, first_seen): lower-case categories in use, in the order of ``position``."""
    used = items.where(F.col("category").isNotNull() & (F.upper(F.trim("category")) != "PROCESSING"))
    return used.groupBy(F.lower("category").alias("folder")).agg(F.min(position).alias("first_seen")).orderBy("first_seen", "folder")


def folder_counts(items: DataFrame, strict: bool = False) -> DataFrame:
    """(folder, n_items); ``strict`` counts only items whose category is written as the folder is."""
    folder = F.lower("category")
    n = F.count_if(F.col("category") == folder) if strict else F.count("*")
    return items.where(F.upper(F.trim("category")) != "PROCESSING").groupBy(folder.alias("folder")).agg(n.alias("n_items"))


def bucket(folder: Column) -> Column:
    f = F.lower(folder)
    return F.when(f.isin(HANGING), "hanging").when(f.isin(DRAWER), "drawer").when(f.isin(SIDE), "side").otherwise("other")


def placeholder(spark, user_id: int, url: str, now_ns: int) -> DataFrame:
    """The row shown while a page is being read; its id is negative, so that no product has it."""
    return spark.createDataFrame([(-now_ns, url, "PROCESSING", user_id)], "product_id long, source_url string, category string, user_id int")


def without(items: DataFrame, product_id: int) -> DataFrame:
    return items.where(F.col("product_id") != product_id)


def prepended(new: DataFrame, items: DataFrame, placeholder_id: int) -> DataFrame:
    """New items before the others, the placeholder gone; ``part`` is 0 and 1."""
    return new.withColumn("part", F.lit(0)).unionByName(without(items, placeholder_id).withColumn("part", F.lit(1)), allowMissingColumns=True)


def appended_unseen(seen: DataFrame, incoming: DataFrame, key: str = "product_id") -> DataFrame:
    """``seen`` and the incoming rows with other keys; repeats within ``incoming`` stay."""
    return seen.unionByName(incoming.join(seen.select(key), key, "left_anti").select(incoming.columns), allowMissingColumns=True)


def toggled(selected: Column, item: Column) -> Column:
    return F.when(F.array_contains(selected, item), F.array_except(selected, F.array(item))).otherwise(F.array_union(selected, F.array(item)))


def with_saved(saved: Column, item: Column) -> Column:
    """The set with the item, which is put in only if it isn't there."""
    return F.array_union(saved, F.array(item))


def similar_query(image: Column, local: Column, title: Column, origin: str) -> Column:
    """What similar items are searched with: the address of the image shown, made absolute, else the title."""
    shown = display_image(image, local, "")
    return falsy(F.when(shown.startswith("/api/"), F.concat(F.lit(origin), shown)).otherwise(shown), title)


def secondhand_query(title: Column) -> Column:
    """A second-hand search takes the title as it is."""
    return title


PAYLOAD = ["title", "source_url", "category", "image_url", "image_vector", "price", "currency", "brand", "is_soldout", "shop"]


def save_payload(items: DataFrame) -> DataFrame:
    """What is sent to save items; ids that aren't numbers, as those of federated results, become null, so that the item is inserted."""
    return items.select(F.col("product_id").cast("string").try_cast("long").alias("product_id"), *(c for c in PAYLOAD if c in items.columns))


def user_view(users: DataFrame) -> DataFrame:
    return users.select("id", "email", F.col("name").alias("username"), "profile_image")


def guest(spark) -> DataFrame:
    """The row that guests share, to be upserted like any user's."""
    return spark.createDataFrame([("guest", "guest@example.invalid", "Guest", None)], "oauth_user_id string, email string, name string, profile_image string")
