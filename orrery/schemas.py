"""Declared schemas (as DDL) of the catalog's tables and the projections that queries return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOPS = "id int not null, name string not null, domain string, url string"
USERS = "id int not null, oauth_user_id string not null, email string not null, name string, profile_image string, created_at timestamp"
PRODUCTS = (
    "id int not null, source_url string not null, title string not null, title_vector array<float>, price decimal(12,2), currency string, "
    "brand string not null, category string not null, is_soldout boolean, image_url string not null, image_vector array<float>, "
    "shop_id int not null, gender string not null, created_at timestamp not null"
)
SAVES = "product_id int not null, user_id int not null, created_at timestamp"
EVENTS = "id int not null, user_id int, action string, entity_type string, entity_id string, metadata string, occurred_at timestamp, created_at timestamp"
BRANDS = "id int, brand_name string not null, brand_name_eng string, keywords string, link string, target_group string, mean_price string, created_at timestamp_ntz"

#: The shops that a catalog starts with; the first one takes what no other name fits.
SEED_SHOPS = [
    ("UNKNOWN", None, None),
    ("FRUITS FAMILY", "fruitsfamily.com", "https://fruitsfamily.com"),
    ("FETCHING", "fetching.co.kr", "https://fetching.co.kr"),
    ("EMPTY", "empty.seoul.kr", "https://empty.seoul.kr"),
    ("WORKSOUT", "worksout.co.kr", "https://worksout.co.kr"),
    ("8DIVISION", "8division.com", "https://8division.com"),
    ("IAMSHOP", "iamshop-online.com", "https://iamshop-online.com"),
    ("THE BOUNCE", "thebounce.co.kr", "https://thebounce.co.kr"),
    ("THE X SHOP", "thexshop.co.kr", "https://thexshop.co.kr"),
    ("COLLECTIV", "collectiv.kr", "https://collectiv.kr"),
    ("KREAM", "kream.co.kr", "https://kream.co.kr"),
    ("MUSINSA", "musinsa.com", "https://musinsa.com"),
    ("EQL", "eqlstore.com", "https://eqlstore.com"),
    ("29CM", "29cm.co.kr", "https://29cm.co.kr"),
    ("Bunjang", "bunjang.co.kr", "https://bunjang.co.kr"),
    ("Danggeun Market", "daangn.com", "https://www.daangn.com"),
    ("Joonggonara", "joongna.com", "https://www.joongna.com"),
    ("ZARA", "zara.com", "https://www.zara.com"),
]

#: Columns of search results; list and feed results add to them.
PRODUCT_COLUMNS = ["product_id", "source_url", "title", "price", "currency", "brand", "category", "is_soldout", "image_url", "image_vector", "shop", "gender"]
LIST_COLUMNS = [*PRODUCT_COLUMNS[:9], "title_vector", "image_vector", "shop_id", "shop", "gender", "created_at"]


def seed_shops(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(SEED_SHOPS, 1)], SHOPS)


def with_vector_length(vector: str, dim: int) -> Column:
    """The vector, or an error where its length isn't ``dim``; null stays."""
    c = F.col(vector)
    return F.when(c.isNull() | (F.size(c) == dim), c).otherwise(F.raise_error(F.lit(f"{vector} must have {dim} elements")))
