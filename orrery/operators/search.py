"""Catalog search: ranked text, vectors, and both merged; filters of the feed's search box."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from orrery.functions.vectors import topk


def text_search(table: DataFrame, query: str | None, k: int = 20, key: str = "product_id", escape: bool = False) -> DataFrame:
    """Titles that contain the query, exact ones first, then those that start with it, then the newest; ``text_rank`` says which.

    Letters' case doesn't count, a blank query finds nothing. Percent signs and
    underscores in the query are wildcards unless ``escape``.
    """
    q = (query or "").strip().lower()
    if not q:
        return table.limit(0).withColumn("text_rank", F.lit(0))
    pattern = q
    if escape:
        for c in "\\%_":
            pattern = pattern.replace(c, "\\" + c)
    lowered = F.lower("title")
    rank = F.when(lowered == q, 0).when(lowered.like(f"{pattern}%"), 1).when(lowered.like(f"%{pattern}%"), 2).otherwise(3)
    return table.where(lowered.like(f"%{pattern}%")).withColumn("text_rank", rank).orderBy("text_rank", F.desc("created_at"), key).limit(k)


def vector_search(table: DataFrame, query: list[float], k: int = 20, key: str = "product_id", vector: str = "title_vector") -> DataFrame:
    return topk(table, vector, query, k, key)


def merged(text_hits: DataFrame, vector_hits: DataFrame, limit: int, key: str = "product_id") -> DataFrame:
    """Text hits, then vector hits, each product once, cut to ``limit``; ``position`` numbers them.

    Both inputs are top-k results, so that what is ranked here is their size.
    """
    text = text_hits.withColumn("__pos", F.row_number().over(Window.orderBy("text_rank", F.desc("created_at"), key))).withColumn("__source", F.lit(0))
    near = vector_hits.withColumn("__pos", F.row_number().over(Window.orderBy(F.desc_nulls_last("similarity"), key))).withColumn("__source", F.lit(1))
    both = text.unionByName(near, allowMissingColumns=True)
    first = both.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__source", "__pos"))).where("__n = 1")
    out = first.withColumn("position", F.row_number().over(Window.orderBy("__source", "__pos"))).where(F.col("position") <= limit)
    return out.drop("__pos", "__source", "__n")


def hybrid_search(table: DataFrame, query: str | None, vector: list[float], limit: int = 12, k: int = 20, key: str = "product_id") -> DataFrame:
    return merged(text_search(table, query, k, key), vector_search(table, vector, k, key), limit, key).withColumn("search_source", F.lit("product_db"))


def any_field_contains(table: DataFrame, query: str | None, fields: list[str] | None = None) -> DataFrame:
    """Rows with the query in any text field or element of a text array; a blank query keeps all, others aren't trimmed."""
    if not (query or "").strip():
        return table
    q = query.lower()
    tests: list[Column] = []
    for f in table.schema.fields:
        if fields is None or f.name in fields:
            if isinstance(f.dataType, StringType):
                tests.append(F.coalesce(F.lower(f.name).contains(q), F.lit(False)))
            elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StringType):
                tests.append(F.coalesce(F.exists(f.name, lambda x: F.coalesce(F.lower(x).contains(q), F.lit(False))), F.lit(False)))
    return table.where(reduce(lambda a, b: a | b, tests)) if tests else table.limit(0)


def exists(table: DataFrame, keys: DataFrame, key: str = "product_id") -> DataFrame:
    """``keys`` with ``found``: whether the table has them."""
    there = table.select(F.col(key).alias("__key")).distinct()
    return keys.join(there, keys[key] == there["__key"], "left").withColumn("found", F.col("__key").isNotNull()).drop("__key")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The row with a key, by a filter that reaches the scan."""
    return table.where(F.col(key) == value).limit(1)


def suggestions(table: DataFrame, n: int = 6, seed: int = 0) -> DataFrame:
    return table.orderBy(F.rand(seed)).limit(n)


def dialog_fields(names: list[str]) -> list[str]:
    """The fields that a detail view shows."""
    return [n for n in names if n not in ("title", "id") and "source" not in n.lower()]


def card_fields(table: DataFrame, hidden: list[str], shown: int = 2) -> DataFrame:
    """``card``: the first fields with a value, as name and text, but for the hidden ones."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in table.columns if c not in hidden))
    return table.withColumn("card", F.slice(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")), 1, shown))
