"""What users are told while a search or a page runs: one row for each message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_notices(items: DataFrame, user_id: int, page: int, failed: bool = False) -> DataFrame:
    """(user_id, position, type, page, payload): a success for each item with an image, an error if the search failed, and the end in any case."""
    shown = items.where(F.col("image_url").isNotNull() & (F.col("image_url") != ""))
    each = shown.select(F.lit(0).alias("position"), F.lit("SEARCH_SUCCESS").alias("type"), F.to_json(F.struct(*items.columns)).alias("payload"))
    last = [(1, "SEARCH_ERROR", None)] * failed + [(2, "SEARCH_FINISHED", None)]
    end = items.sparkSession.createDataFrame(last, "position int, type string, payload string")
    return each.unionByName(end).select(F.lit(user_id).alias("user_id"), "position", "type", F.lit(page).alias("page"), "payload")


def messages(notices: DataFrame, error: str = "") -> DataFrame:
    """(user_id, position, message) of search notices: the JSON that goes to the user's channel.

    A result comes as a list of one that is added to what is shown (``is_append``), with its page; an error with its text; the end by itself.
    """
    result = F.concat(F.lit('{"type":"SEARCH_SUCCESS","results":['), F.col("payload"), F.lit('],"is_append":true,"page":'), F.col("page").cast("string"), F.lit("}"))
    failed = F.to_json(F.struct(F.col("type"), F.lit(error).alias("message")))
    end = F.to_json(F.struct("type"))
    text = F.when(F.col("type") == "SEARCH_SUCCESS", result).when(F.col("type") == "SEARCH_ERROR", failed).otherwise(end)
    return notices.select("user_id", "position", text.alias("message"))


def crawl_notices(results: DataFrame) -> DataFrame:
    """(placeholder_id, type, payload) of rows (placeholder_id, error, and the saved product's columns)."""
    product = [c for c in results.columns if c not in ("placeholder_id", "error")]
    ok = F.col("error").isNull()
    return results.select(
        "placeholder_id", F.when(ok, "CRAWL_SUCCESS").otherwise("CRAWL_ERROR").alias("type"),
        F.when(ok, F.to_json(F.struct(*product))).otherwise(F.to_json(F.struct("error"))).alias("payload"),
    )
