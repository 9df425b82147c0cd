"""User events: validation and ingest, the same for tables and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an event may be about.
ACTIONS = ["SEARCH", "LIKE", "DISLIKE", "SAVE_WISHLIST", "REMOVE_WISHLIST", "CLICK_PURCHASE", "CLICK_ITEM", "VOTE_PRETTY", "VOTE_UGLY"]
ENTITIES = ["SEARCH_RESULT", "VOTING_ITEM", "WISHLIST_ITEM", "SITE"]


def is_valid(actions: list[str] = ACTIONS, entities: list[str] = ENTITIES) -> Column:
    return F.coalesce(F.col("action").isin(actions) & F.col("entity_type").isin(entities), F.lit(False))


def split(events: DataFrame, actions: list[str] = ACTIONS, entities: list[str] = ENTITIES) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected events."""
    ok = is_valid(actions, entities)
    return events.where(ok), events.where(~ok)


def filled(events: DataFrame) -> DataFrame:
    """Events with ``metadata`` and ``occurred_at`` where they had none."""
    return events.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).withColumn("occurred_at", F.coalesce(F.col("occurred_at").cast("timestamp"), F.current_timestamp()))


def ingested(events: DataFrame, actions: list[str] = ACTIONS, entities: list[str] = ENTITIES) -> DataFrame:
    """Valid events with ``metadata`` and ``occurred_at`` filled in."""
    return filled(split(events, actions, entities)[0])
