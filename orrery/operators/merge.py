"""Upserts, deletes and referential actions as functions from tables to tables.

Plain Parquet has no MERGE: each returns the table as it is afterwards, to be
written in one commit. Every upsert is one full outer join on its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.shared import written
from orrery.sources.snapshots import Transaction

REPLACED = ["title", "price", "currency", "brand", "category", "is_soldout", "image_url", "shop_id", "gender"]


def last_by(rows: DataFrame, keys: list[str], order: str, keep_last_value: list[str] = (), keep_first: list[str] = ()) -> DataFrame:
    """A row for each key, the last by ``order``, which must be unique within a key; columns of
    ``keep_last_value`` have their last value that isn't null instead, those of ``keep_first`` the first row's, null or not.

    Aggregates combine before the shuffle, so that a key with very many rows costs no more than others.
    """
    plain = [c for c in rows.columns if c not in keys and c not in keep_last_value and c not in keep_first and c != order]
    aggregates = [F.max_by(F.struct(*plain), order).alias("__last"), F.max(order).alias(order)] if plain else [F.max(order).alias(order)]
    aggregates += [F.expr(f"max_by({c}, {order}) FILTER (WHERE {c} IS NOT NULL)").alias(c) for c in keep_last_value]
    aggregates += [F.min_by(F.struct(*keep_first), order).alias("__first")] if keep_first else []
    out = rows.groupBy(*keys).agg(*aggregates)
    return out.select(*(F.col(f"__last.{c}").alias(c) if c in plain else F.col(f"__first.{c}").alias(c) if c in keep_first else c for c in rows.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], replace: list[str], fill: list[str] = ()) -> DataFrame:
    """``replace`` columns come from the incoming row, ``fill`` columns too unless it has null there; others stay.

    ``incoming`` has one row a key at most. New keys take the incoming row whole.
    """
    a, b = existing.withColumn("__old", F.lit(True)).alias("a"), incoming.withColumn("__new", F.lit(True)).alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
    old, new = F.col("a.__old").isNotNull(), F.col("b.__new").isNotNull()

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"a.{c}")
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys:
            return F.coalesce(x, y)
        if c in replace:
            return F.when(new, y).otherwise(x)
        if c in fill:
            return F.coalesce(y, x)
        return F.when(old, x).otherwise(y)

    return both.select(*(value(c).alias(c) for c in existing.columns))


def upsert_products(existing: DataFrame, incoming: DataFrame, refresh_title_vector: bool = False, seq: str | None = None) -> DataFrame:
    """By source_url. Image vectors, and title vectors where they're refreshed, survive an incoming null; created_at stays.

    With ``seq`` a key may come more than once, as if its rows were applied one by one: what an update leaves as it is
    comes, for a new key, from its first row.
    """
    vectors = ["image_vector", "title_vector"] if refresh_title_vector else ["image_vector"]
    if seq:
        filled = [v for v in vectors if v in incoming.columns]
        first = [c for c in incoming.columns if c not in ("source_url", seq, *REPLACED, *filled)]
        incoming = last_by(incoming, ["source_url"], seq, filled, first).drop(seq)
    return upsert(existing, incoming, ["source_url"], [c for c in REPLACED if c in existing.columns], [v for v in vectors if v in existing.columns])


def upsert_users(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By oauth_user_id; e-mail, name and image are overwritten, with null too."""
    return upsert(existing, incoming, ["oauth_user_id"], ["email", "name", "profile_image"])


def aligned(batches: DataFrame, lists: list[str]) -> DataFrame:
    """A row for each place ``at`` of lists that a batch returned side by side; a shorter list gives nulls at its end."""
    rest = [c for c in batches.columns if c not in lists]
    return batches.select(*rest, F.posexplode(F.arrays_zip(*lists)).alias("at", "__row")).select(*rest, "at", "__row.*")


def batch_totals(items: DataFrame, batch: str) -> DataFrame:
    """(batch, n_items, n_total): items of each batch, and of all batches together."""
    sizes = items.groupBy(batch).agg(F.count("*").alias("n_items"))
    return sizes.crossJoin(F.broadcast(items.agg(F.count("*").alias("n_total"))))  # one row


def with_new_ids(rows: DataFrame, existing: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Numbers rows that have no id from the largest one on, without gaps, in the order given.

    Rows are dealt by range, each task knows its rows' places from its own sort,
    and both are written once: what a range holds is never worked out a second
    time. Ranges' sizes then give every range its first number. Rows that are
    equal in ``order`` stand by a hash of all their columns, so that many of them
    are more than one range. A null sorts first.
    """
    tie = F.xxhash64(*rows.columns)
    keys = [*(F.asc_nulls_first(c) for c in order), tie.asc()]
    fresh = rows.where(F.col(id_col).isNull()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    fresh = written(fresh.withColumn("__at", F.monotonically_increasing_id()), "numbered")  # the task's number times 2^33, and the row's place in it
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = fresh.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("__size"))  # a row for each task
    base = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__base"))
    starts = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__start")).crossJoin(base)
    numbered = fresh.join(F.broadcast(starts), part == F.col("__part"))
    numbered = numbered.withColumn(id_col, (F.col("__base") + F.col("__start") + place + 1).cast(rows.schema[id_col].dataType))
    return rows.where(F.col(id_col).isNotNull()).unionByName(numbered.select(rows.columns))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key is new, the first by ``order``, added. A null in a key makes it unlike any other."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    whole = incoming.where(~null)
    columns = [c for c in incoming.columns if c not in keys]
    if not columns:
        first = whole.distinct()
    else:
        packed = F.struct(*columns)
        first = whole.groupBy(*keys).agg((F.min_by(packed, order) if order else F.min(packed)).alias("__row")).select(*keys, "__row.*").select(incoming.columns)
    new = first.join(existing.select(*keys), keys, "left_anti").select(incoming.columns)
    return existing.unionByName(new, allowMissingColumns=True).unionByName(incoming.where(null), allowMissingColumns=True)


def delete_keys(existing: DataFrame, keys: DataFrame) -> DataFrame:
    return existing.join(keys, keys.columns, "left_anti").select(existing.columns)


def cascade(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``children`` without those whose parent is gone."""
    return delete_keys(children, gone.select(key).distinct())


def set_null(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``children`` with null for parents that are gone."""
    lost = gone.select(F.col(key).alias("__gone")).distinct()
    joined = children.join(lost, children[key] == lost["__gone"], "left")
    return joined.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(children.columns)


def restricted(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """The parents that can't go because a child names them."""
    return parents.join(children.select(key), key, "left_semi")


def delete_restricted(parents: DataFrame, gone: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """``parents`` without ``gone``; an error where a child names one of them."""
    used = restricted(gone.select(key).distinct(), children, key).limit(1).count()
    if used:
        raise ValueError(f"rows still refer to the deleted {key}")
    return cascade(parents, gone, key)


def shop_ids(items: DataFrame, shops: DataFrame, name: str = "shop") -> DataFrame:
    """``items`` with ``shop_id``, that of UNKNOWN for names that aren't there; an error if UNKNOWN isn't either."""
    known = shops.select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    unknown = shops.where("name = 'UNKNOWN'").agg(F.min("id").alias("__unknown"))
    found = items.join(known, items[name] == known["__name"], "left").crossJoin(F.broadcast(unknown))
    shop_id = F.coalesce("__id", "__unknown", F.raise_error(F.lit("the shop UNKNOWN is missing")).cast("int"))
    return found.withColumn("shop_id", shop_id).drop("__id", "__name", "__unknown")


def remove_users(tables: Transaction, gone: DataFrame, users: str = "users", saves: str = "saves", events: str = "events") -> None:
    """Users whose ``id`` is in ``gone`` go with their saves; their events stay without a user. All in one commit."""
    tables.delete(users, gone)
    lost = gone.select(F.col("id").alias("user_id")).distinct()
    tables.delete(saves, tables.read(saves).join(lost, "user_id", "left_semi"))
    left = tables.read(events).join(lost, "user_id", "left_semi")
    tables.upsert(events, left.withColumn("user_id", F.lit(None).cast(left.schema["user_id"].dataType)))


def merge_products(tables: Transaction, incoming: DataFrame, seq: str | None = None, refresh_title_vector: bool = False, table: str = "products") -> None:
    """``upsert_products`` on the rows that ``incoming`` names: what is written is as large as the batch, not as the catalog."""
    existing = tables.read(table, incoming)
    tables.upsert(table, upsert_products(existing, incoming, refresh_title_vector, seq))
