"""Pages of a long list by a cursor: a page starts where the last one ended and reads nothing that came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The last row of a page: when it was made, and its key.
Cursor = tuple[object, object]


def write_list(rows: DataFrame, path: str, made: str = "created_at", key: str = "product_id") -> None:
    """The list, the newest first and equal ones by key, in files of one range each, so that a page's files are known by their statistics."""
    order = [F.desc_nulls_last(made), F.asc(key)]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def after(cursor: Cursor | None, made: str = "created_at", key: str = "product_id") -> Column:
    """Rows that come after the cursor: older ones, of the same time those with larger keys, and at the end those without a time.

    The first condition alone is a range of ``made``, which reaches the scan.
    """
    if cursor is None:
        return F.lit(True)
    when, last = cursor
    if when is None:
        return F.col(made).isNull() & (F.col(key) > last)
    older = F.col(made) <= F.lit(when)
    return (older | F.col(made).isNull()) & ((F.col(made) < F.lit(when)) | F.col(made).isNull() | (F.col(key) > last))


def page(rows: DataFrame, cursor: Cursor | None = None, size: int = 20, made: str = "created_at", key: str = "product_id") -> DataFrame:
    """The ``size`` rows after the cursor."""
    return rows.where(after(cursor, made, key)).orderBy(F.desc_nulls_last(made), F.asc(key)).limit(size)


def pages(spark: SparkSession, path: str, size: int = 20, most: int | None = None, made: str = "created_at", key: str = "product_id"):
    """Yields (number, page as a DataFrame, cursor after it) until a page isn't full, or ``most`` pages.

    Only a page's last row comes to the driver.
    """
    cursor, number = None, 0
    rows = spark.read.parquet(path)
    while most is None or number < most:
        some = page(rows, cursor, size, made, key)
        tail = some.select(made, key).tail(1)
        n = some.count() if tail else 0
        if not n:
            return
        cursor = (tail[0][0], tail[0][1])
        number += 1
        yield number, some, cursor
        if n < size:
            return
