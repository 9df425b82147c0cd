"""A folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that are turned into Python objects at once.
SLICE_BYTES = 1 << 22


def new_folder(spark: SparkSession, name: str) -> str:
    """Under ``spark.checkpoint.dir``; only where that is unset on a single machine, under a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back, so that all uses see the same rows and none works them out again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` in as many even parts as the session's shuffles have, and for each core one at least: for work that is long for the bytes that a scan splits by."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys)


def slices(batch: pa.RecordBatch | pa.Array, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Array]:
    """The batch in parts of about so many bytes."""
    rows = max(1, len(batch) * most_bytes // max(1, batch.nbytes))
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)
