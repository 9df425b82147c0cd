"""Ingest as Structured Streaming: files in, normalised rows out, checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from orrery.operators.events import filled, is_valid, split
from orrery.operators.merge import merge_products
from orrery.sources.captured import item_records, listing_items
from orrery.sources.snapshots import Store


def event_stream(spark: SparkSession, path: str, schema: StructType, actions: list[str], entities: list[str], files_a_batch: int = 100) -> DataFrame:
    """Valid events of the files that arrive under ``path``, filled in as the batch form does."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return filled(raw.where(is_valid(actions, entities)))


def append(stream: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, then stop; a restart with the same checkpoint goes on where this ended."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(to)


def split_events(spark: SparkSession, path: str, schema: StructType, to: str, checkpoint: str, actions: list[str], entities: list[str], files_a_batch: int = 100) -> StreamingQuery:
    """Valid events to ``to``/valid and the others, as they came, to ``to``/rejected.

    Each batch writes a folder of its own in both, so that one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        valid, rejected = split(batch, actions, entities)
        filled(valid).write.mode("overwrite").parquet(f"{to}/valid/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{to}/rejected/batch={number}")

    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FAILURES = "stream string, batch long, error string"


def catalog_stream(spark: SparkSession, path: str, store: Store, checkpoint: str, name: str = "listings", files_a_batch: int = 10, buckets: int = 64, skip_failed: bool = False) -> StreamingQuery:
    """Listing pages (a JSON document a file line) merged into the table ``products`` of ``store``.

    A batch is one commit under the stream's ``name`` and its own number, so that one that is run again changes nothing;
    what it writes is as large as the batch. Rows count in the order of their files' times and names, of the lines' texts
    and of their places in a line, which is the same in a batch that is run again.
    A failing batch fails the query, and its files are read again after a restart; with ``skip_failed`` it is noted in
    the table ``failed_batches`` instead, and the stream goes on.
    """

    def merge(batch: DataFrame, number: int) -> None:
        pages = batch.select(F.col("value").alias("body"), F.struct("changed", "file", "value").alias("page"))
        incoming = item_records(listing_items(pages), keep=["page", "at"]).withColumn("seq", F.struct("page", "at"))
        with store.transaction((name, number)) as t:
            if t.done_before:
                return
            if "products" not in t.tables:
                t.create("products", incoming.drop("page", "at", "seq").limit(0), ["source_url"], buckets)
            merge_products(t, incoming.drop("page", "at"), seq="seq")

    def noting(batch: DataFrame, number: int) -> None:
        try:
            merge(batch, number)
        except Exception as e:  # whatever a batch raises: the next one must come
            with store.transaction((name, number)) as t:
                row = batch.sparkSession.createDataFrame([(name, number, str(e)[:2000])], FAILURES)
                if "failed_batches" not in t.tables:
                    t.create("failed_batches", row.limit(0), ["stream", "batch"], 1)
                t.upsert("failed_batches", row)

    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)
    lines = lines.select("value", F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"))
    return lines.writeStream.foreachBatch(noting if skip_failed else merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
