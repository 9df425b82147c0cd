"""What the text operators share: reading tables and writing intermediate ones."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters that separate words, as a Java/RE2 character class body.
SPACES = r"\x20\x09-\x0D"
#: Rows of keys that are sent to all tasks; more are joined by shuffle.
MOST_SENT = 1 << 19
#: Bytes of an Arrow batch that are turned into Python objects at once.
BATCH_BYTES = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    The setting is the cluster's; only where it is unset on a single machine a
    temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
    return f"{root.rstrip('/')}/orrery-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses don't recompute it,
    and a lost executor costs a re-read, not a re-run."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, gone: DataFrame, keys: list[Column], inside: bool = False, most: int = MOST_SENT) -> DataFrame:
    """``docs`` without the rows whose ``keys`` are a row of ``gone``, a written table, or only those with ``inside``.

    Up to ``most`` rows are sent to all tasks, so that no text moves; beyond,
    both sides are shuffled by the keys.
    """
    names = [f"__key{i}_{uuid.uuid4().hex[:8]}" for i in range(len(keys))]
    gone = gone.toDF(*names)
    if gone.limit(most + 1).count() <= most:
        gone = F.broadcast(gone)
    same = reduce(lambda a, b: a & b, (k == F.col(n) for k, n in zip(keys, names)))
    return docs.join(gone, same, "left_semi" if inside else "left_anti")


def slices(batch: pa.RecordBatch, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes."""
    rows = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: What a worker keeps from one task to the next, by the operator that made it.
_KEPT: dict[str, tuple] = {}


def kept(name: str, key: object, make: Callable[[], object]):
    """What ``make`` gave for ``key`` in an earlier task of this worker, or gives now; of a ``name`` one thing is kept."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT[name] = key, make()
    return _KEPT[name][1]


def forget(but: str | None = None) -> None:
    """Drops what other operators than ``but`` have kept: a session's operators share its workers."""
    for name in [n for n in _KEPT if n != but]:
        del _KEPT[name]


def map_batches(
    df: DataFrame, rows: Callable[[list[list]], Iterable[tuple] | None], schema: str, most: int = 1 << 14, most_bytes: int = BATCH_BYTES, keeps: str | None = None
) -> DataFrame:
    """``rows(columns)`` over each Arrow batch of ``df``; its tuples make up the result.

    A batch of more than ``most_bytes`` is taken in slices. At most ``most``
    tuples are held before they go on as a batch. ``keeps`` names what ``rows``
    has ``kept``.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for batch in batches:
            for some in slices(batch, most_bytes):
                held: list[tuple] = []
                for row in rows([c.to_pylist() for c in some.columns]) or ():
                    held.append(row)
                    if len(held) >= most:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Gives what a task has freed back to the system, Arrow's pool and where the C library can: the stages of a session share their workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def _batch(held: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
