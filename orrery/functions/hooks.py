"""Models that a user plugs in: encoders and translators as Arrow functions, loaded once a worker."""

import hashlib
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from orrery.sources.shared import slices

#: Values that are held with their vectors at a time.
PIECE = 1024


def encoder(load: Callable[[], Callable[[list], list]]):
    """A vectorised function from texts, or image bytes, to vectors. ``load`` gives a function from a list to a list.

    Nulls aren't encoded and stay null; so does what the model gives no vector for.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for values in (some for batch in batches for some in pieces(batch)):
            known = [v for v in values if v is not None]
            vectors = list(model(known)) if known else []
            if len(vectors) != len(known):
                raise ValueError(f"{len(vectors)} vectors of {len(known)} values")
            rest = iter(vectors)
            yield _vectors([None if v is None else next(rest) for v in values])

    return F.arrow_udf(run, ArrayType(FloatType()))


def pieces(batch: pa.Array, most: int = PIECE) -> Iterator[list]:
    """The values of an Arrow batch, of few bytes and ``most`` at a time: what is held doesn't grow with the batch."""
    for some in slices(batch):
        for at in range(0, len(some), most):
            yield some.slice(at, most).to_pylist()


def _vectors(vectors: list) -> pa.Array:
    return pa.array([None if v is None else np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))


@dataclass(frozen=True)
class Patience:
    """How calls that fail are treated.

    A call takes ``batch`` values. One that fails is made again up to ``retries``
    times, after a random part of ``base_delay`` seconds, twice as many each time;
    then its values are halved and tried apart, so that only those that fail
    alone are given up. ``calls`` are made at once by a task, and ``most_calls``
    by all tasks together.
    """

    retries: int = 3
    base_delay: float = 1.0
    batch: int = 64
    calls: int = 1
    most_calls: int | None = None
    seed: int = 0


def attempted(model: Callable[[list], list], values: list, patience: Patience, fallback=None, rng: random.Random | None = None, wait: Callable[[float], None] = time.sleep) -> list[tuple]:
    """(result, error) for each value; ``fallback`` is a value, or a function of the value, for those that fail."""
    rng = rng or random.Random(patience.seed)
    for tried in range(patience.retries + 1):
        try:
            got = list(model(values))[: len(values)]
            return [(x, None) for x in got] + [(None, None)] * (len(values) - len(got))
        except Exception as e:  # whatever a foreign service raises
            error = f"{type(e).__name__}: {e}"[:500]
        if tried < patience.retries:
            wait(rng.uniform(0, patience.base_delay * 2**tried))
    if len(values) == 1:
        return [(fallback(values[0]) if callable(fallback) else fallback, error)]
    half = len(values) // 2
    return [x for part in (values[:half], values[half:]) for x in attempted(model, part, patience, fallback, rng, wait)]


def encoded(rows: DataFrame, value: str, load: Callable[[], Callable[[list], list]], patience: Patience = Patience(), fallback=None, into: str = "vector") -> DataFrame:
    """``rows`` with the model's vectors, and in ``<into>_error`` why a value has none or its fallback.

    A failing call doesn't fail the task: see ``Patience``. Nulls aren't encoded and have neither; so has what the
    model gives no vector for.
    """
    kind = f"struct<{into} array<float>, {into}_error string>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, task = load(), TaskContext.get()
        rng = random.Random(f"{patience.seed}-{task.partitionId() if task else 0}")
        most = patience.batch * max(1, PIECE // patience.batch, patience.calls)
        with ThreadPoolExecutor(max(1, patience.calls)) as pool:
            for values in (some for batch in batches for some in pieces(batch, most)):
                known = [v for v in values if v is not None]
                parts = [known[i : i + patience.batch] for i in range(0, len(known), patience.batch)]
                rest = (x for part in pool.map(lambda p: attempted(model, p, patience, fallback, rng), parts) for x in part)
                done = [(None, None) if v is None else next(rest) for v in values]
                errors = pa.array([e for _, e in done], pa.string())
                yield pa.StructArray.from_arrays([_vectors([v for v, _ in done]), errors], names=[into, f"{into}_error"])

    if patience.most_calls:
        rows = rows.coalesce(max(1, patience.most_calls // max(1, patience.calls)))
    made = F.arrow_udf(run, kind)
    return rows.withColumn("__made", made(value)).select(*rows.columns, f"__made.{into}", f"__made.{into}_error")


def failures(encoded_rows: DataFrame, into: str = "vector") -> DataFrame:
    """(error, n): how many values failed, and why."""
    return encoded_rows.where(F.col(f"{into}_error").isNotNull()).groupBy(F.col(f"{into}_error").alias("error")).agg(F.count("*").alias("n"))


def hashed_encoder(dim: int = 64) -> Callable[[], Callable[[list], list]]:
    """A stand-in model for tests: a unit vector that depends on the text alone."""

    def model(values: list) -> list:
        out = []
        for v in values:
            seed = int.from_bytes(hashlib.sha256(v.encode() if isinstance(v, str) else bytes(v)).digest()[:8], "big")
            x = np.random.default_rng(seed).standard_normal(dim)
            out.append((x / np.linalg.norm(x)).astype(np.float32).tolist())
        return out

    return lambda: model


def translator(translate: Callable[[str], str] | None = None):
    """A function from texts to texts; one that fails on a text, or none at all, leaves it as it is."""

    def run(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str:
            try:
                return translate(text) if translate else text
            except Exception:  # whatever a foreign service raises
                return text

        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, StringType())


def scattered(rows: DataFrame, vectors: DataFrame, index: str = "index", vector: str = "vector") -> DataFrame:
    """``rows`` with the vectors that were made for some of them, null for the others."""
    return rows.join(vectors.select(index, vector), index, "left")
