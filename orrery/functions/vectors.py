"""Vector expressions and searches, in double precision."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.shared import written

#: Queries that are sent to all tasks.
MOST_SENT = 1 << 12
#: Rows that cells are drawn around, at most.
PIVOTS = 256
#: Rows and queries of one cell that one piece compares, about.
ROWS_A_PIECE, QUERIES_A_PIECE = 1 << 16, 1 << 10
#: Queries whose distances to all cells are held at once.
VISITS = 1 << 10
#: More than what rounding can do to a distance between vectors of length one.
SLACK = 1e-6


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null for a null vector or one of length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def normalized(a: Column) -> Column:
    """Of length one; a vector of length zero has null elements."""
    n = norm(a)
    return F.transform(doubles(a), lambda x: F.try_divide(x, n))


def topk(table: DataFrame, vector: str, query: list[float], k: int, key: str) -> DataFrame:
    """The ``k`` rows nearest to one query vector with ``similarity``; an empty query finds none."""
    if not query:
        return table.limit(0).withColumn("similarity", F.lit(None).cast("double"))
    scored = table.where(F.col(vector).isNotNull()).withColumn("similarity", cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))))
    return scored.orderBy(F.desc_nulls_last("similarity"), key).limit(k)


def topk_many(queries: DataFrame, table: DataFrame, k: int, query_key: str, key: str, vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query, key, similarity, rank): the ``k`` rows of ``table`` with the largest cosine for each query, equal ones by key. Exact.

    Up to ``MOST_SENT`` queries go to all tasks, and one pass over the rows
    answers them. Beyond, queries and rows are tables alike. Rows of length one are dealt to the cell
    of their nearest pivot; for each cell its size, its radius and its ``k``
    smallest distances to the pivot are known. By the triangle inequality these
    give each query a distance within which ``k`` rows lie for certain, and the
    cells that can hold anything that near: only there is it compared. A cell
    with many rows or queries is cut into pieces of bounded size.

    Null vectors are passed over on both sides. A vector of length zero has
    similarity 0 with all others: such a query visits every cell, and of such
    rows the ``k`` with the smallest keys are a cell that every query visits.
    """
    rows = table.select(F.col(key).cast("long").alias("key"), doubles(F.col(vector)).alias("v")).where("v IS NOT NULL")
    asked = queries.select(F.col(query_key).cast("long").alias("query"), doubles(F.col(vector)).alias("v")).where("v IS NOT NULL")
    few = asked.limit(MOST_SENT + 1).toArrow()
    return _ranked(_scanned(rows, few, k) if few.num_rows <= MOST_SENT else _by_cells(rows, asked, k, pivots), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "key")))
    return ranked.where(F.col("rank") <= k)


def _scanned(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """(query, key, similarity): the ``k`` best rows of each task for each of a few queries."""
    columns = asked.combine_chunks()
    names = columns["query"].to_numpy() if len(columns) else np.zeros(0, np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((names, _unit(_matrix(columns["v"].combine_chunks())) if len(columns) else np.zeros((0, 0))))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = shared.value
        best_s, best_k = np.full((len(names), 0), -np.inf), np.zeros((len(names), 0), np.int64)
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            sim = m @ _unit(_matrix(batch.column(1))).T
            best_s, best_k = np.c_[best_s, sim], np.c_[best_k, np.broadcast_to(batch.column(0).to_numpy(), sim.shape)]
            top = np.lexsort((best_k, -best_s), axis=1)[:, :k]
            best_s, best_k = np.take_along_axis(best_s, top, 1), np.take_along_axis(best_k, top, 1)
        yield pa.record_batch([pa.array(np.repeat(names, best_s.shape[1])), pa.array(best_k.ravel()), pa.array(best_s.ravel())], names=["query", "key", "similarity"])

    return rows.mapInArrow(search, "query long, key long, similarity double")


def _by_cells(rows: DataFrame, asked: DataFrame, k: int, pivots: int) -> DataFrame:
    """(query, key, similarity): the ``k`` best rows of each piece of a cell for each query that visits it."""
    spark = rows.sparkSession
    # pivots are rows that their hashes choose, as many as ``pivots`` at most
    chosen = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("key"), "key").limit(pivots).select("v").collect()
    if not chosen:  # no row has a direction
        chosen = [{"v": r["v"]} for r in rows.limit(1).select("v").collect()]
    if not chosen:
        return spark.createDataFrame([], "query long, key long, similarity double")
    centres = spark.sparkContext.broadcast(_unit(np.array([r["v"] for r in chosen], np.float64)))
    placed = written(_placed(rows, "key", centres), "placed")
    none = placed.where(F.col("cell") == -1).orderBy("key").limit(k)
    placed = written(placed.where("cell >= 0").unionByName(none), "cells")
    least = F.array_sort(F.collect_list("d")).alias("least")  # k of a cell at most
    first = F.row_number().over(Window.partitionBy("cell").orderBy("d"))
    near = placed.where("cell >= 0").withColumn("n", first).where(F.col("n") <= k).groupBy("cell").agg(least)
    cells = placed.groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("rows")).join(near, "cell", "left").collect()  # a row for each pivot
    visits = _visits(asked, centres, {r["cell"]: (r["radius"], r["least"]) for r in cells}, k)
    visits = written(visits, "visits")
    # pieces: so many rows of a cell with so many queries that visit it
    n_rows = spark.createDataFrame([(r["cell"], r["rows"]) for r in cells], "cell int, rows long")
    n_asked = visits.groupBy("cell").agg(F.count("*").alias("asked"))
    sizes = n_rows.join(n_asked, "cell").select("cell", F.ceil(F.col("rows") / ROWS_A_PIECE).cast("int").alias("r"), F.ceil(F.col("asked") / QUERIES_A_PIECE).cast("int").alias("q"))
    all_of = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    side_a = visits.join(F.broadcast(sizes), "cell").select("cell", F.explode(all_of("r")).alias("i"), part("query", "q").alias("j"), F.lit(0).alias("side"), F.col("query").alias("key"), "v", F.col("bound").alias("d"))
    side_b = placed.join(F.broadcast(sizes), "cell").select("cell", part("key", "r").alias("i"), F.explode(all_of("q")).alias("j"), F.lit(1).alias("side"), "key", "v", "d")
    dealt = side_a.unionByName(side_b).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side", "key")
    return dealt.mapInArrow(_compared(k), "query long, key long, similarity double")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Between vectors of length one."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (v @ centres.T)))


def _placed(rows: DataFrame, key: str, centres) -> DataFrame:
    """(key, v, cell, d): vectors scaled to length one, the number of the nearest pivot (-1 for length zero), and how far it is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _unit(_matrix(batch.column(1)))
            d = _distances(v, centres.value)
            cell = d.argmin(axis=1).astype(np.int32)
            near = d[np.arange(len(d)), cell]
            cell[~v.any(axis=1)] = -1
            yield pa.record_batch([batch.column(0), _lists(v), pa.array(cell), pa.array(near)], names=[key, "v", "cell", "d"])

    return rows.mapInArrow(run, f"{key} long, v array<double>, cell int, d double")


def _visits(asked: DataFrame, centres, cells: dict[int, tuple[float, list[float] | None]], k: int) -> DataFrame:
    """(query, v, cell, bound): each cell that can hold a row within ``bound``, in which ``k`` rows lie for certain.

    ``cells`` has, by pivot, the radius and the least distances: numbers as many as pivots times ``k`` at most.
    """
    shared = asked.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {c: x for c, x in shared.value.items() if c >= 0}
        whole = np.array(sorted(cells), np.int32)
        radius = np.array([cells[c][0] for c in whole])
        owner = np.repeat(np.arange(len(whole)), [len(cells[c][1]) for c in whole])
        least = np.array([x for c in whole for x in cells[c][1]])
        between = _distances(centres.value, centres.value)[np.ix_(whole, whole)] if len(whole) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = _unit(_matrix(batch.column(1))), batch.column(0).to_numpy()
            d = _distances(v, centres.value[whole])
            for at in range(0, len(v), VISITS):
                some = slice(at, at + VISITS)
                far = d[some][:, owner] + least[None, :]
                bound = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] >= k else np.full(len(far), np.inf)
                bound[~v[some].any(axis=1)] = np.inf
                bound = bound + SLACK
                # within the cell's ball, and on its side of the plane between its pivot and the query's nearest one
                reach = d[some] - radius[None, :] <= bound[:, None]
                own = d[some].argmin(axis=1) if len(whole) else np.zeros(len(far), int)
                if len(whole):
                    mine = d[some][np.arange(len(far)), own][:, None]
                    gap = between[own]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(gap > 0, (d[some] ** 2 - mine**2) / (2 * gap), 0.0)
                    reach &= plane <= bound[:, None]
                q, c = np.nonzero(reach)
                cell = whole[c]
                if -1 in shared.value:
                    q, cell = np.r_[q, np.arange(len(far))], np.r_[cell, np.full(len(far), -1, np.int32)]
                if len(q):
                    yield pa.record_batch([pa.array(ids[some][q]), _lists(v[some][q]), pa.array(cell.astype(np.int32)), pa.array(bound[q])], names=["query", "v", "cell", "bound"])

    return asked.mapInArrow(run, "query long, v array<double>, cell int, bound double")


def _compared(k: int):
    """For rows (cell, i, j, side, key, v, d) sorted so that a piece's queries come first: the ``k`` best of each query in the piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, ids, q, bound, best = None, [], [], [], None

        def out():
            if best is None:
                return
            names, s, keys = best
            has = np.isfinite(s)
            yield pa.record_batch([pa.array(np.repeat(names, has.sum(axis=1))), pa.array(keys[has]), pa.array(s[has])], names=["query", "key", "similarity"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(marks)]):
                here, side = tuple(marks[a, :3]), marks[a, 3]
                if here != mark:
                    yield from out()
                    mark, ids, q, bound, best = here, [], [], [], None
                keys, v, d = batch.column(4).slice(a, b - a).to_numpy(), _matrix(batch.column(5).slice(a, b - a)), batch.column(6).slice(a, b - a).to_numpy()
                if side == 0:
                    ids.append(keys)
                    q.append(v)
                    bound.append(d)
                    continue
                if not ids:
                    continue
                if best is None:
                    names, m, within = np.concatenate(ids), np.concatenate(q), np.concatenate(bound)
                    # a row farther than this can't be among the best; queries and rows of length zero have no bound
                    least = np.where(np.isfinite(within), 1 - within**2 / 2 - SLACK, -np.inf) if here[0] >= 0 else np.full(len(names), -np.inf)
                    best = names, np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)
                s = m @ v.T
                s[s < least[:, None]] = -np.inf
                s, at = np.c_[best[1], s], np.c_[best[2], np.broadcast_to(keys, s.shape)]
                top = np.lexsort((at, -s), axis=1)[:, :k]
                best = best[0], np.take_along_axis(s, top, 1), np.take_along_axis(at, top, 1)
        yield from out()

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def nearest_label(prototypes: list[tuple[str, list[float] | None]], vector: str = "embedding") -> Column:
    """The label of the prototype with the largest cosine, the first in the list where equal.

    A null vector scores zero with each and so gets the first label; prototypes
    without a vector are passed over, and without any the label is "unknown".
    """
    known = [(name, v) for name, v in prototypes if v is not None]
    if not known:
        return F.lit("unknown")
    scores = [cosine_or_zero(F.col(vector), F.array(*(F.lit(float(x)) for x in v))) for _, v in known]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    at = F.array_position(F.array(*scores), best)
    return F.when(best <= -1, F.lit("unknown")).otherwise(F.array(*(F.lit(n) for n, _ in known))[at.cast("int") - 1])
