"""Operators for many at once: vector searches, text searches, pages by cursor, and model calls that fail."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import hooks
from orrery.functions import vectors as V
from orrery.operators import paging, search, titles


def brute_topk(queries, rows, k):
    out = []
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v
    for q, v in queries:
        if v is None:
            continue
        scored = sorted((-round(float(unit(np.array(v, float)) @ unit(np.array(w, float))), 9), key) for key, w in rows if w is not None)
        out += [(q, key, rank, -s) for rank, (s, key) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sent, pivots, piece", [(4096, 256, 1), (0, 256, 1 << 16), (0, 12, 40), (0, 1, 7)])
def test_nearest_rows_of_many_queries(spark, monkeypatch, sent, pivots, piece):
    """Clusters, equal rows, rows and queries of length zero, nulls; by one pass, and by cells, in pieces of a few rows and queries too."""
    monkeypatch.setattr(V, "MOST_SENT", sent)
    monkeypatch.setattr(V, "ROWS_A_PIECE", piece)
    monkeypatch.setattr(V, "QUERIES_A_PIECE", max(3, piece // 5))
    rng = np.random.default_rng(pivots)
    centres = rng.standard_normal((9, 8))
    near = lambda i: (centres[i % 9] + 0.15 * rng.standard_normal(8)).round(3).tolist()
    rows = [(i, near(i)) for i in range(300)] + [(1000 + i, [0.0] * 8) for i in range(4)] + [(2000 + i, centres[0].tolist()) for i in range(5)] + [(3000, None)]
    queries = [(i, near(i)) for i in range(40)] + [(100, centres[0].tolist()), (101, [0.0] * 8), (102, None), (103, (-centres[1]).tolist())]
    frame = lambda x, c: spark.createDataFrame(x, f"{c} long, embedding array<double>").repartition(3)
    out = V.topk_many(frame(queries, "q"), frame(rows, "id"), 6, "q", "id", pivots=pivots)
    got = sorted((r["query"], r["key"], r["rank"], round(r["similarity"], 9)) for r in out.collect())
    want = brute_topk(queries, rows, 6)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want))


@pytest.mark.parametrize("sent", [0, 4096])
def test_nearest_rows_of_nothing(spark, monkeypatch, sent):
    monkeypatch.setattr(V, "MOST_SENT", sent)
    kind = "id long, embedding array<double>"
    some, none, zero = spark.createDataFrame([(1, [1.0, 0.0])], kind), spark.createDataFrame([], kind), spark.createDataFrame([(5, [0.0, 0.0]), (6, [0.0, 0.0])], kind)
    assert V.topk_many(some, none, 3, "id", "id").count() == 0 and V.topk_many(none, some, 3, "id", "id").count() == 0
    assert [tuple(r) for r in V.topk_many(some, zero, 1, "id", "id").collect()] == [(1, 5, 0.0, 1)]


def test_cells_are_left_out(spark):
    """Far clusters aren't visited by queries of another one."""
    rng = np.random.default_rng(0)
    centres = np.eye(16)
    rows = spark.createDataFrame([(i, (centres[i % 16] + 0.01 * rng.standard_normal(16)).tolist()) for i in range(640)], "id long, embedding array<double>")
    unit = V._unit(np.array([r["embedding"] for r in rows.limit(16).collect()]))
    shared = spark.sparkContext.broadcast(unit)
    placed = V._placed(rows.select(F.col("id").alias("key"), F.col("embedding").alias("v")), "key", shared)
    cells = {r["cell"]: (r["radius"], sorted(r["d"])[:5]) for r in placed.groupBy("cell").agg(F.max("d").alias("radius"), F.collect_list("d").alias("d")).collect()}
    visits = V._visits(rows.select(F.col("id").alias("query"), F.col("embedding").alias("v")), shared, cells, 5)
    assert visits.count() < 1.2 * 640


def test_many_text_searches_equal_one_each(spark):
    """Wildcards, short and blank queries, upper case, ties; and far fewer titles compared than there are."""
    rng = random.Random(4)
    words = ["red", "redder", "coat", "co_t", "50% off", "ünder", "x", "shoe", "shoes"]
    rows = [(i, " ".join(rng.choices([*words, f"w{i}"], k=3)), i % 7) for i in range(400)]
    items = spark.createDataFrame([*rows, (1000, None, 0), (1001, "Red", 3), (1002, "red", 3), (1003, "ab", 1)], "product_id long, title string, created_at int")
    asked = ["red", " RED ", "redder coat", "w7", "w77", "c_at", "c%t", "50%", "_", "x", "ab", "", None, "nothing at all", "ünd", "shoe%coat", "%"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    postings = titles.index(items)
    got = sorted((r["query_id"], r["rank"], r["key"], r["text_rank"]) for r in titles.search_many(queries, items, postings, k=15).collect())
    want = [(i, n, r["product_id"], r["text_rank"]) for i, q in enumerate(asked) for n, r in enumerate(search.text_search(items, q, 15).collect(), 1)]
    assert got == sorted(want)
    compared = {r["query_id"]: r["candidates"] for r in titles.candidates(queries, postings).collect()}
    assert compared[4] <= 3 and compared[13] == 0 and compared[2] < 200
    with pytest.raises(ValueError):
        titles.search_many(spark.range(titles.MOST_SHORT + 1).select(F.col("id").alias("query_id"), F.lit("x").alias("query")), items, postings)


def test_pages_joined_are_the_list(spark, tmp_path):
    """With equal times, rows without one, and files that a page doesn't read."""
    rows = [(i, f"2024-01-{1 + i % 9:02d}" if i % 10 else None, "x" * 50) for i in range(500)]
    items = spark.createDataFrame(rows, "product_id long, created_at string, t string").repartition(4)
    paging.write_list(items, str(tmp_path / "list"))
    got = [[r["product_id"] for r in some.collect()] for _, some, _ in paging.pages(spark, str(tmp_path / "list"), 37)]
    want = [r["product_id"] for r in items.orderBy(F.desc_nulls_last("created_at"), "product_id").collect()]
    assert list(itertools.chain(*got)) == want and all(len(p) == 37 for p in got[:-1])
    later = paging.page(spark.read.parquet(str(tmp_path / "list")), ("2024-01-02", 10), 5)
    assert "PushedFilters" in (plan := later._jdf.queryExecution().toString()) and "LessThanOrEqual(created_at,2024-01-02)" in plan
    paging.write_list(items.limit(0), str(tmp_path / "none"))
    assert list(paging.pages(spark, str(tmp_path / "none"), 5)) == []


class Flaky:
    """Fails at random, and whenever it is given a bad value."""

    def __init__(self, share, seed=1):
        self.rng, self.share, self.made = random.Random(seed), share, 0

    def __call__(self, values):
        self.made += 1
        if self.rng.random() < self.share or "bad" in values:
            raise RuntimeError("no answer")
        return [[float(len(v))] for v in values]


def test_only_bad_values_are_given_up():
    waits = []
    values = [f"v{i}" for i in range(40)] + ["bad"] + ["w"] * 23
    model = Flaky(0.2)
    got = hooks.attempted(model, values, hooks.Patience(retries=4, base_delay=2.0), lambda v: [-1.0], random.Random(3), waits.append)
    assert [g[0] for g in got] == [[-1.0] if v == "bad" else [float(len(v))] for v in values]
    assert [e for _, e in got if e] == ["RuntimeError: no answer"] and model.made < 80
    assert waits and all(0 <= w <= 2.0 * 2**4 for w in waits)
    assert hooks.attempted(lambda v: [[1.0]], ["a", "b"], hooks.Patience(retries=0)) == [([1.0], None), (None, None)]  # what there is no vector for


def test_encoded_rows_and_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "bb"), (5, "bad")], "i int, t string").repartition(2)
    made = hooks.encoded(df, "t", lambda: Flaky(0.0), hooks.Patience(retries=1, base_delay=0.0, batch=2, calls=2, most_calls=4))
    got = {r["i"]: (r["vector"], r["vector_error"]) for r in made.collect()}
    assert got == {1: ([1.0], None), 2: (None, None), 3: (None, "RuntimeError: no answer"), 4: ([2.0], None), 5: (None, "RuntimeError: no answer")}
    assert [tuple(r) for r in hooks.failures(made).collect()] == [("RuntimeError: no answer", 2)]
    assert made.rdd.getNumPartitions() <= 2
