"""New ids from one numbering, and tables with snapshots: atomic commits, batches that write about their own size."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import merge
from orrery.sources.snapshots import Conflict, Store, sizes


@pytest.mark.parametrize("conf", [
    {"spark.sql.shuffle.partitions": "200"},
    {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false"},
    {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"},
])
def test_new_ids_have_no_gaps_and_no_repeats(spark, conf):
    """Also with payload, many equal keys, nulls, ids that are there, and however partitions are coalesced."""
    n = 400_000
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        key = F.when(F.col("i") % 3 == 0, "same").when(F.col("i") % 1000 == 1, None).otherwise(F.sha2(F.col("i").cast("string"), 256))
        rows = spark.range(n).toDF("i").select(F.when(F.col("i") % 100 == 7, -F.col("i")).alias("id"), key.alias("k"), F.repeat(F.sha2(F.col("i").cast("string"), 512), 3).alias("payload"), "i")
        existing = spark.createDataFrame([(41,), (7,)], "id long")
        out = merge.with_new_ids(rows, existing, "id", ["k"]).drop("payload").cache()
        fresh = out.where("id > 0")
        assert out.count() == n and out.select("i").distinct().count() == n
        low, high, ids, m = fresh.agg(F.min("id"), F.max("id"), F.count_distinct("id"), F.count("*")).first()
        assert (low, high, ids, m) == (42, 41 + m, m, n - n // 100)
        # in order: a key's ids lie together, nulls first
        spans = fresh.groupBy("k").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
        assert spans.where("b - a + 1 <> n").count() == 0 and spans.where("k IS NULL").first()["a"] == 42
        assert fresh.where("k = 'same'").agg(F.min("id")).first()[0] > fresh.where("k < 'same'").agg(F.max("id")).first()[0]
        out.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_new_ids_of_nothing(spark):
    rows = spark.createDataFrame([], "id long, k string")
    assert merge.with_new_ids(rows, rows, "id", ["k"]).count() == 0
    one = spark.createDataFrame([(None, "a")], "id int, k string")
    assert [tuple(r) for r in merge.with_new_ids(one, one, "id", ["k"]).collect()] == [(1, "a")]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def table(spark, ids, text, **also):
    return spark.range(0, 0).select("id") if not ids else spark.createDataFrame([(i, f"{text}{i}", None if i % 5 == 0 else i * 2) for i in ids], "id long, title string, n long")


def test_changes_and_versions(spark, store):
    with store.transaction() as t:
        t.create("items", table(spark, range(100), "a"), ["id"], buckets=8)
    with store.transaction() as t:
        t.upsert("items", table(spark, [3, 50, 200], "b"))
        t.delete("items", spark.createDataFrame([(4,), (999,)], "id long"))
        assert t.read("items").count() == 100  # its own changes show
        assert rows_of(t.read("items", spark.createDataFrame([(3,), (4,), (5,)], "id long")).select("title")) == [("a5",), ("b3",)]
        assert store.read("items").count() == 100 and store.read("items").where("id = 4").count() == 1  # others don't see them
    want = {i: f"a{i}" for i in range(100)} | {3: "b3", 50: "b50", 200: "b200"}
    del want[4]
    assert rows_of(store.read("items").select("id", "title")) == sorted(want.items())
    assert store.read("items", 1).where("id = 200").count() == 0 and store.versions() == [1, 2]
    with store.transaction() as t:  # a key that has gone comes again, and twice changed in one transaction
        t.upsert("items", table(spark, [4], "c"))
        t.upsert("items", table(spark, [4, 5], "d"))
        t.delete("items", spark.createDataFrame([(5,)], "id long"))
    want |= {4: "d4"}
    del want[5]
    assert rows_of(store.read("items").select("id", "title")) == sorted(want.items())
    assert store.read("items").schema == store.read("items", 1).schema


def test_many_batches_equal_one_upsert_each(spark, store):
    """Whatever buckets are written anew on the way; versions that aren't kept go, the last one stays whole."""
    with store.transaction() as t:
        t.create("items", table(spark, range(40), "a"), ["id"], buckets=4)
    want = {i: f"a{i}" for i in range(40)}
    for b in range(6):
        ids = [(b * 13 + i * 3) % 60 for i in range(9)]
        with store.transaction(("batches", b)) as t:
            t.upsert("items", table(spark, ids, f"b{b}-"))
        want |= {i: f"b{b}-{i}" for i in ids}
        assert rows_of(store.read("items").select("id", "title")) == sorted(want.items())
    state = store.manifest()["tables"]["items"]
    assert any(len(p) == 1 for p in state["parts"].values())
    assert store.vacuum(keep=1) > 0 and store.versions() == [7]
    assert rows_of(store.read("items").select("id", "title")) == sorted(want.items())


def test_bytes_written_follow_the_batch(spark, store):
    """One row in a hundred, all over the catalog: the commit writes a few hundredths of it."""
    big = spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("title"))
    with store.transaction() as t:
        t.create("items", big, ["id"], buckets=8)
    with store.transaction() as t:
        t.upsert("items", big.where("id % 100 = 3").withColumn("title", F.reverse("title")))
    whole, batch = sizes(store)[1], sizes(store)[2]
    assert batch < 0.04 * whole, (whole, batch)
    assert store.read("items").count() == 50_000


def test_a_batch_run_again_gives_the_same_version(spark, store):
    with store.transaction() as t:
        t.create("items", table(spark, range(5), "a"), ["id"])
    for _ in range(2):
        with store.transaction(("stream", 0)) as t:
            t.upsert("items", table(spark, [1], "b"))
        assert store.versions() == [1, 2]
    with store.transaction(("other", 0)) as t:
        assert not t.done_before


def test_readers_see_all_of_a_commit_or_nothing(spark, store):
    """A failure between two tables' writes leaves readers on the old snapshot; so does a commit that came second."""
    with store.transaction() as t:
        t.create("users", table(spark, range(5), "u"), ["id"], buckets=2)
        t.create("saves", table(spark, range(9), "s"), ["id"], buckets=2)
    with pytest.raises(ZeroDivisionError), store.transaction() as t:
        t.delete("users", spark.createDataFrame([(1,)], "id long"))
        raise ZeroDivisionError
    assert store.versions() == [1] and store.read("users").count() == 5
    first, second = store.transaction(), store.transaction()
    first.delete("users", spark.createDataFrame([(1,)], "id long"))
    second.delete("saves", spark.createDataFrame([(1,)], "id long"))
    assert first.commit() == 2
    with pytest.raises(Conflict):
        second.commit()
    assert store.read("users").count() == 4 and store.read("saves").count() == 9
    store.vacuum(keep=1)  # what the failed ones had written goes
    assert store.read("users").count() == 4 and store.read("saves").count() == 9


def test_user_goes_with_saves_and_leaves_events(spark, store):
    users = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    saves = spark.createDataFrame([(7, 1), (8, 1), (7, 2)], "product_id long, user_id long")
    events = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, None, "c")], "id long, user_id long, action string")
    with store.transaction() as t:
        t.create("users", users, ["id"])
        t.create("saves", saves, ["product_id", "user_id"])
        t.create("events", events, ["id"])
    with store.transaction() as t:
        merge.remove_users(t, spark.createDataFrame([(1,), (5,)], "id long"))
    assert rows_of(store.read("users")) == [(2, "y")] and rows_of(store.read("saves")) == [(7, 2)]
    assert sorted(map(str, store.read("events").collect())) == sorted(map(str, spark.createDataFrame([(1, None, "a"), (2, 2, "b"), (3, None, "c")], "id long, user_id long, action string").collect()))
