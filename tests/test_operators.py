"""Operators on small tables, and against plain Python on random ones."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators import brands, events, federated, feed, merge, search
from orrery.sources.snapshots import Store
from orrery.streaming import ingest

DAY = dt.date(2024, 1, 1)
ITEM = "product_id int, title string, created_at date, title_vector array<double>"


def items(spark):
    rows = [(1, "Red Jacket", DAY, [1.0, 0.0]), (2, "red jacket xl", DAY, [0.0, 1.0]), (3, "Dark red jacket", DAY, None), (4, "Jacket", DAY, [1.0, 1.0]), (5, "a%b", DAY, [0.0, 0.0])]
    return spark.createDataFrame(rows, ITEM)


def test_text_rank(spark):
    found = search.text_search(items(spark), " Red Jacket ").select("product_id", "text_rank").collect()
    assert [tuple(r) for r in found] == [(1, 0), (2, 1), (3, 2)]
    assert search.text_search(items(spark), "  ").count() == 0
    assert search.text_search(items(spark), None).count() == 0
    assert search.text_search(items(spark), "j_ck").count() == 4
    assert [r[0] for r in search.text_search(items(spark), "%", escape=True).collect()] == [5]


def test_vector_topk(spark):
    found = search.vector_search(items(spark), [1.0, 0.0], 10).select("product_id", F.round("similarity", 3)).collect()
    assert [tuple(r) for r in found] == [(1, 1.0), (4, 0.707), (2, 0.0), (5, None)]
    assert search.vector_search(items(spark), []).count() == 0
    many = V.topk_many(items(spark).where("product_id < 3"), items(spark), 2, "product_id", "product_id", "title_vector")
    assert sorted((r["query"], r["rank"], r["key"]) for r in many.collect()) == [(1, 1, 1), (1, 2, 4), (2, 1, 2), (2, 2, 4)]


def test_hybrid_against_plain_merge(spark):
    rng = random.Random(5)
    for limit in (1, 3, 10):
        text, near = rng.sample(range(8), 4), rng.sample(range(8), 5)
        t = spark.createDataFrame([(p, i, DAY) for i, p in enumerate(text)], "product_id int, text_rank int, created_at date")
        v = spark.createDataFrame([(p, 1.0 - i / 10) for i, p in enumerate(near)], "product_id int, similarity double")
        want = list(dict.fromkeys(text + near))[:limit]
        assert [r[0] for r in search.merged(t, v, limit).orderBy("position").collect()] == want


def test_any_field(spark):
    df = spark.createDataFrame([(1, "Red", ["x"]), (2, None, ["a", "RED "]), (3, "blue", None)], "id int, t string, tags array<string>")
    assert sorted(r[0] for r in search.any_field_contains(df, "red").collect()) == [1, 2]
    assert sorted(r[0] for r in search.any_field_contains(df, "red ").collect()) == [2]
    assert search.any_field_contains(df, " ").count() == 3
    card = search.card_fields(df, ["id"]).orderBy("id").select("card").collect()
    assert [[p["name"] for p in r[0]] for r in card] == [["t", "tags"], ["tags"], ["t"]]


def test_feed(spark):
    rows = [(1, "Top", 3), (2, "top", 1), (3, "PROCESSING", 0), (4, "shoes", 2), (5, None, 9)]
    df = spark.createDataFrame(rows, "product_id int, category string, pos int")
    assert [r["folder"] for r in feed.folders(df, "pos").collect()] == ["top", "shoes"]
    assert dict(feed.folder_counts(df.where("category is not null")).collect()) == {"top": 2, "shoes": 1}
    assert dict(feed.folder_counts(df.where("category is not null"), strict=True).collect()) == {"top": 1, "shoes": 1}
    assert feed.in_folder(df, "top").count() == 2 and feed.in_folder(df, None).count() == 0
    assert feed.by_category(df, "All").count() == 5 and feed.by_category(df, "top").count() == 1
    prev, incoming = (spark.createDataFrame([(i,) for i in ids], "product_id int") for ids in ([1], [1, 2, 2]))
    assert sorted(r[0] for r in feed.appended_unseen(prev, incoming).collect()) == [1, 2, 2]
    pick = spark.createDataFrame([(["a", "b"], "a"), (["a"], "c")], "s array<string>, x string").select(feed.toggled(F.col("s"), F.col("x")))
    assert [r[0] for r in pick.collect()] == [["b"], ["a", "c"]]


SMALL = "source_url string, title string, title_vector array<double>, image_vector array<double>, created_at int"


def test_upsert_keeps_vectors_and_dates(spark):
    old = spark.createDataFrame([("u", "old", [1.0], [2.0], 1)], SMALL)
    new = spark.createDataFrame([("u", "new", [3.0], None, 9), ("w", "w", [4.0], None, 9)], SMALL)
    got = {r[0]: tuple(r)[1:] for r in merge.upsert_products(old, new).collect()}
    assert got == {"u": ("new", [1.0], [2.0], 1), "w": ("w", [4.0], None, 9)}
    assert merge.upsert_products(old, new, refresh_title_vector=True).where("source_url = 'u'").first()["title_vector"] == [3.0]


def test_batch_upsert_against_one_by_one(spark):
    rng = random.Random(2)
    state = {str(k): (f"t{k}", [float(k)] if k % 2 else None) for k in range(4)}
    old = spark.createDataFrame([(k, t, v) for k, (t, v) in state.items()], "source_url string, title string, title_vector array<double>")
    batch = [(str(rng.randrange(6)), f"n{i}", [float(100 + i)] if rng.random() < 0.4 else None, i) for i in range(30)]
    for k, t, v, _ in batch:
        state[k] = (t, v if v is not None else state.get(k, (None, None))[1])
    new = spark.createDataFrame(batch, "source_url string, title string, title_vector array<double>, seq int")
    got = merge.upsert_products(old, new, refresh_title_vector=True, seq="seq").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == state


def test_batch_upsert_of_all_columns_against_one_by_one(spark):
    """Single upserts in turn, in plain Python; new keys repeat within the batch."""
    rng = random.Random(3)
    state = {str(k): (f"t{k}", [float(k)], [k + 0.5] if k % 2 else None, -k) for k in range(3)}
    old = spark.createDataFrame([(k, *v) for k, v in state.items()], SMALL)
    vector = lambda i: [float(i)] if rng.random() < 0.5 else None
    batch = [(str(rng.randrange(8)), f"n{i}", vector(i), vector(i), 100 + i, i) for i in range(60)]
    for k, title, tv, iv, made, _ in batch:
        known = state.get(k)
        state[k] = (title, tv, iv, made) if known is None else (title, known[1], iv if iv is not None else known[2], known[3])
    got = merge.upsert_products(old, spark.createDataFrame(rng.sample(batch, 60), SMALL + ", seq int"), seq="seq").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == state


def test_last_line_of_the_latest_file_wins(spark, tmp_path):
    page = '{"data": {"list": [{"goodsLinkUrl": "u", "goodsName": "%s", "price": "1"}, {"goodsLinkUrl": "u", "goodsName": "%s", "price": "1"}]}}'
    (tmp_path / "in").mkdir()
    for i, name in enumerate("bac"):
        (tmp_path / f"in/{name}").write_text(page % (f"first {name}", f"last {name}"))
        os.utime(tmp_path / f"in/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    store = Store(spark, str(tmp_path / "out"))
    ingest.catalog_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "cp")).awaitTermination()
    assert [r["title"] for r in store.read("products").collect()] == ["last c"]


def test_aligned_lists(spark):
    lists = spark.createDataFrame([(1, ["a", "b"], [1]), (2, [], [])], "id int, t array<string>, v array<int>")
    assert sorted(map(tuple, merge.aligned(lists, ["t", "v"]).collect())) == [(1, 0, "a", 1), (1, 1, "b", None)]


def test_insert_ignore_and_deletes(spark):
    kind = "product_id int, user_id int"
    old, new = spark.createDataFrame([(1, 1)], kind), spark.createDataFrame([(1, 1), (2, 1), (2, 1)], kind)
    assert sorted(merge.insert_ignore(old, new, ["product_id", "user_id"]).collect()) == [(1, 1), (2, 1)]
    b = spark.createDataFrame([("n", None), ("n", None), ("n", "l"), ("n", "l")], "brand_name string, link string")
    assert brands.inserted(b.limit(0), b).count() == 3
    assert merge.cascade(old.union(new), old, "product_id").count() == 2
    assert [r[0] for r in merge.set_null(old, old.select("user_id"), "user_id").select("user_id").collect()] == [None]
    with pytest.raises(ValueError):
        merge.delete_restricted(old, old, new, "product_id")
    assert merge.delete_restricted(old, spark.createDataFrame([(9, 9)], kind), new, "product_id").count() == 1


def test_new_ids(spark):
    rows = spark.createDataFrame([(None, f"u{i}") for i in range(50)] + [(3, "x")], "id int, source_url string")
    got = [r[0] for r in merge.with_new_ids(rows, spark.createDataFrame([(7,)], "id int"), "id", ["source_url"]).collect()]
    assert sorted(got) == [3, *range(8, 58)]


def test_category(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "id int, v array<double>")
    label = V.nearest_label([("outer", [1.0, 0.0]), ("none", None), ("top", [0.0, 1.0])], "v")
    assert [r[0] for r in df.orderBy("id").select(label).collect()] == ["outer", "top", "outer"]


def test_events(spark, tmp_path):
    df = spark.createDataFrame([(1, "LIKE", "SITE", None), (2, "BUY", "SITE", "{}"), (3, "LIKE", None, None)], "event_id int, action string, entity_type string, metadata string").withColumn("occurred_at", F.lit(None).cast("timestamp"))
    good, bad = events.split(df)
    assert (good.count(), bad.count()) == (1, 2)
    row = events.ingested(df).first()
    assert row["metadata"] == "{}" and row["occurred_at"] is not None
    df.write.parquet(str(tmp_path / "in"))
    for n in (1, 1):  # a restart adds nothing
        stream = ingest.event_stream(spark, str(tmp_path / "in"), df.schema, events.ACTIONS, events.ENTITIES)
        ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_catalog_stream_restarts(spark, tmp_path):
    page = '{"data": {"list": [{"goodsLinkUrl": "%s", "goodsName": "%s", "price": "1,000"}, {"goodsName": "no link"}]}}'
    (tmp_path / "in").mkdir()
    store = Store(spark, str(tmp_path / "out"))
    run = lambda cp="cp", **more: ingest.catalog_stream(spark, str(tmp_path / "in"), store, str(tmp_path / cp), files_a_batch=1, **more).awaitTermination()
    (tmp_path / "in/a").write_text(page % ("u", "first"))
    run()
    (tmp_path / "in/b").write_text(page % ("u", "second") + "\n" + page % ("w", "other"))
    run()
    run()
    rows = lambda: sorted((r["source_url"], r["title"]) for r in store.read("products").collect())
    assert rows() == [("u", "second"), ("w", "other")] and store.versions() == [1, 2]
    run("lost")  # a checkpoint that was lost: the batches are known by name and number
    assert rows() == [("u", "second"), ("w", "other")] and store.versions() == [1, 2]


def test_failed_batches_are_noted_or_stop_the_stream(spark, tmp_path, monkeypatch):
    page = '{"data": {"list": [{"goodsLinkUrl": "%s", "goodsName": "n", "price": "1"}]}}'
    (tmp_path / "in").mkdir()
    for i, name in enumerate("abc"):
        (tmp_path / f"in/{name}").write_text(page % name)
        os.utime(tmp_path / f"in/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    merge_products = ingest.merge_products

    def failing(t, incoming, **more):
        if incoming.where("source_url = 'b'").count():
            raise RuntimeError("no b today")
        merge_products(t, incoming, **more)

    monkeypatch.setattr(ingest, "merge_products", failing)
    store = Store(spark, str(tmp_path / "out"))
    run = lambda **more: ingest.catalog_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), files_a_batch=1, **more).awaitTermination()
    with pytest.raises(Exception, match="no b today"):
        run()
    assert [r["source_url"] for r in store.read("products").collect()] == ["a"]
    run(skip_failed=True)  # goes on at the failed batch
    assert sorted(r["source_url"] for r in store.read("products").collect()) == ["a", "c"]
    noted = store.read("failed_batches").collect()
    assert [(r["stream"], r["batch"]) for r in noted] == [("listings", 1)] and "no b today" in noted[0]["error"]


def test_split_stream_keeps_rejects(spark, tmp_path):
    kind = "event_id int, action string, entity_type string, metadata string, occurred_at timestamp"
    df = spark.createDataFrame([(1, "LIKE", "SITE", None, None), (2, "BUY", "SITE", "{}", None), (3, None, None, None, None)], kind)
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing
        ingest.split_events(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), events.ACTIONS, events.ENTITIES).awaitTermination()
        good, bad = spark.read.parquet(str(tmp_path / "out/valid")).collect(), spark.read.parquet(str(tmp_path / "out/rejected")).collect()
        assert [(r["event_id"], r["metadata"], r["occurred_at"] is None) for r in good] == [(1, "{}", False)]
        assert sorted((r["event_id"], r["occurred_at"] is None) for r in bad) == [(2, True), (3, True)]


def test_federated(spark):
    raw = spark.createDataFrame([('{"images_results": [{"title": "t", "thumbnail": "th", "original": "o", "link": "l", "price": "5", "source": "s"}]}', "a.com", "A"),
                                 ('{"visual_matches": [{"thumbnail": "th", "original": "o", "link": "m", "price": {"value": "7", "currency": "USD"}}]}', "instagram.com", None)], "body string, site_domain string, site_name string")
    got = {r["source_url"]: r for r in federated.normalized(federated.responses(raw)).collect()}
    assert (got["l"]["title"], got["l"]["price"], got["l"]["currency"], got["l"]["image_url"], got["l"]["shop"]) == ("t", "5", "KRW", "o", "s")
    assert (got["m"]["title"], got["m"]["price"], got["m"]["currency"], got["m"]["image_url"], got["m"]["shop"]) == ("상품명 없음", "7", "USD", "th", "알 수 없는 샵")


def test_brands(spark):
    known = spark.createDataFrame([("a",)], "brand_name string")
    edges = spark.createDataFrame([("a", 1, "B", "비"), ("a", 2, "C", ""), ("a", 3, "C", None), ("a", 4, "a", None), ("z", 5, "Z", None)], "brand_name string, id int, name string, name_kr string")
    got = sorted(tuple(r) for r in brands.expanded(known, edges, "https://b/brand").collect())
    assert got == [("C", "C", "https://b/brand/2"), ("비", "B", "https://b/brand/1")]
    lines = brands.from_lines(spark.createDataFrame([("비\n B ", "/b")], "text string, href string"), "https://x").first()
    assert tuple(lines) == ("비", "B", "https://x/b")


def test_payloads_and_guests(spark):
    found = spark.createDataFrame([("12", "t", "x"), ("9f-uuid", "t", "x"), (None, "t", "x")], "product_id string, title string, text_rank string")
    out = feed.save_payload(found)
    assert out.columns == ["product_id", "title"] and [r[0] for r in out.collect()] == [12, None, None]
    users = merge.upsert_users(feed.guest(spark).limit(0), feed.guest(spark))
    assert merge.upsert_users(users, feed.guest(spark)).count() == 1
    assert feed.user_view(users.withColumn("id", F.lit(1))).first()["username"] == "Guest"
