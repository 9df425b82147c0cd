"""Plans stay as they should: filters and columns reach the scans, no Python where SQL functions do."""

import re

from orrery.plans import catalog


def plan(df):
    return df._jdf.queryExecution().toString()


def scans(text):
    return re.findall(r"(PushedFilters: \[[^\]]*\]).*?ReadSchema: (struct<[^\n]*)", text.split("== Physical Plan ==")[1])


def test_feed_reads_only_the_users_rows(spark, sf):
    text = plan(catalog.QUERIES["saved_feed"](spark, sf))
    orders = next(x for x in scans(text) if "o_custkey" in x[1])
    assert f"EqualTo(o_custkey,{catalog.USER})" in orders[0]
    assert "o_totalprice" not in orders[1] and "l_extendedprice" not in text.split("== Physical Plan ==")[1]


def test_top_k_is_one_operator(spark, sf):
    for name in ("text_search", "vector_topk"):
        assert "TakeOrderedAndProject" in plan(catalog.QUERIES[name](spark, sf))


def test_no_python_in_rules_and_merges(spark, sf):
    for name in ("price_parse", "currency_norm", "availability", "product_upsert", "batch_upsert_vectors", "user_upsert", "event_ingest", "federated_union", "category_argmax"):
        physical = plan(catalog.QUERIES[name](spark, sf)).split("== Physical Plan ==")[1]
        assert not re.search("Python|Pandas|Arrow", physical), name
        assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical, name

