"""Field rules, case by case."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orrery.functions import normalize as N


def applied(spark, rule, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


D = Decimal
CASES = [
    (N.price, {None: None, "₩12,900": D("12900.00"), "1,299.99 ~ 1,500": D("1299.99"), "1.2.3": D("1.20"), "-5": D("-5.00"), "가격 미상": None, "": None, "12.5": D("12.50"), "9" * 20: None}),
    (N.price_batch, {"12,900원": D("12900.00"), ".5": D("0.50"), "12-34": None, "1.2.3": None, "-": None, "": None, None: None}),
    (N.price_html, {"₩12,900": "12900", "12.50": "1250", "문의": "문의", "  ": None, None: None, "007": "7", "0": "0"}),
    (N.currency, {"₩": "KRW", "usd": "USD", " gbp ": "GBP", "GB": "KRW", None: "KRW"}),
    (N.shop, {" Musinsa ": "MUSINSA", "the bounce": "THE BOUNCE", "FRUITS FAMILY": "UNKNOWN", "nope": "UNKNOWN", None: "UNKNOWN"}),
    (lambda c: N.shop(c, extended=True), {"FRUITS FAMILY": "FRUITS FAMILY", "eqlstore": "EQL"}),
    (N.soldout, {"Yes": True, "0": False, "1": True, "maybe": None, None: None}),
    (N.available, {None: False, "": False, "In Stock": True, "x/InStock": True, "x/OutOfStock": False, "unavailable": True, "품절": False, "PreOrder": True}),
    (N.domain, {"https://www.a.com/x": "a.com", "https://m.www.a.com": "m.a.com", "a.com/x": "a.com", "www.a.com/x": "www.a.com"}),
    (N.site_label, {"https://www.a.co.kr/x": "a", "https://shop.b.com": "b", "https://empty.seoul.kr": "empty"}),
    (N.image_url, {" //i.x/a?b=1&amp;c=2 ": "https://i.x/a?b=1&c=2", None: "", "x &amp;amp;": "x &amp;"}),
    (N.image_path, {"/api/images/a.png": "a.png", "\\images\\b.png": "b.png", "//c.png": "c.png", None: ""}),
    (N.category_label, {"ALL": "All", "outer wear": "Outer wear"}),
    (N.with_scheme, {"shop.kr": "https://shop.kr", "httpfoo.kr": "httpfoo.kr"}),
    (N.title, {"": "제목 없음", None: "제목 없음", "a": "a"}),
    (N.input_kind, {"https://a": "url", "//a": "url", "data:image/png;base64,AA": "data", "red coat": "text", "": None, None: None}),
    (N.search_batch, {"1": 0, "3": 0, "4": 1, "0": 0, "x": 0, None: 0}),
    (N.is_processing, {" processing ": True, "top": False, None: False}),
]


@pytest.mark.parametrize("rule, cases", CASES, ids=range(len(CASES)))
def test_rule(spark, rule, cases):
    assert applied(spark, rule, list(cases)) == list(cases.values())


def test_offer(spark):
    df = spark.createDataFrame([(1, None, None), (2, "OutOfStock", None), (3, "InStock", None), (4, "OutOfStock", "x")], "i int, a string, s string")
    assert [r[0] for r in df.orderBy("i").select(N.soldout_from_offer(F.col("a"), F.col("s"))).collect()] == [True, True, False, False]


def test_numbers(spark):
    assert applied(spark, N.price_number, [12.0, 12.5, None], "double") == ["12", "12.5", None]
    df = spark.createDataFrame([(0, 5000), (None, 5000), (7, 1)], "a int, b int")
    assert [r[0] for r in df.select(N.price_or(F.col("a"), F.col("b"))).collect()] == [5000, 5000, 7]


def test_query_fields(spark):
    df = spark.createDataFrame([("", "black", "", "top", "X")], "a string, b string, c string, d string, e string")
    assert df.select(N.detail_query(*(F.col(c) for c in "abcde"))).first()[0] == "black top X"
    assert df.select(N.display_image(F.lit("//x/y"), F.lit(None).cast("string"), "none"), N.display_image(F.lit("/images/y"), F.lit(""), "none")).first()[:] == ("https://x/y", "/api/images/y")
    assert df.select(N.image_bytes(F.lit("data:image/png;base64,QUI="))).first()[0] == b"AB"
    assert df.select(N.won(F.lit(12900.0)), N.item_key(F.lit(1), F.lit(None), F.lit("s")), N.brand_link(F.lit(7), "https://b/brand/"), N.absolute_link(F.lit("/a"), "https://b")).first()[:] == ("₩12,900", "1::s", "https://b/brand/7", "https://b/a")
