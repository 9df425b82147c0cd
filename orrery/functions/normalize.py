"""Normalisation rules of catalog fields, each a Column made of Columns.

Digits, letters and case folding are ASCII in the patterns, as in Spark's regular expressions.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PRICE = "decimal(12,2)"

#: Names that shops go by, in lower case, and their canonical names.
SHOP_ALIASES = {
    "fruitsfamily": "FRUITS FAMILY",
    "fetching": "FETCHING",
    "empty": "EMPTY",
    "worksout": "WORKSOUT",
    "8division": "8DIVISION",
    "iamshop": "IAMSHOP",
    "thebounce": "THE BOUNCE",
    "the bounce": "THE BOUNCE",
    "thexshop": "THE X SHOP",
    "the x shop": "THE X SHOP",
    "collectiv": "COLLECTIV",
    "kream": "KREAM",
    "musinsa": "MUSINSA",
    "eql": "EQL",
    "29cm": "29CM",
    "bunjang": "Bunjang",
    "daangn": "Danggeun Market",
    "danggeun market": "Danggeun Market",
    "joongna": "Joonggonara",
    "joonggonara": "Joonggonara",
    "zara": "ZARA",
}
#: Canonical names and domain labels that the aliases leave out; only with ``extended``.
MORE_ALIASES = {"fruits family": "FRUITS FAMILY", "eqlstore": "EQL", "iamshop-online": "IAMSHOP"}
#: Signs and codes of currencies.
CURRENCIES = {"₩": "KRW", "KRW": "KRW", "$": "USD", "USD": "USD", "¥": "JPY", "JPY": "JPY", "€": "EUR", "EUR": "EUR"}
#: Words for availability, in lower case; the first group is looked for first.
AVAILABLE = ["판매중", "in stock", "available"]
SOLD_OUT = ["품절", "outofstock", "out of stock", "sold out", "soldout"]
TRUE_WORDS, FALSE_WORDS = ["true", "t", "1", "yes", "y"], ["false", "f", "0", "no", "n"]
#: Endings of two labels under which names are registered.
SUFFIXES = ["co.kr", "or.kr", "go.kr", "ac.kr", "ne.kr", "re.kr", "pe.kr", "seoul.kr", "busan.kr", "co.uk", "org.uk", "co.jp", "com.au", "com.br", "com.cn", "com.tw", "com.hk"]


def falsy(c: Column, *others: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (c, *others)))


def _lookup(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c]


def price(text: Column) -> Column:
    """The first number in a text, without thousands separators."""
    return F.nullif(F.regexp_extract(F.replace(F.trim(text), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast(PRICE)


def price_batch(text: Column) -> Column:
    """What is left of a text without anything but digits, points and signs, if it is a number."""
    return F.nullif(F.regexp_replace(text, r"[^0-9.\-]", ""), F.lit("")).try_cast(PRICE)


def price_html(text: Column) -> Column:
    """All digits of a text in a row, decimal points lost; a text without digits stays."""
    trimmed = F.nullif(F.trim(text), F.lit(""))
    digits = F.nullif(F.regexp_replace(trimmed, r"[^\d]", ""), F.lit(""))
    return F.coalesce(F.regexp_replace(digits, "^0+(?=.)", ""), trimmed)


def price_number(value: Column) -> Column:
    """A number as text, whole ones without a point; JSON's own numbers come as such texts from ``sources/html.py``."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def price_or(first: Column, other: Column) -> Column:
    """``first`` unless it is null or zero."""
    return F.coalesce(F.nullif(first, F.lit(0)), other)


def currency(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.coalesce(_lookup(t, CURRENCIES), F.when(t.rlike("^[A-Z]{3}$"), t), F.lit("KRW"))


def shop(text: Column, extended: bool = False) -> Column:
    """The canonical name, UNKNOWN for others and null."""
    return F.coalesce(_lookup(F.lower(F.trim(text)), SHOP_ALIASES | (MORE_ALIASES if extended else {})), F.lit("UNKNOWN"))


def soldout(text: Column) -> Column:
    """A flag from words; null where there's none that says so."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(TRUE_WORDS), True).when(t.isin(FALSE_WORDS), False)


def available(text: Column) -> Column:
    """False for null and blank, then by words; other texts count as available, and so does any that contains "available"."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    has = lambda words: F.greatest(*(t.contains(w) for w in words))
    return F.when(t == "", False).when(has(AVAILABLE), True).when(has(SOLD_OUT), False).otherwise(True)


def soldout_from_offer(availability: Column, status: Column) -> Column:
    return ~(available(availability) | available(status))


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain(url: Column) -> Column:
    """The host without its first ``www.``; of what is no URL, what comes before the first slash."""
    rest = F.split(F.regexp_replace(url, "^https?://", ""), "/")[0]
    return F.coalesce(F.regexp_replace(host(url), r"^(.*?)www\.", "$1"), rest)


def domain_host(url: Column) -> Column:
    """The host in lower case; of what is no URL, what comes before the first slash."""
    return F.coalesce(host(url), F.lower(F.split(F.regexp_replace(url, "^https?://", ""), "/")[0]))


def site_label(url: Column) -> Column:
    """The label that is registered, left of the public suffix; null without one. An IP address is a label as a whole.

    For all rules of public suffixes see ``operators/sites.py``.
    """
    h = domain_host(url)
    two = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    address = F.when(h.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), h)
    return F.nullif(F.coalesce(address, F.nullif(F.regexp_extract(h, rf"([^.]+)\.(?:{two})$", 1), F.lit("")), F.regexp_extract(h, r"([^.]+)\.[^.]+$", 1)), F.lit(""))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML entities to characters, one pass."""
    return texts.map(html.unescape, na_action="ignore")


def image_url(text: Column, unescape=unescaped) -> Column:
    """Trimmed, unescaped, with a scheme where it starts with two slashes; null gives an empty text."""
    t = unescape(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t)


def image_path(text: Column) -> Column:
    """A path below the image folder."""
    t = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^/api/images/", ""), "^/images/", ""), "^/+", "")


def display_image(image: Column, local: Column, fallback: str) -> Column:
    t = falsy(local, image)
    path = t
    for pattern in ("^/+api/images/", "^/+images/", "^/+"):
        path = F.regexp_replace(path, pattern, "")
    return (
        F.when(t.isNull(), F.lit(fallback))
        .when(t.rlike("^(https?://|data:)"), t)
        .when(t.startswith("//"), F.concat(F.lit("https:"), t))
        .otherwise(F.coalesce(F.concat(F.lit("/api/images/"), F.nullif(path, F.lit(""))), F.lit(fallback)))
    )


def title(text: Column) -> Column:
    return falsy(text, F.lit("제목 없음"))


def category_label(text: Column) -> Column:
    return F.when(F.upper(text) == "ALL", F.lit("All")).otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20))))


def detail_query(mood: Column, color: Column, fit: Column, category: Column, brand: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (mood, color, fit, category, brand)))


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def item_key(item: Column, image: Column, source: Column) -> Column:
    return F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in (item, image, source)))


def won(amount: Column) -> Column:
    return F.concat(F.lit("₩"), F.format_number(amount, 0))


def image_bytes(data_uri: Column) -> Column:
    return F.unbase64(F.regexp_replace(data_uri, "^data:image/.+;base64,", ""))


def input_kind(text: Column) -> Column:
    """url, data or text, for a search input; null for none."""
    return F.when(F.nullif(text, F.lit("")).isNull(), None).when(text.rlike("^(https?:)?//"), "url").when(text.startswith("data:image"), "data").otherwise("text")


def is_processing(category: Column, marker: Column | None = None) -> Column:
    flag = F.coalesce(F.upper(F.trim(category)) == "PROCESSING", F.lit(False))
    return flag if marker is None else flag | F.coalesce(marker, F.lit(False))


def vector_unwrapped(nested: Column) -> Column:
    return F.flatten(nested)


def vector_text(v: Column) -> Column:
    """A vector as text, elements in brackets."""
    return F.to_json(v)


def soldout_flag(json: Column) -> Column:
    """A JSON value that is true or false; others give null."""
    t = F.trim(json)
    return F.when(t == "true", True).when(t == "false", False)


def brand_name(local: Column, name: Column) -> Column:
    return falsy(local, name)


def brand_link(brand_id: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), brand_id.cast("string"))


def absolute_link(link: Column, base: str) -> Column:
    return F.when(link.startswith("/"), F.concat(F.lit(base), link)).otherwise(link)


def search_batch(page: Column) -> Column:
    """The batch of results that holds a page of the user's: three pages each, pages below one and no numbers counting as one."""
    return F.floor((F.greatest(F.lit(1), F.coalesce(page.cast("string").try_cast("int"), F.lit(1))) - 1) / 3).cast("int")


#: What is left out of a search for product pages.
NO_LISTS = "-inurl:search -inurl:category -inurl:snap"


def site_query(query: Column, site: Column) -> Column:
    """A query for one shop's product pages; the general engine gets no site."""
    no_lists = F.lit(NO_LISTS)
    return F.when(site == "google.com", F.concat_ws(" ", query, no_lists)).otherwise(F.concat_ws(" ", query, F.concat(F.lit("site:"), site), F.lit("(> products)"), no_lists))


def product_defaults() -> dict[str, Column]:
    """Fields of a product record with what stands in for null and empty values."""
    return {
        "title": falsy(F.col("title"), F.lit("Unknown")),
        "brand": falsy(F.col("brand"), F.lit("UNKNOWN")),
        "category": falsy(F.col("category"), F.lit("PRODUCT")),
        "gender": falsy(F.col("gender"), F.lit("UNKNOWN")),
        "image_url": F.coalesce(falsy(F.col("image_url"), F.col("local_path")), F.lit("")),
    }
