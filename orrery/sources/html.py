"""Product facts from HTML pages: marked-up elements, JSON-LD, OpenGraph, embedded state.

One Arrow pass parses each page once; rules on prices and availability, and the
merge of what the readers found, are Column expressions on its result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orrery.functions import normalize as N
from orrery.sources.shared import dealt, slices

FIELDS = ["title", "price", "brand", "image_url", "category", "availability", "status", "shop"]
FOUND = "struct<" + ", ".join(f"{f}: string" for f in FIELDS) + ", is_soldout: boolean, has_offer: boolean, numeric: boolean, gender: string>"
SCHEMA = f"url string, page_title string, heading string, page_title_source string, heading_source string, marked {FOUND}, linked {FOUND}, graph {FOUND}, state {FOUND}"
#: Classes of the elements that carry facts, and the text of a button to buy.
MARKS = {("h1", "Product-title"): "title", ("div", "Product-price"): "price", ("h2", "Product-brand"): "brand", ("div", "Product-buy"): "buy"}
BUY = "구매하기"
PLAIN = {"title": "page_title", "h1": "heading"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Page(HTMLParser):
    """Collects what the readers need in one pass; unclosed elements end with their parent. Texts are held as the page writes them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.texts: dict[str, list[str]] = {}
        self.image: str | None = None
        self.scripts: list[tuple[dict, str]] = []
        self.metas: list[dict] = []

    def feed(self, data):
        super().feed(data.replace("&", "&amp;"))  # the parser takes one layer of references off, so that the page's own are left

    def handle_starttag(self, tag, attrs):
        a = {k: unescape(v or "") for k, v in attrs}
        classes = a.get("class", "").split()
        if tag == "meta":
            self.metas.append(a)
        if tag == "img" and "Product-image" in classes and self.image is None:
            self.image = a.get("src")
        if tag in VOID:
            return
        names = {MARKS.get((tag, c)) for c in classes} | {PLAIN.get(tag)}
        slot = [n for n in sorted(names - {None}) if n not in self.texts]
        for n in slot:
            self.texts[n] = []
        if tag == "script":
            self.scripts.append((a, ""))
        self.open.append((tag, slot))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "script":
            a, text = self.scripts[-1]
            self.scripts[-1] = (a, text + data.replace("&amp;", "&"))  # no references in scripts
            return
        for _, slot in self.open:
            for n in slot:
                self.texts[n].append(data)

    def text(self, name: str) -> str | None:
        if name not in self.texts:
            return None
        return "".join(unescape(t).strip() for t in self.texts[name])

    def source(self, name: str) -> str | None:
        """The text with its references and blanks, as the page has it."""
        return "".join(self.texts[name]) if name in self.texts else None


def _text(value) -> str | None:
    """A JSON value as text: numbers without a needless point, other kinds as JSON."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return json.dumps(value, ensure_ascii=False)


def _price(value) -> dict:
    """A JSON value as a price: what is a number there stays one, other kinds are text for the rules on texts."""
    return {"price": _text(value), "numeric": isinstance(value, (int, float)) and not isinstance(value, bool)}


def _marked(page: Page) -> dict | None:
    found = {"title": page.text("title"), "price": page.text("price"), "brand": page.text("brand"), "image_url": page.image}
    if BUY in unescape("".join(page.texts.get("buy", []))):
        found["is_soldout"] = False
    return found if found["title"] else None


def _linked(page: Page) -> dict | None:
    """The first JSON-LD product; scripts that hold something else are passed over."""
    for attributes, text in page.scripts:
        if attributes.get("type") != "application/ld+json" or not text:
            continue
        try:
            data = json.loads(text)
        except ValueError:
            continue
        if isinstance(data, list):
            if not all(isinstance(x, dict) for x in data[: next((i + 1 for i, x in enumerate(data) if isinstance(x, dict) and x.get("@type") == "Product"), len(data))]):
                continue
            data = next((x for x in data if x.get("@type") == "Product"), None)
        if not isinstance(data, dict) or data.get("@type") != "Product":
            continue
        found = {"title": _text(data.get("name") or data.get("headline")), "category": _text(data.get("category"))}
        brand, images, offers = data.get("brand"), data.get("image"), data.get("offers")
        found["brand"] = _text(brand.get("name")) if isinstance(brand, dict) else brand if isinstance(brand, str) else None
        found["image_url"] = _text(images[0]) if isinstance(images, list) and images else images if isinstance(images, str) else None
        if isinstance(offers, list):
            offers = offers[0] if offers else None
        if isinstance(offers, dict) and offers:
            found |= _price(offers.get("price")) | {"availability": _text(offers.get("availability")), "status": _text(offers.get("status")), "has_offer": True}
        return found if found["title"] else None
    return None


def _graph(page: Page, lenient: bool) -> dict | None:
    """OpenGraph properties, the last of each counting; ``lenient`` also reads those that start with ``product:``."""
    data: dict[str, str] = {}
    for a in page.metas:
        prop, content = a.get("property", ""), a.get("content")
        if not content:
            continue
        if prop.startswith("og:") or lenient and prop.startswith("product:"):
            data[prop.replace("og:", "")] = content.strip()
        elif a.get("name") == "description":
            data.setdefault("description", content.strip())
    title = data.get("title") or data.get("site_name")
    if not title:
        return None
    return {
        "title": title, "image_url": data.get("image"), "brand": data.get("brand"), "category": data.get("category"), "shop": data.get("site_name"),
        "price": data.get("product:price:amount") or data.get("price:amount"),
        "availability": data.get("availability") or data.get("product:availability") or data.get("status"), "has_offer": True,
    }


#: Where a shop's pages keep their product, and that shop's name in a URL.
STATE = re.compile(r"window\.__MSS_FE__\.product\.state\s*=\s*(\{.*?\});", re.DOTALL)
STATE_SITE = "musinsa.com"


def _state(page: Page) -> dict | None:
    """The product that a page's state holds; none where it isn't there or isn't made as it should be."""
    text = next((text for a, text in page.scripts if a.get("id") == "pdp-data"), "")
    if not (m := STATE.search(text)):
        return None
    try:
        data = json.loads(m[1])
        brand, cost = data.get("brandInfo", {}).get("brandName"), data.get("goodsPrice", {})
        price = cost.get("salePrice") or cost.get("normalPrice")
    except (ValueError, AttributeError):
        return None
    return {
        "title": _text(data.get("goodsNm")), "brand": _text(brand), "category": _text(data.get("baseCategoryFullPath")), "image_url": _text(data.get("thumbnailImageUrl")),
        "is_soldout": bool(data.get("isOutOfStock")), "gender": _text(data.get("displayGenderText")),
    } | _price(price)


def read(html: str | None, lenient: bool = False) -> dict:
    """What each reader finds in a page; a null or broken page gives nulls."""
    page = Page()
    page.feed(html or "")
    page.close()
    plain = {n: page.text(n) for n in PLAIN.values()} | {f"{n}_source": page.source(n) for n in PLAIN.values()}
    return plain | {"marked": _marked(page), "linked": _linked(page), "graph": _graph(page, lenient), "state": _state(page)}


def parsed(pages: DataFrame, lenient: bool = False, keep: list[str] = ()) -> DataFrame:
    """``SCHEMA`` for pages (url, html), with the columns in ``keep``, so that nothing needs to be joined back."""
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA.replace("struct<", "STRUCT<")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole)):
            rows = [{"url": u} | read(h, lenient) for u, h in zip(*(c.to_pylist() for c in batch.columns[:2]))]
            made = pa.RecordBatch.from_pylist(rows, schema=schema)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made.columns], names=[*keep, *schema.names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema) if keep else ""
    return dealt(pages.select("url", "html", *keep)).mapInArrow(run, kept + SCHEMA)


def _facts(s: str) -> Column:
    """One reader's facts, prices and availability by rule."""
    f = F.col(s)
    price = F.when(f["numeric"], f["price"]).otherwise(N.price_html(f["price"]))
    offered = F.when(f["has_offer"], N.soldout_from_offer(f["availability"], f["status"]))
    return F.when(
        f.isNotNull(),
        F.struct(
            f["title"].alias("title"), price.alias("price"), f["brand"].alias("brand"), f["image_url"].alias("image_url"),
            f["category"].alias("category"), F.coalesce(f["is_soldout"], offered).alias("is_soldout"),
        ),
    )


def merged(found: list[Column], fields: list[str]) -> list[Column]:
    """Each field from the first reader that has it; empty text counts as missing, zero and false don't."""
    return [
        F.coalesce(*(F.nullif(f[name], F.lit("")) if name != "is_soldout" else f[name] for f in found)).alias(name)
        for name in fields
    ]


def products(pages: DataFrame, lenient: bool = False, keep: list[str] = (), state_site: str = STATE_SITE) -> DataFrame:
    """(url, title, price, brand, image_url, category, is_soldout, gender, shop), and the columns in ``keep``.

    The URL decides: pages of ``state_site`` have what their embedded state says, or nothing, others what all readers find together.
    """
    p = parsed(pages, lenient, keep)
    fields = ["title", "price", "brand", "image_url", "category", "is_soldout"]
    for i, reader in enumerate(("marked", "linked", "graph", "state")):
        p = p.withColumn(f"f{i}", _facts(reader))
    special = F.coalesce(F.col("url").contains(state_site), F.lit(False))
    chosen = F.when(special, F.col("f3")).otherwise(F.struct(*merged([F.col(f"f{i}") for i in range(3)], fields)))
    gender = N.falsy(F.when(special, F.col("state.gender")), F.lit("UNKNOWN"))
    return p.select(*keep, "url", chosen.alias("c"), gender.alias("gender")).select(*keep, "url", "c.*", "gender", N.site_label(F.col("url")).alias("shop"))


def records(facts: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Product records from page facts, with what stands in for missing fields, and the columns in ``keep``.

    Facts may have ``local_path``, an image of the page's own that stands in for a missing one.
    """
    facts = facts if "local_path" in facts.columns else facts.withColumn("local_path", F.lit(None).cast("string"))
    default = N.product_defaults()
    return facts.select(
        F.col("url").alias("source_url"), default["title"].alias("title"), N.price(F.col("price")).alias("price"), F.lit("KRW").alias("currency"), default["brand"].alias("brand"),
        default["category"].alias("category"), "is_soldout", default["image_url"].alias("image_url"), N.shop(F.col("shop")).alias("shop"), default["gender"].alias("gender"), *keep,
    )


def marked(facts: DataFrame, source: str = "feed_add") -> DataFrame:
    """Facts with where they come from; the mark isn't part of a record."""
    return facts.withColumn("_source", F.lit(source))


class Anchors(HTMLParser):
    """Links of a class within list items of a class."""

    def __init__(self, item: str, link: str):
        super().__init__(convert_charrefs=True)
        self.item, self.link, self.depth = item, link, []
        self.found: list[list] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag == "br" and self.inside:
            self.found[-1][0] += "\n"
        if tag == "li":
            self.depth.append(self.item in classes)
        if tag == "a" and self.link in classes and self.depth and self.depth[-1]:
            self.found.append(["", a.get("href")])
            self.inside = True

    def handle_endtag(self, tag):
        if tag == "li" and self.depth:
            self.depth.pop()
        if tag in ("a", "li"):
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.found[-1][0] += data


def anchors(pages: DataFrame, item: str = "menu", link: str = "view") -> DataFrame:
    """(url, text, href) of the links with class ``link`` in list items with class ``item``; line breaks stay in the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, text in zip(*(c.to_pylist() for c in batch.columns)):
                reader = Anchors(item, link)
                reader.feed(text or "")
                rows += [(url, t.strip(), href) for t, href in reader.found]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["url", "text", "href"])

    return dealt(pages.select("url", "html")).mapInArrow(run, "url string, text string, href string")
