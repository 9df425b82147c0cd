"""Brand lists and their one-hop expansion by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.normalize import absolute_link, brand_link, brand_name
from orrery.operators.merge import insert_ignore


def expanded(brands: DataFrame, edges: DataFrame, link_base: str) -> DataFrame:
    """New brands (brand_name, brand_name_eng, link) that edges (brand_name, id, name, name_kr) lead to from known ones.

    Each new name comes once, from the edge with the smallest id.
    """
    names = brands.select("brand_name").distinct()
    near = edges.join(names, "brand_name", "left_semi").withColumn("__name", brand_name(F.col("name_kr"), F.col("name"))).where(F.col("__name").isNotNull())
    new = near.join(names.withColumnRenamed("brand_name", "__name"), "__name", "left_anti")
    first = new.groupBy("__name").agg(F.min_by(F.struct("name", "id"), "id").alias("first"))
    return first.select(F.col("__name").alias("brand_name"), F.col("first.name").alias("brand_name_eng"), brand_link(F.col("first.id"), link_base).alias("link"))


def found_ids(answers: DataFrame, body: str = "body") -> DataFrame:
    """(brand_name, brand_id, error) of captured answers (brand_name, body) to a look-up by name.

    Only an answer of code 200 with a brand has an id; one that lists errors, or is no JSON, has an error instead, and
    any other neither.
    """
    answer = F.from_json(body, "struct<errors: array<string>, data: struct<getBrandByNameResponse: struct<code: int, brand: struct<id: string>>>, _corrupt_record: string>")
    reply = answer["data"]["getBrandByNameResponse"]
    failed = answer["errors"].isNotNull() | answer["_corrupt_record"].isNotNull() | F.col(body).isNull()
    error = F.when(failed, F.coalesce(F.to_json(answer["errors"]), F.lit("no answer")))
    return answers.select("brand_name", F.when(~failed & (reply["code"] == 200), reply["brand"]["id"]).alias("brand_id"), error.alias("error"))


def edges(found: DataFrame, answers: DataFrame, body: str = "body") -> DataFrame:
    """(brand_name, id, name, name_kr) of captured answers (brand_id, body) on similar brands, for the brands whose id was found."""
    similar = F.from_json(body, "struct<errors: array<string>, data: struct<getSimilarBrands: array<struct<id: long, name: string, name_kr: string>>>>")
    near = answers.select("brand_id", F.when(similar["errors"].isNull(), similar["data"]["getSimilarBrands"]).alias("s"))
    known = found.where("brand_id IS NOT NULL").select("brand_name", "brand_id")
    return known.join(near, "brand_id").select("brand_name", F.explode("s").alias("s")).select("brand_name", "s.*")


def inserted(brands: DataFrame, new: DataFrame) -> DataFrame:
    """``brands`` with the new ones, one for each name and link; rows without a link all stay."""
    return insert_ignore(brands, new, ["brand_name", "link"])


def listed(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The entries of brand lists captured as JSON."""
    entry = "array<struct<name: string, englishName: string, linkUrl: string>>"
    return bodies.select(F.explode(F.from_json(body, entry)).alias("__entry")).select("__entry.*")


def popular(bodies: DataFrame, body: str = "body") -> DataFrame:
    """(brand_name) of captured answers on popular brands."""
    answer = "struct<data: struct<getPopularKeywordsByFilterCached: struct<popularBrands: array<struct<name: string>>>>>"
    names = F.from_json(body, answer)["data"]["getPopularKeywordsByFilterCached"]["popularBrands"]["name"]
    return bodies.select(F.explode(names).alias("brand_name"))


def from_json(raw: DataFrame) -> DataFrame:
    """(brand_name, brand_name_eng, link) of a brand list (name, englishName, linkUrl)."""
    return raw.select(F.col("name").alias("brand_name"), F.col("englishName").alias("brand_name_eng"), F.col("linkUrl").alias("link"))


def from_lines(links: DataFrame, base: str) -> DataFrame:
    """The same of links (text, href) whose text has the local name on one line and the English one on the next."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return links.withColumn("__lines", lines).select(
        F.get("__lines", 0).alias("brand_name"), F.coalesce(F.get("__lines", 1), F.get("__lines", 0)).alias("brand_name_eng"), absolute_link(F.col("href"), base).alias("link")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """(processed, failed) of rows (brand_name, error)."""
    return results.agg(F.count("*").alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def run_errors(results: DataFrame) -> DataFrame:
    """(error) for each row that failed, with its brand."""
    return results.where("error IS NOT NULL").select(F.concat_ws(": ", "brand_name", "error").alias("error"))
