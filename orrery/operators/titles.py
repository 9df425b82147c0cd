"""Ranked text search for many queries at once, over an inverted index of the titles' trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram; queries with no run of so many scan the titles.
GRAM = 3
#: Short queries that are compared with all titles at once.
MOST_SHORT = 1 << 12


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def index(items: DataFrame, key: str = "product_id", title: str = "title") -> DataFrame:
    """(gram, key): the postings, to be written sorted by gram, so that a search reads only those of its grams."""
    return items.select(F.col(key).alias("key"), F.explode(grams(F.lower(title))).alias("gram")).select("gram", "key")


def write_index(items: DataFrame, path: str, key: str = "product_id", title: str = "title") -> None:
    """Ranges of grams, those of a very frequent one in several files, each sorted."""
    index(items, key, title).repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.parquet(path)


def search_many(queries: DataFrame, items: DataFrame, postings: DataFrame, k: int = 20, query_id: str = "query_id", query: str = "query", key: str = "product_id", title: str = "title", newest: str = "created_at") -> DataFrame:
    """(query_id, key, title, text_rank, rank): for each row of ``queries`` the ``k`` best items, as ``search.text_search`` ranks them.

    Percent signs and underscores are wildcards. Of the grams that a query's
    literal runs hold, the one with the shortest list gives the candidates; what
    it hits is then compared by LIKE. Queries without a gram, a few short ones,
    are compared with every title. Blank and null queries find nothing.
    """
    q = F.lower(F.trim(query))
    asked = queries.select(F.col(query_id).alias("query_id"), q.alias("q")).where("q IS NOT NULL AND q <> ''")
    runs = F.split(F.col("q"), "[%_]")
    asked = asked.withColumn("grams", F.array_distinct(F.flatten(F.transform(runs, grams))))
    long, short = asked.where(F.size("grams") > 0), asked.where(F.size("grams") == 0).select("query_id", "q")
    needed = long.select("query_id", "q", F.explode("grams").alias("gram"))
    sizes = postings.join(needed.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no title has: no candidates, and the query finds nothing
    rarest = needed.join(sizes, "gram", "left").groupBy("query_id", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    hits = rarest.select("query_id", "q", F.col("r.gram").alias("gram")).join(postings, "gram").select("query_id", "q", "key")
    titles = items.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(newest).alias("newest"))
    found = hits.join(titles, "key")
    if (n := short.limit(MOST_SHORT + 1).count()) > MOST_SHORT:
        raise ValueError(f"more than {MOST_SHORT} queries have no run of {GRAM} characters")
    if n:
        found = found.unionByName(titles.crossJoin(F.broadcast(short)).select(found.columns))  # a stated set of bounded size against all titles
    lowered, literal = F.lower("title"), F.col("q")
    like = lambda before, after: F.expr(f"lower(title) LIKE concat('{before}', q, '{after}')")
    rank = F.when(lowered == literal, 0).when(like("", "%"), 1).otherwise(2)
    matching = found.where(like("%", "%")).withColumn("text_rank", rank)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("text_rank", F.desc("newest"), "key"))
    return matching.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "key", "title", "text_rank", "rank")


def candidates(queries: DataFrame, postings: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, candidates): how many titles a search compares for each query that has grams."""
    q = F.lower(F.trim(query))
    needed = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(F.flatten(F.transform(F.split(q, "[%_]"), grams)))).alias("gram"))
    sizes = postings.groupBy("gram").agg(F.count("*").alias("n"))
    return needed.join(sizes, "gram", "left").groupBy("query_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("candidates"))
