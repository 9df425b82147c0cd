"""How the sources of a language differ in their words, counted by DuckDB over hash shards (operator 12).

Tasks count terms where the texts stand and pass on, for each language, source
and term, occurrences and documents. These are dealt by hash of language and
term, so that a shard has all of a term; DuckDB sums them in SQL over Arrow
batches and keeps the terms that enough of the language's documents hold. From
the sums of kept terms Spark makes the totals of the groups; then DuckDB, again
by shard, turns counts into shares, sums the divergences of each pair of sources
over the shard's terms, and ranks each group's terms. Spark adds up what the
shards found for pairs and merges their rankings.

Where a language has more sources than a block, pairs are made in blocks of
sources, so that what goes to all tasks stays bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import slices, written

LEAST_DOCS, RANKS = 10, 10
#: Entries that a task counts before it passes them on.
MOST_COUNTED = 1 << 20
#: (language, source) groups that are sent to all tasks at once.
GROUPS_A_BLOCK = 4096
#: Memory of one shard's DuckDB; beyond, it writes to the task's temporary folder.
DUCKDB_MEMORY = "512MB"
#: Bytes of letters as they are, with A-Z lower-cased, and blanks for all others.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: 1 + floor(10^9 (count + 2) / (N + 2 V)), in 128 bits, which no count of a corpus exceeds.
_SHARE = "(1 + (1000000000::HUGEINT * ({count} + 2)) // ({n} + 2 * {v}))::BIGINT"
#: floor((p - q)^2 / (p + q)); shares are 10^9 + 1 at most, so that squares fit 64 bits.
_DIVERGENCE = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

_SUMMED = """
WITH counts AS (
  SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM rows GROUP BY ALL
)
SELECT lang, term, source, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS first
FROM counts WINDOW w AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER w >= {least}
"""

_PAIRS = f"""
WITH terms AS (
  SELECT lang, term, row_number() OVER () AS t FROM (SELECT DISTINCT lang, term FROM counts)
), numbered AS (
  SELECT t, source, n FROM counts JOIN terms USING (lang, term)
), shares AS (
  SELECT x.t, g.side, g.number, {_SHARE.format(count="coalesce(c.n, 0)", n="g.n", v="g.v")} AS p
  FROM terms x JOIN groups g USING (lang) LEFT JOIN numbered c ON c.t = x.t AND c.source = g.source
)
SELECT a.number AS a, b.number AS b, sum({_DIVERGENCE.format(p="a.p", q="b.p")})::BIGINT AS value
FROM shares a JOIN shares b ON a.t = b.t AND a.side = 0 AND b.side = 1 AND a.number < b.number GROUP BY ALL
"""

_TERMS = f"""
WITH whole AS (
  SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY ALL
), shares AS (
  SELECT c.lang, c.source, c.term, {_SHARE.format(count="c.n", n="c.n_group", v="c.v")} AS p, {_SHARE.format(count="w.n", n="c.n_lang", v="c.v")} AS q
  FROM counts c JOIN whole w USING (lang, term) WHERE c.n > 0
)
SELECT lang, source, term AS item, {_DIVERGENCE.format(p="p", q="q")} AS value
FROM shares WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {{ranks}}
"""


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in order: runs of letters, of which all characters beyond ASCII are; only A-Z lower-cased."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def counted(docs: DataFrame, most: int = MOST_COUNTED) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, in parts, as ``docs`` (text, lang, source) are read."""
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def parts(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, held) in groups.items():
            words = list(n)
            for at in range(0, len(words), 1 << 16):
                some = words[at : at + (1 << 16)]
                columns = [[lang] * len(some), [source] * len(some), [w.decode() for w in some], [n[w] for w in some], [held[w] for w in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        size = 0
        for batch in batches:
            for some in slices(batch):
                for text, lang, source in zip(*(c.to_pylist() for c in some.columns)):
                    n, held = groups.setdefault((lang, source), (Counter(), Counter()))
                    words, before = Counter(terms_of(text)), len(n)
                    n.update(words)
                    held.update(words.keys())
                    size += len(n) - before
                    if size >= most:
                        yield from parts(groups)
                        groups, size = {}, 0
        yield from parts(groups)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _by_shard(rows: DataFrame, name: str, sql: str, schema: str, also: dict[str, pa.Table] | None = None) -> DataFrame:
    """The SQL over each hash shard of ``rows`` by language and term, which it calls ``name``; ``also`` are small tables for all shards."""
    shared = rows.sparkSession.sparkContext.broadcast(also or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tempfile

        import duckdb

        first = next(batches, None)
        if first is None:
            return
        with tempfile.TemporaryDirectory() as folder, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": folder}) as con:
            for other, small in shared.value.items():
                con.register(other, small)
            whole = pa.RecordBatchReader.from_batches(first.schema, (b for some in ([first], batches) for b in some))
            con.register("arrived", whole)
            con.execute(f"CREATE TEMP TABLE {name} AS SELECT * FROM arrived")  # what arrives is read once; the table can go to disk
            yield from con.sql(sql).to_arrow_reader(1 << 16)

    return rows.repartition("lang", "term").mapInArrow(run, schema)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST_COUNTED) -> DataFrame:
    """(lang, term, source, n, first): occurrences by source of the terms that ``least_docs`` documents of the language hold; ``first`` marks one row of a term."""
    return _by_shard(counted(docs, most), "rows", _SUMMED.format(least=int(least_docs)), "lang string, term string, source string, n long, first boolean")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, n_lang): of every group that occurs, its kept terms' occurrences, its language's kept terms and their occurrences."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    whole = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("n_lang"))
    occurring = docs.select("lang", "source").distinct()
    out = occurring.join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return out.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "v", "n_lang")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS, groups_a_block: int = GROUPS_A_BLOCK, most: int = MOST_COUNTED) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Part ``pair``: how far each other source of the language is from this one
    over all kept terms, all ranks. Part ``term``: the terms that the source has
    more of than its language, up to rank ``ranks``. Null texts, languages and
    sources count as empty ones; an empty table gives an empty result; repeated
    rows count each; texts are taken whole, whatever their length; ties rank by
    the item's bytes. A group without kept terms has pairs and no terms, all of
    value 0 in a language without kept terms. Other columns don't matter,
    whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = written(kept_terms(docs, least_docs, most), "kept")
    groups = group_totals(docs, kept)
    # numbered within languages, which go one after another: a block is a range of numbers
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"))
    starts = sizes.withColumn("start", F.sum("groups").over(Window.orderBy("lang")) - F.col("groups")).drop("groups")  # a row for each language
    within = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = written(groups.join(starts, "lang").withColumn("number", F.col("start") + within - 1).drop("start"), "groups")
    return _pairs(spark, kept, groups, groups_a_block).unionByName(_terms(kept, groups, ranks))


def _pairs(spark: SparkSession, kept: DataFrame, groups: DataFrame, a_block: int) -> DataFrame:
    blocks = [(r["block"], r["low"], r["high"]) for r in groups.groupBy(F.floor(F.col("number") / a_block).alias("block")).agg(F.min("lang").alias("low"), F.max("lang").alias("high")).orderBy("block").collect()]
    sides = groups.select("lang", "source", "number", "n", "v")

    def block(b: int, side: int) -> pa.Table:
        return sides.where(F.col("number").between(b * a_block, (b + 1) * a_block - 1)).withColumn("side", F.lit(side)).toArrow()  # ``a_block`` rows at most

    found = []
    for i, (a, _, last) in enumerate(blocks):
        for b, low, _ in blocks[i:]:
            if low <= last:  # else they share no language
                small = pa.concat_tables([block(a, 0), block(b, 1)])
                found.append(_by_shard(kept.drop("first"), "counts", _PAIRS, "a long, b long, value long", {"groups": small}))
    names = groups.select("lang", "source", "number")
    # every pair occurs, also without any kept term
    pairs = names.toDF("lang", "source", "a").join(names.toDF("lang", "item", "b"), "lang").where("a <> b")
    if not found:
        sums = spark.createDataFrame([], "a long, b long, value long")
    else:
        sums = reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.sum("value").alias("value"))
    sums = written(sums, "pairs")
    both = sums.unionByName(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    valued = pairs.join(both, ["a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    return _ranked(valued, "pair")


def _terms(kept: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    counts = kept.join(groups.select("lang", "source", F.col("n").alias("n_group"), "n_lang", "v"), ["lang", "source"]).drop("first")
    best = _by_shard(counts, "counts", _TERMS.format(ranks=int(ranks)), "lang string, source string, item string, value long")
    return _ranked(best, "term").where(F.col("rank") <= ranks)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL over whole tables with the rows of the registered query.
ORACLE = f"""
WITH texts AS (
  SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc FROM documents
), occurring AS (
  SELECT DISTINCT lang, source FROM texts
), words AS MATERIALIZED (
  SELECT lang, source, doc, unnest({_WORDS}) AS term FROM texts
), kept AS (
  SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST_DOCS}
), counts AS MATERIALIZED (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), langs AS (
  SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = o.lang) AS v, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = o.lang), 0) AS n FROM (SELECT DISTINCT lang FROM occurring) o
), totals AS (
  SELECT o.lang, o.source, l.v, coalesce(sum(c.n), 0) AS n FROM occurring o JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = o.lang AND c.source = o.source GROUP BY ALL
), cells AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS count, {_SHARE.format(count="coalesce(c.n, 0)", n="t.n", v="t.v")} AS p
  FROM totals t JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), of_lang AS (
  SELECT c.lang, c.term, {_SHARE.format(count="sum(c.n)", n="any_value(l.n)", v="any_value(l.v)")} AS q FROM counts c JOIN langs l USING (lang) GROUP BY c.lang, c.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum({_DIVERGENCE.format(p="a.p", q="b.p")}) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, {_DIVERGENCE.format(p="p", q="q")} AS value FROM cells JOIN of_lang USING (lang, term) WHERE count > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""

