"""Ranked lexical search over sharded, compressed postings (operator 11).

``build`` makes an index where the texts stand: each task cuts what it reads
into shards of bounded tokens, sorts a shard's documents by id, and writes for
each term of the shard its postings, as differences of places and counts in
variable-length bytes. ``search`` reads only the postings of the queries' terms,
brings those of a shard together, and walks them document at a time: a heap of
the lists' next places is merged k ways, and each query keeps a heap of its best
documents by score, then id. Lists that together can't lift a document over the
worst that is kept are left out of the merge and looked up only for documents
that can still enter (MaxScore), which changes no result.

All scores are 64-bit integers, so that they don't depend on the shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.common import MOST_SENT, slices

#: Tokens of a shard, at least, but for a task's last one; a document is never split.
SHARD_TOKENS = 1 << 20
#: Pairs of query and term that are sent to all tasks at once; more queries take another pass over their postings.
BLOCK_PAIRS = 1 << 20
RESULTS = 10
#: Bytes of terms as they are, with A-Z lower-cased, and blanks for all others.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The text's terms in order: runs of letters and digits, of which all characters beyond ASCII are; only A-Z lower-cased."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned numbers in groups of seven bits, the lowest first, all but a number's last with the high bit; and each number's bytes."""
    v = values.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for k in range(1, 10):
        sizes += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(sizes.max(initial=0))):
        has = sizes > k
        byte = (v[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - sizes)[has] + k] = byte.astype(np.uint8) | np.where(sizes[has] > k + 1, 128, 0).astype(np.uint8)
    return out, sizes


def numbers(blob: bytes) -> np.ndarray:
    """What ``varints`` has encoded."""
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.r_[0, ends[:-1] + 1]
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (shift * 7).astype(np.uint64), starts).astype(np.int64)


class _Shard:
    """Documents and terms of a shard while it is filled."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, words: list[bytes]) -> None:
        known = self.known
        self.ids.append(doc)
        self.tokens.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        self.size += len(words)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """A row without a term for the documents, then one for each term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        lengths = np.array([len(self.tokens[i]) for i in order], np.int64)
        pairs = np.concatenate([self.tokens[i] for i in order]) * len(order) + np.repeat(np.arange(len(order)), lengths)
        pairs, tf = np.unique(pairs, return_counts=True)
        term, doc = pairs // len(order), pairs % len(order)
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        gaps = np.r_[doc[:1], np.diff(doc)]
        gaps[first] = doc[first]
        blob, sizes = varints(np.stack([gaps, tf], axis=1).ravel())
        df = np.diff(np.r_[first, len(term)])
        bounds = np.r_[0, np.cumsum(sizes)][np.r_[2 * first, 2 * len(term)]]
        head, _ = varints(lengths)
        names = list(self.known)
        yield _index_batch([shard], [None], [[self.ids[i] for i in order]], [int((lengths > 0).sum())], [int(lengths.sum())], [head.tobytes()])
        for at in range(0, len(names), 1 << 16):
            to = min(at + (1 << 16), len(names))
            parts = [blob[a:b].tobytes() for a, b in zip(bounds[at:to], bounds[at + 1 : to + 1])]
            yield _index_batch([shard] * (to - at), [n.decode() for n in names[at:to]], [None] * (to - at), df[at:to], [0] * (to - at), parts)


INDEX = "shard long, term string, ids array<long>, n_docs long, n_tokens long, postings binary"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("postings", pa.binary())])


def _index_batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The index as rows: of each shard one without a term, with its documents' ids and lengths, and one for each term.

    Each row of ``docs`` is a document of its own, repeated ids and rows too; a
    null text has no terms, and a null id stands before all others. An empty
    table gives an empty index. Texts of any length are one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch):
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    shard.add(doc, terms_of(text))
                    if shard.size >= shard_tokens:
                        yield from shard.rows(number)
                        shard, number = _Shard(), number + 1
        if shard.ids:
            yield from shard.rows(number)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, INDEX)


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the index of ``docs`` to a new folder that all executors can read."""
    index(docs, id_col, text_col, shard_tokens).write.parquet(path)


def weight(n: int, df: int) -> int:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = RESULTS, item_col: str = "item_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of ``queries`` the ``k`` documents of the index at ``path`` with the highest scores above 0.

    Equal scores rank by ascending id, a null id first. Each row of ``queries``
    is a query of its own, also where ids repeat. Null texts and those without
    terms find nothing, nor does anything in an empty index. Queries go to all
    tasks in blocks of about ``block_pairs`` pairs of query and term; each block
    reads its own terms' postings. Other columns are left out, whatever their names.
    """
    table = spark.read.schema(INDEX).parquet(path)
    n, tokens = table.where("term IS NULL").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    kind = queries.schema[item_col].dataType.simpleString()
    found = spark.createDataFrame([], f"query long, item_id {kind}, doc_id long, score long")
    if n:
        for at, block in _blocks(queries.select(item_col, F.col(text_col).cast("string")), block_pairs):
            hits = _best(spark, table, block, n, tokens, k)
            names = spark.createDataFrame([(at + i, item) for i, (item, _) in enumerate(block)], f"query long, item_id {kind}")
            found = found.unionByName(hits.withColumn("query", F.col("query") + at).join(F.broadcast(names), "query"))  # as many rows as the block has queries
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[int, list[tuple[object, dict[str, int]]]]]:
    """(number of the first, [(item, times of each term)]), each block of about ``most`` pairs; the driver holds one at a time."""
    block, held, at = [], 0, 0
    for item, text in queries.toLocalIterator():
        times: dict[str, int] = {}
        for w in terms_of(text):
            times[w.decode()] = times.get(w.decode(), 0) + 1
        block.append((item, times))
        held += len(times)
        if held >= most:
            yield at, block
            at, block, held = at + len(block), [], 0
    if block:
        yield at, block


def _best(spark: SparkSession, table: DataFrame, block: list, n: int, tokens: int, k: int) -> DataFrame:
    """(query, doc_id, score): the ``k`` best of each task for each query of the block."""
    asked = sorted({w for _, times in block for w in times})
    words = spark.createDataFrame([(w,) for w in asked], "term string")
    words = F.broadcast(words) if len(asked) <= MOST_SENT else words
    hits = table.where("term IS NOT NULL").join(words, "term", "left_semi").select("shard", "term", "ids", "n_docs", "postings")
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.sum("n_docs").alias("df")).toLocalIterator()}  # a row for each term of the block at most
    weights = {t: w for t, x in df.items() if (w := weight(n, x)) > 0}
    items = [[(w, times) for w, times in terms.items() if w in weights] for _, terms in block]
    shared = spark.sparkContext.broadcast((weights, items))
    heads = table.where("term IS NULL").select("shard", "term", "ids", "n_docs", "postings")
    # the documents' row comes first of its shard
    dealt = hits.unionByName(heads).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = shared.value
        tops: list[list[tuple[int, int]]] = [[] for _ in items]
        at, ids, m, lists = None, [], None, {}
        for batch in batches:
            for shard, term, of, postings in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if shard != at:
                    _walk_all(items, lists, ids, tops, k)
                    at, lists = shard, {}
                if term is None:
                    ids = of
                    m = 25 + 75 * numbers(postings) * n // tokens if tokens else None
                elif term in weights:
                    pairs = numbers(postings)
                    doc, tf = np.cumsum(pairs[::2]), pairs[1::2]
                    lists[term] = _List(doc, weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc])), k)
        _walk_all(items, lists, ids, tops, k)
        rows = [(q, None if key == _FIRST else key, score) for q, top in enumerate(tops) for score, key in ((s, -x) for s, x in top)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ([], [], []))], names=["query", "doc_id", "score"])

    return dealt.mapInArrow(run, "query long, doc_id long, score long")


#: Stands for a null id: before all that there can be.
_FIRST = -(1 << 63) - 1


class _List:
    """Places of documents and what each adds to a score; the most, and the ``k``-th most, that any adds."""

    def __init__(self, doc: np.ndarray, adds: np.ndarray, k: int):
        self.doc, self.adds = doc.tolist(), adds.tolist()
        self.most = int(adds.max())
        self.kth = int(np.partition(adds, -k)[-k]) if len(adds) >= k else 0


def _walk_all(items: list, lists: dict[str, _List], ids: list, tops: list, k: int) -> None:
    if lists:
        for terms, top in zip(items, tops):
            own = [(lists[w], times) for w, times in terms if w in lists]
            if own:
                walk(own, ids, top, k)


def walk(own: list[tuple[_List, int]], ids: list, top: list[tuple[int, int]], k: int) -> None:
    """Merges the lists (each with how often the query has its term) document at a time into ``top``.

    ``top`` is a heap of (score, minus id), ``k`` at most, the worst first.
    """
    own = sorted(own, key=lambda x: x[0].most * x[1])
    docs, adds, times = [x.doc for x, _ in own], [x.adds for x, _ in own], [t for _, t in own]
    bounds = np.cumsum([x.most * t for x, t in own]).tolist()  # what a list and all before it can add together
    floor_ = max(x.kth * t for x, t in own)  # k documents reach it with one term alone
    n, left_out = len(own), 0

    def least() -> int:
        return max(floor_, top[0][0]) if len(top) == k else floor_

    while left_out < n and bounds[left_out] < least():
        left_out += 1
    at = [0] * n
    # place * n + list: one number for each list's next document
    heap = [docs[i][0] * n + i for i in range(left_out, n)]
    heapify(heap)
    while heap:
        place, score = heap[0] // n, 0
        while heap and heap[0] // n == place:
            i = heap[0] % n
            j = at[i]
            score += adds[i][j] * times[i]
            at[i] = j = j + 1
            if j < len(docs[i]):
                heapreplace(heap, docs[i][j] * n + i)
            else:
                heappop(heap)
        limit = least()
        for i in range(left_out - 1, -1, -1):
            if score + bounds[i] < limit:
                break
            j = bisect_left(docs[i], place, at[i])
            at[i] = j
            if j < len(docs[i]) and docs[i][j] == place:
                score += adds[i][j] * times[i]
        else:
            if score >= limit and score > 0:
                entry = (score, -(_FIRST if ids[place] is None else ids[place]))
                if len(top) < k:
                    heappush(top, entry)
                elif entry > top[0]:
                    heapreplace(top, entry)
                more = left_out
                while more < n and bounds[more] < least():
                    more += 1
                if more > left_out:  # these lists leave the merge
                    left_out = more
                    heap = [x for x in heap if x % n >= left_out]
                    heapify(heap)


def ranked(docs: DataFrame, queries: DataFrame, path: str, k: int = RESULTS) -> DataFrame:
    """An index of ``docs`` at ``path`` and the search in it; see ``build`` and ``search``."""
    build(docs, path)
    return search(docs.sparkSession, path, queries, k)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL with the rows of the registered query, for ids that don't repeat.
ORACLE = f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, unnest({_WORDS}) AS term FROM documents
), tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY ALL
), whole AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs
), m AS (
  SELECT doc_id, 25 + (75 * n * n_docs) // n_tokens AS m FROM lengths, whole
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {RESULTS}
"""
