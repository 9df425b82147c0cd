"""Line dedup with two Bloom filters, for lines seen once and seen twice (operator 8).

First pass: each task keeps a filter of line hashes seen and one of hashes seen
again; the tasks' filters are merged segment by segment, where what two tasks
saw once each counts as seen twice. A key that two documents hold is always in
the merged second filter, whose size is fixed and which is broadcast. Second
pass: only lines found in it are shuffled, by the whole key, to be counted
exactly. Third pass: documents lose the lines that others keep. The keys in
question are sent to all tasks if they are few, so that no text moves; if they
are many, the texts that hold suspects, and no others, are joined with what they
lose.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from orrery.llm.common import forget, map_batches, released, slices, written

STRIP = " \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits of a filter: so many for each line that the texts can hold, between these powers of two.
BITS_A_LINE, LEAST_BITS, MOST_BITS = 4, 16, 28
HASHES = 3
#: Bytes of a segment; task filters merged in the first of two rounds.
SEGMENT, FIRST_ROUND = 1 << 19, 64
#: Repeated keys that are sent to all tasks; more are joined.
MOST_KEYS = 1 << 18
#: Holders of one key that one task joins; the tasks that they are spread over, at least and at most.
SALT_ROWS, LEAST_SALTS, MOST_SALTS = 1 << 17, 16, 1024


def key_of(line: str, least: int = LEAST_CHARS) -> bytes | None:
    """The line stripped and with A-Z lower-cased, in UTF-8; None if it is too short."""
    k = line.strip(STRIP)
    return k.encode().lower() if len(k) >= least else None


def keys_of(text: str | None, least: int = LEAST_CHARS) -> set[bytes]:
    return {k for line in (text or "").split("\n") if len(line) >= least and (k := key_of(line, least))}


class Filters:
    """The once-seen and the twice-seen filter of one task."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, "u1"), np.zeros(bits // 8, "u1")

    def add(self, hashes: np.ndarray) -> None:
        """Hashes, each as often as documents hold it."""
        fresh, n = np.unique(hashes, return_counts=True)
        again = fresh[(n > 1) | holds(self.once, fresh)]
        _put(self.once, fresh)
        _put(self.twice, again)


def _places(size: int, hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(size * 8 - 1) for i in range(HASHES)])


def holds(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(len(filter_), hashes)
    return ((filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype("u1")) & 1).all(axis=0)


def _put(filter_: np.ndarray, hashes: np.ndarray) -> None:
    at = np.unique(_places(len(filter_), hashes))
    if len(at):
        byte, bit = at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype("u1"), dtype="u1")
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        filter_[byte[first]] |= np.bitwise_or.reduceat(bit, first)


def _hashes(keys: set[bytes]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(k) for k in keys]


def bits_for(docs: DataFrame, text_col: str, least: int, most_bits: int = MOST_BITS) -> int:
    """A power of two from the most lines of ``least`` characters that all texts can hold, 2^``most_bits`` at most."""
    chars = docs.agg(F.sum(F.length(text_col) + 1)).first()[0] or 0
    return 1 << min(most_bits, max(LEAST_BITS, (BITS_A_LINE * chars // (least + 1)).bit_length()))


def seen_twice(docs: DataFrame, text_col: str, bits: int, least: int) -> np.ndarray:
    """The merged filter of keys that two documents or more hold; no more than ``bits`` bits reach the driver."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget()
        zip_ = zstandard.ZstdCompressor(level=1).compress
        filters = Filters(bits)
        for batch in batches:
            for some in slices(batch):
                filters.add(np.array([h for t in some.column(0).to_pylist() for h in _hashes(keys_of(t, least))], np.uint64))
        part = TaskContext.get().partitionId() // FIRST_ROUND
        for s in range(0, bits // 8, SEGMENT):
            pair = [x[s : s + SEGMENT] for x in (filters.once, filters.twice)]
            if pair[0].any():
                yield pa.record_batch([pa.array([s // SEGMENT], pa.int32()), pa.array([part], pa.int32()), *(pa.array([zip_(x.tobytes())], pa.binary()) for x in pair)], names=["segment", "part", "once", "twice"])
        del filters
        released()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_, unzip = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        key, once, twice = None, None, None

        def out():
            return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([0], pa.int32()), *(pa.array([zip_(x.tobytes())], pa.binary()) for x in (once, twice))], names=["segment", "part", "once", "twice"])

        for batch in batches:
            for segment, part, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(unzip(a), "u1"), np.frombuffer(unzip(b), "u1")
                if (segment, part) != key:
                    if key is not None:
                        yield out()
                    key, once, twice = (segment, part), a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if key is not None:
            yield out()

    schema = "segment int, part int, once binary, twice binary"
    pieces = docs.select(text_col).mapInArrow(build, schema)
    for _ in range(2):  # tasks by dozens, then all of a segment, each row being merged as it comes
        pieces = pieces.repartition("segment", "part").sortWithinPartitions("segment", "part").mapInArrow(merge, schema)
    import zstandard

    filter_ = np.zeros(bits // 8, "u1")
    for row in pieces.select("segment", "twice").collect():
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row[1])), "u1")
        filter_[row[0] * SEGMENT : row[0] * SEGMENT + len(part)] = part
    return filter_


def suspected(docs: DataFrame, filter_, least: int) -> DataFrame:
    """(doc_id, key) of the lines whose hash was seen twice; ``docs`` has an id and a text."""

    def rows(columns):
        found = []
        for doc, text in zip(*columns):
            found += [(doc, k) for k in keys_of(text, least)]
        if found:
            hit = holds(filter_.value, np.array(_hashes([k for _, k in found]), np.uint64))
            for i in np.flatnonzero(hit):
                yield found[i][0], found[i][1].decode()

    return written(map_batches(docs, rows, "doc_id long, key string"))


def lost_by_join(suspects: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, drop array of keys): the keys that each document loses."""
    most = kept.agg(F.max("n")).first()[0] or 0
    salts = min(MOST_SALTS, max(LEAST_SALTS, -(-most // SALT_ROWS)))
    # a key that a third of all documents hold meets its row in many tasks
    spread = kept.select("key", "keep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    lost = salted.join(spread, ["key", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))


def _digest(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _sent(kept: DataFrame, most: int) -> dict[bytes, int | None] | None:
    """Digests of the keys and who keeps them, or None if there are more than ``most``."""
    if kept.limit(most + 1).count() > most:
        return None

    def rows(columns):
        return ((_digest(key.encode()), keep) for key, keep in zip(*columns))

    return {bytes(r[0]): r[1] for r in map_batches(kept.select("key", "keep"), rows, "digest binary, keep long").collect()}


#: What comes of a batch and, for each of its rows, the lines, the lines lost, and the text left.
Emit = Callable[[pa.RecordBatch, list[tuple[int, int, str]]], pa.RecordBatch]


def _rewritten(docs: DataFrame, id_col: str, text_col: str, emit: Emit, schema, least_chars: int, least_docs: int, most_bits: int, most_keys: int) -> DataFrame:
    texts = docs.select(id_col, text_col)
    filter_ = docs.sparkSession.sparkContext.broadcast(seen_twice(texts, text_col, bits_for(texts, text_col, least_chars, most_bits), least_chars))
    suspects = suspected(texts, filter_, least_chars)
    kept = written(suspects.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= least_docs))
    names = docs.columns
    id_at, text_at = names.index(id_col), names.index(text_col)
    if (known := _sent(kept, most_keys)) is not None:
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keeper = shared.value.get
            for batch in batches:
                for some in slices(batch):
                    rows = zip(some.column(id_at).to_pylist(), some.column(text_at).to_pylist())
                    yield emit(some, [_kept(text, lambda key, doc=doc: keeper(_digest(key), doc) != doc, least_chars) for doc, text in rows])
            released()

        return docs.mapInArrow(run, schema)
    mark, drop = f"__{uuid.uuid4().hex}", f"__{uuid.uuid4().hex}"

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [keys_of(t, least_chars) for t in batch.column(text_at).to_pylist()]
            hit = iter(holds(filter_.value, np.array([h for keys in held for h in _hashes(keys)], np.uint64)).tolist())
            yield batch.append_column(mark, pa.array([any([next(hit) for _ in keys]) for keys in held], pa.bool_()))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                rows = zip(some.column(text_at).to_pylist(), some.column(-1).to_pylist())
                yield emit(some.select(names), [_kept(text, {k.encode() for k in gone or ()}.__contains__, least_chars) for text, gone in rows])

    flagged = docs.mapInArrow(flag, StructType([*docs.schema.fields, StructField(mark, BooleanType())]))
    drops = written(lost_by_join(suspects, kept)).toDF(f"{drop}id", drop)
    joined = flagged.where(mark).join(drops, F.col(id_col).eqNullSafe(F.col(f"{drop}id")), "left").select(*names, drop)
    return joined.union(flagged.where(~F.col(mark)).select(*names, F.lit(None).cast("array<string>"))).mapInArrow(run_joined, schema)


def _kept(text: str | None, lost: Callable[[bytes], bool], least: int) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    kept = [x for x in lines if len(x) < least or (k := key_of(x, least)) is None or not lost(k)]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS, most_keys: int = MOST_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) for each row.

    A null or empty text is one empty line; repeated rows count as documents of
    their own but share an id, so all of them keep what the largest id keeps; a
    null id is smaller than any other. An empty table gives an empty one; other
    columns are left out, whatever their names. ``most_bits`` bounds the
    broadcast filter: what is too full for it makes suspects, never losses.
    """
    names, types = ["doc_id", "n_lines", "n_dropped", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def emit(batch: pa.RecordBatch, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        columns = [batch.column(0).to_pylist(), [f[0] for f in found], [f[1] for f in found], [hashlib.sha256(f[2].encode()).hexdigest() for f in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _rewritten(docs.select(id_col, text_col), id_col, text_col, emit, "doc_id long, n_lines long, n_dropped long, kept_sha256 string", least_chars, least_docs, most_bits, most_keys)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS, most_keys: int = MOST_KEYS) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``; a text that loses none stays as it was, null too.

    Which lines go is as in ``digests``; the other columns pass through, whatever
    their names, and an empty table stays empty.
    """
    place = docs.columns.index(text_col)

    def emit(batch: pa.RecordBatch, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
        texts = [kept if lost else text for text, (_, lost, kept) in zip(batch.column(place).to_pylist(), found)]
        return batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.column(place).type))

    return _rewritten(docs, id_col, text_col, emit, docs.schema, least_chars, least_docs, most_bits, most_keys)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), keyed AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM lines
), held AS (
  SELECT doc_id, unnest(list_distinct(list_filter(ks, lambda k: length(k) >= 40))) AS k FROM keyed
), often AS (
  SELECT k, max(doc_id) AS keep FROM held GROUP BY k HAVING count(*) >= 5
), lost AS (
  SELECT held.doc_id, list(held.k) AS gone FROM held JOIN often ON held.k = often.k WHERE held.doc_id <> often.keep GROUP BY held.doc_id
), kept AS (
  SELECT keyed.doc_id, ls, CASE WHEN gone IS NULL THEN ls ELSE
    list_transform(list_filter(list_zip(ls, ks), lambda p: NOT list_contains(gone, p[2])), lambda p: p[1]) END AS stay
  FROM keyed LEFT JOIN lost ON keyed.doc_id = lost.doc_id
)
SELECT doc_id, len(ls) AS n_lines, len(ls) - len(stay) AS n_dropped, sha256(array_to_string(stay, chr(10))) AS kept_sha256 FROM kept
"""
