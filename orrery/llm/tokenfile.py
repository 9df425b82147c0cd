"""Token-ID output in a binary format with a shared zstandard dictionary (operator 9).

A dictionary is trained on serialized id arrays. Documents are encoded where
they stand and compressed one by one with that dictionary; only the compressed
ids are shuffled, to be sorted by document id across partitions. Many compressed documents make a block: a header with the dictionary's hash, an
index of ids, lengths and offsets, then the frames, so that a short document is
read by decompressing its own frame only. Blocks are rows of a Parquet table,
which Spark commits as a whole: an executor lost while writing leaves nothing
half-written. A second small table holds the dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.bpe import ready
from orrery.llm.common import map_batches, written

MAGIC = b"OTK1"
#: Documents that the dictionary is trained on, chosen by a hash of their ids, and the bytes used of each, in pieces from all over it.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_PIECES = 400, 1 << 15, 8
DICTIONARY_BYTES = 1 << 15
#: Compressed bytes after which a block is closed.
BLOCK_BYTES = 1 << 20
LEVEL = 1

BLOCKS = "part int, block int, first_doc long, last_doc long, n_docs long, n_tokens long, start_in_part long, data binary"


def _dictionary(samples: list[bytes]) -> bytes:
    """Trained where there is enough to train on, else the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[-DICTIONARY_BYTES:]


def train(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The dictionary, from a bounded sample of documents; the same rows give the same dictionary."""
    chosen = [r[0] for r in docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return _dictionary([])

    def rows(columns):
        encoder, _ = ready(path)
        width = _width(encoder)
        for doc, text in zip(*columns):
            yield doc, _pieces(_ids(encoder, text, end_id).astype(width))

    sample = map_batches(docs.where(F.col(id_col).isin(chosen)).select(id_col, text_col), rows, "doc_id long, ids binary", most=64, keeps="bpe")
    once = sample.groupBy("doc_id").agg(F.min("ids").alias("ids"))  # however many rows have the id
    return _dictionary([bytes(r[1]) for r in sorted(once.collect())])


def _pieces(ids: np.ndarray) -> bytes:
    """The whole array if it is short, else pieces at even distances."""
    most = SAMPLE_BYTES // ids.itemsize
    if len(ids) <= most:
        return ids.tobytes()
    size = most // SAMPLE_PIECES
    return b"".join(ids[at : at + size].tobytes() for at in np.linspace(0, len(ids) - size, SAMPLE_PIECES).astype(int).tolist())


def _ids(encoder, text: str | None, end_id: int) -> np.ndarray:
    return np.frombuffer(b"".join(encoder.encode(text)) + end_id.to_bytes(4, "little"), "<u4")


def _width(encoder) -> str:
    return "<u2" if max(encoder.vocab.values()) < 1 << 16 and max(encoder.special.values(), default=0) < 1 << 16 else "<u4"


def pack(docs: list[tuple[int | None, int, bytes]], dictionary_hash: bytes, width: int) -> bytes:
    """A block of (doc_id, number of ids, frame)."""
    n = len(docs)
    return b"".join([
        MAGIC, dictionary_hash, struct.pack("<BI", width, n),
        np.array([d[0] is None for d in docs], "u1").tobytes(),
        np.array([d[0] or 0 for d in docs], "<i8").tobytes(),
        np.array([d[1] for d in docs], "<u8").tobytes(),
        np.cumsum([0, *(len(d[2]) for d in docs)]).astype("<u8").tobytes(),
        *(d[2] for d in docs),
    ])


class Block:
    """Reads a block; ``ids(i)`` decompresses only the document asked for."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        assert data[:4] == MAGIC, "not a block"
        if data[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.width, n = struct.unpack_from("<BI", data, 36)
        at = 41
        null = np.frombuffer(data, "u1", n, at)
        docs = np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [None if x else int(d) for x, d in zip(null, docs)]
        self.n_tokens = np.frombuffer(data, "<u8", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 17 * n).astype(np.int64) + at + 25 * n + 8
        self.data = data
        self.unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, i: int) -> np.ndarray:
        b = self.unzip.decompress(self.data[self.offsets[i] : self.offsets[i + 1]])
        return np.frombuffer(b, f"<u{self.width}").astype("<u4")


def write(docs: DataFrame, path: str, to: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as token files under ``to``, in ascending order of id, an end id after each.

    A null or empty text gives the end id only; null ids come first; rows with
    the same id follow each other, by a hash of their ids, so that a range of
    ids can be cut between them; other columns are left out. An empty table
    gives files without documents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dictionary = train(docs, path, end_id, "doc_id", "text")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{to}/dictionary")
    digest = hashlib.sha256(dictionary).digest()

    def encode(columns):
        import zstandard

        encoder, _ = ready(path)
        width = _width(encoder)
        zipper = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for doc, text in zip(*columns):
            ids = _ids(encoder, text, end_id).astype(width)
            data = ids.tobytes()
            yield doc, int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True), len(ids), zipper.compress(data)

    state: dict = {}

    def pack_rows(columns):
        part = TaskContext.get().partitionId()
        if state.get("part") != part:
            state.update(part=part, block=0, start=0)
        width = int(_width(ready(path)[0])[-1])
        held, size = [], 0
        for doc, n, frame in zip(*columns):
            held.append((doc, n, frame))
            size += len(frame)
            if size >= BLOCK_BYTES:
                yield _row(held, state, digest, width)
                held, size = [], 0
        if held:
            yield _row(held, state, digest, width)

    frames = written(map_batches(docs, encode, "doc_id long, tie long, n_tokens long, frame binary", most=256, keeps="bpe"))  # as the ranges' bounds are sampled first
    ordered = frames.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n_tokens", "frame")
    map_batches(ordered, pack_rows, BLOCKS, most=4, keeps="bpe").write.parquet(f"{to}/blocks")


def _row(held: list, state: dict, digest: bytes, width: int) -> tuple:
    n, known = sum(d[1] for d in held), [d[0] for d in held if d[0] is not None] or [None]
    out = (state["part"], state["block"], known[0], known[-1], len(held), n, state["start"], pack(held, digest, width))
    state["block"] += 1
    state["start"] += n
    return out


def _dictionary_of(spark: SparkSession, at: str) -> bytes:
    return bytes(spark.read.parquet(f"{at}/dictionary").first()[0])


def located(spark: SparkSession, at: str) -> DataFrame:
    """The blocks with ``start``, the ids before each; the running total is over one row a partition.

    Files of an empty table have no blocks.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{at}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return blocks.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def read_all(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decompressed ids.

    A row for each row that was written, repeated ones too; of a null or empty
    text the end id alone; a null id stays null and comes before all others.
    Files of an empty table give an empty result.
    """
    dictionary = _dictionary_of(spark, at)

    def rows(columns):
        for start, data in zip(*columns):
            block = Block(data, dictionary)
            for i, (doc, n) in enumerate(zip(block.doc_ids, block.n_tokens.tolist())):
                ids = block.ids(i)
                if len(ids) != n:
                    raise ValueError(f"document {doc} has {len(ids)} ids, its index says {n}")
                yield doc, start, n, zlib.crc32(ids.tobytes())
                start += n

    return map_batches(located(spark, at).select("start", "data"), rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, at: str, doc_id: int) -> Iterator[list[int]]:
    """The ids of the documents with this id: only blocks that can hold it are read, and only its frames decompressed."""
    dictionary = _dictionary_of(spark, at)
    blocks = spark.read.schema(BLOCKS).parquet(f"{at}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    for row in blocks.orderBy("part", "block").select("data").toLocalIterator():
        block = Block(bytes(row[0]), dictionary)
        yield from (block.ids(i).tolist() for i, d in enumerate(block.doc_ids) if d == doc_id)
