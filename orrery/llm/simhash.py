"""Near-duplicates by SimHash with covering locality-sensitive hashing (operator 3).

Texts get 64-bit fingerprints. For radius r every bit position carries a
nonzero vector of r + 1 bits, and every nonzero v of r + 1 bits gives a mask:
the positions whose vector has an odd inner product with v. Any r differing
positions span at most r dimensions, so some v is orthogonal to all of them:
its mask leaves all the differences out, and the pair meets in that v's table.
No pair within the radius is missed, and none needs a second chance.

Only distinct fingerprints are compared. A bucket with many is split into
blocks, and each pair of blocks is one piece of work; what a piece gives are the
links of a spanning forest, never all its pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import minhash
from orrery.llm.common import map_batches, without, written
from orrery.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that are compared in one piece; larger buckets are split into blocks of about so many.
BLOCK = 512
#: Shingles that are hashed at a time.
STEP = 1 << 16


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks, as unsigned integers."""
    most = 1 << (radius + 1)
    vector = [i % (most - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, most)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text; zero for one without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks are \x20 and \x09-\x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    counts, n = np.zeros(BITS, np.int64), len(words) - shingle + 1
    for at in range(0, n, STEP):
        some = words[at : at + STEP + shingle - 1]
        hashes = [digest(b" ".join(w), SEED) for w in zip(*(some[i:] for i in range(shingle)))]
        counts += np.unpackbits(np.array(hashes, ">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty."""

    def rows(columns):
        for doc, text in zip(*columns):
            yield doc, signed(fingerprint(text, shingle))

    return map_batches(docs.select(id_col, text_col), rows, "doc_id long, fp long")


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (larger, smaller) that connect exactly what links at ``radius`` or fewer bits connect in ``fps``."""
    if len(fps) < 2:
        return []
    x = fps.view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    left, out = np.ones(len(x), bool), []
    while left.any():
        reached = np.zeros(len(x), bool)
        front = np.flatnonzero(left)[:1]
        reached[front] = True
        while len(front):
            grown = near[front].any(axis=0) & ~reached
            front = np.flatnonzero(grown)
            reached |= grown
        left &= ~reached
        members = fps[reached]
        low = members.min()
        out += [(int(m), int(low)) for m in members if m != low]
    return out


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) between distinct fingerprints ``fp``, connecting what links within ``radius`` bits connect."""
    tables = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks(radius))))
    rows = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["t", "key"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    own = F.pmod(F.xxhash64("fp", "t"), F.col("blocks")).cast("int")
    # a row of block i goes to the pieces (i, j) and (j, i) of its bucket, one for each other block j
    pieces = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    )
    dealt = rows.select("t", "key", "fp", F.explode(pieces).alias("p")).select("t", "key", "p.i", "p.j", "fp")
    key = ["t", "key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            cols = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            edges = np.flatnonzero((cols[1:, :4] != cols[:-1, :4]).any(axis=1)) + 1
            out: list[tuple[int, int]] = []
            for part in np.split(cols, edges):
                mark = part[0, :4].tolist()
                if mark != last:
                    out += _piece(held, radius)
                    held, last = [], mark
                held.append(part[:, 4])
            yield _pairs(out)
        yield _pairs(_piece(held, radius))

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def _piece(held: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    fps = np.concatenate(held) if len(held) > 1 else held[0] if held else np.zeros(0, np.int64)
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(max(a, b), min(a, b))] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius else []
    return forest(fps, radius)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links within ``radius`` bits.

    One row for each row of ``docs``, repeated ones too. Null, empty and blank
    texts have fingerprint zero and link like any other. A null doc_id never is
    a component's id, unless all of its members' ids are null. An empty table
    gives an empty one. Other columns are left out, whatever their names.
    """
    return _components(written(fingerprints(docs, id_col, text_col, shingle)), radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """``marked`` (doc_id, fp and others) with ``root`` and ``component_id``, both null for a fingerprint of one row without links.

    Where ids repeat, two components can have one ``component_id``; their roots tell them apart.
    """
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(fps, radius))
    # fingerprints of one document without links need no look-up below
    shared = fps.join(roots, fps["fp"] == roots["node"], "left").where("n > 1 or root is not null").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    shared = written(shared)
    least = shared.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(shared.join(least, "root").select("fp", "root", "component_id"), "fp", "left")


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, similar: tuple[int, int] | None = None
) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, and of several with this id the one with the smallest text hash.

    With ``similar`` (words, percent) texts whose sets of shingles of so many
    words are so similar are linked too, however far their fingerprints are
    apart: a few edited words move more bits than a radius can cover.

    Rows are told apart by id and hash of the text, so that none goes for
    another one's sake; of repeated rows one stays. Rows with a null id stay.
    All columns are as they were, whatever their names.
    """
    name = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keys = [F.col(id_col).cast("long"), name]

    def rows(columns):
        for doc, text, hash_ in zip(*columns):
            yield doc, signed(fingerprint(text, shingle)), hash_

    def members(found: DataFrame) -> DataFrame:
        return found.groupBy("root", "doc_id", "name").agg(F.count("*").alias("n"))

    marked = written(map_batches(docs.select(keys[0], text_col, name), rows, "doc_id long, fp long, name long"))
    linked = members(_components(marked, radius).where("root is not null"))
    if similar:
        alike = members(minhash.grouped(docs, id_col, text_col, *similar).withColumnRenamed("place", "name"))
        linked = _joined(written(linked), written(alike))
    linked = written(linked.where("doc_id is not null"))
    kept = linked.groupBy("root").agg(F.min(F.struct("doc_id", "name")).alias("kept"))
    gone = linked.join(kept, "root").where("doc_id <> kept.doc_id or name <> kept.name").select("doc_id", "name")
    left = without(docs, written(gone), keys)
    again = written(linked.where("n > 1").select("doc_id", "name"))
    if again.isEmpty():
        return left
    mark = f"__{uuid.uuid4().hex}"
    once = without(left, again, keys, inside=True).withColumn(mark, name).dropDuplicates([id_col, mark]).drop(mark)
    return without(left, again, keys).unionByName(once)


def _joined(*groups: DataFrame) -> DataFrame:
    """(root, doc_id, name, n) of tables with such rows: groups that share a text, known by its hash, are one."""
    stars = []
    for rows in groups:
        least = rows.groupBy("root").agg(F.min("name").alias("least"))
        stars.append(rows.select("root", "name").distinct().join(least, "root").select(F.col("name").alias("a"), F.col("least").alias("b")))
    roots = components(reduce(DataFrame.unionByName, stars))
    rows = reduce(DataFrame.unionByName, groups).groupBy("doc_id", "name").agg(F.max("n").alias("n"))  # a group has all rows of a text
    return rows.join(roots, rows["name"] == roots["node"], "left").select(F.coalesce("root", "name").alias("root"), "doc_id", "name", "n")
