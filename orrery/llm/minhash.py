"""Near-duplicates by bottom-k sketches from one hash function (operator 13).

A text's set is that of its distinct shingles, each known by a 64-bit hash; its
sketch is the ``RETAINED`` smallest hashes, and all of them of a smaller set.
Equal sets are one from the start. Sets meet in the inverted lists of their
``LISTED`` smallest hashes: of two whose similarity is J, none of these is
shared with a chance of (1 - J)^LISTED at most, 1.3e-10 at 0.85; sets of no more
than ``LISTED`` hashes are listed whole, and so can't miss each other. A set
whose smallest hashes are in many others, as those of a phrase that a corpus
repeats, is listed by rarer ones of its ``HEADS`` smallest instead (see
``listed_of``), and of lists with the same members one is enough. In a list
the overlaps of all sketches are counted at once, and a pair goes on if the
similarity estimated from the sketch of its union, the ``RETAINED`` smallest
hashes of both, can be one of a link (a link falls under it with a chance of
1e-9). What goes on from a list are the links of a spanning forest, never all
pairs; what they connect are the candidate groups.

Within candidate groups, and only there, whole sets are made again from the
texts and compared exactly. Long lists and large groups are cut into blocks.
First each block meets one of them, which ties a group of near copies with about
twice its rows; only what is apart then meets in pairs of blocks, so that no
link is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_batches, released, slices, without, written
from orrery.llm.components import components

SHINGLE = 3
#: Sets link if NUMERATOR / 100 of their union is common to both.
NUMERATOR = 85
#: Hashes of a sketch, and those of them that have inverted lists.
RETAINED, LISTED = 64, 12
#: Smallest hashes among which sets look for rarer ones than the first; frequent hashes that are known as such, at most.
HEADS, FREQUENT = 32, 1 << 16
#: The chance that a link is taken for none by its sketches.
LOST = 1e-9
#: Sets of a list or group that are one block, and bytes of whole sets of one.
BLOCK, BLOCK_BYTES = 256, 1 << 21
#: Columns of the matrices in which overlaps are counted, at a time.
COLUMNS = 1 << 13
#: Words whose hashes are remembered; bytes of texts that are worked on at once, and whole sets that are held before they go on.
KNOWN, TEXT_BYTES, SETS = 1 << 16, 1 << 23, 1 << 9
#: Pairs whose union sketches are made at a time.
PAIRS = 1 << 14


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: dict[bytes, int] | None = None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted; A-Z lower-cased, and of a text with fewer words its whole sequence.

    ``known`` remembers words' hashes from one text to the next.
    """
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks are \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    known = {} if known is None else known
    if len(known) > KNOWN:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    size = min(shingle, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
    return np.unique(out)


def name_of(hashes: np.ndarray) -> str:
    """A set's name: 128 bits in hexadecimal digits."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def least_shared(sketch: int = RETAINED, numerator: int = NUMERATOR, lost: float = LOST) -> int:
    """Of ``sketch`` hashes of a union, as many as those of a link share but for a chance of ``lost``.

    The shared ones are drawn without replacement, which falls below this less often than the binomial law says.
    """
    j, below = numerator / 100, 0.0
    for x in range(sketch + 1):
        below += math.comb(sketch, x) * j**x * (1 - j) ** (sketch - x)
        if below > lost:
            return x
    return sketch


def least_free(heads: int = HEADS, listed: int = LISTED, numerator: int = NUMERATOR) -> int:
    """Of ``heads`` hashes, as many as must not be frequent for a set to do without lists of frequent ones.

    A link is missed only if all of them are among the hashes that the two sets
    don't share, of the ``heads`` smallest of their union: a chance no larger
    than that of sharing none of ``listed`` hashes.
    """
    apart, above = 1 - numerator / 100, 0.0
    for x in range(heads, -1, -1):
        above += math.comb(heads, x) * apart**x * (1 - apart) ** (heads - x)
        if above > apart**listed:
            return x + 1
    return 0


def listed_of(n: int, first: np.ndarray, frequent: np.ndarray, listed: int = LISTED, heads: int = HEADS, numerator: int = NUMERATOR) -> np.ndarray:
    """The hashes in whose lists a set of ``n`` is, by its ``heads`` smallest ones; ``frequent`` are sorted, and may be any.

    A set without frequent ones among the ``listed`` smallest has the lists of
    these. Others have those of all their hashes that aren't frequent, and the
    smallest besides if too few are left: two of these meet by the smallest,
    one of these and any other by what isn't frequent.
    """
    rare = ~_within(first, frequent)
    if rare[:listed].all():
        return first[:listed]
    small = 100 * n <= numerator * heads and numerator * rare.sum() > (100 - numerator) * n  # a link's union is among the heads, so what isn't shared is few
    if small or rare.sum() >= least_free(heads, listed, numerator):
        return first[rare]
    rare[:listed] = True
    return first[rare]


def _within(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in a sorted array."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def sets(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, retained: int = RETAINED, heads: int = HEADS) -> DataFrame:
    """(doc_id, place, n, name, first, sketch): number and name of each row's set, its smallest hashes, and its sketch; ``place`` is a hash of the text."""

    def rows(columns):
        known: dict[bytes, int] = {}
        for doc, text, place in zip(*columns):
            s = shingle_set(text, known, shingle)
            yield doc, place, len(s), name_of(s), s[:heads].view(np.int64).tolist(), (s[:retained] >> np.uint64(32)).astype(np.uint32).tobytes()

    place = F.xxhash64(F.coalesce(text_col, F.lit("")))
    return map_batches(docs.select(F.col(id_col).cast("long"), text_col, place), rows, "doc_id long, place long, n long, name string, first array<long>, sketch binary", 1 << 12, TEXT_BYTES)


def _forest(near: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what a symmetric matrix connects, without those within a block where there are two: another piece gives these."""
    one = _trees(near & (block[:, None] == block[None, :]))
    if block.min() == block.max():
        return [(int(t), int(m)) for m, t in enumerate(one) if m != t]
    # the blocks' trees are the nodes now, and what joins two of them is a link
    tops, tree = np.unique(one, return_inverse=True)
    joined = np.zeros((len(tops), len(tops)), bool)
    a, b = np.nonzero(near & (block[:, None] != block[None, :]))
    joined[tree[a], tree[b]] = True
    return [(int(tops[t]), int(tops[m])) for m, t in enumerate(_trees(joined)) if m != t]


def _trees(near: np.ndarray) -> np.ndarray:
    """The first place that each place is connected with."""
    out = np.full(len(near), -1)
    for first in range(len(near)):
        if out[first] >= 0:
            continue
        reached, front = np.zeros(len(near), bool), np.array([first])
        reached[first] = True
        while len(front):
            grown = near[front].any(axis=0) & ~reached
            front = np.flatnonzero(grown)
            reached |= grown
        out[reached] = first
    return out


def _shared(rows: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two rows, each of distinct numbers, have in common."""
    sizes = [len(r) for r in rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, column, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(rows), min(COLUMNS, width - at)), np.float32)
        held[owner[a:b], column[a:b] - at] = 1
        out += held @ held.T
    return out.astype(np.int64)


def candidates(sizes: np.ndarray, sketches: list[np.ndarray], block: np.ndarray, retained: int = RETAINED, numerator: int = NUMERATOR, lost: float = LOST) -> list[tuple[int, int]]:
    """Links, by place, of a spanning forest of the pairs whose union sketch lets them be links; see ``_forest`` for blocks.

    Sketches hold the upper halves of hashes. Two hashes of one sketch that share theirs count as one, and are made up for.
    """
    least = np.array([least_shared(k, numerator, lost) for k in range(retained + 1)])
    length = np.array([len(s) for s in sketches])
    rows = [np.unique(s) for s in sketches]
    again = length - [len(r) for r in rows]
    common = _shared(rows) + again[:, None] + again[None, :]
    both = np.clip(length[:, None] + length[None, :] - common, 0, retained)  # hashes of the union's sketch
    whole = (sizes[:, None] <= retained) & (sizes[None, :] <= retained)  # both sketches are whole sets: no estimate
    fits = 100 * np.minimum(sizes[:, None], sizes[None, :]) >= numerator * np.maximum(sizes[:, None], sizes[None, :])
    exact = 100 * common >= numerator * (sizes[:, None] + sizes[None, :] - common)
    near = np.where(whole, exact, least[both] <= common) & fits
    # the overlap may lie beyond the union's sketch: pairs that pass so far are looked at closely
    a, b = np.nonzero(np.triu(near & ~whole & (again[:, None] + again[None, :] == 0), 1))
    if len(a):
        padded = np.arange(1 << 33, (1 << 33) + retained)[None, :].repeat(len(rows), axis=0)  # fills up with numbers larger than all others
        padded[np.arange(retained)[None, :] < length[:, None]] = np.concatenate(sketches)
        for at in range(0, len(a), PAIRS):
            i, j = a[at : at + PAIRS], b[at : at + PAIRS]
            other = np.where(padded[j] >= 1 << 33, padded[j] + retained, padded[j])  # so that fillings of two rows are never the same
            union = np.sort(np.concatenate([padded[i], other], axis=1), axis=1)
            twice = union[:, 1:] == union[:, :-1]
            rank = np.arange(1, 2 * retained)[None, :] - np.cumsum(twice, axis=1) + twice  # of the first of two equal ones, among the distinct
            far = (twice & (rank <= both[i, j][:, None])).sum(axis=1) < least[both[i, j]]
            near[i[far], j[far]] = near[j[far], i[far]] = False
    return _forest(near, block)


def linked(rows: list[np.ndarray], block: np.ndarray, numerator: int = NUMERATOR) -> list[tuple[int, int]]:
    """Links, by place, of a spanning forest of the pairs of whole sets that are links; see ``_forest`` for blocks."""
    common, sizes = _shared(rows), np.array([len(r) for r in rows])
    return _forest(100 * common >= numerator * (sizes[:, None] + sizes[None, :] - common), block)


def _against_first(members: DataFrame, key: list[str]) -> DataFrame:
    """``members`` (key, id, parts) dealt to pieces of their ``key``: each block, of which there are ``parts``, with the first one.

    The first block's rows alone are copied to all, so that about twice the rows come out, however large a group is.
    """
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = F.when((own > 0) | (F.col("parts") == 1), F.array(own)).otherwise(F.sequence(F.lit(1), F.col("parts") - 1))
    return members.select(*key, F.lit(0).alias("i"), F.explode(dealt).alias("j"), "id", F.lit(0).alias("own"))


def _still_apart(members: DataFrame, key: list[str], tied: DataFrame) -> DataFrame:
    """``members`` dealt to the pieces that can still join something, where ``tied`` (node, root) is known.

    Of a key, the rows of the root that has most of them are the bulk: no two of
    these need to meet. The others meet each other and the bulk, in pairs of
    blocks. Of a group that is tied nothing is left, and few others make few copies.
    """
    roots = members.join(tied.select(F.col("node").alias("id"), F.col("root").alias("__tied")), "id", "left").withColumn("__tied", F.coalesce("__tied", "id"))
    counts = roots.groupBy(*key, "parts", "__tied").agg(F.count("*").alias("__n"))
    bulk = counts.groupBy(*key, "parts").agg(F.max_by("__tied", F.struct("__n", "__tied")).alias("__bulk"), F.sum("__n").alias("__all"), F.max("__n").alias("__most"))
    share = lambda n: F.ceil(n * F.col("parts") / F.col("__all")).cast("int")
    bulk = bulk.where("__all > __most").select(*key, "__bulk", share(F.col("__all") - F.col("__most")).alias("__others"), share(F.col("__most")).alias("__bulks"))
    rows, place = roots.join(bulk, key), F.xxhash64("id")
    inside = F.col("__tied") == F.col("__bulk")
    own = F.when(inside, F.col("__others") + F.pmod(place, F.col("__bulks"))).otherwise(F.pmod(place, F.col("__others"))).cast("int")
    upto = F.when(inside, F.col("__others")).otherwise(F.col("__others") + F.col("__bulks"))
    dealt = F.transform(F.sequence(F.lit(0), upto - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return rows.select(*key, F.explode(dealt).alias("__p"), "id", own.alias("own")).select(*key, "__p.i", "__p.j", "id", "own")


def _links_of(members: DataFrame, key: list[str], loaded: Callable[[DataFrame], DataFrame], links: Callable[[list[list]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) that connect what ``links`` connects of all members (key, id, parts) of a key; ``loaded`` adds to dealt ids what is compared.

    First each block meets one of them; what this leaves apart meets in a second pass.
    """
    first = written(_by_piece(loaded(_against_first(members, key)), len(key), links), "first")
    large = members.where("parts > 1")
    if large.isEmpty():
        return first
    rest = written(_still_apart(large, key, components(first)), "apart")
    return first if rest.isEmpty() else first.union(_by_piece(loaded(rest), len(key), links))


def _by_piece(dealt: DataFrame, n_keys: int, links: Callable[[list[list]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): ids of what ``links`` joins, by place, of the columns of each piece."""
    keys = dealt.columns[: n_keys + 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out():
            columns = list(zip(*held))
            pairs = links(columns[1:]) if len(held) > 1 else []
            if pairs:
                yield pa.record_batch([pa.array([columns[0][p[i]] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for some in slices(batch):
                columns = [c.to_pylist() for c in some.columns]
                for mark, row in zip(zip(*columns[: n_keys + 2]), zip(*columns[n_keys + 2 :])):
                    if mark != last:
                        yield from out()
                        last, held = mark, []
                    held.append(row)
        yield from out()
        last, held = None, []
        released()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def candidate_links(distinct: DataFrame, retained: int = RETAINED, numerator: int = NUMERATOR, block: int = BLOCK, lost: float = LOST) -> DataFrame:
    """(a, b) between ids of sets (id, n, first, sketch), connecting what pairs that may be links connect.

    Lists are kept by size: a set of size class c is in the lists of c and, as a
    guest, of c + 1, as those of a link are of one class or of two that follow
    each other. Only lists in which sets meet carry sketches, and of lists with
    the same members only one.
    """
    size_class = F.floor(F.ln("n") / F.lit(1.0001 * math.log(100 / numerator))).cast("int")  # a little wider than the sizes of a link can be apart
    counts = distinct.select(F.explode("first").alias("value")).groupBy("value").agg(F.count("*").alias("sets")).where(F.col("sets") > block)
    frequent = np.sort(np.array([r[0] for r in counts.orderBy(F.desc("sets"), "value").limit(FREQUENT).collect()], np.int64))
    shared = distinct.sparkSession.sparkContext.broadcast(frequent)

    def chosen(columns):
        for id_, own, n, first in zip(*columns):
            yield id_, own, listed_of(n, np.array(first, np.int64), shared.value, numerator=numerator).tolist()

    some = map_batches(distinct.where("n > 0").select("id", size_class.alias("class"), "n", "first"), chosen, "id long, class int, listed array<long>", 1 << 12, TEXT_BYTES)
    heads = written(some, "listed").select("id", "class", F.explode("listed").alias("value"))
    common = heads.groupBy("value").agg(F.count("*").alias("sets")).where("sets > 1").select("value")
    lists = F.array(F.struct(F.col("class").alias("class"), F.lit(False).alias("guest")), F.struct((F.col("class") + 1).alias("class"), F.lit(True).alias("guest")))
    listed = written(heads.join(common, "value").select("value", "id", F.explode(lists).alias("x")).select("value", "id", "x.*"), "lists")
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}") for k in (0, 1)]  # 128 bits of a list's members
    sizes = listed.groupBy("value", "class").agg(F.count("*").alias("rows"), F.count_if(~F.col("guest")).alias("hosts"), *marks).where("rows > 1 and hosts > 0")
    sizes = written(sizes.groupBy("class", "rows", "mark0", "mark1").agg(F.min("value").alias("value")), "sizes")
    members = listed.join(sizes, ["value", "class"]).select("value", "class", "id", F.ceil(F.col("rows") / F.lit(block)).cast("int").alias("parts"))
    sketches = distinct.select("id", "n", "sketch")

    def loaded(dealt: DataFrame) -> DataFrame:
        return dealt.join(sketches, "id").select(*dealt.columns, "n", "sketch")

    def links(columns: list[list]) -> list[tuple[int, int]]:
        own, sizes, sketches = columns
        return candidates(np.array(sizes), [np.frombuffer(s, np.uint32) for s in sketches], np.array(own), retained, numerator, lost)

    return _links_of(members, ["value", "class"], loaded, links)


def exact_links(groups: DataFrame, docs: DataFrame, keys: list[Column], text_col: str, shingle: int = SHINGLE, numerator: int = NUMERATOR, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b) between ids, connecting what links between whole sets connect; ``groups`` are (id, name, root, doc_id, place, n).

    The sets are made again from the texts of one row of each name. A set takes part once, however many rows there are of it.
    """

    def rows(columns):
        known: dict[bytes, int] = {}
        for (text,) in zip(*columns):
            s = shingle_set(text, known, shingle)
            yield name_of(s), s.tobytes()

    def loaded(dealt: DataFrame) -> DataFrame:
        wanted = groups.join(dealt.select("id").distinct(), "id", "left_semi")
        texts = without(docs, written(wanted.select("doc_id", "place"), "wanted"), keys, inside=True).select(text_col)
        whole = map_batches(texts, rows, "name string, hashes binary", SETS, TEXT_BYTES).dropDuplicates(["name"])
        named = dealt.join(groups.select("id", "name"), "id")  # the small side goes to the names, where the sets are already
        return named.join(whole, "name").select(*dealt.columns, "hashes")

    blocks = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("n") * 8 / F.lit(block_bytes)))
    large = groups.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")
    members = groups.select("id", "root").join(large, "root", "left").select("root", "id", F.coalesce(F.col("blocks").cast("int"), F.lit(1)).alias("parts"))

    def links(columns: list[list]) -> list[tuple[int, int]]:
        own, hashes = columns
        return linked([np.frombuffer(h, np.uint64) for h in hashes], np.array(own), numerator)

    return _links_of(members, ["root"], loaded, links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, numerator: int = NUMERATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the smallest doc_id reachable over links of similarity ``numerator`` / 100 or more.

    One row for each row of ``docs``, repeated ones too, which link as equal
    sets do. A text without words, or a null one, has an empty set and links
    with nothing: its component is its own id. A null doc_id never is a
    component's id, unless all of its members' ids are null; where ids repeat,
    all rows with a component's id are kept. Texts of any length are
    taken whole; an empty table gives an empty one. Other columns are left out,
    whatever their names.
    """
    marked = written(sets(docs, id_col, text_col, shingle), "sets")
    roots = _roots(docs, marked, id_col, text_col, shingle, numerator)
    found = marked.select("doc_id", "n", "name").join(roots.select("name", "component_id"), "name", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, numerator: int = NUMERATOR) -> DataFrame:
    """(doc_id, place, root) of the rows that have others with an equal or linked set; ``place`` is the hash of the text, ``root`` names the group."""
    marked = written(sets(docs, id_col, text_col, shingle), "sets")
    roots = _roots(docs, marked, id_col, text_col, shingle, numerator)
    return marked.join(roots.select("name", "root"), "name").select("doc_id", "place", "root")


def _roots(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, shingle: int, numerator: int) -> DataFrame:
    """(name, root, component_id) of the sets that other rows share or are linked with."""
    of = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("place")))
    distinct = marked.where("n > 0").groupBy("name").agg(of.alias("of"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n", "first", "sketch")))
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("id"), "name", "of.doc_id", "of.place", "rows", "n", "first", "sketch"), "distinct")
    near = components(candidate_links(distinct, numerator=numerator))
    groups = written(near.select(F.col("node").alias("id"), "root").join(distinct.select("id", "name", "doc_id", "place", "n"), "id"), "groups")
    keys = [F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(F.coalesce(text_col, F.lit("")))]
    wanted = groups.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    tied = components(exact_links(wanted, docs, keys, text_col, shingle, numerator))
    shared = distinct.join(tied, distinct["id"] == tied["node"], "left").where("rows > 1 or root is not null")
    shared = written(shared.select("name", F.coalesce("root", "id").alias("root"), "doc_id"), "shared")
    least = written(shared.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")  # so that the join can split a large group
    return shared.join(least, "root").select("name", "root", "component_id")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: DuckDB SQL over whole tables with the rows of the registered query, for ids that don't repeat: all pairs that share a shingle.
ORACLE = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, {_WORDS} AS ws FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < {SHINGLE} THEN array_to_string(ws, ' ') ELSE concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM words WHERE len(ws) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= {NUMERATOR} * (x.n + y.n - c.n)
), reached AS (
  SELECT a AS node, b AS other FROM links UNION SELECT b, a FROM links
  UNION SELECT r.node, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reached r JOIN links l ON r.other IN (l.a, l.b)
), least AS (
  SELECT node, least(node, min(other)) AS component_id FROM reached GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON node = d.doc_id
"""
