"""Benchmark decontamination by latent semantic retrieval (operator 6).

Texts are read once into numbers of the benchmark's words, all of them, and cut
into overlapping passages, which are weighted by term frequency and inverse
document frequency over all documents. A randomised SVD of all passages, over
all partitions, gives the leading directions of their words. A passage is a
candidate for an item in two ways: by the cosine of both in the latent space of
these directions, where words that stand in the same passages are near each
other, so that a paraphrase with other words is found; or by the cosine in the
full space, which doesn't depend on what is frequent in a corpus, so that a
single leak is found at any size. The less of an item the latent space keeps,
the nearer a passage must be there. Candidates are checked where they stand, by
the longest common subsequence of words and by the words of the item's end, its
answer: the numbers of a text that the check needs are those of the row at
hand, so that no text is ever shuffled.

Inverse document frequency is logarithmic. A leak whose rarest words were all
replaced keeps most of its weight then, which it wouldn't if a word's energy
fell in proportion to its frequency.

The benchmark is read in groups of bounded vocabulary. A group has one basis,
made in one pass over its texts' numbers however many items it has; within it
items are compared in blocks, whose matrices are small.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import map_batches, released, slices, written

#: Characters of scripts without blanks are words of their own (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD = re.compile(rf"(?=[^\W_])[{UNSPACED}]|[^\W_{UNSPACED}]+")
#: Words of half a passage; passages overlap by half.
HALF = 16
#: Leading directions; added for the randomised start; power iterations.
RANK, MORE, POWER, SEED = 48, 8, 1, 11
#: Contaminated: so much of the item's words in order, or less with so much of its answer and a cosine of ``COSINE``.
LCS, LCS_WITH_ANSWER, ANSWER = 0.6, 0.45, 0.8
#: Cosine that answers need, as those of frequent words alone are found anywhere.
COSINE = 0.35
#: Cosine in the full space from which a passage is checked: that of the least share of an item's weight beside other words with so many times the item's.
BESIDE = 4
LATENT = LCS_WITH_ANSWER / (LCS_WITH_ANSWER + BESIDE) ** 0.5
#: Cosine in the latent space from which a passage is checked, for items of which so much of the length or more is kept there; see ``least_latent``.
LEAST_LATENT, WELL_KEPT = 0.95, 0.2
#: The answer is the item's last share of words; items of fewer words aren't searched.
ANSWER_SHARE, LEAST_WORDS = 0.25, 5
#: Items of a block; words of a block and of a group of blocks.
BLOCK_ITEMS, BLOCK_WORDS, GROUP_WORDS = 256, 16_384, 65_536
#: Words of texts that are worked on at once, a multiple of ``HALF``.
STEP = 1 << 15
#: Passages that are checked at once.
HITS = 1 << 9
#: Tasks whose matrices are added up in the first of two rounds.
FIRST_ROUND = 64

RESULT = "doc_id long, item_id long, cosine double, lcs double, answer double"
Block = list[tuple[int, list[str]]]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


#: For texts of Latin-1 characters the same words as bytes: letters and digits in lower case, blanks for all else.
LATIN = bytes(ord(chr(b).lower()) if WORD.fullmatch(chr(b)) else 0x20 for b in range(256))


class Vocabulary:
    """Numbers of words, -1 for words that aren't in it."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        number = {w: i for i, w in enumerate(self.words)}
        self.find = (number | {w.encode("latin-1"): i for w, i in number.items() if _latin(w)}).get

    def __len__(self) -> int:
        return len(self.words)

    def __reduce__(self):
        return Vocabulary, (self.words,)

    def codes(self, text: str | None) -> np.ndarray:
        try:
            words = (text or "").encode("latin-1").translate(LATIN).split()
        except UnicodeEncodeError:
            words = words_of(text)
        return np.fromiter(map(self.find, words, repeat(-1)), np.int32, len(words))


def _latin(word: str) -> bool:
    return all(ord(c) < 256 for c in word)


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Items as (id, words), in blocks; null ids, and null, empty and very short texts are left out."""
    held, size = [], 0
    for item, text in benchmark.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).orderBy(id_col, text_col).toLocalIterator():
        words = words_of(text)
        if len(words) < LEAST_WORDS:
            continue
        if held and (len(held) >= BLOCK_ITEMS or size + len(words) > BLOCK_WORDS):
            yield held
            held, size = [], 0
        held.append((item, words))
        size += len(words)
    if held:
        yield held


def groups(found: Iterable[Block]) -> Iterator[list[Block]]:
    """Blocks whose vocabulary is looked up in one pass over the texts."""
    held, size = [], 0
    for block in found:
        n = sum(len(ws) for _, ws in block)
        if held and size + n > GROUP_WORDS:
            yield held
            held, size = [], 0
        held.append(block)
        size += n
    if held:
        yield held


def lcs(item: list, other: list) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    state = full = (1 << len(item)) - 1
    for w in other:
        if m := where.get(w):
            u = state & m
            state = (state + u | state - u) & full
    return len(item) - state.bit_count()


class Passages:
    """All passages of some texts: each is a half and the next one of the same text, and a text of one half has an empty one after it."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray):
        self.sizes = np.array([max(2, -(-len(t) // HALF)) for t in texts])
        self.first = np.cumsum(np.r_[0, self.sizes])
        codes = np.full(self.first[-1] * HALF, -1, np.int32)
        for at, t in zip((self.first * HALF).tolist(), texts):
            codes[at : at + len(t)] = t
        known = np.flatnonzero(codes >= 0)
        self.codes, self.half = codes[known], known // HALF
        self.weights = weights
        last = np.zeros(self.first[-1], bool)
        last[self.first[1:] - 1] = True
        self.lead = np.flatnonzero(~last)
        self.starts = np.flatnonzero(np.r_[True, self.half[1:] != self.half[:-1]]) if len(known) else known

    def lengths(self) -> np.ndarray:
        """Of each passage."""
        n = len(self.weights)
        words, counts = np.unique(np.r_[self.half * n + self.codes, (self.half - 1) * n + self.codes], return_counts=True)
        half = words // n  # -1 for the second place of the first half, which leads nothing
        square = np.bincount(half + 1, (counts * self.weights[words - half * n]) ** 2, minlength=self.first[-1] + 1)
        return np.sqrt(square[self.lead + 1])

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """The passages times a matrix with a row for each word (already weighted)."""
        out = np.zeros((self.first[-1], matrix.shape[1]), np.float32)
        if len(self.codes):
            out[self.half[self.starts]] = np.add.reduceat(matrix[self.codes], self.starts, axis=0)
        return out[self.lead] + out[self.lead + 1]

    def add_transposed(self, x: np.ndarray, to: np.ndarray) -> None:
        """Adds the transpose of the passages times ``x`` to ``to``."""
        if not len(self.codes):
            return
        halves = np.zeros((self.first[-1], x.shape[1]), np.float32)
        halves[self.lead] = x
        halves[self.lead + 1] += x
        by = np.argsort(self.codes, kind="stable")
        f = self.codes[by]
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        to[f[first]] += np.add.reduceat(halves[self.half[by]], first, axis=0) * self.weights[f[first], None].astype(np.float32)

    def cosines(self, space: Space) -> np.ndarray:
        """Of each passage with each item of a block, in the full space."""
        n, some = len(space.items), space.size[self.codes]
        at = np.repeat(space.start[self.codes] - np.r_[0, np.cumsum(some)[:-1]], some) + np.arange(some.sum()) if len(self.codes) else self.codes
        sums = np.bincount(np.repeat(self.half, some) * n + space.item[at], space.product[at], minlength=self.first[-1] * n).reshape(-1, n)
        sums = sums[self.lead] + sums[self.lead + 1]
        return sums / np.maximum(self.lengths(), 1e-9)[:, None]


@dataclass
class Space:
    """A block of items: for each word of the vocabulary its products with the items, those that aren't zero; and the items in the latent space."""

    items: list[tuple[int, np.ndarray]]
    weights: np.ndarray
    start: np.ndarray
    size: np.ndarray
    item: np.ndarray
    product: np.ndarray
    #: Numbers of the group's vocabulary to those of the block's, -1 for others.
    local: np.ndarray
    #: Of length one, a column for each item, and the cosine with it that a candidate needs.
    latent: np.ndarray
    least: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, np.ndarray]], weights: np.ndarray, vectors: np.ndarray, local: np.ndarray) -> Space:
        """``vectors`` are the directions, with a row for each word of the block."""
        own = np.stack([np.bincount(i, minlength=len(weights)) * weights for _, i in items], axis=1)
        length = np.linalg.norm(own, axis=0)
        products = weights[:, None] * own / length
        word, item = np.nonzero(products)
        size = np.bincount(word, minlength=len(weights))
        latent = vectors.T @ own
        kept = np.linalg.norm(latent, axis=0)
        return cls(items, weights, np.r_[0, np.cumsum(size)[:-1]], size, item, products[word, item], local, (latent / np.maximum(kept, 1e-12)).astype(np.float32), least_latent(kept / length))


def least_latent(kept: np.ndarray) -> np.ndarray:
    """The cosine that a candidate needs in the latent space, by the share of an item's length that is kept there.

    Where little is kept, what is kept says little of the item: the bound rises to 1, which the other way in makes up for.
    """
    return 1 - (1 - LEAST_LATENT) * np.minimum(1, kept / WELL_KEPT)


def chunks(texts: Iterable[np.ndarray]) -> Iterator[tuple[list[np.ndarray], list[tuple[int, int]]]]:
    """Pieces of about ``STEP`` words together, and for each the text and the half that it starts with.

    A longer text is cut into pieces that share a half, so that each of its passages is in one of them.
    """
    held: list[np.ndarray] = []
    of: list[tuple[int, int]] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - HALF), STEP):
            piece = text[at : at + STEP + HALF]
            if held and size + len(piece) > STEP:
                yield held, of
                held, of, size = [], [], 0
            held.append(piece)
            of.append((number, at // HALF))
            size += len(piece) + HALF
    if held:
        yield held, of


class Search:
    """Finds and checks the items of some blocks in texts given as codes; ``vectors`` are the group's directions, ``weights`` its words'."""

    def __init__(self, spaces: list[Space], vectors: np.ndarray, weights: np.ndarray, full: float = LATENT):
        self.spaces, self.vectors, self.weights, self.full = spaces, vectors, weights, full
        self.weighted = (vectors * weights[:, None]).astype(np.float32)
        self.checks = [Check([own for _, own in s.items], len(s.weights)) for s in spaces]

    def __reduce__(self):
        return Search, (self.spaces, self.vectors, self.weights, self.full)

    def hits(self, texts: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, and in arrays text, item, number of the first half, cosine) of passages near an item in either space."""
        for some, of in chunks(texts):
            whole = Passages(some, self.weights)
            z = whole.times(self.weighted)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
            for b, space in enumerate(self.spaces):
                p = whole if len(space.weights) == len(self.weights) else Passages([space.local[t] for t in some], space.weights)  # -1 takes the last one, which is -1
                cosines = p.cosines(space)
                row, item = np.nonzero((cosines >= self.full) | (z @ space.latent >= space.least))
                half = p.lead[row]
                piece = np.searchsorted(p.first, half, side="right") - 1
                text, start = np.array(of)[piece].T
                yield b, text, item, start + half - p.first[piece], cosines[row, item]

    def found(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item id, cosine, share of the longest common subsequence, share of the answer), the best place of each item."""
        best: dict[tuple[int, int, int], tuple[float, float, float]] = {}
        first = np.cumsum([0, *map(len, texts)])
        codes = np.concatenate([*texts, np.array([-1], np.int32)])
        for b, *hit in self.hits(texts):
            order = np.argsort(self.checks[b].size[hit[1]], kind="stable")  # items of about one length together, as the longest says how far to look
            text, item, at, cosine = (x[order] for x in hit)
            for i in range(0, len(text), HITS):
                some = slice(i, i + HITS)
                of = text[some]
                needed = np.where(cosine[some] >= COSINE, LCS_WITH_ANSWER, LCS)  # an answer counts only from this cosine on
                for k, share, answer in self.checks[b](codes, self.spaces[b].local, first[of], first[of + 1], first[of] + at[some] * HALF, item[some], needed):
                    near = min(1.0, float(cosine[i + k]))
                    if share >= LCS or answer >= ANSWER and near >= COSINE:
                        key = b, int(of[k]), int(item[i + k])
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (share, answer, near))
        for (b, text, item), (share, answer, near) in best.items():
            yield text, self.spaces[b].items[item][0], near, share, answer


class Check:
    """Longest common subsequences of many passages with their items at once, an item's places being the bits of a number."""

    def __init__(self, items: list[np.ndarray], words: int):
        self.items = [i.tolist() for i in items]
        self.size = np.array([len(i) for i in items])
        self.tails = [Counter(i[-max(1, round(ANSWER_SHARE * len(i))) :]) for i in self.items]
        self.bits = np.zeros((words + 1, len(items)), np.uint64)  # the last row is for words that no item has
        for k, own in enumerate(items):
            if len(own) <= 64:
                np.bitwise_or.at(self.bits[:, k], own, np.left_shift(np.uint64(1), np.arange(len(own), dtype=np.uint64)))
        self.full = np.array([(1 << min(n, 64)) - 1 for n in self.size.tolist()], np.uint64)

    def __call__(self, codes: np.ndarray, local: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, item: np.ndarray, share: np.ndarray | float = LCS_WITH_ANSWER) -> Iterator[tuple[int, float, float]]:
        """(hit, share of the subsequence, share of the answer) of hits that can be a leak: whose subsequence has ``share`` of the item or more.

        A hit is a passage that starts at ``at`` in a text from ``low`` to
        ``high``; so many words as the item has before and after it count too.
        """
        size = self.size[item]
        reach = int(size.max(initial=0))
        offset = np.arange(-reach, 2 * HALF + reach)[:, None]
        place = at + offset
        inside = (place >= low) & (place < high) & (offset >= -size) & (offset < 2 * HALF + size)
        near = np.where(inside, local[codes[np.clip(place, 0, len(codes) - 1)]], -1)
        found = self.bits[near, item]
        # no subsequence is longer than the places of the item whose words are there at all
        some = np.flatnonzero((np.bitwise_count(np.bitwise_or.reduce(found, axis=0)) >= share * size) | (size > 64))
        if not len(some):
            return
        if len(some) < len(item):
            found, near, size, item = found[:, some], near[:, some], size[some], item[some]
        state = self.full[item]
        for row in found:
            both = state & row
            state = (state + both) | (state - both)
        length = size - np.bitwise_count(state & self.full[item])
        for k in np.flatnonzero(size > 64).tolist():
            own = self.items[item[k]]
            length[k] = lcs(own, near[:, k].tolist())
        for k in np.flatnonzero(length >= LCS_WITH_ANSWER * size).tolist():
            tail = self.tails[item[k]]
            yield int(some[k]), float(length[k] / size[k]), (tail & Counter(near[:, k].tolist())).total() / tail.total()


def coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, codes) of every document, written once: the one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(columns):
        for doc, text in zip(*columns):
            yield doc, shared.value.codes(text).tobytes()

    return written(map_batches(docs, rows, "doc_id long, codes binary", most=1 << 10))


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b, "<i4") for b in batch.column("codes").to_pylist()]


def frequencies(texts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """The documents that hold each word of the vocabulary, and the number of documents; over all of them."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(size, np.int64)
        for batch in batches:
            for codes in _codes(batch):
                held = np.unique(codes)
                seen[held[held >= 0]] += 1
            n += batch.num_rows
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, seen[at]])], names=["word", "n"])

    df, n = np.zeros(size), 0
    for word, k in texts.mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n")).collect():
        if word < 0:
            n = k
        else:
            df[word] = k
    return df, n


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n + 1) / (df + 1))


def _summed(table: DataFrame, partial, shape: tuple[int, int], rows: int = 512) -> np.ndarray:
    """The sum of one matrix of this shape from each task, in chunks of rows: first of some dozens of tasks, then of those sums."""
    schema = "chunk int, part int, data binary"

    def packed(chunk: int, part: int, data: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([data.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "part", "data"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for batch in batches:
            partial(batch, total)
        for i in range(0, shape[0], rows):
            if (some := total[i : i + rows]).any():
                yield packed(i // rows, TaskContext.get().partitionId() // FIRST_ROUND, some)
        released()

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted, so that one sum is held at a time."""
        key, held = None, None
        for batch in batches:
            for chunk, part, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (chunk, part) != key:
                    if key is not None:
                        yield packed(key[0], 0, held)
                    key, held = (chunk, part), np.zeros(len(data) // 4)
                held += np.frombuffer(data, np.float32)
        if key is not None:
            yield packed(key[0], 0, held)

    pieces = table.mapInArrow(emit, schema)
    for _ in range(2):
        pieces = pieces.repartition("chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(add, schema)
    out = np.zeros(shape)
    for chunk, data in pieces.select("chunk", "data").collect():
        some = np.frombuffer(data, np.float32).reshape(-1, shape[1])
        out[chunk * rows : chunk * rows + len(some)] = some
    return out


def directions(texts: DataFrame, weights: np.ndarray, rank: int = RANK, more: int = MORE, power_steps: int = POWER) -> np.ndarray:
    """The leading right singular vectors of all passages, not scaled to length one, a column each.

    A direction counts as far as it stands out of the last one that is computed, which is taken for noise.
    """
    n = len(weights)
    width = min(n, rank + more)
    context = texts.sparkSession.sparkContext
    basis = np.random.default_rng(SEED).standard_normal((n, width))
    weighted = weights.astype(np.float32)[:, None]

    def passages(batch: pa.RecordBatch) -> Iterator[Passages]:
        return (Passages(some, weights) for some, _ in chunks(_codes(batch)))

    for _ in range(power_steps):
        basis, _ = np.linalg.qr(basis)
        shared = context.broadcast((basis * weighted).astype(np.float32))

        def power(batch, total, shared=shared):
            for p in passages(batch):
                p.add_transposed(p.times(shared.value), total)

        image = _summed(texts, power, (n, width))
        start, basis = basis, image
    vectors, values = nystrom(start, image)
    noise = float(values[-1]) if width == rank + more else 0.0
    return vectors[:, :rank] * np.maximum(0.0, 1 - noise / np.maximum(values[:rank], 1e-12))


def nystrom(start: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors, a column each, and eigenvalues, the largest first, of a positive matrix known by the ``image`` of orthonormal columns.

    One pass over the passages is all that it takes: the matrix isn't multiplied again.
    """
    shift = 1e-7 * max(np.linalg.norm(image), 1e-12)
    moved = image + shift * start
    square = start.T @ moved
    root = np.linalg.cholesky((square + square.T) / 2)
    vectors, sizes, _ = np.linalg.svd(np.linalg.solve(root, moved.T).T, full_matrices=False)
    return vectors, np.maximum(0.0, sizes**2 - shift)


def space_of(block: Block, vocabulary: Vocabulary, weights: np.ndarray, vectors: np.ndarray) -> Space:
    """A block of a group whose words have ``weights`` and ``vectors``."""
    own = [(i, np.array([vocabulary.find(w) for w in ws], np.int32)) for i, ws in block]
    used = np.unique(np.concatenate([c for _, c in own]))
    local = np.full(len(vocabulary) + 1, -1, np.int32)
    local[used] = np.arange(len(used))
    return Space.of([(i, local[c]) for i, c in own], weights[used], vectors[used], local)


def _prepared(docs: DataFrame, group: list[Block]) -> tuple[DataFrame, Vocabulary, Search]:
    """The texts in codes of a group's vocabulary, and the search for its blocks."""
    vocabulary = Vocabulary(w for block in group for _, ws in block for w in ws)
    texts = coded(docs, vocabulary)
    weights = idf(*frequencies(texts, len(vocabulary)))
    vectors = directions(texts, weights)
    return texts, vocabulary, Search([space_of(block, vocabulary, weights, vectors) for block in group], vectors, weights)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): the documents that hold a benchmark item, and which.

    Null or empty texts hold nothing; an item of fewer than five words isn't
    searched. Repeated rows of a document give a row each, and so do items with
    the same text. Other columns are left out, whatever their names. Without
    documents or items the result is empty.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], RESULT)
    for group in groups(blocks(benchmark, item_col, item_text)):
        texts, _, search = _prepared(docs, group)
        shared = docs.sparkSession.sparkContext.broadcast(search)  # bounded by the group's words

        def check(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[text], *found) for text, *found in shared.value.found(_codes(batch))]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])
            released()

        out = out.union(written(texts.mapInArrow(check, RESULT)))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item, all columns as they were; nothing of them is shuffled.

    Each row is judged by its own text: one that shares its id with a
    contaminated row stays. Null and empty texts stay, and so do all rows of a
    table without items to compare with; repeated rows share their fate.
    """
    place = docs.columns.index(text_col)
    for group in groups(blocks(benchmark, "item_id", "text")):
        _, vocabulary, search = _prepared(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), group)
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, search))

        def keep(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, search = shared.value
            for batch in batches:
                for some in slices(batch):
                    found = search.found([vocabulary.codes(t) for t in some.column(place).to_pylist()])
                    clean = np.ones(some.num_rows, bool)
                    clean[list({text for text, *_ in found})] = False
                    yield some.filter(pa.array(clean))
            released()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
