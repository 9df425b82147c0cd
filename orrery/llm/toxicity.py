"""Toxic passages by maximum-scoring segments of token log-odds (operator 10).

Training counts, for words and their beginnings hashed to a fixed number of
buckets, the toxic and the other training documents that hold them. A bucket's
weight is the lower confidence bound of its log-odds under a Dirichlet prior in
proportion to the classes; a token's weight is the best of its buckets', less a
drift where none speaks for toxicity. In each text one scan finds all
maximum-scoring segments (Ruzzo and Tompa). The scores of non-toxic training
texts give the decay of the extreme-value law, so that a segment's score is
judged against the text's length; a logistic fit over the same documents, each
scored without its own counts, turns it into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import forget, kept, map_batches, released, slices, written

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 20
#: Beginnings of words that count, in characters.
PREFIXES = range(3, 8)
#: Strength of the prior in documents, standard errors of the bound, and the least cost of a token that doesn't speak for toxicity.
PRIOR, ERRORS, LEAST_DRIFT = 4.0, 2.5, 0.01
#: The labelled rows that the model is fitted on, at most: those first by a hash of their ids.
MOST_ROWS = 15_000
FOLDS = 5
#: Steps of score, log length and token gain in the calibration tables, and the chance below which passages are listed, and clear evidence.
STEP, LENGTH_STEP, GAIN_STEP, CHANCE, CLEAR = 4, 4, 16, 0.01, 8.0


def places(text: str | None) -> tuple[list[str], Callable[[], Iterator[tuple[int, int]]]]:
    """The words in lower case, and a function that gives their places in the text itself."""
    text = text or ""
    lower = text.lower()
    if len(lower) == len(text):
        return WORD.findall(lower), lambda: (m.span() for m in WORD.finditer(lower))
    return [w.lower() for w in WORD.findall(text)], lambda: (m.span() for m in WORD.finditer(text))


def words_of(text: str | None) -> list[str]:
    return places(text)[0]


def beginnings(word: str) -> list[int]:
    """The buckets of a word's beginnings."""
    if len(word) < PREFIXES[0]:
        return []
    crc = zlib.crc32(word[: PREFIXES[0]].encode())
    found = [crc % BUCKETS]
    for c in word[PREFIXES[0] : PREFIXES[-1]]:
        crc = zlib.crc32(c.encode(), crc)
        found.append(crc % BUCKETS)
    return found


def buckets(word: str) -> set[int]:
    """Of the whole word and its beginnings."""
    return {zlib.crc32(b"=" + word.encode()) % BUCKETS, *beginnings(word)}


def bound(docs: np.ndarray, tokens: np.ndarray, n_docs: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Lower confidence bound of the log-odds of buckets, zero where negative.

    ``docs`` and ``tokens`` have a row for other texts and one for toxic texts:
    a bucket's documents and occurrences. The prior spreads over the classes as
    all tokens do, and documents, not occurrences, are what is independent.
    """
    share = (n_tokens + 1) / (n_tokens + 1).sum()
    prior = PRIOR * share[:, None]
    rate = np.log(tokens + prior) - np.log(share)[:, None]
    return np.maximum(rate[1] - rate[0] - ERRORS * np.sqrt((1 / (docs + prior)).sum(axis=0)), 0)


def without_one(docs: np.ndarray, tokens: np.ndarray, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The counts as they'd be without one text of a class that holds the bucket."""
    docs, tokens = docs.copy(), tokens.copy()
    left = np.maximum(docs[toxic] - 1, 0)
    tokens[toxic] *= left / np.maximum(docs[toxic], 1)
    docs[toxic] = left
    return docs, tokens


@dataclass
class Model:
    """Weights by bucket, for new texts; where training, also for texts that count as toxic or not themselves."""

    weights: list[np.ndarray]
    drift: float = LEAST_DRIFT
    decay: float = 1.0
    slope: float = 1.0
    offset: float = 0.0

    def score(self, best: float, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.offset + self.slope * evidence(best, n, self.decay), -50, 50))))


def evidence(best, n, decay):
    """Negative log of the segments at least so good to expect in a text of ``n`` tokens by chance.

    Beyond ``CLEAR`` it says no more, so that a few long texts don't set the slope.
    """
    return np.clip(decay * best - np.log(n + 1), -CLEAR, CLEAR)


def segments(at: np.ndarray, gain: np.ndarray, drift: float = LEAST_DRIFT) -> list[tuple[int, int, float]]:
    """All maximum-scoring segments (first token, end, score), given the tokens that gain; others cost ``drift``.

    Linear time: each candidate goes on or off the list once.
    """
    found: list[tuple] = []  # first, end, sum before it, sum after it, the nearest one before with a lower sum before it
    total, last = 0.0, -1
    for i, g in zip(at.tolist(), gain.tolist()):
        total -= drift * (i - last - 1)
        last = i
        one = (i, i + 1, total, total + g, None)
        total += g
        while True:
            j = one[4]
            if j is None:
                j = len(found) - 1
            while j >= 0 and found[j][2] >= one[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= one[3]:
                found.append((*one[:4], j))
                break
            one = (found[j][0], one[1], found[j][2], one[3], found[j][4])
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


class Gains(dict):
    """The best weight of each word's buckets; so many words, and so many of their beginnings, are remembered."""

    def __init__(self, weights: np.ndarray, remembered: int):
        at = np.flatnonzero(weights)
        self.weights, self.remembered = dict(zip(at.tolist(), weights[at].tolist())), remembered
        self.starts: dict[str, float] = {}

    def __missing__(self, word: str) -> float:
        if len(self) >= self.remembered:
            self.clear()
        gain = self[word] = max(self.weights.get(zlib.crc32(b"=" + word.encode()) % BUCKETS, 0.0), self._of_start(word[: PREFIXES[-1]]))
        return gain

    def _of_start(self, start: str) -> float:
        gain = self.starts.get(start)
        if gain is None:
            if len(self.starts) >= self.remembered:
                self.starts.clear()
            gain = self.starts[start] = max((self.weights.get(b, 0.0) for b in beginnings(start)), default=0.0)
        return gain


class Scorer:
    """Scores texts with one table of weights; remembers the weights of words."""

    def __init__(self, weights: np.ndarray, drift: float, remembered: int = 150_000):
        self.weights, self.drift, self.known = weights, drift, Gains(weights, remembered)

    def gain(self, word: str) -> float:
        return self.known[word]

    def gains(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def best(self, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
        """The best segment's score, the number of tokens, and all segments."""
        gain = self.gains(text)
        at = np.flatnonzero(gain)
        found = segments(at, gain[at], self.drift)
        return max((s for _, _, s in found), default=0.0), len(gain), found


def in_fold(id_col: str) -> Column:
    """True for held-out ids: crc32 of the id as text leaves no remainder."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """(text, toxic): at most ``most_rows`` labelled documents that aren't held out.

    Repeated labels count as toxic if one does; of rows that share an id the one with the smallest text is used.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("__id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold("__id"))
        .groupBy("__id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(most_rows)
    )
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    return labelled.groupBy("__id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Model:
    """A model of fixed size; without toxic or other rows it gives every text the same low or high score."""
    rows = written(training_rows(docs, labels, id_col, text_col, most_rows))

    def count(columns):
        docs_of, tokens_of = np.zeros((2, BUCKETS), np.int64), np.zeros((2, BUCKETS), np.int64)
        n_docs, n_tokens = [0, 0], [0, 0]
        for text, toxic in zip(*columns):
            words, c = words_of(text), int(toxic == 1)
            tokens: Counter = Counter()
            for word, n in Counter(words).items():
                for b in buckets(word):
                    tokens[b] += n
            at = np.fromiter(tokens.keys(), np.int64, len(tokens))
            docs_of[c, at] += 1
            tokens_of[c, at] += np.fromiter(tokens.values(), np.int64, len(tokens))
            n_docs[c] += 1
            n_tokens[c] += len(words)
        yield -1, *n_docs, *n_tokens
        at = np.flatnonzero(docs_of.any(axis=0))
        yield from zip(at.tolist(), *docs_of[:, at].tolist(), *tokens_of[:, at].tolist())

    names = ["other", "toxic", "other_tokens", "toxic_tokens"]
    counts = map_batches(rows, count, "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))
    found = counts.where("toxic > 0 or bucket < 0").toArrow()
    at = found.column("bucket").to_numpy()
    columns = np.stack([found.column(n).to_numpy() for n in names]).astype(float)
    n_docs, n_tokens = columns[:, at < 0].sum(axis=1).reshape(2, 2)
    table = np.zeros((4, BUCKETS))
    table[:, at[at >= 0]] = columns[:, at >= 0]
    docs_of, tokens_of = table[:2], table[2:]
    tables = [bound(*without_one(docs_of, tokens_of, c), n_docs, n_tokens) for c in (0, 1)]  # for a text of the class itself
    tables.append(bound(docs_of, tokens_of, n_docs, n_tokens))
    model = Model([np.where(docs_of[1] > 0, t, 0).astype(np.float32) for t in tables])
    return _calibrated(model, rows, n_docs)


def _calibrated(model: Model, rows: DataFrame, n_docs: np.ndarray) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(model.weights[:2])

    def weigh(columns):
        scorers = [Scorer(w, 0.0) for w in shared.value]
        seen: Counter = Counter()
        for text, toxic in zip(*columns):
            gain = np.ceil(scorers[toxic == 1].gains(text) * GAIN_STEP).astype(int)
            seen.update({(int(toxic == 1), g): n for g, n in zip(*(x.tolist() for x in np.unique(gain, return_counts=True)))})
        for (toxic, g), n in seen.items():
            yield toxic, g, n

    found = map_batches(rows, weigh, "toxic int, gain int, tokens long").groupBy("toxic", "gain").agg(F.sum("tokens").alias("tokens")).toArrow()
    of, gain, tokens = (found.column(c).to_numpy() for c in ("toxic", "gain", "tokens"))
    gain = gain / GAIN_STEP
    shares = [tokens[of == c] / max(1, tokens[of == c].sum()) for c in (0, 1)]
    gaining = [shares[c][gain[of == c] > 0].sum() for c in (0, 1)]
    # a neutral token's log-odds is about the share of gaining ones that toxicity adds; by chance a text must not gain
    drift = model.drift = float(max(LEAST_DRIFT, gaining[1] - gaining[0], 1.5 * (shares[0] * gain[of == 0]).sum()))
    model.decay = _decay(np.where(gain[of == 0] > 0, gain[of == 0], -drift), shares[0])

    def score(columns):
        scorers = [Scorer(w, drift) for w in shared.value]
        for text, toxic in zip(*columns):
            best, n, _ = scorers[toxic == 1].best(text)
            yield int(toxic == 1), round(best * STEP), round(float(np.log(n + 1)) * LENGTH_STEP)

    table = map_batches(rows, score, "toxic int, best int, length int").groupBy("toxic", "best", "length").count().toArrow()
    y, best, length, n = (table.column(c).to_numpy().astype(float) for c in ("toxic", "best", "length", "count"))
    best, length = best / STEP, length / LENGTH_STEP
    model.slope, model.offset = _logistic(evidence(best, np.expm1(length), model.decay), y, n, (n_docs[1] + 0.5) / (n_docs.sum() + 1))
    return model


def _decay(score: np.ndarray, share: np.ndarray) -> float:
    """Of the extreme-value law of best scores by chance: the positive root of sum(share * exp(decay * score)) = 1."""
    if not (share[score > 0]).sum():
        return 1.0
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (share * np.exp(mid * score)).sum() > 1 else (mid, high)
    return max(low, 0.01)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, share: float) -> tuple[float, float]:
    """Slope (not negative) and offset, with a small penalty that keeps them finite."""
    slope, offset = 0.0, float(np.log(share / (1 - share)))
    if not len(x):
        return slope, offset
    mid, spread = np.average(x, weights=n), max(1e-6, float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))))
    z = (x - mid) / spread
    b = np.array([0.0, offset])
    design = np.stack([z, np.ones_like(z)], axis=1)
    penalty = np.array([0.1, 0.0])

    def loss(b: np.ndarray) -> float:
        at = design @ b
        return float((n * (np.logaddexp(0, at) - y * at)).sum() + (penalty * b * b).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -50, 50)))
        gradient = design.T @ (n * (y - p)) - penalty * b
        curve = design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag([0.1, 1e-3])
        step = np.linalg.solve(curve, gradient)
        now = loss(b)
        while loss(b + step) > now and np.abs(step).max() > 1e-9:  # a whole Newton step can lead far away where classes are well apart
            step /= 2
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    if b[0] <= 0:
        return 0.0, offset
    return float(b[0] / spread), float(b[1] - b[0] * mid / spread)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_tokens, passages) for each row; a null or empty text has no tokens and a low score.

    ``passages`` lists the significant segments as start:end in characters of
    the text, comma-joined. Repeated rows are scored each; an empty table gives
    an empty one; other columns are left out, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights[2], replace(model, weights=[])))

    def rows(columns):
        scorer = _scorer(shared)
        model = shared.value[1]
        for doc, text in zip(*columns):
            best, n, found = scorer.best(text)
            listed = [s for s in found if evidence(s[2], n, model.decay) > -np.log(CHANCE)]
            yield doc, model.score(best, n), n, ",".join(f"{a}:{b}" for a, b in _characters(text, listed))

    return map_batches(docs.select(id_col, text_col), rows, "doc_id long, score double, n_tokens long, passages string", keeps="toxicity")


def _scorer(shared) -> Scorer:
    """A worker's scorer for one broadcast; it holds the weights, so that no others have their identity."""
    return kept("toxicity", id(shared.value[0]), lambda: Scorer(shared.value[0], shared.value[1].drift))


def _characters(text: str | None, listed: list[tuple[int, int, float]]) -> Iterator[tuple[int, int]]:
    if not listed:
        return
    spans = list(places(text)[1]())
    for a, b, _ in listed:
        yield spans[a][0], spans[b - 1][1]


def predictions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages): trained on the rows that aren't held out, applied to all.

    A row for each row, repeated ones too. Null and empty texts have no tokens
    and so the lowest score; a null id is never held out, nor trained on, as it
    has no label; texts are scored whole. Without labels of both kinds all have
    one score; an empty table gives an empty one; other columns don't matter.
    """
    found = scores(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return found.select(
        "doc_id", F.coalesce(in_fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``limit``, all columns as they were; nothing is shuffled.

    Null and empty texts have no tokens and so the lowest score; null ids stay;
    repeated rows share their fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights[2], replace(model, weights=[])))
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget("toxicity")
        scorer, model = _scorer(shared), shared.value[1]
        for batch in batches:
            for some in slices(batch):
                yield some.filter(pa.array([model.score(*scorer.best(t)[:2]) < limit for t in some.column(place).to_pylist()], pa.bool_()))
        released()

    return docs.mapInArrow(keep, docs.schema)
