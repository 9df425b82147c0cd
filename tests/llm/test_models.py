"""Toxicity, decontamination and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import decontam, toxicity
from orrery.llm.common import written
from tests.llm.test_dedup import brute_fingerprint, brute_lines, roots_of

LARGE = "/root/testdata/sf0.1"


def brute_segments(scores):
    """By definition: the best segment, then the same to its left and right."""
    best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-9:
        return []
    i, j = best[3:]
    return brute_segments(scores[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        gain = np.array([rng.choice([0, 0, 0, 1.3, 0.4]) for _ in range(rng.randint(0, 30))])
        at = np.flatnonzero(gain)
        got = toxicity.segments(at, gain[at], 0.37)
        want = brute_segments([g if g else -0.37 for g in gain])
        assert [round(s, 6) for _, _, s in got] == [round(s, 6) for _, _, s in want]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_decay_solves_its_equation():
    score, share = np.array([2.0, -0.5]), np.array([0.1, 0.9])
    x = toxicity._decay(score, share)
    assert abs((share * np.exp(x * score)).sum() - 1) < 1e-6 and x > 0.1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.predictions(docs, labels)
    known = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = got.join(known, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    pos, neg = ([r["score"] for r in held if r["toxic"] == t] for t in (1, 0))
    auc = np.mean([[1.0 if p > n else 0.5 if p == n else 0.0 for n in neg] for p in pos])
    accuracy = np.mean([r["predicted"] == r["toxic"] for r in held])
    assert auc > 0.93 and accuracy > 0.95, (auc, accuracy)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"text vile{i % 3} {i}") for i in range(40)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.in_fold("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.predictions(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def brute_best(gains, drift):
    """The best sum of any run of tokens."""
    values = [g if g else -drift for g in gains]
    return max([0.0] + [sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)])


def test_counts_bounds_and_scores_against_brute_force(spark):
    rng = random.Random(21)
    vile, plain = ["vile", "filth", "vilest"], [f"plain{chr(97 + i)}" for i in range(20)]
    rows, toxic = [], {}
    for doc in range(120):
        toxic[doc] = int(doc % 4 == 0)
        words = [rng.choice(vile if toxic[doc] and rng.random() < 0.4 else plain) for _ in range(rng.randint(0, 25))]
        rows.append((doc, " ".join(words).title() if doc % 3 else " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    known = [(t.lower().split(), toxic[d]) for d, t in rows if zlib.crc32(str(d).encode()) % 5]
    held = {}
    n_docs, n_tokens = [0, 0], [0, 0]
    for words, c in known:
        n_docs[c] += 1
        n_tokens[c] += len(words)
        seen = Counter(b for w in words for b in toxicity.buckets(w))
        for b, n in seen.items():
            one = held.setdefault(b, [[0, 0], [0, 0]])
            one[0][c] += 1
            one[1][c] += n
    share = [(n + 1) / (sum(n_tokens) + 2) for n in n_tokens]
    for b, (in_docs, times) in held.items():
        prior = [toxicity.PRIOR * s for s in share]
        rate = [np.log(times[c] + prior[c]) - np.log(share[c]) for c in (0, 1)]
        want = max(0.0, rate[1] - rate[0] - toxicity.ERRORS * sum(1 / (in_docs[c] + prior[c]) for c in (0, 1)) ** 0.5) if in_docs[1] else 0.0
        assert abs(model.weights[2][b] - want) < 1e-4
    assert np.count_nonzero(model.weights[2]) == sum(1 for b in held if model.weights[2][b] > 0) > 3
    got = {r["doc_id"]: r for r in toxicity.scores(docs, model).collect()}
    for doc, text in rows:
        words = text.lower().split()
        gains = [max(float(model.weights[2][b]) for b in toxicity.buckets(w)) for w in words]
        x = min(toxicity.CLEAR, max(-toxicity.CLEAR, model.decay * brute_best(gains, model.drift) - np.log(len(words) + 1)))
        assert got[doc]["n_tokens"] == len(words) and abs(got[doc]["score"] - 1 / (1 + np.exp(-(model.offset + model.slope * x)))) < 1e-6


def test_training_rows_are_bounded_and_places_are_those_of_the_text(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels, "doc_id", "text", 2).count() <= 2
    text = "İİ ok VILE"
    words, spans = toxicity.places(text)
    assert [text[a:b].lower() for a, b in spans()] == words


def test_logistic_fit_of_classes_that_are_well_apart():
    """Where a whole Newton step overshoots the fit still ends at the likelihood's maximum."""
    rng = np.random.default_rng(3)
    for share, high, low, spread in ((0.1, 8.0, -3.5, 0.01), (0.1, 8.0, -3.5, 1.5), (0.02, 2.0, 0.0, 0.5), (0.5, 1.0, 0.0, 3.0)):
        y = (rng.random(15_000) < share).astype(float)
        x = np.clip(np.where(y == 1, high, low) + spread * rng.standard_normal(15_000), -8, 8)
        n = np.ones(15_000)
        slope, offset = toxicity._logistic(x, y, n, share)
        assert slope > 0 and 1 / (1 + np.exp(-(offset + slope * high))) > share > 1 / (1 + np.exp(-(offset + slope * low)))
        at = slope * x + offset
        best = (np.logaddexp(0, at) - y * at).sum()
        for ds, do in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
            at = (slope + ds) * x + offset + do
            assert (np.logaddexp(0, at) - y * at).sum() > best - 0.5
    assert toxicity._logistic(np.zeros(0), np.zeros(0), np.zeros(0), 0.3)[0] == 0.0


def test_toxicity_edge_rows(spark):
    rows = [(1, "some vile words", "x"), (2, None, "x"), (3, "", "x"), (1, "some vile words", "x"), (None, "vile " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        got = toxicity.predictions(docs, known).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predictions(docs.limit(0), labels).count() == 0
    model = toxicity.train(docs, labels)
    assert toxicity.without_toxic(docs, model, limit=2.0).count() == 5 and toxicity.without_toxic(docs, model, limit=0.0).columns == docs.columns


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs(a, b) == table[-1][-1]


def brute_leaks(docs, items):
    """Pairs whose five-word shingles are shared by half or more of the item's."""
    grams = {i: set(zip(*(w[j:] for j in range(5)))) for i, t in items if len(w := decontam.words_of(t)) >= 5}
    where = {}
    for i, g in grams.items():
        for x in g:
            where.setdefault(x, []).append(i)
    out = set()
    for doc, text in docs:
        w = decontam.words_of(text)
        seen = {}
        for x in set(zip(*(w[j:] for j in range(5)))):
            for i in where.get(x, ()):
                seen[i] = seen.get(i, 0) + 1
        out |= {(doc, i) for i, n in seen.items() if 2 * n >= len(grams[i])}
    return out


def test_leaks_of_whole_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r[0], r[1]) for r in decontam.contaminated(docs, items).collect()}
    want = brute_leaks(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert len(want) > 10 and got == want


def test_paraphrases_and_edge_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)] + ["the", "of", "and"] * 200
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(15, 60))) for i in range(30)]
    rows, want = [], set()
    for doc in range(150):
        words = text(300)
        if doc % 5 == 0:
            item, own = items[doc // 5 % 30]
            own = [w if rng.random() > 0.15 else "changed" for w in own]
            at = rng.randrange(300)
            words[at:at] = own
            want.add((doc, item))
        rows.append((doc, (" ".join(words)).upper() if doc % 2 else " ".join(words), "x"))
    rows += [(1000, None, "x"), (1001, "", "x"), (0, rows[0][1], "x"), (None, " ".join(items[7][1]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, ""), (97, "too short"), (None, "a b c d e f g"), (30, " ".join(items[0][1]))], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    pairs = [(r["doc_id"], r["item_id"]) for r in got]
    want |= {(d, 30) for d, i in want if i == 0} | {(None, 7)}
    assert set(pairs) == want and pairs.count((0, 0)) == 2
    left = decontam.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(rows) - len({d for d, _ in want}) - 1
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_sums_of_many_tasks(spark):
    def partial(batch, total):
        for i in batch.column(0).to_pylist():
            total[i % 700, i % 3] += i

    want = np.zeros((700, 3))
    for i in range(1300):
        want[i % 700, i % 3] += i
    assert (decontam._summed(spark.range(0, 1300, 1, 2 * decontam.FIRST_ROUND + 2), partial, (700, 3)) == want).all()


def windows(words, size):
    """The words around each passage that its check looks at."""
    for at in range(0, max(1, len(words) - decontam.HALF), decontam.HALF):
        yield words[max(0, at - size) : at + 2 * decontam.HALF + size]


def brute_lcs(docs, items):
    """Pairs with a window that holds so much of an item in order; the windows of all documents with all items, but where the words alone are too few."""
    out = set()
    for doc, text in docs:
        words = decontam.words_of(text)
        held = set(words)
        for item, own in items:
            least = decontam.LCS * len(own)
            if sum(w in held for w in own) >= least and any(decontam.lcs(own, near) >= least for near in windows(words, len(own)) if sum(n for n in (Counter(own) & Counter(near)).values()) >= least):
                out.add((doc, item))
    return out


def test_recall_against_lcs_of_all_documents_and_items(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r[0], r[1]) for r in decontam.contaminated(docs, items).collect()}
    want = brute_lcs(docs.select("doc_id", "text").collect(), [(i, w) for i, t in items.select("item_id", "text").collect() if len(w := decontam.words_of(t)) >= decontam.LEAST_WORDS])
    assert len(want) > 20 and len(want & got) >= 0.9 * len(want)


def replaced(own, share, rng, vocabulary):
    gone = set(rng.sample(range(len(own)), round(share * len(own))))
    return [rng.choice(vocabulary) if k in gone else w for k, w in enumerate(own)]


@pytest.mark.parametrize("copies", [1, 4, 12])
def test_single_paraphrases_at_several_sizes(spark, copies):
    """Changed leaks of each item in a corpus that grows by shuffled copies: by single words, and by all of the rarest ones."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(1500)]
    share = [1 / (i + 20) for i in range(1500)]
    text = lambda n: rng.choices(vocabulary, share, k=n)
    items = [(i, text(rng.randint(15, 40))) for i in range(150)]
    base = [text(200) for _ in range(400)]
    rows = [(k, " ".join(rng.sample(d, len(d)) if k >= len(base) else d)) for k, d in enumerate(base * copies)]
    frequency = Counter(w for d in base for w in set(d))
    leaks = {}
    for i, own in items:
        kinds = [replaced(own, x, rng, vocabulary) for x in (0.1, 0.25, 0.35)]
        rare = set(sorted(set(own), key=lambda w: (frequency[w], w))[:8])
        kinds.append(["changed" if w in rare else w for w in own])
        for kind, words in enumerate(kinds):
            doc = 10**6 + 4 * i + kind
            leaks[doc] = (kind, i, decontam.lcs(own, words) >= decontam.LCS * len(own))
            rows.append((doc, " ".join(text(40) + words + text(40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = {(r[0], r[1]) for r in decontam.contaminated(docs, bench).collect()}
    for kind, least in enumerate((0.99, 0.99, 0.95, 0.9)):
        true = {(d, i) for d, (k, i, leak) in leaks.items() if leak and k == kind}
        assert len(true) > 80 and len(true & got) >= least * len(true), (kind, len(true), len(true & got))


def test_no_passage_near_an_item_is_lost(spark):
    """Against cosines over the whole space, computed word by word, and against those in the latent space, from a dense matrix."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    texts = docs.select(F.col("doc_id"), F.col("text"))
    (group,) = decontam.groups(decontam.blocks(items, "item_id", "text"))
    coded, vocabulary, search = decontam._prepared(texts, group)
    rows = texts.where("text is not null").collect()
    df = Counter(w for _, t in rows for w in set(decontam.words_of(t)))
    weight = lambda w: np.log1p((coded.count() + 1) / (df[w] + 1))
    weights = {w: weight(w) for w in vocabulary.words}
    unit = lambda words: {w: n * weights[w] / size for w, n in c.items()} if (c := Counter(w for w in words if w in weights)) and (size := sum((n * weights[w]) ** 2 for w, n in c.items()) ** 0.5) else {}
    own = [unit(ws) for _, ws in group[0]]
    place = {w: i for i, w in enumerate(vocabulary.words)}
    dense = lambda u: np.bincount([place[w] for w in u], list(u.values()), minlength=len(place)) @ search.vectors if u else np.zeros(search.vectors.shape[1])
    latent = np.stack([dense(o) for o in own])
    kept = np.linalg.norm(latent, axis=1)
    least, latent = 1 - (1 - decontam.LEAST_LATENT) * np.minimum(1, kept / decontam.WELL_KEPT), latent / kept[:, None]
    want, by_latent, about = set(), set(), set()
    for d, (_, t) in enumerate(rows):
        words = decontam.words_of(t)
        for at in range(max(1, -(-len(words) // decontam.HALF) - 1)):
            p = unit(words[at * decontam.HALF : (at + 2) * decontam.HALF])
            want |= {(d, k, at) for k, o in enumerate(own) if sum(x * o.get(w, 0) for w, x in p.items()) >= decontam.LATENT + 1e-6}
            z = dense(p)
            over = latent @ (z / max(np.linalg.norm(z), 1e-9)) - least
            by_latent |= {(d, k, at) for k in np.flatnonzero(over >= 1e-4).tolist()}
            about |= {(d, k, at) for k in np.flatnonzero(abs(over) < 1e-4).tolist()}
    codes = [vocabulary.codes(t) for _, t in rows]
    got = {hit for _, *arrays in search.hits(codes) for hit in zip(*(a.tolist() for a in arrays[:3]))}
    assert len(want) > 20 and want <= got and by_latent - want and by_latent <= got
    assert len(got - want - by_latent - about) <= 0.01 * len(want) + 5


def paraphrases(rng):
    """A corpus of topics, each with pairs of words that mean the same and stand near each other; items with the first of
    each pair, and documents that tell an item again with the second ones. What both share are words that all documents have."""
    common = [f"c{i}" for i in range(30)]
    pairs = [[(f"t{t}a{i}", f"t{t}b{i}") for i in range(14)] for t in range(12)]
    passage = lambda own: rng.sample([w for p in rng.sample(own, 12) for w in p] + rng.sample(common, 8), 32)
    docs = [(d, " ".join(w for _ in range(rng.randint(4, 12)) for w in passage(pairs[d % 12]))) for d in range(1500)]
    items, told = [], []
    for i, own in enumerate(pairs):
        plan = [(rng.choice(common),) * 2 if k % 5 < 3 else own[(3 * k) % 14] for k in range(40)]
        items.append((i, " ".join(a for a, _ in plan)))
        items.append((100 + i, " ".join(b for _, b in rng.sample(own, 14)) + f" only{i} here{i}"))  # so that the other words are known
        told.append((10_000 + i, " ".join(b for _, b in plan)))
    return docs + told, items, {(d, d - 10_000) for d, _ in told}


@pytest.mark.parametrize("way", ["directions", "random", "none"])
def test_paraphrases_come_through_the_latent_space(spark, monkeypatch, way):
    """They are found by the SVD's directions, and neither by random ones nor without any."""
    docs, items, want = paraphrases(random.Random(12))
    if way == "random":
        monkeypatch.setattr(decontam, "directions", lambda texts, weights: np.linalg.qr(np.random.default_rng(3).standard_normal((len(weights), decontam.RANK)))[0])
    if way == "none":
        monkeypatch.setattr(decontam, "least_latent", lambda kept: np.full(len(kept), 2.0))
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    got = decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    found = want & {(r["doc_id"], r["item_id"]) for r in got}
    if way == "directions":
        assert found == want and max(r["cosine"] for r in got if (r["doc_id"], r["item_id"]) in want) < decontam.LATENT
    else:
        assert not found


def test_subsequences_of_many_passages():
    rng = random.Random(5)
    items = [np.array([rng.randrange(30) for _ in range(rng.choice([5, 12, 63, 64, 65, 90]))]) for _ in range(12)]
    check = decontam.Check(items, 30)
    for _ in range(200):
        text = np.array([rng.randrange(-1, 30) for _ in range(rng.randint(1, 200))], np.int32)
        k, at = rng.randrange(12), rng.randrange(0, len(text), 16)
        n = len(items[k])
        near = text[max(0, at - n) : at + 2 * decontam.HALF + n].tolist()
        want = decontam.lcs(items[k].tolist(), near)
        found = list(check(np.r_[text, -1], np.r_[np.arange(30), -1], np.array([0]), np.array([len(text)]), np.array([at]), np.array([k])))
        assert bool(found) == (want >= decontam.LCS_WITH_ANSWER * n) and all(abs(f[1] - want / n) < 1e-9 for f in found)


def test_words_of_latin_texts_and_scripts_without_blanks():
    vocabulary = decontam.Vocabulary(["straße", "é2", "µ", "日", "本"])
    for text in ("Straße_É2 µ×", "straße É2—µ", "日本、é2", None, ""):
        assert vocabulary.codes(text).tolist() == [vocabulary.find(w, -1) for w in decontam.words_of(text)]
    assert decontam.words_of("日本語 ok") == ["日", "本", "語", "ok"]


def test_long_texts_lose_no_passage(spark, monkeypatch):
    """Texts are cut into pieces that share a half."""
    monkeypatch.setattr(decontam, "STEP", 4 * decontam.HALF)
    rng = random.Random(3)
    text = [rng.randrange(9) for _ in range(1000)]
    for n in (0, 1, 16, 17, 32, 33, 80, 81, 96, 97, 1000):
        codes = np.array(text[:n], np.int32)
        got = [(h + k, some.codes.tolist()) for pieces, of in decontam.chunks([codes]) for p, (_, h) in zip(pieces, of) for k in range(max(1, -(-len(p) // 16) - 1)) for some in [decontam.Passages([p[16 * k : 16 * k + 32]], np.ones(9))]]
        assert got == [(at // 16, text[at : min(n, at + 32)]) for at in range(0, max(1, n - 16), 16)]


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    leak = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(5, leak, "x"), (5, "clean words of another text", "y"), (6, "clean words too", "z")], "doc_id long, text string, __id string")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    left = decontam.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r[2] for r in left.collect()) == ["y", "z"]


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def test_pipeline(spark):
    """Each stage on its own input; ``run`` gives what they give one after another."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, sizes = docs.select("doc_id", "text").collect(), []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf))
        if name == "bpe":
            break
        assert out.columns == docs.columns
        after = out.select("doc_id", "text").collect()
        left = {r[0] for r in after}
        if name == "line_dedup":
            assert sorted(after) == sorted((d, t) for d, _, _, t in brute_lines([tuple(r) for r in before]))
        if name == "simhash":
            prints = [brute_fingerprint(t) for _, t in before]
            values = list(zip(prints, (shingle_set(t, 5) for _, t in before)))
            roots = roots_of(values, lambda a, b: (a[0] ^ b[0]).bit_count() <= 3 or len(a[1]) and 100 * (common := len(a[1] & b[1])) >= 80 * (len(a[1]) + len(b[1]) - common))
            least = {}
            for (doc, _), r in zip(before, roots):
                least[r] = min(doc, least.get(r, doc))
            assert left == set(least.values())
        if name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
            assert left == {r[0] for r in before} - {d for d, _ in brute_leaks(before, items)}
        docs, before = out, after
        sizes.append(len(after))
    assert sizes[0] < 1000 and sizes[3] < sizes[2] < sizes[1] == sizes[0] and sizes[3] > 800
    assert sorted(corpus_pipeline.run(spark, sf).collect()) == sorted(out.collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_edge_rows(spark, sf, name, stage):
    rows = [(1, "a text of some words here", "en", "s", 25, "x"), (1, "a text of some words here", "en", "s", 25, "x"), (2, None, None, None, None, "x"), (3, "", "en", "s", 0, "x"),
            (None, "unlike the others in every word", "en", "s", 31, "x"), (4, "long " * 50_000, "en", "s", 250_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string")
    out = stage(spark, docs, sf)
    if name != "bpe":
        assert out.columns == docs.columns
    assert {r[0] for r in out.select("doc_id").collect()} <= {1, 2, 3, 4, None} and out.count() >= 4
    assert stage(spark, docs.limit(0), sf).count() == 0
