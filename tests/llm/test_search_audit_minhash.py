"""Ranked search, divergence of sources and MinHash near-duplicates against brute force, with edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import divergence, lexical, minhash

DOCS = "rank long, doc_id long, text string, lang string, source string, n string, score string, term string, name string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(0, *r, "x", "x", "x", "x") for r in rows], DOCS).repartition(3)


# -- ranked search ---------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    texts = [(d, Counter(split(t))) for d, t in docs]
    n, total = sum(1 for _, c in texts if c), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in texts:
            m = 100 - 75 + 75 * sum(c.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in split(text) if w in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(item, rank, d if there else None, -s) for rank, (s, there, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [" ".join(rng.choices([f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(words)], weights, k=rng.randint(1, 40))) for _ in range(n)]


def ranked(spark, tmp_path, rows, items, **more):
    lexical.build(documents(spark, [(d, t, "en", "s") for d, t in rows]), str(tmp_path / "index"), shard_tokens=more.pop("shard_tokens", 200))
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    out = lexical.search(spark, str(tmp_path / "index"), asked, **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("k, block_pairs", [(10, 1 << 20), (3, 8)])
def test_search_equals_brute_force(spark, tmp_path, k, block_pairs):
    """Over several shards and blocks of queries; with ties, repeated rows and ids, nulls, and a very long text."""
    texts = corpus(1, 300)
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (8, "other w1"), (None, texts[3]), (None, None), (900, None), (901, ""), (902, "w1 w2 " * 40_000), (903, texts[5]), (-4, texts[5])]
    items = list(enumerate(corpus(2, 12))) + [(3, "w1 w1 w1 w2é zz"), (50, None), (51, ""), (52, "zz unknown"), (None, "w9 w11")]
    got = ranked(spark, tmp_path, rows, items, k=k, block_pairs=block_pairs)
    brute = brute_search(rows, items, k)
    assert got == brute and len(got) > 30


def test_search_of_nothing(spark, tmp_path):
    assert ranked(spark, tmp_path / "a", [], [(1, "w1")]) == []
    assert ranked(spark, tmp_path / "b", [(1, None), (2, "...")], [(1, "w1")]) == []
    assert ranked(spark, tmp_path / "c", [(1, "w1")], []) == []
    assert ranked(spark, tmp_path / "d", [(1, "w1 w1"), (2, "w2")], [(1, "w1 w1")]) == brute_search([(1, "w1 w1"), (2, "w2")], [(1, "w1 w1")])


def test_terms_and_varints():
    text = "A1-b_ÀÉ x y \x85z Ωμ \x7fq"
    assert [t.decode() for t in lexical.terms_of(text)] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
    values = np.array([0, 1, 127, 128, 300, 1 << 20, (1 << 62) + 5], np.int64)
    blob, sizes = lexical.varints(values)
    assert lexical.numbers(blob.tobytes()).tolist() == values.tolist() and sizes.tolist() == [1, 1, 1, 2, 2, 3, 9]
    assert lexical.numbers(b"").tolist() == []


def test_merge_leaves_lists_out_and_loses_nothing():
    """Many common terms under one rare one: fewer postings are merged than there are, with the same result."""
    rng = np.random.default_rng(3)
    lists = []
    for p, most in [(0.9, 5), (0.8, 7), (0.7, 9), (0.02, 1000), (0.01, 3000)]:
        doc = np.flatnonzero(rng.random(4000) < p)
        lists.append((lexical._List(doc, rng.integers(1, most + 1, len(doc)), 5), 1))
    top = []
    lexical.walk(lists, list(range(4000)), top, 5)
    whole = Counter()
    for x, times in lists:
        for d, a in zip(x.doc, x.adds):
            whole[d] += a * times
    assert sorted(top, reverse=True) == sorted(((s, -d) for d, s in whole.items()), reverse=True)[:5]


# -- divergence of sources -------------------------------------------------------------------------------------------


def brute_audit(rows, least=10, ranks=10):
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    rows = [(split(t), lang or "", source or "") for t, lang, source in rows]
    df, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in rows:
        df[lang].update(set(words))
        count[lang, source].update(words)
        sources[lang].add(source)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, own in sources.items():
        kept = [w for w, n in df[lang].items() if n >= least]
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        p = {s: share(count[lang, s]) for s in own}
        q = share(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(-sum(f(p[s][w], p[t][w]) for w in kept), t.encode(), t) for t in own if t != s]
            terms = [(-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[lang, s][w] > 0 and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("groups_a_block, most", [(4096, 1 << 20), (3, 50)])
def test_audit_equals_brute_force(spark, groups_a_block, most):
    """In one block and in many; with nulls, a source without terms, a language without kept terms, repeated rows and a very long text."""
    texts = corpus(4, 150, 30)
    rng = random.Random(5)
    rows = [(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t), rng.choice(["en", "en", "de"]), rng.choice("abcdef")) for t in texts]
    rows += [(None, "en", "quiet"), ("", None, None), ("only one", "xx", "a"), ("two", "xx", "b"), ("123 .", "en", None), ("wa wb " * 30_000, "en", "a"), rows[0], rows[0]]
    docs = documents(spark, [(i, *r) for i, r in enumerate(rows)])
    out = divergence.audit(docs, groups_a_block=groups_a_block, most=most)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = sorted(map(tuple, out.collect()))
    assert got == brute_audit(rows) and {r[2] for r in got} == {"pair", "term"} and ("xx", "a", "pair", "b", 0, 1) in got


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    assert divergence.audit(documents(spark, [(1, "a b", "en", "s")])).count() == 0


# -- near-duplicates by sketches -------------------------------------------------------------------------------------


def brute_near(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        component = least.get(find(i), doc)
        out.append((doc, len(sets[i]), component, doc is None and component is None or doc == component))
    return sorted(out, key=str)


def edited(rng, words, share):
    return [f"e{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def near_corpus(seed=6):
    """Copies, chains of small edits, edits about the threshold, a passage that many texts share, and short texts."""
    rng = random.Random(seed)
    rows, doc = [], iter(range(10_000))
    passage = [f"p{i}" for i in range(60)]
    for size in (5, 12, 30, 80, 150, 400, 1500):
        base = [f"{size}b{i}" for i in range(size)]
        rows += [(next(doc), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05])))) for _ in range(14)]
        chain = [f"{size}c{i}" for i in range(size)]
        for _ in range(6):
            chain = edited(rng, chain, 0.02)
            rows.append((next(doc), " ".join(chain)))
    rows += [(next(doc), " ".join(passage + [f"{i}x{j}" for j in range(rng.randint(5, 200))])) for i in range(60)]
    rows += [(next(doc), t) for t in ("one", "ONE", "one two", "one  two", "two one", "a b c", "A b c", "a b c d", "", "  \t", None, None, "É b", "é b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """Also with lists and groups cut into many blocks."""
    for f, at in ((minhash.candidate_links, -2), (minhash.exact_links, -2)):
        monkeypatch.setattr(f, "__defaults__", tuple(block if i == len(f.__defaults__) + at else x for i, x in enumerate(f.__defaults__)))
    rows = near_corpus()
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, "null one"), (None, "null one"), (5, "another text of this id"), (20_000, " ".join(f"l{i}" for i in range(100_000))), (20_001, " ".join(f"l{i}" for i in range(95_000)))]
    out = minhash.near_duplicates(documents(spark, [(d, t, "en", "s") for d, t in rows]))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == brute_near(rows)
    assert len({r[2] for r in got}) < len(got) - 60


def test_many_near_copies_are_one_group(spark):
    """Hundreds of edits of one text, by links between edits, and none that isn't one."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.06])))) for i in range(400)]
    got = sorted(map(tuple, minhash.near_duplicates(documents(spark, [(d, t, "", "") for d, t in rows])).collect()), key=str)
    assert got == brute_near(rows)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(documents(spark, [(3, None, "", "")])).collect()] == [(3, 0, 3, True)]


@pytest.mark.parametrize("blocks", [1, 2])
def test_candidates_lose_no_link_and_drop_what_shares_a_passage(blocks):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(500)]
    close = [minhash.shingle_set(" ".join(edited(rng, base, 0.02))) for _ in range(60)]
    apart = [minhash.shingle_set(" ".join(base[:120] + [f"{i}z{j}" for j in range(380)])) for i in range(60)]
    rows = close + apart
    block = np.arange(len(rows)) % blocks
    sketches = [(r[: minhash.RETAINED] >> np.uint64(32)).astype(np.uint32) for r in rows]
    joined = minhash.candidates(np.array([len(r) for r in rows]), sketches, block)
    assert all(a < 60 and b < 60 for a, b in joined)
    exact = minhash.linked(rows, block)
    if blocks == 1:
        assert {x for p in exact for x in p} <= {x for p in joined for x in p} and len(exact) > 30
    else:  # what hangs together within a block isn't said again
        assert 0 < len(joined) < 30


def test_hashes_with_equal_halves_lose_no_link():
    """Two hashes of a sketch that share their upper half count as one there."""
    a = np.arange(1, 41, dtype=np.uint64) << np.uint64(32)
    x = np.sort(np.r_[a, a[:6] + np.uint64(1)])
    y = x[:-4]
    sketches = [(r >> np.uint64(32)).astype(np.uint32) for r in (x, y)]
    assert minhash.candidates(np.array([len(x), len(y)]), sketches, np.zeros(2, int)) == [(0, 1)]
    assert minhash.linked([x, y], np.zeros(2, int)) == [(0, 1)]


def test_bound_of_sketches():
    """A link's union sketch falls under the bound about as rarely as said."""
    assert [minhash.least_shared(k) for k in (0, 1)] == [0, 0]
    rng = np.random.default_rng(1)
    shared = rng.binomial(minhash.RETAINED, 0.85, 2_000_000)
    assert (shared < minhash.least_shared()).sum() == 0 and minhash.least_shared() >= 0.5 * minhash.RETAINED



def test_a_large_group_is_dealt_by_its_rows(spark):
    """The first pass makes two rows of each at most; the second has only what is apart, and what is apart meets all."""
    members = spark.range(4000).selectExpr("0 AS root", "id", "20 AS parts")
    assert minhash._against_first(members, ["root"]).count() < 2 * 4000 * 1.2
    tied = lambda n: spark.range(n).selectExpr("id AS node", "0L AS root")
    assert minhash._still_apart(members, ["root"], tied(4000)).count() == 0
    few = minhash._still_apart(members, ["root"], tied(3990))
    assert few.count() < 4500
    met = {(r["i"], r["j"], r["id"]) for r in few.collect()}
    at = {}
    for i, j, x in met:
        at.setdefault(x, set()).add((i, j))
    assert all(at[x] & at[y] for x in range(3990, 4000) for y in range(4000))
    none = minhash._still_apart(members.where("id < 60").selectExpr("root", "id", "3 AS parts"), ["root"], tied(0))
    at = {}
    for r in none.collect():
        at.setdefault(r["id"], set()).add((r["i"], r["j"]))
    assert all(at[x] & at[y] for x in range(60) for y in range(60))


def phrase_corpus(rng, n):
    """Texts that share a phrase and are apart else, with an edited copy of every fifth."""
    phrase = [f"p{i}" for i in range(14)]
    own = [phrase + [f"{k}z{j}" for j in range(70)] for k in range(n)]
    return [" ".join(w) for w in own] + [" ".join(edited(rng, w, 0.01)) for w in own[::5]]


def listed_rows(spark, monkeypatch, texts):
    """How many rows the two passes deal, and the groups of ``near_duplicates`` over ``texts``."""
    dealt = {"_against_first": 0, "_still_apart": 0}
    for name in dealt:

        def counted(members, key, *more, f=getattr(minhash, name), name=name):
            out = f(members, key, *more)
            dealt[name] += out.count() if key == ["value", "class"] else 0
            return out

        monkeypatch.setattr(minhash, name, counted)
    found = minhash.near_duplicates(documents(spark, [(i, t, "", "") for i, t in enumerate(texts)])).collect()
    monkeypatch.undo()
    return dealt, sorted(map(tuple, found), key=str)


def test_a_phrase_of_many_texts_makes_no_long_lists(spark, monkeypatch):
    """What shares a hash and is apart else meets nowhere, so that nothing grows with the square of its number; edited copies are found."""
    texts = phrase_corpus(random.Random(12), 700)
    dealt, found = listed_rows(spark, monkeypatch, texts)
    assert dealt["_still_apart"] == 0 and dealt["_against_first"] < 2 * len(texts)
    assert found == brute_near(list(enumerate(texts))) and sum(not r[3] for r in found) > 40


def test_lists_with_the_same_members_are_one(spark, monkeypatch):
    texts = [" ".join(f"{k}z{j}" for j in range(60 + more)) for k in range(30) for more in (0, 1)]
    dealt, found = listed_rows(spark, monkeypatch, texts)
    assert dealt["_against_first"] <= 4 * len(texts) and sum(r[3] for r in found) == 30


@pytest.mark.parametrize("numerator", [80, 85, 90])
def test_links_meet_whatever_is_frequent(numerator):
    """Sets of any size, and any hashes taken for frequent: each two that link are in one list."""
    rng = np.random.default_rng(numerator)
    met = 0
    for trial in range(4000):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 62, n))
        gone = int(rng.integers(0, (100 - numerator) * len(a) // 100 + 1))
        b = np.sort(np.r_[rng.permutation(a)[gone:], rng.integers(0, 1 << 62, int(rng.integers(0, 3)))])
        common = len(np.intersect1d(a, b))
        if 100 * common < numerator * (len(a) + len(b) - common):
            continue
        frequent = np.sort(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))])
        x, y = (minhash.listed_of(len(s), s[: minhash.HEADS], frequent, numerator=numerator) for s in (a, b))
        assert len(np.intersect1d(x, y)), (n, gone)
        met += 1
    assert met > 1000
    apart = 1 - numerator / 100
    missed = sum(math.comb(minhash.HEADS, x) * apart**x * (1 - apart) ** (minhash.HEADS - x) for x in range(minhash.least_free(numerator=numerator), minhash.HEADS + 1))
    assert missed <= apart**minhash.LISTED
