"""SimHash components and line dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from orrery.llm import common, linededup, simhash
from orrery.llm import components as rounds
from orrery.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_one_row_of_each_group_stays(spark, monkeypatch):
    """Ids that stand on several texts: no row goes for another one's sake, and of repeated rows one stays."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(1, text("a"), "x"), (5, text("a"), "x"), (5, text("b"), "x"), (7, text("b"), "x"), (5, text("c"), "x"), (8, text("c"), "x"), (9, text("d"), "x"), (9, text("d"), "x"),
            (None, text("a"), "x"), (None, text("e"), "x"), (10, None, "x"), (11, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    want = sorted([rows[i] for i in (0, 2, 4, 6, 8, 9, 10)], key=str)
    assert sorted(map(tuple, simhash.without_near_duplicates(docs).collect()), key=str) == want
    monkeypatch.setattr(common.without, "__defaults__", (False, 0))  # by shuffle, as beyond the limit
    left = simhash.without_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == want


def test_masks_cover():
    rng = random.Random(0)
    masks = simhash.masks()
    assert len(masks) == 15
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", " \t", "One", "ONE two", "É é x y", "word " * 50_000]
    for _ in range(20):
        base = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        texts += [" ".join(base), " ".join(base).upper(), " ".join(base + ["tail"]), " ".join(base[:-1] + ["end"])]
    ids = rng.sample(range(1000), len(texts))
    rows = [(i, t, "x") for i, t in zip(ids, texts)] + [(ids[0], texts[0], "x"), (None, "unlike any other text here", "x")]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()), key=str)
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    roots = roots_of(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    want = []
    for (doc, _, _), f, r in zip(rows, prints, roots):
        members = [d for (d, _, _), s in zip(rows, roots) if s == r and d is not None]
        want.append((doc, f"{f:016x}", min(members) if members else None))
    assert got == sorted(want, key=str)
    assert len({g[2] for g in got}) < len(got) - 10


@pytest.mark.parametrize("block", [3, 512])
def test_links_of_a_large_bucket(spark, block):
    """Hundreds of fingerprints within few bits of each other, in pieces of any size, and no more links than members."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre}
    for _ in range(250):
        x = centre
        for b in rng.sample(range(64), rng.choice([1, 2, 4])):
            x ^= 1 << b
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(simhash.signed(v) for v in values)
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), block=block)
    root = dict(components(links).collect())
    mask = (1 << 64) - 1
    want = roots_of(values, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    assert [root.get(v, v) for v in values] == [values[r] for r in want]


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(1)
    order = rng.sample(range(100), 60)
    edges = list(zip(order, order[1:])) + [(500, 500 + i) for i in range(80)] + [(7000, 7000), (500, 501)]
    rng.shuffle(edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {v for k, v in got.items() if k < 100} == {min(order)} and {v for k, v in got.items() if k >= 500} == {500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_roots(edges):
    root = {v: v for e in edges for v in e}
    while True:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_components_of_links_that_tasks_see_apart(spark, monkeypatch):
    rng = random.Random(2)
    order = rng.sample(range(-40, 40), 50)
    edges = list(zip(order, order[1:])) + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, 300 + i) for i in range(1, 40)]
    edges = [e for e in edges if e[0] != e[1]]
    rng.shuffle(edges)
    links = spark.createDataFrame([*edges, *edges[:9], (None, 1), (1, None)], "a long, b long")
    monkeypatch.setattr(rounds, "TIED", 2)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "2")
    try:
        got = components(links.repartition(12)).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted(map(tuple, got)) == sorted(brute_roots(edges).items())


def test_components_of_a_large_group_take_few_steps(spark, monkeypatch):
    """Each step is a job over all shuffle partitions, whatever it holds: with a mark that must stay for a round it took 9 at least."""
    rng = random.Random(3)
    stars = [(m, x) for _ in range(40) for m in [rng.randrange(2000)] for x in rng.sample(range(2000), 100) if x != m]
    steps = []

    def counted(df, *more, f=common.written):
        steps.append(1)
        return f(df, *more)

    monkeypatch.setattr(rounds, "written", counted)
    got = components(spark.createDataFrame(stars, "a long, b long").repartition(40)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_roots(stars).items())
    assert len(steps) <= 8


LINE = "  A line of well over forty characters number {}\t"


def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    held = {}
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(doc)
    keep = {k: max((d for d in ds if d is not None), default=None) for k, ds in held.items() if len(ds) >= 5}
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keep or keep[key(x)] == doc]
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


def line_rows():
    rng = random.Random(6)
    rows = [(None, LINE.format(0)), (900, None), (901, ""), (902, "\n\n"), (903, LINE.format(1) + "\n" + LINE.format(1).upper()), (903, LINE.format(1))]
    for doc in range(60):
        rows.append((doc, "\n".join(LINE.format(rng.randrange(12)) if rng.random() < 0.7 else f"short {rng.randrange(3)}" for _ in range(rng.randint(1, 6))) + rng.choice(["", "\r", "\x85"])))
    return rows


def test_line_dedup_against_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, drop string").repartition(5)
    want = sorted(((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in brute_lines(rows)), key=str)
    assert sorted(map(tuple, linededup.digests(docs).collect()), key=str) == want
    assert sum(w[2] for w in want) > 50
    texts = sorted(((d, t) for d, _, _, t in brute_lines(rows)), key=str)
    got = linededup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted(((r[0], r[1] or "") for r in got.collect()), key=str) == texts
    assert linededup.digests(docs.limit(0)).count() == 0
    # by join, as where more keys repeat than are sent to all tasks
    assert sorted(map(tuple, linededup.digests(docs, most_keys=0).collect()), key=str) == want
    joined = linededup.dedup_lines(docs, most_keys=0)
    assert joined.columns == docs.columns and sorted(((r[0], r[1] or "") for r in joined.collect()), key=str) == texts
    clashing = docs.toDF("__id", "__drop", "__key0")
    assert linededup.dedup_lines(clashing, "__id", "__drop", most_keys=0).columns == clashing.columns
    # a filter that is full makes all lines suspects and changes nothing
    assert sorted(map(tuple, linededup.digests(docs, most_bits=6).collect()), key=str) == want


def test_filters_hold_every_key_seen_twice():
    rng = np.random.default_rng(0)
    once, twice = rng.integers(0, 2**63, 2000, dtype=np.uint64), rng.integers(0, 2**63, 500, dtype=np.uint64)
    f = linededup.Filters(1 << 17)
    f.add(np.r_[once, twice])
    f.add(twice[:250])
    f.add(np.r_[twice[250:], twice[250:]])
    assert linededup.holds(f.twice, twice).all()
    assert linededup.holds(f.twice, once).mean() < 0.05
