"""Encoding, decoding and token files against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orrery.llm import bpe, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", " ", "Hello wörld <|endoftext|> x's 日本 ΑΣ ½ 12 don't I'LL <|x \x1c\x85\xa0 éà İI ﬁ", "the" * 4000, "'s" * 2000 + "x", "***'''" * 700, "日本" * 900, "éà" * 1500,
    "ab cd " * 1000, "12" * 900, "ΣΑΣ " * 5 + "Σ" * 900, "각" * 500, "🙂🙂 ok" * 300, "à́ " * 400, "<|startoftext|><|endoftext|", "a b　c",
]


@pytest.fixture(scope="module")
def encoders():
    small = bpe.Encoder(PATH, block=50, chunk=300)
    return bpe.Encoder(PATH), small


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def random_texts(n=150):
    rng = random.Random(1)
    return ["".join(rng.choice(rng.choice(["ab", "the ", "in'st", "aeiounrtsl", "*#'s a", "éàé b", "日本a ' "])) for _ in range(rng.randint(1, 2500))) for _ in range(n)]


def test_ids_equal_the_library(encoders):
    for text in ODD + random_texts():
        for e in encoders:
            assert e.ids(text) == ids(text), text[:40]


def test_long_words_stream(encoders):
    rng = random.Random(3)
    for alphabet in ("ab", "thein", "aeiounrtsl"):
        text = "".join(rng.choice(alphabet) for _ in range(30_000))
        stream = bpe.WordStream(encoders[0])
        first = stream.push(text.encode())
        assert first and len(stream.held) <= encoders[0].lookahead + 2 * bpe.BLOCK
        assert np.frombuffer(first + stream.close(), "<u4").tolist() == ids(text)


def test_the_transducer_emits_before_the_end(encoders, spark, monkeypatch):
    """Whole words with the next run, and parts of a long word by lookahead; also on the way that the registered query takes."""
    e = encoders[0]
    through = bpe.Transducer(e)
    out = through.push("Hello there, it's a lo")
    assert np.frombuffer(out, "<u4").tolist() == ids("Hello there, it's a") and through.held == "lo"
    out += through.push("ng day") + through.close()
    assert np.frombuffer(out, "<u4").tolist() == ids("Hello there, it's a long day")
    rng = random.Random(2)
    for alphabet in ("aeiounrtsl", "*#", "0123456789", "日本語"):
        text = "".join(rng.choice(alphabet) for _ in range(40_000))
        for encoder in encoders:
            through, early = bpe.Transducer(encoder), b""
            for at in range(0, len(text), 777):
                early += through.push(text[at : at + 777])
                assert len(through.held) <= encoder.chunk + 777 and (through.open is None or len(through.open.held) <= encoder.lookahead + 2 * encoder.block + 4 * encoder.chunk)
            if encoder is encoders[1]:
                assert len(early) > 4 * 1000
            assert np.frombuffer(early + through.close(), "<u4").tolist() == ids(text)
    seen = []
    push = bpe.WordStream._emit
    monkeypatch.setattr(bpe.WordStream, "_emit", lambda self, upto: seen.append(out := push(self, upto)) or out)
    whole = "".join(rng.choice("aeiounrtsl") for _ in range(600_000))
    pieces = list(e.encode(whole))
    assert len(pieces) > 2 and any(seen) and any(pieces[:-1]) and np.frombuffer(b"".join(pieces), "<u4").tolist() == ids(whole)


def test_memory_stays_flat_over_a_long_text(encoders):
    """A hundred megabytes pass through; what is held doesn't grow."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiounrtsl") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    piece = " ".join(rng.choice(words) for _ in range(1 << 15))
    through = bpe.Transducer(encoders[0])
    through.push(piece + " ")
    done = most = 0
    while done < 100_000_000:
        through.push(piece + " ")
        done += len(piece) + 1
        most = max(most, len(through.held))
    tracemalloc.start()
    for _ in range(10):
        through.push(piece + " ")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 and peak < 32_000_000


def test_lookahead_of_small_merge_lists():
    """Tokens that end so far before the end of a prefix stay, whatever follows."""
    rng = random.Random(7)
    for _ in range(60):
        tokens, merges = list("ab"), []
        for _ in range(rng.randint(1, 6)):
            pair = rng.choice(tokens), rng.choice(tokens)
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        look = bpe.sufficient_lookahead(merges)

        def encode(word):
            out = list(word)
            for a, b in merges:
                i = 0
                while i < len(out) - 1:
                    if (out[i], out[i + 1]) == (a, b):
                        out[i : i + 2] = [a + b]
                    i += 1
            return out

        word = "".join(rng.choice("ab") for _ in range(200))
        whole = np.cumsum([len(t) for t in encode(word)]).tolist()
        for n in range(1, 200, 7):
            stable = [e for e in np.cumsum([len(t) for t in encode(word[:n])]).tolist() if e <= n - look]
            assert stable == whole[: len(stable)]


def test_decoding(encoders):
    decoder = bpe.Decoder(encoders[0])
    for text in ODD + random_texts(30):
        got = "".join(decoder.push([i]) for i in ids(text)) + decoder.close()
        assert got == LIBRARY.decode(ids(text), skip_special_tokens=False)
    plain = bpe.Decoder(encoders[0], raw=False)
    assert "".join(plain.push([i]) for i in ids("日本 wörld <|endoftext|>")) + plain.close() == "日本 wörld <|endoftext|>"
    assert decoder.push([10**6]) + decoder.close() == ""


ROWS = [(1, "Hello there", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello there", "x"), (None, "null id", "x"), (4, "word " * 30_000, "x")]
KIND = "doc_id long, text string, n_tokens string"


def test_digests_and_edge_rows(spark):
    docs = spark.createDataFrame(ROWS, KIND)
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for doc, text, _ in ROWS:
        i = ids(text or "")
        want.append((doc, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(i, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    back = {r[0]: r[1] for r in bpe.decode(bpe.encode(docs, PATH), PATH, raw=False).collect()}
    assert back[1] == "hello there " and back[2] == "" and back[None] == "null id "


def test_token_files_of_a_whole_table(spark, tmp_path):
    """Every row against the library, from shuffled rows in many partitions, in many blocks."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tokenfile.write(rows.repartition(17, F.xxhash64("text")), PATH, str(tmp_path / "t"))
    got = sorted(map(tuple, tokenfile.read_all(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc, text in sorted(map(tuple, rows.collect())):
        i = [*ids(text or ""), 2]
        want.append((doc, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert got == want and len(got) >= 200


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, KIND).repartition(3)
    tokenfile.write(docs, PATH, str(tmp_path / "t"))
    got = sorted(map(tuple, tokenfile.read_all(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        i = [*ids(text or ""), 2]
        want.append((doc, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert got == want
    assert list(tokenfile.read_document(spark, str(tmp_path / "t"), 4)) == [[*ids("word " * 30_000), 2]]
    assert len(list(tokenfile.read_document(spark, str(tmp_path / "t"), 1))) == 2
    data = bytes(spark.read.parquet(str(tmp_path / "t/blocks")).first()["data"])
    with pytest.raises(ValueError):
        tokenfile.Block(data, b"another dictionary")
    tokenfile.write(docs.limit(0), PATH, str(tmp_path / "e"))
    assert tokenfile.read_all(spark, str(tmp_path / "e")).count() == 0


def test_merges_are_looked_up_by_small_numbers():
    """Ranks by left and right part say what the merge list says, for short words and long ones."""
    import public_tokenizers

    from orrery.llm import bpe

    e = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(map(len, {id(d): d for d in e.rank}.values())) == len({(a, b) for a, b in e.merges})
    assert all(e.rank[e.vocab[a]][e.vocab[b]] == i for i, (a, b) in list(enumerate(e.merges))[::97])
    for word in ("understanding", "x", "erreouti", "fürscheräch" * 9):
        b = word.encode()
        ids = [*(e.inner[x] for x in b[:-1]), e.final[b[-1]]]
        assert e.merge(list(ids)) == e._merge_long(list(ids)) == e.library().encode(word, add_special_tokens=False).ids
