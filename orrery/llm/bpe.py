"""BPE encoding and decoding as a bounded-lookahead streaming transducer (operator 1).

All encoding goes through a transducer that takes a text piece by piece and
emits tokens once they are stable. No merge crosses a word's end, so that with
the first character after it all of a word's tokens are; what a whole word
leads to from there is remembered. Within a word that is still open the merge
list has a *sufficient lookahead*, a number L such that a token which ends L or
more symbols before the end of what has been read can't change any more. Such
tokens are emitted at once, and encoding goes on from the first that isn't
stable, so that working memory depends on L and the block, not on the text.

Why L exists: compare a run on a prefix with a run on the whole word. A merge
that only one of the runs applies lost one of its parts to a merge of strictly
earlier rank that overlaps it and reaches further right (or lacks a part that
is built by a merge for which the same holds). Ranks fall along such a chain,
so its reach to the right is bounded, and ``sufficient_lookahead`` adds up the
longest one over the merge list.

Decoding is a state machine that takes ids as they come, keeps an incomplete
UTF-8 sequence until its rest arrives, and gives text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from orrery.llm.common import kept, map_batches

#: Symbols of a word that are read before stable tokens are emitted.
BLOCK = 4096
#: Characters of a text that are taken at a time.
CHUNK = 1 << 18
#: Words remembered by a worker, in each of two generations.
REMEMBERED = 250_000

#: The words of a lower-cased text of Latin-1 characters.
LATIN_WORDS = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Characters that str.split() takes for blanks and the vocabulary's pattern doesn't.
NOT_BLANK = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[\t-\r \x85\xa0  -     　]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[str, str]], end: str = "") -> int:
    """Symbols after a token that decide whether it is stable, for merges in order of rank."""

    def symbols(token: str) -> tuple[str, ...]:
        body = token[: -len(end)] if end and token.endswith(end) else token
        out = list(body)
        if len(body) != len(token):
            out[-1] += end
        return tuple(out)

    reach: dict[str, int] = {}  # of the merge that makes a token
    starts: dict[tuple[str, ...], int] = {}  # proper prefix -> reach of a merge that starts with it
    inside: dict[tuple[str, ...], int] = {}  # infix that isn't final -> the same
    most = 1
    for left, right in merges:
        s = symbols(left + right)
        n = len(s)
        r = max([reach.get(left, 0), reach.get(right, 0), inside.get(s, 0), *(starts.get(s[i:], 0) for i in range(n))])
        reach[left + right] = max(r, reach.get(left + right, 0))
        for j in range(1, n):
            starts[s[:j]] = max(starts.get(s[:j], 0), n - 1 + r)
        for i in range(1, n - 2):
            for j in range(i + 2, n):
                inside[s[i:j]] = max(inside.get(s[i:j], 0), n - 1 + r)
        most = max(most, n + r)
    return most


class Encoder:
    """Encodes as the tokenizers library does for a vocabulary of byte-level BPE with word ends.

    ``encode`` yields ids as little-endian unsigned 32-bit bytes, piece by piece.
    """

    def __init__(self, path: str, block: int = BLOCK, chunk: int = CHUNK):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: list[dict[int, int]] = [{}] * (max(self.vocab.values(), default=-1) + 1)  # by the left part, then the right one: small numbers, none of which needs to be made
        for i, (a, b) in enumerate(self.merges):
            self.rank[self.vocab[a]] = self.rank[self.vocab[a]] or {}
            self.rank[self.vocab[a]][self.vocab[b]] = i
        self.made = [self.vocab[a + b] for a, b in self.merges]
        chars = byte_symbols()
        self.inner = [self.vocab[chars[b]] for b in range(256)]
        self.final = [self.vocab[chars[b] + self.end] for b in range(256)]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")")
        self.special_hint = tuple(x[:2] for x in self.special)
        self.path, self.block, self.chunk = path, block, chunk
        self._lookahead: int | None = None
        self._library = None
        self.young, self.old = Remembered(self), {}

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            self._lookahead = sufficient_lookahead(self.merges, self.end)
        return self._lookahead

    # Words

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a sequence of symbols."""
        if len(ids) > 64:
            return self._merge_long(ids)
        rank, made, none = self.rank, self.made, len(self.made)
        ranks = [rank[a].get(b, none) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank[new].get(ids[i + 1], none)
            if i:
                ranks[i - 1] = rank[ids[i - 1]].get(new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, made, n = self.rank, self.made, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank[ids[i]].get(ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank[ids[i]].get(ids[j]) != r:
                continue
            ids[i], ids[j] = made[r], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (q := rank[ids[i]].get(ids[after[i]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (p := before[i]) >= 0 and (q := rank[ids[p]].get(ids[i])) is not None:
                heapq.heappush(heap, (q, p))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word."""
        b = word.encode()
        if len(b) > self.block:
            stream = WordStream(self)
            return stream.push(b) + stream.close()
        inner = self.inner
        ids = [inner[x] for x in b]
        ids[-1] = self.final[b[-1]]
        return _packed(self.merge(ids))

    def run(self, run: str) -> bytes:
        """The ids of a run without blanks, for runs that ``young`` doesn't have."""
        if (out := self.old.get(run)) is None:
            if run.isalpha() or len(words := LATIN_WORDS.findall(run)) < 2:
                out = self.word(run)
            else:
                out = b"".join(map(self.young.__getitem__, words))
        if len(self.young) >= REMEMBERED:
            self.old, self.young = dict(self.young), Remembered(self)
        if len(run) <= 40:
            self.young[run] = out
        return out

    # Texts

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, part: str) -> list[str]:
        """The words of a part that starts and ends where no character sequence is cut.

        Characters beyond Latin-1 need the library's tables for their forms and classes.
        """
        if _latin(part):
            return LATIN_WORDS.findall(part.lower())
        t = self.library()
        back = self._bytes_of()
        found = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part))
        return [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in found]

    def _bytes_of(self) -> dict[str, int]:
        if not hasattr(self, "_back"):
            self._back = {c: b for b, c in byte_symbols().items()}
        return self._back

    def cut(self, text: str) -> tuple[int, bool]:
        """How much of a text's beginning can be taken whatever follows, and whether a word is open there."""
        n = len(text)
        high = min(n, self.chunk)
        for i in range(min(high, n - 1), max(0, high - 4096), -1):
            if BLANK.match(text, i - 1) and not unicodedata.combining(text[i]):
                return i, False
        if n <= self.chunk:
            return 0, False
        for i in range(high - 1, 4, -1):
            near = text[i - 4 : i + 1]
            kinds = {unicodedata.category(c)[0] for c in near[-2:]}
            if "'" in near or any(0x1100 <= ord(c) < 0x1200 for c in near[-2:]) or "’" in near:
                continue
            if kinds == {"N"}:  # each is a word
                return i, False
            if kinds == {"L"} or kinds <= {"P", "S"}:
                return i, True
        found = BLANK.search(text, high)
        return (found.end(), False) if found and found.end() < n else (0, False)

    def encode(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, null or empty giving none, in pieces that are stable."""
        if not text:
            return
        if any(h in text for h in self.special_hint):
            for piece in self.special_split.split(text):
                if piece in self.special:
                    yield self.special[piece].to_bytes(4, "little")
                else:
                    yield from self._plain(piece)
        else:
            yield from self._plain(text)

    def _plain(self, text: str) -> Iterator[bytes]:
        through = Transducer(self)
        for at in range(0, len(text), self.chunk):
            yield through.push(text[at : at + self.chunk])
        yield through.close()

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(self.encode(text)), "<u4").tolist()


class Remembered(dict):
    """Runs without blanks and their ids."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, run: str) -> bytes:
        return self.encoder.run(run)


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _latin(part: str) -> bool:
    try:
        part.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Transducer:
    """Takes a text without special tokens piece by piece and emits ids once they are stable.

    It holds what has no end yet: the last run of characters, and of a long word
    the symbols that its sufficient lookahead asks for.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.held = encoder, ""
        self.open: WordStream | None = None

    def push(self, text: str) -> bytes:
        self.held = self.held + text if self.held else text
        out = []
        while self.held and (found := self.encoder.cut(self.held))[0]:
            part, self.held = self.held[: found[0]], self.held[found[0] :]
            out.append(self._words(part, found[1]))
        return b"".join(out)

    def close(self) -> bytes:
        part, self.held = self.held, ""
        out = self._words(part, False)
        if self.open:
            out, self.open = out + self.open.close(), None
        return out

    def _words(self, part: str, inside: bool) -> bytes:
        """The ids of a part that ends with a word, or within one if ``inside``."""
        e = self.encoder
        if self.open is None and not inside and _latin(part) and not NOT_BLANK.search(part):
            return b"".join(map(e.young.__getitem__, part.lower().split()))
        words, out = e.words(part), []
        if self.open and words:  # the open word goes on
            out.append(self.open.push(words.pop(0).encode()))
            if words or not inside:
                out.append(self.open.close())
                self.open = None
        last = words.pop() if inside and words else None
        out += map(e.word, words)
        if last is not None:
            self.open = WordStream(e)
            out.append(self.open.push(last.encode()))
        return b"".join(out)


class WordStream:
    """Encodes one word that arrives in pieces, holding back what isn't stable."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.held = encoder, b""

    def push(self, more: bytes) -> bytes:
        out = []
        look = self.encoder.lookahead
        for at in range(0, len(more), self.encoder.block):
            self.held += more[at : at + self.encoder.block]
            if len(self.held) >= self.encoder.block + look:
                out.append(self._emit(len(self.held) - 1 - look))
        return b"".join(out)

    def _emit(self, upto: int) -> bytes:
        """Tokens that end at ``upto`` or before; the last symbol stays, as it may be the word's end."""
        e = self.encoder
        ids = e.merge([e.inner[b] for b in self.held[:-1]])
        ends = np.cumsum([e.length(i) for i in ids])
        stable = int(np.searchsorted(ends, upto, side="right"))
        if stable:
            self.held = self.held[int(ends[stable - 1]) :]
        return _packed(ids[:stable])

    def close(self) -> bytes:
        e, b = self.encoder, self.held
        self.held = b""
        return _packed(e.merge([*(e.inner[x] for x in b[:-1]), e.final[b[-1]]])) if b else b""


def _length(self: Encoder, token: int) -> int:
    """Symbols of a token."""
    if not hasattr(self, "_lengths"):
        self._lengths = {i: len(t) - len(self.end) * t.endswith(self.end) if self.end else len(t) for t, i in self.vocab.items()}
    return self._lengths[token]


Encoder.length = _length


class Decoder:
    """Ids to text as they come; an incomplete UTF-8 sequence waits for its rest.

    ``raw`` gives the tokens' own strings, separated by blanks, as a library
    without a decoder does; else bytes and word ends are restored to text.
    """

    def __init__(self, encoder: Encoder, raw: bool = True):
        back = encoder._bytes_of()
        end = encoder.end
        self.table: dict[int, bytes] = {}
        for token, i in [*encoder.vocab.items(), *encoder.special.items()]:
            if raw or token in encoder.special:
                self.table[i] = token.encode()
            else:
                body = token[: -len(end)] if end and token.endswith(end) else token
                self.table[i] = bytes(back[c] for c in body) + b" " * (len(body) != len(token))
        self.glue = b" " if raw else b""
        self.reset()

    def reset(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, ids: list[int]) -> str:
        """The text that these ids complete; unknown ids give nothing."""
        try:
            b = self.glue.join(map(self.table.__getitem__, ids))
        except KeyError:
            b = self.glue.join(self.table[i] for i in ids if i in self.table)
        if not b:
            return ""
        if self.begun:
            b = self.glue + b
        self.begun = True
        return self.state.decode(b)

    def close(self) -> str:
        out = self.state.decode(b"", final=True)
        self.reset()
        return out


def ready(path: str) -> tuple[Encoder, Decoder]:
    """A worker's encoder and decoder, kept between tasks."""

    def made() -> tuple[Encoder, Decoder]:
        e = Encoder(path)
        return e, Decoder(e)

    return kept("bpe", path, made)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary): each whole text's ids, little-endian unsigned 32-bit.

    A null or empty text has no ids; rows with a null id stay; repeated rows are
    encoded each; other columns are left out, whatever their names.
    """

    def rows(columns):
        encoder, _ = ready(path)
        for doc, text in zip(*columns):
            b = b"".join(encoder.encode(text))
            yield doc, len(b) // 4, b

    return map_batches(docs.select(id_col, text_col), rows, "doc_id long, n_tokens long, ids binary", most=256, keeps="bpe")


def decode(encoded: DataFrame, path: str, raw: bool = True) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids binary); null ids give an empty text."""

    def rows(columns):
        encoder, _ = ready(path)
        decoder = Decoder(encoder, raw)
        for doc, b in zip(*columns):
            yield doc, "".join(decoder.push(x) for x in _id_lists(b)) + decoder.close()

    return map_batches(encoded.select("doc_id", "ids"), rows, "doc_id long, text string", most=256, keeps="bpe")


def _id_lists(b: bytes | None, step: int = 1 << 16) -> Iterator[list[int]]:
    a = np.frombuffer(b or b"", "<u4")
    for at in range(0, len(a), step):
        yield a[at : at + step].tolist()


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the number of ids, and SHA-256 of the ids and of the text decoded from them.

    Ids pass from the encoder to both hashes as they become stable; nothing
    else of a document is kept. Nulls, empty texts, repeated rows and other
    columns are treated as in ``encode``.
    """

    def rows(columns):
        encoder, decoder = ready(path)
        for doc, text in zip(*columns):
            n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
            for piece in encoder.encode(text):
                n += len(piece) // 4
                ids.update(piece)
                for some in _id_lists(piece):
                    back.update(decoder.push(some).encode())
            back.update(decoder.close().encode())
            yield doc, n, ids.hexdigest(), back.hexdigest()

    return map_batches(docs.select(id_col, text_col), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps="bpe")
