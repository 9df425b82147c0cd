"""Secret scan: keyword automaton, anchored patterns near its hits, checksums (operator 5).

One Aho-Corasick pass over a text finds keywords; a pattern is tried only where
its keyword stands. Kinds with a checksum of their own are kept only if it
holds. Runs of hexadecimal digits have no keyword and are found by their class.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from orrery.llm.common import map_batches

BASE = ("assign", "access", "hex")
#: Kinds that the method adds, in the order in which they are listed after the base ones.
MORE = ("github", "jwt", "npm", "pem")
HEX = re.compile("[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _assigned(m: re.Match) -> bool:
    return m.end(2) - m.start(2) >= 6


def _long_key(m: re.Match) -> bool:
    return m.end() - m.start() >= 20


def _crc_holds(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of those before them, in base 62."""
    body, check, n = m[1], m[2], 0
    for c in check:
        n = n * 62 + BASE62.index(c)
    return zlib.crc32(body.encode()) == n


def _is_jwt(m: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (binascii.Error, ValueError):
        return False
    return isinstance(head, dict) and "alg" in head


def _is_pem(m: re.Match) -> bool:
    """The body is base64 of a DER sequence or of an OpenSSH key."""
    try:
        body = base64.b64decode("".join(m[2].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    return body[:1] == b"\x30" or body.startswith(b"openssh-key-v1")


#: Kind -> keywords in lower case, pattern anchored at the keyword, check.
RULES = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), _assigned),
    "access": (("akia",), re.compile("AKIA[A-Z0-9]+"), _long_key),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_holds),
    "jwt": (("eyj",), re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"), _is_jwt),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), _crc_holds),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"), _is_pem),
}

#: Kind -> what a match's first part is a run of, and what must stand after the run: where it doesn't, no keyword in the run is one.
RUNS = {"jwt": (re.compile("[A-Za-z0-9_-]*"), re.compile(r"\.[A-Za-z0-9_-]+\."))}

_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, (words, _, _) in RULES.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; within a kind leftmost matches don't overlap."""
    if not text:
        return []
    spans = [("hex", *m.span()) for m in HEX.finditer(text)]
    lower = text.lower()
    if len(lower) != len(text):  # one capital letter becomes two characters
        lower = text.replace("İ", "I").lower()
    passed = dict.fromkeys(RULES, 0)
    for last, (kind, size) in automaton().iter(lower):
        start = last + 1 - size
        if start < passed[kind]:
            continue
        _, pattern, holds = RULES[kind]
        if kind in RUNS:
            run, after = RUNS[kind]
            end = run.match(text, start).end()
            if not after.match(text, end):
                passed[kind] = end  # each run is read once, however many keywords it holds
                continue
        if m := pattern.match(text, start):
            passed[kind] = m.end()
            if holds(m):
                spans.append((kind, *m.span()))
    order = {k: i for i, k in enumerate(BASE + MORE)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row.

    A null or empty text has no spans; repeated rows are scanned each; an empty
    table gives an empty one. Texts are scanned whole, in time that follows their
    length. Other columns are left out, whatever their names.
    """

    def rows(columns) -> Iterator[tuple]:
        for doc, text in zip(*columns):
            spans = find(text)
            base = [s for s in spans if s[0] in BASE]
            counts = [sum(s[0] == k for s in base) for k in BASE]
            yield doc, *counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)

    return map_batches(docs.select(id_col, text_col), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
