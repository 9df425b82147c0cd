"""Quality rules on repetition by suffix arrays (operator 7).

The words of many documents are put behind one another, each numbered apart by
document so that nothing matches across texts, and one suffix array is built by
doubling, going on only with suffixes that aren't told apart yet. The longest
common prefixes of neighbours in the array are found in linear time, in the
order of the text. A suffix repeats over the longer of its two common prefixes,
which is the deepest LCP interval it lies in; the union of these spans is the
union of all maximal repeated substrings.

The base rule looks at words in repeats of five. The verdict looks at the
characters that maximal repeats cover, those of five words or more and those of
ten words or more by themselves, and at the longest repeat of all.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from orrery.llm.common import map_batches

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Words of the shortest repeat that counts.
LEAST_REPEAT = 5
#: Words of a long repeat.
LONG_REPEAT = 10
#: Limits: words of a text at least, percent of words in repeats, share of characters in repeats and in long ones, words of the longest repeat.
LEAST_WORDS, MOST_REPEATED, MOST_COVERED, MOST_COVERED_LONG, MOST_LONGEST = 10, 20, 0.15, 0.10, 100
#: Words whose suffix array is built at once; a longer text has one of its own.
GROUP = 1 << 18


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """The order of all suffixes."""
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    new = np.r_[True, keys[sa[1:]] != keys[sa[:-1]]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        at = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(at) or step >= n:
            return sa
        here = sa[at]
        then = here + step
        second = np.where(then < n, rank[np.minimum(then, n - 1)], -1)
        key = rank[here] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        sa[at], key = here[by], key[by]
        first = np.r_[True, key[1:] != key[:-1]]
        new[at] |= first
        rank[sa[at]] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        step *= 2


def common_prefixes(keys: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each suffix, in the order of the text, with the one before it in the array; the first has none.

    Linear time and memory: from one position to the next a common prefix loses one key at most.
    """
    n = len(keys)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    key = array("q", np.r_[keys, -1].astype(np.int64).tobytes())  # the end is unlike any key
    out = array("q", bytes(8 * n))
    length = 0
    for i, j in enumerate(array("q", before.tobytes())):
        if j < 0:
            length = 0
            continue
        while key[i + length] == key[j + length]:
            length += 1
        if length:
            out[i] = length
            length -= 1
    return np.frombuffer(out, np.int64)


def longest_repeats(keys: np.ndarray) -> np.ndarray:
    """For each position the longest substring from there that is found elsewhere too."""
    if not len(keys):
        return np.zeros(0, np.int64)
    sa = suffix_array(keys)
    lcp = common_prefixes(keys, sa)[sa]
    out = np.empty(len(keys), np.int64)
    out[sa] = np.maximum(lcp, np.r_[lcp[1:], 0])
    return out


def _measured(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each list of words the longest repeat from each word on, and the words' characters."""
    known: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sum(sizes))
    doc = np.repeat(np.arange(len(texts)), sizes)
    length = longest_repeats(doc * (len(known) + 1) + ids)
    chars = np.fromiter((len(w.decode()) for w in known), np.int64, len(known))
    start = 0
    for n in sizes:
        yield length[start : start + n], chars[ids[start : start + n]]
        start += n


def _covered(length: np.ndarray, least: int) -> np.ndarray:
    """The words within repeats of at least so many words."""
    at = np.flatnonzero(length >= least)
    mark = np.zeros(len(length) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + length[at], -1)
    return np.cumsum(mark[:-1]) > 0


def repeats(texts: list[list[bytes]], least: int = LEAST_REPEAT) -> Iterator[tuple[int, int, int]]:
    """For each list of words: words within repeats, characters of those words, and words of the longest repeat."""
    for length, chars in _measured(texts):
        inside = _covered(length, least)
        yield int(inside.sum()), int(chars[inside].sum()), int(length[length >= least].max(initial=0))


def _measures(text: str, words: list[bytes]) -> tuple[int, int, int]:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
    )


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered, covered_long, longest_repeat).

    A null or empty text has no words and fails; repeated rows are judged each;
    an empty table gives an empty one; other columns are left out, whatever
    their names. A text at a limit is kept.
    """

    def judged(held):
        for (doc, text, words), (length, chars) in zip(held, _measured([w for _, _, w in held])):
            n = len(words)
            inside, long = _covered(length, LEAST_REPEAT), _covered(length, LONG_REPEAT)
            word_chars, symbols, dups = _measures(text, words)
            repeated, longest = int(inside.sum()), int(length[length >= LEAST_REPEAT].max(initial=0))
            failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
            covered, covered_long = (int(chars[x].sum()) / word_chars if word_chars else 0.0 for x in (inside, long))
            kept = not failed and covered <= MOST_COVERED and covered_long <= MOST_COVERED_LONG and longest <= MOST_LONGEST
            yield doc, n, word_chars, symbols, dups, repeated, failed, kept, covered, covered_long, longest

    def rows(columns):
        held, size = [], 0
        for doc, text in zip(*columns):
            words = (text or "").encode().split()  # of bytes: blanks are \x20 and \x09-\x0D
            if held and size + len(words) > GROUP:
                yield from judged(held)
                held, size = [], 0
            held.append((doc, text or "", words))
            size += len(words)
        yield from judged(held)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered double, covered_long double, longest_repeat long"
    return map_batches(docs.select(id_col, text_col), rows, schema)


def oracle(levels: int = 20) -> str:
    """DuckDB SQL with the same rows, for texts of fewer than 2^``levels`` words.

    ``w{k}`` has the windows of 2^k words that their text holds twice or more,
    each named after its first place; it is made from pairs in ``w{k-1}``.
    ``best{k}`` has a text's windows of the greatest repeated length that is a
    multiple of 2^k, tried from long to short.
    """
    twice = "SELECT doc_id, pos, name{more} FROM (SELECT doc_id, pos, min(pos) OVER g AS name, count(*) OVER g AS n{more} FROM ({rows}) WINDOW g AS (PARTITION BY doc_id, a, b)) WHERE n > 1"
    steps = ["w0 AS MATERIALIZED (" + twice.format(more="", rows="SELECT doc_id, pos, word AS a, 0 AS b FROM words") + ")"]
    for k in range(1, levels):
        pairs = f"SELECT x.doc_id, x.pos, x.name AS a, y.name AS b FROM w{k - 1} x JOIN w{k - 1} y ON x.doc_id = y.doc_id AND y.pos = x.pos + {1 << k - 1}"
        steps.append(f"w{k} AS MATERIALIZED ({twice.format(more='', rows=pairs)})")
    steps.append(f"best{levels} AS (SELECT doc_id, pos, name, 0 AS size FROM w0 WHERE false)")
    for k in reversed(range(levels)):
        old = f"best{k + 1}"
        pairs = f"SELECT x.doc_id, x.pos, x.name AS a, y.name AS b, x.size + {1 << k} AS size FROM {old} x JOIN w{k} y ON x.doc_id = y.doc_id AND y.pos = x.pos + x.size"
        steps.append(f"longer{k} AS MATERIALIZED ({twice.format(more=', size', rows=pairs)} UNION ALL SELECT doc_id, pos, name, {1 << k} FROM w{k} WHERE doc_id NOT IN (SELECT doc_id FROM {old}))")
        steps.append(f"best{k} AS MATERIALIZED (SELECT * FROM longer{k} UNION ALL SELECT * FROM {old} WHERE doc_id NOT IN (SELECT doc_id FROM longer{k}))")
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), words AS MATERIALIZED (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM texts
), {", ".join(steps)}, fives AS (
  SELECT a.doc_id, a.pos, a.name AS a, b.word AS b FROM w2 a JOIN words b ON a.doc_id = b.doc_id AND b.pos = a.pos + 4
), tens AS (
  SELECT a.doc_id, a.pos, a.name AS a, b.name AS b FROM w3 a JOIN w1 b ON a.doc_id = b.doc_id AND b.pos = a.pos + 8
), inside AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + {LEAST_REPEAT})) AS pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b) AS n FROM fives) WHERE n > 1
), inside_long AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + {LONG_REPEAT})) AS pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b) AS n FROM tens) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM inside JOIN words USING (doc_id, pos) GROUP BY doc_id
), repeated_long AS (
  SELECT doc_id, sum(length(word)) AS chars_long FROM inside_long JOIN words USING (doc_id, pos) GROUP BY doc_id
), longest AS (
  SELECT doc_id, max(size) AS size FROM best0 GROUP BY doc_id
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts
), measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{blank}', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, CASE WHEN length(regexp_replace(text, '{blank}', '', 'g')) > 0
      THEN coalesce(chars, 0)::DOUBLE / length(regexp_replace(text, '{blank}', '', 'g')) ELSE 0.0::DOUBLE END AS covered,
    CASE WHEN length(regexp_replace(text, '{blank}', '', 'g')) > 0
      THEN coalesce(chars_long, 0)::DOUBLE / length(regexp_replace(text, '{blank}', '', 'g')) ELSE 0.0::DOUBLE END AS covered_long,
    CASE WHEN size >= {LEAST_REPEAT} THEN size ELSE 0 END::BIGINT AS longest_repeat
  FROM texts JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN repeated_long USING (doc_id) LEFT JOIN longest USING (doc_id)
)
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND covered <= {MOST_COVERED} AND covered_long <= {MOST_COVERED_LONG} AND longest_repeat <= {MOST_LONGEST} AS kept
FROM measured
"""


ORACLE = oracle()
