"""Records from HTML by CSS selectors that are data: what is an item, and where its fields are within it.

Selectors may have tags, ``*``, ``.class``, ``#id``, ``[name]``, ``[name=value]``, ``[name^=start]``, descendants (a blank),
children (``>``) and alternatives (``,``). Each becomes a row of steps; while a page is parsed, once, every open element has the
set of steps that it fulfils, from which those of its children follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.sources.shared import dealt, slices

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_WORD = re.compile(r">|(?:\[[^\]]*\]|[^\s>\[])+")
_SIMPLE = re.compile(r"(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:[.#][\w-]+|\[[^\]]*\])*)")
_PART = re.compile(r"""[.#][\w-]+|\[\s*([\w:-]+)\s*(?:(\^?=)\s*["']?([^"'\]]*)["']?\s*)?\]""")


@dataclass(frozen=True)
class Step:
    """One element of a selector; ``child`` says that it stands right under the one before."""

    tag: str | None
    classes: frozenset[str]
    id: str | None
    attributes: tuple[tuple[str, str, str], ...]
    child: bool

    def fits(self, tag: str, attributes: dict[str, str]) -> bool:
        if self.tag not in (None, tag) or self.id is not None and attributes.get("id") != self.id:
            return False
        if not self.classes <= set(attributes.get("class", "").split()):
            return False
        return all(n in attributes and (not op or attributes[n] == v if op != "^=" else attributes[n].startswith(v)) for n, op, v in self.attributes)


def compiled(selector: str) -> list[tuple[Step, ...]]:
    """The alternatives of a selector, each a row of steps; an error for what isn't one."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, child = [], False
        if _WORD.sub("", alternative).strip():
            raise ValueError(f"no selector: {selector!r}")
        for word in _WORD.findall(alternative):
            if word == ">":
                child = True
                continue
            m = _SIMPLE.fullmatch(word)
            if not m or not word:
                raise ValueError(f"no selector: {selector!r}")
            parts = list(_PART.finditer(m["rest"]))
            if "".join(p[0] for p in parts) != m["rest"]:
                raise ValueError(f"no selector: {selector!r}")
            names = [p[0] for p in parts if p[0][0] != "["]
            steps.append(Step(
                None if m["tag"] in (None, "*") else m["tag"].lower(), frozenset(n[1:] for n in names if n[0] == "."), next((n[1:] for n in names if n[0] == "#"), None),
                tuple((p[1].lower(), p[2] or "", p[3] or "") for p in parts if p[0][0] == "["), child,
            ))
            child = False
        if not steps or child:
            raise ValueError(f"no selector: {selector!r}")
        out.append(tuple(steps))
    return out


class Matcher:
    """Follows some selectors, given by name, through a tree; ``open`` says which of them an element fulfils."""

    def __init__(self, selectors: dict[str, list[tuple[Step, ...]]]):
        self.rows = [(name, steps) for name, alternatives in selectors.items() for steps in alternatives]
        self.stack: list[tuple[frozenset, frozenset]] = [(frozenset(), frozenset())]

    def open(self, tag: str, attributes: dict[str, str]) -> set[str]:
        parent, above = self.stack[-1]
        own, found = set(), set()
        for r, (name, steps) in enumerate(self.rows):
            for i, step in enumerate(steps):
                if (i == 0 or (r, i - 1) in (parent if step.child else above)) and step.fits(tag, attributes):
                    own.add((r, i))
                    if i == len(steps) - 1:
                        found.add(name)
        self.stack.append((frozenset(own), above | own))
        return found

    def close(self) -> None:
        self.stack.pop()


class Rule:
    """An item's selector and its fields', read once for all pages."""

    def __init__(self, item: str, fields: dict[str, str]):
        self.item = compiled(item)
        self.attribute = {f: s.partition("@")[2] for f, s in fields.items()}
        self.inner = {f: compiled(s.partition("@")[0]) for f, s in fields.items() if s.partition("@")[0]}
        self.own = [f for f in fields if f not in self.inner]  # of the item itself


class Reader(HTMLParser):
    """The records of one page. A field is the text of its first element within the item, or with ``selector@name`` an attribute."""

    def __init__(self, rule: Rule):
        super().__init__(convert_charrefs=True)
        self.attribute, self.inner, self.own = rule.attribute, rule.inner, rule.own
        self.items = Matcher({"item": rule.item})
        self.records: list[dict[str, str | list[str] | None]] = []
        #: For each open element its tag, the record that it opens, and the (record, field) whose text it holds.
        self.opened: list[tuple[str, int | None, list[tuple[int, str]]]] = []
        self.inside: dict[int, Matcher] = {}

    def _take(self, record: int, field: str, attributes: dict[str, str], holds: list) -> None:
        if self.records[record][field] is None:
            if name := self.attribute[field]:
                self.records[record][field] = attributes.get(name)
            else:
                self.records[record][field] = []
                holds.append((record, field))

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        if tag == "br":
            self.handle_data("\n")
        holds: list[tuple[int, str]] = []
        for record, matcher in self.inside.items():
            for field in matcher.open(tag, attributes):
                self._take(record, field, attributes, holds)
        opens = None
        if self.items.open(tag, attributes):
            opens = len(self.records)
            self.records.append(dict.fromkeys(self.attribute))
            for field in self.own:
                self._take(opens, field, attributes, holds)
            self.inside[opens] = Matcher(self.inner)
        self.opened.append((tag, opens, holds))
        if tag in VOID:
            self._close()

    def _close(self) -> None:
        _, opens, _ = self.opened.pop()
        self.items.close()
        if opens is not None:
            del self.inside[opens]
        for matcher in self.inside.values():
            matcher.close()

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.opened):  # elements that were left open end with it
            while self.opened:
                last = self.opened[-1][0]
                self._close()
                if last == tag:
                    return

    def handle_data(self, data):
        for _, _, holds in self.opened:
            for record, field in holds:
                self.records[record][field].append(data)


def records(html: str | None, item: str, fields: dict[str, str], rule: Rule | None = None) -> list[dict[str, str | None]]:
    """The items of a page in their order; texts without blanks at their ends, null for fields that aren't there. ``rule`` has the selectors read."""
    reader = Reader(rule or Rule(item, fields))
    reader.feed(html or "")
    reader.close()
    return [{f: "".join(v).strip() if isinstance(v, list) else v for f, v in r.items()} for r in reader.records]


def selected(pages: DataFrame, item: str, fields: dict[str, str], keep: list[str] = ()) -> DataFrame:
    """(columns in ``keep``, at, and a text for each field) of every item of pages (html); a null or broken page has what can be read of it."""
    rule = Rule(item, fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole)):
            found = [(i, at, r) for i, html in enumerate(batch.column(0).to_pylist()) for at, r in enumerate(records(html, item, fields, rule))]
            rest = [batch.column(c + 1).take(pa.array([i for i, _, _ in found], pa.int64())) for c in range(len(keep))]
            columns = [pa.array([at for _, at, _ in found], pa.int32()), *(pa.array([r[f] for _, _, r in found], pa.string()) for f in fields)]
            yield pa.RecordBatch.from_arrays([*rest, *columns], names=[*keep, "at", *fields])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*keep).schema) if keep else ""
    return dealt(pages.select("html", *keep)).mapInArrow(run, kinds + "at int, " + ", ".join(f"`{f}` string" for f in fields))
