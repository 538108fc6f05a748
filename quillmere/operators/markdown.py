"""Markdown of answers as nested blocks, and lines of it as inline spans.

A text is cut at its code fences first, whose contents are never looked at again. Every other line has a kind by a table of
patterns; blocks are runs of lines, which each kind opens, goes on with and closes by its own rule. Both work on Arrow batches, text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_S = T.StringType()
#: Columns of a block and of a span; those that a kind doesn't have are null.
BLOCK = T.StructType([T.StructField(n, t) for n, t in (
    ("type", _S), ("level", T.IntegerType()), ("text", _S), ("ordered", T.BooleanType()), ("items", T.ArrayType(_S)), ("headers", T.ArrayType(_S)), ("rows", T.ArrayType(T.ArrayType(_S))),
    ("code", _S), ("language", _S), ("path", _S), ("line", T.IntegerType()), ("url", _S),
)])
SPAN = T.StructType([T.StructField(n, _S) for n in ("type", "text", "href")])

#: What makes a line of a kind, in the order of precedence.
KINDS = (
    ("blank", re.compile(r"^\s*$")),
    ("rule", re.compile(r"^\s*(?:---+|\*\*\*+|___+)\s*$")),
    ("heading", re.compile(r"^(#{1,3})\s+(.*)$")),
    ("bullet", re.compile(r"^\s*[-*+]\s+(.*)$")),
    ("number", re.compile(r"^\s*\d+[.)]\s+(.*)$")),
    ("quote", re.compile(r"^\s*>\s?(.*)$")),
)
ROW = re.compile(r"^\s*\|(.+)\|\s*$")
DIVIDER = re.compile(r"^\s*\|?[\s:-]*[-]{2,}[\s:|-]*\|?\s*$")
FENCE = re.compile(r"(?:\*\*`([^`]+)`\*\*(?:[^\n]*?\[open on GitHub\]\(([^)]+)\))?[^\n]*\n+)?```([A-Za-z0-9_+-]*)\n([\s\S]*?)```")
#: Inline spans in the order of precedence; code before emphasis, so that its marks stay literal.
SPANS = (
    ("code", r"`([^`]+)`"),
    ("link", r"\[([^\]]+)\]\(([^)]+)\)"),
    ("bold", r"\*\*([^*]+)\*\*"),
    ("bold", r"__([^_]+)__"),
    ("italic", r"\*([^*\n]+)\*"),
    ("italic", r"_([^_\n]+)_"),
    ("mention", r"(?:(?<=\s)|(?<![\s\S]))(@[a-zA-Z][A-Za-z0-9_-]*)"),
)
_INLINE = re.compile("|".join(f"(?P<s{i}>{p})" for i, (_, p) in enumerate(SPANS)))

def _block(kind: str, **values) -> dict:
    return dict.fromkeys(BLOCK.names) | {"type": kind} | values


def _cells(line: str) -> list[str]:
    inner = line.strip()
    return [c.strip() for c in inner[inner.startswith("|") : len(inner) - (len(inner) > 1 and inner.endswith("|"))].split("|")]


class Lines:
    """A run over the lines of one segment; each opener takes what belongs to its block and leaves the rest."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at = 0

    def kind(self) -> tuple[str, re.Match | None]:
        line = self.lines[self.at]
        for name, pattern in KINDS[:3]:
            if found := pattern.match(line):
                return name, found
        if self.row(self.at) and self.at + 1 < len(self.lines) and DIVIDER.match(self.lines[self.at + 1]):
            return "table", None
        return next(((name, found) for name, pattern in KINDS[3:] if (found := pattern.match(line))), ("text", None))

    def row(self, at: int) -> bool:
        return at < len(self.lines) and ROW.match(self.lines[at]) is not None

    def run(self, name: str) -> list[str]:
        """The bodies of the lines from here that are of that kind, whatever else they may be."""
        pattern, out = dict(KINDS)[name], []
        while self.at < len(self.lines) and (found := pattern.match(self.lines[self.at])):
            out.append(found[1])
            self.at += 1
        return out

    def table(self) -> dict:
        head = _cells(self.lines[self.at])
        self.at += 2
        first = self.at
        while self.row(self.at):
            self.at += 1
        return _block("table", headers=head, rows=[_cells(x) for x in self.lines[first : self.at]])

    def blocks(self) -> Iterator[dict]:
        held: list[str] = []
        while self.at < len(self.lines):
            name, found = self.kind()
            if name == "text":
                held.append(self.lines[self.at])
                self.at += 1
                continue
            if paragraph := "\n".join(held).strip():
                yield _block("paragraph", text=paragraph)
            held = []
            if name == "table":
                yield self.table()
            elif name in ("bullet", "number"):
                yield _block("list", ordered=name == "number", items=[x.strip() for x in self.run(name)])
            elif name == "quote":
                yield _block("quote", text="\n".join(self.run(name)).strip())
            else:
                self.at += 1
                if name == "heading":
                    yield _block("heading", level=len(found[1]), text=found[2].strip())
                elif name == "rule":
                    yield _block("rule")
        if paragraph := "\n".join(held).strip():
            yield _block("paragraph", text=paragraph)


def _fenced(found: re.Match) -> dict:
    head, url, language, code = found.groups()
    place = re.match(r"^(.*):(\d{1,9})$", head) if head else None
    return _block("code", code=code, language=language or "text", path=place[1] if place else head, line=int(place[2]) if place else None, url=url)


def blocks_of(text: str | None) -> list[dict]:
    out, last = [], 0
    for found in FENCE.finditer(text or ""):
        out += Lines(text[last : found.start()]).blocks()
        out.append(_fenced(found))
        last = found.end()
    return out + list(Lines((text or "")[last:]).blocks())


def spans_of(text: str | None) -> list[dict]:
    out, last, text = [], 0, text or ""
    for found in _INLINE.finditer(text):
        if found.start() > last:
            out.append({"type": "text", "text": text[last : found.start()], "href": None})
        kind = SPANS[int(found.lastgroup[1:])][0] if found.lastgroup else "text"
        inner = [g for g in found.groups()[found.re.groupindex[found.lastgroup] :] if g is not None]
        out.append({"type": kind, "text": inner[0], "href": inner[1] if kind == "link" else None})
        last = found.end()
    if last < len(text):
        out.append({"type": "text", "text": text[last:], "href": None})
    return out


@F.arrow_udf(T.ArrayType(BLOCK))
def blocks(text: pa.Array) -> pa.Array:
    """The blocks of a text in order; null and empty texts have none."""
    return pa.array([blocks_of(t) for t in text.to_pylist()], to_arrow_type(T.ArrayType(BLOCK)))


@F.arrow_udf(T.ArrayType(SPAN))
def spans(text: pa.Array) -> pa.Array:
    """The inline spans of a line in order; those of text give, with the marks of the others, the line again."""
    return pa.array([spans_of(t) for t in text.to_pylist()], to_arrow_type(T.ArrayType(SPAN)))


def block_rows(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, place (from 0) and the columns of BLOCK: a row for each block."""
    return texts.select(key, F.posexplode(blocks(F.col(column))).alias("place", "b")).select(key, "place", "b.*")


def plain(found: Column) -> Column:
    """What a reader sees of an array of spans."""
    return F.array_join(F.transform(found, lambda s: s["text"]), "")
