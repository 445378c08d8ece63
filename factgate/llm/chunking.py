"""Splitting oversized texts at natural boundaries by structure-tree packing.

A text is parsed into a tree: sections by the depth of their headings, paragraphs between blank lines, list items and lines by
their indent, sentences, words, and characters at the bottom. Only nodes over the limit are opened. Siblings that were not opened are
merged while they fit; what comes of an opened node never joins a node of another parent. Pieces are spans of the text: each begins
exactly `overlap` characters before the end of its predecessor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgate.tables import small_rows

#: Levels from coarse to fine, each with the pattern after whose match a stretch begins. Every cut of a level is one of the next.
LEVELS = (
    ("blank_line", re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)*\n")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"\n|(?<=[.!?])\s+")),
    ("space", re.compile(r"\s+")),
)
_MARK = re.compile(r"\s*(#{1,6})\s")
_NUMBERED = re.compile(r"\s*(\d+(?:\.\d+)*)\.?\s+[^\W\d_][^\n.!?]{0,80}$")
_TITLE = re.compile(r"\s*(?:[^\W\d_][^\n.!?]{0,60}(?::|\s-)\s*$|[^a-z\n]{3,60}$)")
_INDENT = re.compile(r"[^\S\n]*")
MAX_TABLES = 1000
#: Indents nested deeper than this are lines side by side.
DEEPEST = 40


def stretches(text: str, a: int, b: int, level: int) -> list[tuple[int, int]]:
    """[a, b) cut after each boundary of the level; the parts tile the span."""
    out, at = [], a
    for m in LEVELS[level][1].finditer(text, a, b):
        if at < m.end() < b:
            out.append((at, m.end()))
            at = m.end()
    out.append((at, b))
    return out


def inner(text: str, a: int, b: int) -> int:
    """Length of a span without outer blanks."""
    return len(text[a:b].strip())


def heading_depth(line: str) -> int:
    """1 for the highest heading, larger for lower ones, 0 for other lines: marks, then numbers by their parts, then titles."""
    if m := _MARK.match(line):
        return len(m[1])
    if (m := _NUMBERED.match(line)) and "." in m[1]:
        return 6 + m[1].count(".")
    return 30 if _TITLE.fullmatch(line) else 0


def _groups(parts: list[tuple[int, int]], starts: list[bool]) -> list[tuple[int, int]]:
    """Neighbouring parts joined: each part marked as a start begins a group."""
    out = parts[:1]
    for part, new in zip(parts[1:], starts[1:], strict=True):
        if new:
            out.append(part)
        else:
            out[-1] = (out[-1][0], part[1])
    return out


class Tree:
    """One text, its limit and the room of a piece's new part. `opened` is the boundary down to which nodes had to be opened."""

    def __init__(self, text: str, limit: int, core: int):
        self.text, self.limit, self.core = text, limit, core
        self.opened = 0

    def first_line(self, a: int, b: int) -> str:
        a += len(self.text[a:b]) - len(self.text[a:b].lstrip())
        end = self.text.find("\n", a, b)
        return self.text[a : b if end < 0 else end].rstrip()

    def sections(self, a: int, b: int) -> list[tuple[int, int]]:
        """The parts of a span under its highest headings; the span itself where it has no heading of its own inside."""
        parts = stretches(self.text, a, b, 0)
        depths = [heading_depth(self.first_line(*p)) for p in parts]
        inside = [d for d in depths[1:] if d]
        return _groups(parts, [d == min(inside) for d in depths]) if inside else [(a, b)]

    def glued(self, parts: list[tuple[int, int]], heads: bool) -> list[tuple[int, int]]:
        """Parts, blank ones joined with what precedes them and, if asked, each that is a heading only with what follows it."""
        starts, after = [], False
        for x, y in parts:
            line = self.text[x:y].strip()
            starts.append(bool(line) and not after)
            if line:
                after = heads and "\n" not in line and heading_depth(line) > 0
        return _groups(parts, starts)

    def by_indent(self, parts: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
        """Lines, each with the lines below it that are indented further."""
        if depth >= DEEPEST:
            return parts
        indents = [len(_INDENT.match(self.text, x, y)[0]) if self.text[x:y].strip() else None for x, y in parts]
        known = [i for i in indents if i is not None]
        if len(set(known)) < 2:
            return parts
        least = min(known[1:])  # the node's own first line is its head, whatever its indent
        return _groups(parts, [i is not None and i <= least for i in indents])

    def children(self, a: int, b: int, level: int, depth: int) -> tuple[list[tuple[int, int]], int]:
        """Child spans and the boundary between them (-1 for sections, then the index into LEVELS)."""
        if level < 0:
            kids = self.sections(a, b)
            if len(kids) > 1:
                return kids, -1
            level = 0
        parts = stretches(self.text, a, b, level)
        if inner(self.text, a, b) > self.limit and any(inner(self.text, *p) > self.limit for p in parts):
            self.opened = max(self.opened, level + 1)
        kids = self.glued(parts, level < 2)
        return (self.by_indent(kids, depth) if level == 1 else kids), level

    def pack(self, a: int, b: int, level: int = -1, at: int = 0, depth: int = 0) -> list[tuple[int, int, int]]:
        """Subtrees of at most `core` characters that tile [a, b), each with the boundary it starts at."""
        if b - a <= self.core:
            return [(a, b, at)]
        if level == len(LEVELS):
            return [(x, min(b, x + self.core), level if x > a else at) for x in range(a, b, self.core)]
        kids, cut = self.children(a, b, level, depth)
        nested = cut == 1 and len(kids) > 1 and any("\n" in self.text[x : y - 1] for x, y in kids)
        out: list[tuple[int, int, int]] = []
        run: tuple[int, int, int] | None = None
        for i, (x, y) in enumerate(kids):
            begins = max(0, cut) if i else at
            if y - x <= self.core:
                if run and y - run[0] <= self.core:
                    run = (run[0], y, run[2])
                    continue
                out += [run] if run else []
                run = (x, y, begins)
                continue
            out += [run] if run else []
            run = None
            # sections and nested lines are opened by the same boundary again, all else by the next finer one
            finer = cut if len(kids) > 1 and (cut < 0 or (nested and "\n" in self.text[x : y - 1])) else cut + 1
            out += self.pack(x, y, finer, begins, depth + 1 if finer == cut == 1 else 0)
        return out + ([run] if run else [])


def split(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, str]]]:
    """(boundary, spans): how far the tree had to be opened for every stretch to fit the limit, and the pieces (start, end, level of the
    boundary the new part begins at) of at most `limit` characters.

    Neighbours share exactly `overlap` characters, so the new part of a piece has at most limit - overlap.
    """
    if overlap < 0 or limit <= overlap:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return LEVELS[0][0], [(0, n, "whole")]
    names = [name for name, _ in LEVELS] + ["none"]
    tree = Tree(text, limit, limit - overlap)
    packed = tree.pack(0, n)
    return names[tree.opened], [(max(0, a - overlap) if i else 0, b, names[at] if i else "whole") for i, (a, b, at) in enumerate(packed)]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    return split(text, limit, overlap)[1]


def coarsest(text: str, limit: int) -> str:
    """The first boundary at which all stretches of a text fit the limit, read off its tree."""
    return split(text, limit, 0)[0]


_SCHEMA = "item_table string, item_key string, boundary string, piece_no int, start_char int, end_char int, cut string, piece string"


def split_texts(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Ordered pieces of every text above its table's limit.

    items: item_table, item_key, text. limits: item_table, max_chars, overlap_chars (repeated tables: the smallest limit).
    Result, one row per piece: boundary (of the whole text: the coarsest level whose stretches all fit), piece_no from
    0, the span, the level the piece ends at, its text. Texts that fit, null texts and tables without a limit give no rows.
    Rows with the same key are split each for itself.
    """
    rows = small_rows(limits.groupBy("item_table").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("m")).select("item_table", "m.*"), MAX_TABLES, "chunk_limits")
    bound = {r.item_table: (r.max_chars, r.overlap_chars or 0) for r in rows if r.item_table and r.max_chars}
    over = F.lit(False)
    for t, (n, _) in bound.items():
        over = over | ((F.col("item_table") == t) & (F.length("text") > n))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = []
            for table, key, text in zip(p["item_table"], p["item_key"], p["text"], strict=True):
                boundary, spans = split(text, *bound[table])
                got += [(table, key, boundary, i, a, b, cut, text[a:b]) for i, (a, b, cut) in enumerate(spans)]
            yield pd.DataFrame(got, columns=["item_table", "item_key", "boundary", "piece_no", "start_char", "end_char", "cut", "piece"])

    return items.select("item_table", F.col("item_key").cast("string").alias("item_key"), "text").filter(over).mapInPandas(run, _SCHEMA)
