"""Splitting oversized items at natural boundaries by packing their structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
_SPACE = re.compile(r"\s+")
_HEADING = re.compile(r"(#{1,6})\s|\s*<h([1-6])[\s>]")
_ENTRY = re.compile(r"([ \t]*)(?:[-*+]|\d{1,9}[.)])\s")
KINDS = ("blank_line", "line", "sentence", "word", "none")
#: Depths of the tree: six levels of headings, blocks between blank lines, four levels of list entries, lines, sentences, words.
BLOCKS, LISTS, LINES = 6, 4, 11


class Tree:
    """A text as a tree: sections within sections by the level of their headings, then blocks, list entries within
    entries by their indentation, lines, sentences and words.

    A node of one depth is what lies between two cuts of that depth; the cuts of a depth are among those of the next.
    """

    def __init__(self, text: str):
        self.text = text
        headings: list[tuple[int, int]] = []
        blocks, lines, entries = [], [], []
        fenced, at = False, 0
        indents: list[int] = []
        while at < len(text):
            end = _LINE.match(text, at).end()
            line = text[at:end]
            lines.append(end)
            if line.lstrip().startswith("```"):
                fenced = not fenced
            elif not fenced:
                if not line.strip():
                    blocks.append(end)
                elif m := _HEADING.match(line):
                    headings.append((at, len(m[1]) if m[1] else int(m[2])))
                    indents = []
                elif m := _ENTRY.match(line):
                    indent = len(m[1].expandtabs(4))
                    while indents and indents[-1] > indent:
                        indents.pop()
                    if not indents or indents[-1] < indent:
                        indents.append(indent)
                    entries.append((at, len(indents)))
                elif not line[:1].isspace():
                    indents = []
            at = end
        self.blocks = blocks
        sections = [[at for at, level in headings if level <= depth + 1] for depth in range(6)]
        upper = {*sections[5], *blocks}
        lists = [sorted({*upper, *(at for at, level in entries if level <= depth + 1)}) for depth in range(LISTS)]
        self.cuts = [*sections, sorted(upper), *lists, sorted({*lines, *lists[-1]}), None, None]

    def at(self, depth: int) -> list[int]:
        if self.cuts[depth] is None:
            self.cuts[depth] = [m.end() for m in (_SENTENCE if depth == LINES + 1 else _SPACE).finditer(self.text)]
        return self.cuts[depth]

    def parts(self, start: int, end: int, cuts: list[int]) -> list[tuple[int, int]]:
        """The children of a node."""
        inner = cuts[_bisect(cuts, start) : _bisect(cuts, end - 1)]
        return list(zip([start, *inner], [*inner, end]))

    def pack(self, room: int) -> list[tuple[int, int]]:
        """Spans of at most ``room`` characters that cover the text, cut as high in the tree as they can be.

        Sibling subtrees are merged up to ``room``, and only oversized nodes are entered. What is left of an entered
        section is not merged with the section after it; of blocks and smaller nodes it is.
        """
        return self._pack(0, len(self.text), 0, room)

    def _pack(self, start: int, end: int, depth: int, room: int) -> list[tuple[int, int]]:
        if end - start <= room:
            return [(start, end)] if end > start else []
        if depth == len(self.cuts):
            return [(x, min(x + room, end)) for x in range(start, end, room)]
        out: list[tuple[int, int]] = []
        joins = False  # whether the last span may still take a sibling
        for a, b in self.parts(start, end, self.at(depth)):
            if b - a > room:
                out += self._pack(a, b, depth + 1, room)
                joins = depth >= BLOCKS
            elif joins and b - out[-1][0] <= room:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
                joins = True
        return out

    def boundary(self, limit: int) -> str:
        """The first kind of boundary at which cutting everywhere leaves no stretch over the limit.

        Only stretches between blank lines that are too long are entered: within them the later kinds cut ever finer.
        """
        long = lambda x, y: y - x > limit and len(self.text[x:y].strip()) > limit
        worst = 0
        for start, end in self.parts(0, len(self.text), self.blocks):
            if long(start, end):
                fits = (k for k in (1, 2, 3) if not any(long(x, y) for x, y in self.parts(start, end, self.at(LINES + k - 1))))
                worst = max(worst, next(fits, 4))
        return KINDS[worst]


def _bisect(cuts: list[int], x: int) -> int:
    """The number of cuts that are at most ``x``."""
    low, high = 0, len(cuts)
    while low < high:
        mid = (low + high) // 2
        if cuts[mid] <= x:
            low = mid + 1
        else:
            high = mid
    return low


def pieces_of(text: str, limit: int = 1500, overlap: float = 0.1, tree: Tree | None = None) -> list[tuple[int, int, int]]:
    """``(start, end, overlap)`` of each piece; what two pieces share is about ``overlap`` of the first one."""
    tree = tree or Tree(text)
    spans = tree.pack(max(1, limit - int(limit * overlap)))
    out: list[tuple[int, int, int]] = []
    for start, end in spans:
        back = 0
        if out:
            first = out[-1][0]
            back = min(int((start - first) * overlap), limit - (end - start))
            if back > 0 and (m := _SPACE.search(text, start - back, start)) and m.end() < start:
                back = start - m.end()  # begin with a whole word
        out.append((start - back, end, back))
    return out


def split_items(df: DataFrame, id_col: str, content_col: str, kind: str, limit: int = 1500, overlap: float = 0.1, with_content: bool = True) -> DataFrame:
    """Cut every text longer than ``limit`` characters into pieces of at most ``limit``.

    One row per piece: ``(item_kind, item_id, boundary, chunk_index, start_pos, overlap, content)``, the id as
    text, ``overlap`` the number of first characters that the piece before holds too; dropping them and joining
    the pieces gives the text back. A text is parsed to a tree (see ``Tree``); sibling subtrees are merged up to the
    limit, and only oversized nodes are entered. ``boundary`` is the first kind of cut that would suffice everywhere,
    ``none`` if a run without white space is longer. Null and shorter texts and null ids give no rows; repeated rows
    give repeated pieces (see ``one_text``). Without ``with_content`` the pieces come without their text.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for item, text in zip(frame.item_id, frame.content):
                tree = Tree(text)
                pieces = pieces_of(text, limit, overlap, tree)
                kind_of = tree.boundary(limit)
                for index, (start, end, back) in enumerate(pieces):
                    rows.append((kind, item, kind_of, index, start, back, text[start:end] if with_content else None))
            out = pd.DataFrame(rows, columns=["item_kind", "item_id", "boundary", "chunk_index", "start_pos", "overlap", "content"])
            yield out.astype({"chunk_index": "Int32", "start_pos": "Int32", "overlap": "Int32"})

    long = df.where(F.col(id_col).isNotNull() & (F.length(content_col) > limit)).select(F.col(id_col).cast("string").alias("item_id"), F.col(content_col).alias("content"))
    return long.mapInPandas(run, "item_kind string, item_id string, boundary string, chunk_index int, start_pos int, overlap int, content string")


def one_text(df: DataFrame, id_col: str, content_col: str, limit: int = 1500) -> DataFrame:
    """The texts over ``limit``, one for each id: of differing rows the one with the smallest hash."""
    long = df.where(F.length(content_col) > limit).withColumn("_h", F.sha2(content_col, 256))
    first = long.groupBy(id_col).agg(F.min("_h").alias("_h"))
    return long.join(first, [id_col, "_h"], "left_semi").dropDuplicates([id_col, "_h"]).drop("_h")
