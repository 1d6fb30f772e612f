"""Cutting oversized runs of blocks into pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = "doc_id string, first_block int, n_blocks int, item_chars int, piece int, start int, end int, page int, section string, text string"

#: Where a node of each level of the tree begins, outermost level first; the last levels cut within a sentence.
_LEVELS = [
    re.compile(p, re.M)
    for p in (
        r"^(?=#\s|<h1|(?:ARTICLE|PART|CHAPTER)\s+[\dIVXLC]+)",
        r"^(?=##\s|<h2|(?:SECTION|ITEM)\s+\d|\d{1,3}\.?\s+[A-Z])",
        r"^(?=#{3,}\s|<h[3-6]|\d{1,3}(?:\.\d{1,3})+\.?\s)",
        r"(?<=\f)|(?<=\n\n)(?=[^\n])|(?<=</p>)|(?<=</div>)",
        r"^(?=\s*(?:[-*•]\s|\(?[a-z\d]{1,3}[.)]\s|<li))",
        r"(?<=\n)(?=[^\n])",
        r"(?<=[.!?])\s+(?=\S)",
        r"(?<=[;:,])\s+(?=\S)",
        r"\s+(?=\S)",
    )
]


_BOUNDARY = re.compile(r"(?<=\s)(?=\S)")


class Node:
    """A stretch of text in the tree of its structure; ``children`` cover it, none if nothing divides it."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end
        self.children: list[Node] = []

    def __len__(self) -> int:
        return self.end - self.start


def structure(text: str, limit: int) -> Node:
    """The tree of a text: headings hold the headings below them, these paragraphs, list items, lines, sentences, clauses and words.

    Nodes within the limit are not divided further; a run without any boundary is divided at the limit itself.
    """
    root = Node(0, len(text))
    todo = [(root, 0)]
    while todo:
        node, level = todo.pop()
        if len(node) <= limit:
            continue
        cuts: list[int] = []
        while not cuts and level < len(_LEVELS):
            cuts = sorted({m.end() for m in _LEVELS[level].finditer(text, node.start, node.end) if node.start < m.end() < node.end})
            level += 1
        edges = [node.start, *(cuts or range(node.start + limit, node.end, limit)), node.end]
        node.children = [Node(a, b) for a, b in zip(edges, edges[1:])]
        todo.extend((c, level) for c in node.children)
    return root


def merged(root: Node, limit: int) -> list[tuple[int, int]]:
    """Spans of ``limit`` characters at most, by merging neighbouring subtrees from the bottom up.

    A node gives one span if it fits. Otherwise it takes the spans that its children gave, and joins neighbours as long as they fit together; what is
    left over at the end of a divided child is joined with the sibling that follows.
    """
    spans: dict[int, list[tuple[int, int]]] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children)
    for node in reversed(order):  # children before their parents
        if not node.children:
            spans[id(node)] = [(node.start, node.end)]
            continue
        own: list[tuple[int, int]] = []
        for a, b in (s for c in node.children for s in spans.pop(id(c))):
            if own and b - own[-1][0] <= limit:
                own[-1] = (own[-1][0], b)
            else:
                own.append((a, b))
        spans[id(node)] = own
    return spans[id(root)]


def split_spans(text: str, limit: int) -> list[tuple[int, int]]:
    """Spans that cover ``text``, each of ``limit`` characters at most: :func:`merged` over its :func:`structure`."""
    return merged(structure(text, limit), limit)


def overlap_start(text: str, at: int, overlap: int, floor: int) -> int:
    """Where the overlap ahead of ``at`` begins: at the first word within ``overlap`` characters of it, not before ``floor``.

    Where no word begins there, it has its full length.
    """
    first = max(floor, at - overlap)
    if first == floor or first == at:
        return first
    m = _BOUNDARY.search(text, first, at)
    return m.start() if m else first


def split_items(docs: DataFrame, limit: int = 2000, overlap: int = 200, only_oversized: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of every item of parsed documents; an item is a longest run of blocks of one section (null equals null).

    Each document is handled where it is read; nothing is shuffled. Repeated rows of a document give repeated pieces.

    Args:
        docs: ``doc_id``, ``text`` and ``blocks(len, page, section)``; other columns are ignored. ``text`` is the blocks
            joined by one newline. Null or empty ``blocks`` give no items; a null text counts as empty.
        limit: characters of a piece at most, the overlap included.
        overlap: characters by which a piece repeats the end of the piece before it (all of that piece, if shorter), less what is
            ahead of the first word that begins among them.
        only_oversized: leave out items that fit; they come as one piece otherwise.
        with_text: without it ``text`` is null.

    Returns:
        ``doc_id, first_block, n_blocks, item_chars, piece, start, end, page, section, text``: positions from 0,
        ``start`` and ``end`` in the document's text, ``page`` of the block in which the piece's own part begins. Taken
        without their overlaps the pieces of an item give its text back.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, lens, pages, sections in zip(*(pdf[c] for c in ("doc_id", "text", "lens", "pages", "sections"))):
                if lens is None:
                    continue
                text, at, first = text or "", 0, 0
                while first < len(lens):
                    last = first
                    while last + 1 < len(lens) and sections[last + 1] == sections[first]:
                        last += 1
                    size = int(sum(lens[first : last + 1])) + last - first
                    if size > limit or not only_oversized:
                        bounds, pos = [], at
                        for n in lens[first : last + 1]:
                            bounds.append(pos)
                            pos += int(n) + 1
                        item = text[at : at + size]
                        spans = [(0, len(item))] if size <= limit else split_spans(item, limit - overlap)
                        block, before = 0, 0
                        for k, (a, b) in enumerate(spans):
                            while block + 1 < len(bounds) and bounds[block + 1] <= at + a:
                                block += 1
                            begin = overlap_start(item, a, overlap, before) if k else a
                            rows.append((doc, first, last - first + 1, size, k, at + begin, at + b, pages[first + block], sections[first], item[begin:b] if with_text else None))
                            before = a
                    at, first = at + size + 1, last + 1
            if rows:
                out = pd.DataFrame(rows, columns=["doc_id", "first_block", "n_blocks", "item_chars", "piece", "start", "end", "page", "section", "text"])
                out["page"] = out["page"].astype("Int32")
                yield out

    part = [
        F.transform("blocks", lambda b: F.coalesce(b["len"], F.lit(0))).alias("lens"),
        F.transform("blocks", lambda b: b["page"]).alias("pages"),
        F.transform("blocks", lambda b: b["section"]).alias("sections"),
    ]
    return docs.select(F.col("doc_id").cast("string"), "text", *part).mapInPandas(split, _PIECE)
