"""Held-out passages in a corpus: SimHash windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordonlake.llm.words import mix64, word_hashes
from cordonlake.session import stacked

_HIT = "doc_id string, item_id long, windows int, run int, covered double, similarity double"
WIDE_RADIUS, WIDE_STRIDE, WIDE_NEAR = 8, 8, 0.6


def window_fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of every window of ``size`` neighbouring words, from running sums of the words' bits."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out = np.empty(len(words) - size + 1, np.uint64)
    step = 50_000
    for lo in range(0, len(out), step):
        part = words[lo : lo + step + size - 1]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8)
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(bits, axis=0, out=sums[1:])
        above = 2 * (sums[size:] - sums[:-size]) > size
        out[lo : lo + step] = np.packbits(above, axis=1).view(np.uint64)[:, 0]
    return out


def _windows(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window that lies within one text, and its text."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(np.arange(len(words)) + size <= offsets[text + 1]) if len(words) else np.zeros(0, np.int64)
    return at, text[at]


class ItemIndex:
    """Fingerprints of the windows of some items, by each of ``radius`` + 1 blocks of their bits.

    Fingerprints that differ in at most ``radius`` bits agree in one of the blocks, so looking up all of them gives every item
    window within that radius. With a ``stride`` only every so many windows of an item are held, and its last one; a document's windows are
    looked up at every word, so a copy of an item still lines up with each of them.
    """

    def __init__(self, ids: np.ndarray, texts: pd.Series, size: int, radius: int = 3, stride: int = 1):
        self.words, self.offsets = word_hashes(texts)
        self.ids, self.size, self.radius = ids, size, radius
        self.at, self.item = _windows(self.words, self.offsets, size)
        inside, last = self.at - self.offsets[self.item], self.offsets[self.item + 1] - size
        held = (inside % stride == 0) | (self.at == last)
        self.at, self.item = self.at[held], self.item[held]
        prints = window_fingerprints(self.words, size)
        self.prints = prints[self.at]
        self.bits = 64 // (radius + 1)
        self.order, self.first = [], []
        for b in range(radius + 1):
            block = self._block(self.prints, b)
            self.order.append(np.argsort(block, kind="stable"))
            self.first.append(np.searchsorted(block[self.order[b]], np.arange((1 << self.bits) + 1)))
        # a two-word sequence weighs the less, the more items hold it
        pairs, owner = self._pairs(self.words, self.offsets)
        held = np.unique(np.stack([pairs, owner.astype(np.uint64)], 1), axis=0)[:, 0] if len(pairs) else pairs
        self.pairs, count = np.unique(held, return_counts=True)
        self.weight = 1.0 / count

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(self.bits * b)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    @staticmethod
    def _pairs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            at, text = _windows(words, offsets, 2)
            return mix64(words[at] * np.uint64(3) ^ mix64(words[at + 1 if len(at) else at])), text

    def near(self, prints: np.ndarray, step: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``prints``, item window) that differ in at most ``radius`` bits, each once."""
        parts = [self._near(prints[lo : lo + step], lo) for lo in range(0, len(prints), step)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _near(self, prints: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for b in range(self.radius + 1):
            block = self._block(prints, b)
            lo, n = self.first[b][block], self.first[b][block + 1] - self.first[b][block]
            who = np.repeat(np.arange(len(prints)), n)
            what = self.order[b][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            differ = prints[who] ^ self.prints[what]
            ok = np.flatnonzero(np.bitwise_count(differ) <= self.radius)
            for earlier in range(b):  # pairs that an earlier block already gave
                ok = ok[self._block(differ[ok], earlier) != 0]
            left.append(who[ok] + offset)
            right.append(what[ok])
        return np.concatenate(left), np.concatenate(right)

    def similarity(self, words: np.ndarray, at: int, window: int) -> float:
        """Weighted share of two-word sequences that a corpus window and an item window have in common."""
        sets = []
        for w, p in ((words, at), (self.words, self.at[window])):
            part = w[p : p + self.size]
            sets.append(np.unique(self._pairs(part, np.array([0, len(part)]))[0]))
        both = np.intersect1d(*sets, assume_unique=True)

        def weigh(x: np.ndarray) -> float:
            i = np.minimum(np.searchsorted(self.pairs, x), len(self.pairs) - 1)
            return float(np.where(self.pairs[i] == x, self.weight[i], 1.0).sum())

        shared = weigh(both)
        return shared / (weigh(sets[0]) + weigh(sets[1]) - shared)


class WholeItems:
    """Items as whole windows, found with up to ``(1 - near)`` of their words changed, left out or put in.

    An item of n words within e such edits keeps at least n - 2 - 3e of its three-word sequences, within n + e words of the
    document. Places with as many are aligned word by word. Items too short to keep one are left to the other windows.
    """

    def __init__(self, ids: np.ndarray, texts: pd.Series, near: float):
        self.words, self.offsets = word_hashes(texts)
        self.ids, self.near = ids, near
        self.n = np.diff(self.offsets)
        self.edits = ((1 - near) * self.n + 1e-9).astype(np.int64)
        self.least = self.n - 2 - 3 * self.edits
        seeds, at, item = self._seeds(self.words, self.offsets)
        use = self.least[item] >= 1
        order = np.argsort(seeds[use], kind="stable")
        self.seeds, self.at, self.item = seeds[use][order], (at - self.offsets[item])[use][order], item[use][order]

    @staticmethod
    def _seeds(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            at, text = _windows(words, offsets, 3)
            return (mix64(mix64(words[at] * np.uint64(3)) ^ (words[at + 1] * np.uint64(5))) ^ mix64(words[at + 2] * np.uint64(7)) if len(at) else np.zeros(0, np.uint64)), at, text

    def _distance(self, item: int, part: np.ndarray) -> int:
        """Least edits between the item and any stretch of ``part``."""
        place = np.arange(len(part) + 1)
        row = np.zeros(len(part) + 1, np.int64)
        for w in self.words[self.offsets[item] : self.offsets[item + 1]]:
            new = row + 1
            new[1:] = np.minimum(new[1:], row[:-1] + (part != w))
            row = np.minimum.accumulate(new - place) + place
        return int(row.min())

    def find(self, words: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], float]:
        """Best similarity, 1 - edits / words, by (text, item)."""
        seeds, at, text = self._seeds(words, offsets)
        lo = np.searchsorted(self.seeds, seeds)
        n = np.searchsorted(self.seeds, seeds, side="right") - lo
        who = np.repeat(np.arange(len(seeds)), n)
        what = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, pos, doc = self.item[what], at[who], text[who]
        order = np.lexsort((pos, item, doc))
        item, pos, doc, inside = item[order], pos[order], doc[order], self.at[what][order]
        # positions grow with the text, so an item and a position tell the place; hits are counted from each place on
        group = np.cumsum(np.diff(doc, prepend=-1).astype(bool) | np.diff(item, prepend=-1).astype(bool)) if len(item) else item
        line = group * (2 * len(words) + 2) + pos
        until = np.searchsorted(line, group * (2 * len(words) + 2) + np.minimum(pos + self.n[item] + self.edits[item], offsets[doc + 1]), side="right")
        enough = np.flatnonzero(until - np.arange(len(line)) >= self.least[item])
        best: dict[tuple[int, int], float] = {}
        tried = set()
        for i in enough:
            d, it = int(doc[i]), int(item[i])
            start = int(pos[i] - inside[i])
            if best.get((d, it)) == 1.0 or (d, it, start) in tried:
                continue
            tried.add((d, it, start))
            e = int(self.edits[it])
            near = 1 - self._distance(it, words[max(offsets[d], start - e) : min(offsets[d + 1], start + self.n[it] + 2 * e)]) / self.n[it]
            if near >= self.near - 1e-9 and near > best.get((d, it), 0):
                best[d, it] = float(near)
        return best


def _doc_hits(index: ItemIndex, words: np.ndarray, who: np.ndarray, what: np.ndarray, near: float) -> list[tuple]:
    """One row per item that a document gives away; ``who`` are word positions, ``what`` item windows."""
    rows = []
    items = index.item[what]
    size = index.size
    for item in np.unique(items):
        p, w = who[items == item], index.at[what[items == item]]
        same = np.all(words[p[:, None] + np.arange(size)] == index.words[w[:, None] + np.arange(size)], axis=1)
        best, run = (1.0, size) if same.any() else (0.0, 0)
        good = same.copy()
        for i in np.flatnonzero(~same):
            s = index.similarity(words, p[i], what[items == item][i])
            good[i], best = s >= near, max(best, s)
        if not good.any():
            continue
        if same.any():  # windows that follow each other in both texts make a longer run
            line, pos = (p - w)[same], p[same]
            order = np.lexsort((pos, line))
            line, pos = line[order], pos[order]
            new = np.flatnonzero(np.append(True, (np.diff(line) != 0) | (np.diff(pos) != 1)))
            run = size - 1 + int(np.diff(np.append(new, len(pos))).max())
        a = index.offsets[item]
        covered = np.zeros(index.offsets[item + 1] - a, bool)
        for start in np.unique(w[good] - a):
            covered[start : start + size] = True
        rows.append((int(index.ids[item]), int(good.sum()), run, float(covered.mean()), float(best)))
    return rows


def leaked_items(docs: DataFrame, items: DataFrame, window: int = 12, radius: int = 3, near: float = 0.8, block_words: int = 2_000_000, whole: float | None = None) -> DataFrame:
    """Documents that hold passages of items, whole, in part or slightly changed.

    Method: every window of a document gets a SimHash, and blocks of its bits find all item windows within a radius; candidates are verified
    word by word and, where they are not equal, by the weighted share of their two-word sequences. Windows come in two widths. Those of ``window`` words
    with ``radius`` (3 at most) find every run of so many equal words, the shortest passage that counts; an item shorter than that is one window of its own
    length. With ``whole``, windows as wide as the item to within a factor of two (32, 64, 128 ... words), ``WIDE_RADIUS`` bits in nine blocks and a share of
    ``WIDE_NEAR``, find passages with changed words: of 64 words with one changed 0.99 lie within the radius, with three 0.89, with six 0.57.

    What that leaves is looked for as :class:`WholeItems`, with ``whole``, such as 0.8, of their words in order, which is exact; an item found by this
    alone has ``windows`` 1, ``run`` 0, and this share as ``covered`` and ``similarity``.

    The items are a stated query set: they are read in blocks of about ``block_words`` words, each block is broadcast, and
    every document is scanned once per block where it is read. Nothing is shuffled.

    Args:
        docs: ``doc_id`` and ``text``; items: ``item_id`` and ``text``. Other columns are ignored. Null texts and texts
            without words hold nothing; rows with a null id are left out. Repeated rows give repeated results.

    Returns:
        ``doc_id, item_id, windows, run, covered, similarity``: matching pairs of windows, the most equal words in a row (0: no
        equal window), the share of the item's words in matching windows, the best similarity of a window.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be from 0 to 3")
    spark = docs.sparkSession
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    clean = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text", words.alias("n")).where("n > 0")
    total = clean.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // block_words))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("string"), "text")
    found = spark.createDataFrame([], _HIT)
    for part in range(parts):
        block = clean.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toPandas()
        block["size"] = np.minimum(block["n"], window)
        indexes = [(ItemIndex(g["item_id"].to_numpy(), g["text"], int(size), radius), near) for size, g in block.groupby("size")]
        if whole:
            block["wide"] = 32 * 2 ** np.floor(np.log2(np.maximum(block["n"], 32) / 32)).astype(int)
            indexes += [(ItemIndex(g["item_id"].to_numpy(), g["text"], int(size), WIDE_RADIUS, WIDE_STRIDE), WIDE_NEAR) for size, g in block[block["n"] >= 32].groupby("wide")]
        entire = WholeItems(block["item_id"].to_numpy(), block["text"], whole) if whole and len(block) else None
        shared = spark.sparkContext.broadcast((indexes, entire))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 500):
                    piece = pdf.iloc[lo : lo + 500]
                    words, offsets = word_hashes(piece["text"])
                    ids, rows = piece["doc_id"].to_numpy(), []
                    by_window, by_item = shared.value
                    for index, least in by_window:
                        at, doc = _windows(words, offsets, index.size)
                        who, what = index.near(window_fingerprints(words, index.size)[at])
                        owner = doc[who]
                        order = np.argsort(owner, kind="stable")
                        bounds = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1))
                        for a, b in zip(bounds[:-1], bounds[1:]):
                            chosen = order[a:b]
                            rows += [(lo + owner[chosen[0]], *hit) for hit in _doc_hits(index, words, at[who[chosen]], what[chosen], least)]
                    if by_item:
                        known = {(r[0], r[1]) for r in rows}
                        hits = [(lo + d, int(by_item.ids[i]), s) for (d, i), s in by_item.find(words, offsets).items()]
                        rows += [(d, i, 1, 0, s, s) for d, i, s in hits if (d, i) not in known]
                    if rows:
                        out = pd.DataFrame(rows, columns=["row", "item_id", "windows", "run", "covered", "similarity"])
                        # an item can be found by windows of both widths: the longest run and the best of the rest
                        out = out.groupby(["row", "item_id"], as_index=False).agg({"windows": "sum", "run": "max", "covered": "max", "similarity": "max"})
                        out.insert(0, "doc_id", ids[out.pop("row").to_numpy() - lo])
                        yield out

        found = stacked(found, texts.mapInPandas(scan, _HIT))
    return found
