"""Word hashes of whole batches of texts at once.

A word is a maximal run of a-z and 0-9 after lower-casing. The batch is handled as one byte buffer, so the cost
per text is a few NumPy passes and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wrapping arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_STEP = 1 << 16
_UP, _DOWN = _powers(_BASE, _STEP), _powers(_INVERSE, _STEP)


def _hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run of bytes; position powers repeat per block so that the tables stay small."""
    out = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(data), _STEP // 2):
        # a block holds the runs that start in its first half; longer runs are hashed one by one below
        a, b = np.searchsorted(starts, [lo, lo + _STEP // 2])
        if a == b:
            continue
        block = data[lo : lo + _STEP]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * _UP[: len(block)], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        fits = e <= len(block)
        out[a:b] = (sums[np.where(fits, e, s)] - sums[s]) * _DOWN[s]
        for i in np.flatnonzero(~fits):
            value = np.uint64(0)
            for part in range(int(starts[a + i]), int(ends[a + i]), _STEP):
                piece = data[part : min(part + _STEP, int(ends[a + i]))].astype(np.uint64) + np.uint64(1)
                value = mix64(np.array([value], np.uint64))[0] + (piece * _UP[: len(piece)]).sum(dtype=np.uint64)
            out[a + i] = value
    return mix64(out ^ (ends - starts).astype(np.uint64))


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the offsets at which each text's words begin.

    ``hashes[offsets[i]:offsets[i + 1]]`` belong to text i; null and wordless texts have none.
    """
    with np.errstate(over="ignore"):
        parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        word = np.zeros(len(data) + 1, np.int8)
        word[1:] = _IS_WORD[data]
        change = np.diff(word)
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        offsets = np.zeros(len(parts) + 1, np.int64)
        if parts:
            bounds = np.cumsum([len(p) + 1 for p in parts])
            offsets[1:] = np.searchsorted(starts, bounds)
        return _hash_runs(data, starts, ends), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of ``n`` neighbouring words of a text, and each sequence's text.

    A text of fewer than ``n`` words but at least one gives one sequence of all its words.
    """
    with np.errstate(over="ignore"):
        texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        size = np.diff(offsets)
        first = np.arange(len(words)) - offsets[texts] if len(words) else np.zeros(0, np.int64)
        length = np.minimum(size, n)[texts] if len(words) else first
        at = np.flatnonzero(first <= size[texts] - length)
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            here = k < length[at]
            step = np.where(here, words[np.where(here, at + k, 0)], np.uint64(0)) if len(words) else out
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + step + np.uint64(k + 1))
        return out, texts[at]
