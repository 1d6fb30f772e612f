"""Linear multi-label classifiers on hashed features: a small model fitted on a bounded sample, applied to all rows."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Features = dict[str, float]


class Hashed:
    """Rows of hashed features: positions, values and the row of each."""

    def __init__(self, at: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int):
        self.at, self.value, self.row, self.rows = at, value, row, rows

    @classmethod
    def of(cls, rows: Sequence[Features], bits: int) -> Hashed:
        """From named features."""
        names = [n for r in rows for n in r]
        at = np.fromiter((zlib.crc32(n.encode("utf-8", "replace")) for n in names), np.int64, len(names)) & ((1 << bits) - 1)
        return cls(at, np.fromiter((v for r in rows for v in r.values()), np.float64, len(names)), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows))

    def take(self, mask: np.ndarray) -> Hashed:
        new = np.cumsum(mask) - 1
        use = mask[self.row]
        return Hashed(self.at[use], self.value[use], new[self.row[use]], int(mask.sum()))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], minlength=self.rows)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, self.value * g[self.row], minlength=size)


class LinearModel:
    """One regularised logistic regression per label, with a threshold of its own."""

    def __init__(self, labels: Sequence[str], bits: int = 15, l2: float = 1e-4, rounds: int = 120):
        self.labels, self.bits, self.l2, self.rounds = list(labels), bits, l2, rounds
        self.weights = np.zeros((len(self.labels), (1 << bits) + 1))
        self.thresholds = np.full(len(self.labels), 0.5)

    def _hashed(self, rows: Sequence[Features] | Hashed) -> Hashed:
        return rows if isinstance(rows, Hashed) else Hashed.of(rows, self.bits)

    def fit(self, rows: Sequence[Features] | Hashed, y: np.ndarray, sure: np.ndarray | None = None) -> LinearModel:
        """``y`` is (rows, labels) of 0 and 1; ``sure`` weighs each entry (0: unknown, left out)."""
        x, size = self._hashed(rows), 1 << self.bits
        sure = np.ones(y.shape) if sure is None else sure
        for k in range(len(self.labels)):
            w, b = np.zeros(size), 0.0
            seen_w, seen_b = np.full(size, 1e-8), 1e-8
            # both sides of a label weigh the same
            side = np.where(y[:, k] > 0, 0.5 / max(1.0, (sure[:, k] * y[:, k]).sum()), 0.5 / max(1.0, (sure[:, k] * (1 - y[:, k])).sum())) * sure[:, k]
            for _ in range(self.rounds):
                p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30)))
                g = side * (p - y[:, k])
                gw = x.back(g, size) + self.l2 * w
                seen_w += gw**2
                seen_b += g.sum() ** 2
                w -= 0.5 * gw / np.sqrt(seen_w)
                b -= 0.5 * g.sum() / np.sqrt(seen_b)
            self.weights[k, :-1], self.weights[k, -1] = w, b
        return self

    def scores(self, rows: Sequence[Features] | Hashed) -> np.ndarray:
        """Probabilities (rows, labels)."""
        x = self._hashed(rows)
        z = np.stack([x.dot(w[:-1]) + w[-1] for w in self.weights], 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, rows: Sequence[Features] | Hashed, y: np.ndarray, sure: np.ndarray | None = None) -> dict[str, float]:
        """Sets each threshold in the middle of those that are best on held-out rows by F1; returns those F1 values."""
        p, out = self.scores(rows), {}
        grid = np.linspace(0.05, 0.95, 91)
        for k, label in enumerate(self.labels):
            use = np.ones(len(p), bool) if sure is None else sure[:, k] > 0
            truth, score = y[use, k] > 0, p[use, k]
            f1 = np.array([2 * (truth & (score >= t)).sum() / max(1, truth.sum() + (score >= t).sum()) for t in grid])
            best = grid[f1 >= f1.max() - 1e-9]
            self.thresholds[k], out[label] = float(np.median(best)), float(f1.max())
        return out


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> pd.DataFrame:
    """The ``n`` rows whose hash of ``key`` is smallest, on the driver; all rows if there are no more.

    Rows are counted, and a share of them that gives four times ``n`` is drawn by the hash first, so a table of any size sends
    no more than that to be sorted; should the draw give too few, all rows are sorted. A sample of a table with rows is never empty.
    """
    total = rows.count()
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    placed = rows.withColumn("_h", h)
    if total > 8 * n:
        below = int(-(2**63) + 2**64 * (4 * n / total))
        drawn = placed.where(F.col("_h") < F.lit(below)).orderBy("_h", key).limit(n).toPandas()
        if len(drawn) == n:
            return drawn.drop(columns="_h")
    return placed.orderBy("_h", key).limit(n).toPandas().drop(columns="_h")


def ngrams(words: Sequence[str], prefix: str, upto: int = 2) -> Features:
    return {f"{prefix}{n}:{' '.join(words[i : i + n])}": 1.0 for n in range(1, upto + 1) for i in range(len(words) - n + 1)}
