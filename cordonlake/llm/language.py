"""Languages told apart by character n-grams, learnt from texts that carry a label."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd

from cordonlake.llm.linear import Hashed, LinearModel
from cordonlake.llm.words import mix64

_BITS = 14


def char_ngrams(texts: Sequence[str]) -> Hashed:
    """Runs of one to three bytes within words, of letters only and in lower case; a text's values are shares of its runs."""
    kept = ["".join(c if c.isalpha() else " " for c in t.lower()).split() for t in texts]
    parts = [(" " + " ".join(w) + " ").encode("utf-8", "replace") if w else b"" for w in kept]
    data = np.frombuffer(b"\n".join(parts) + b"\n\n\n", np.uint8).astype(np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    row = np.searchsorted(ends, np.arange(len(data)), side="right")
    at, rows = [], []
    for n in (1, 2, 3):
        code = np.full(len(data) - 3, n, np.uint64)
        whole = np.ones(len(code), bool)
        for k in range(n):
            b = data[k : k + len(code)]
            code = code * np.uint64(257) + b
            whole &= b != 10
        at.append((mix64(code[whole]) & np.uint64((1 << _BITS) - 1)).astype(np.int64))
        rows.append(row[: len(code)][whole])
    at, rows = np.concatenate(at), np.concatenate(rows)
    used = rows < len(parts)
    at, rows = at[used], rows[used]
    size = np.bincount(rows, minlength=len(parts))
    return Hashed(at, 20.0 / np.maximum(1, size)[rows], rows, len(parts))


class Languages:
    """Shares of the languages of short texts. ``quality`` is the F1 of each on every fifth of the fitted texts, which were left out."""

    def __init__(self, sample: pd.DataFrame, least: float = 0.01, piece: int = 160):
        """``sample``: ``text`` and ``lang``; of each text one stretch of ``piece`` characters is learnt, about as long as an answer. Labels that
        less than ``least`` of the texts carry are left out."""
        sample = sample.dropna(subset=["text", "lang"])
        labels = sample["lang"].str.strip().str.lower()
        common = labels.value_counts()
        names = sorted(common[common >= max(2, least * len(sample))].index)
        use = labels.isin(names).to_numpy()
        texts, labels = sample["text"][use].tolist(), labels[use].tolist()
        cut = [t[len(t) // 3 :][:piece] if len(t) > 2 * piece else t[: 2 * piece] for t in texts]
        y = np.array([[label == n for n in names] for label in labels], float).reshape(len(labels), len(names))
        held = np.arange(len(cut)) % 5 == 0
        x = char_ngrams(cut)
        self.names = names
        self.model = LinearModel(names, bits=_BITS, l2=1e-5, rounds=150).fit(x.take(~held), y[~held])
        self.quality = self.model.calibrate(x.take(held), y[held]) if held.any() and names else {}

    def shares(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, languages), each row adding up to 1; equal shares for a text without letters."""
        x = char_ngrams(texts)
        if not self.names:
            return np.zeros((len(texts), 0))
        z = np.stack([x.dot(w[:-1]) + w[-1] for w in self.model.weights], 1)
        z -= z.max(1, keepdims=True)
        p = np.exp(np.clip(z, -30, 0))
        p[np.bincount(x.row, minlength=len(texts)) == 0] = 1.0
        return p / p.sum(1, keepdims=True)
