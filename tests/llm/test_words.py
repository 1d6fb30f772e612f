import re

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from cordonlake.llm.words import shingle_hashes, word_hashes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("ab1 \n-É", max_size=40)), max_size=8))
def test_word_hashes_match_the_regular_expression(texts):
    expected = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    hashes, offsets = word_hashes(texts)
    assert np.diff(offsets).tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    by_word = {}
    for w, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    for n in (1, 3):
        s, owner = shingle_hashes(hashes, offsets, n)
        grams = [(i, tuple(ws[k : k + n])) for i, ws in enumerate(expected) for k in range(max(1, len(ws) - n + 1)) if ws]
        assert owner.tolist() == [i for i, _ in grams]
        assert len(set(s.tolist())) == len({g for _, g in grams})


def test_long_words_and_texts():
    long = "x" * 200_000
    hashes, offsets = word_hashes([long, "a " * 70_000 + "b", long, long + "y"])
    assert np.diff(offsets).tolist() == [1, 70_001, 1, 1]
    assert hashes[0] == hashes[offsets[2]] != hashes[offsets[3]]
    assert len(set(hashes[offsets[1] : offsets[2]].tolist())) == 2


def test_pandas_is_not_confused_by_series_index():
    s = pd.Series(["a b", None], index=[5, 9])
    assert word_hashes(s)[1].tolist() == [0, 2, 2]
