import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from cordonlake.llm.leakage import WIDE_NEAR, WIDE_RADIUS, WIDE_STRIDE, ItemIndex, _windows, leaked_items, window_fingerprints
from cordonlake.llm.words import word_hashes

DOCS, ITEMS = "doc_id long, text string, item_id string, run int", "item_id long, text string, suite string"


def longest(a, b):
    a, b = (re.findall("[a-z0-9]+", (x or "").lower()) for x in (a, b))
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


@pytest.mark.parametrize("block_words", [2_000_000, 100])
def test_runs_match_brute_force(spark, block_words):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([12, 30, 60]))), "s") for i in range(12)]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.6:
            i = rng.choice(items)[1].split()
            n = rng.randrange(5, min(40, len(i)) + 1)
            a = rng.randrange(len(i) - n + 1)
            w[len(w) // 2 : len(w) // 2] = [x.upper() for x in i[a : a + n]]
        docs.append((d, ", ".join(w), "x", 1))
    docs += [(100, None, "", 0), (101, "", "", 0), (102, "long " * 30000 + items[0][1], "", 0)]
    got = {(int(r["doc_id"]), r["item_id"]): r["run"] for r in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items + [(90, None, ""), (91, "", "")], ITEMS), block_words=block_words).collect() if r["run"]}
    assert got == {(d, i): longest(t, x) for d, t, *_ in docs for i, x, _ in items if longest(t, x) >= 12}


def test_slight_changes_and_short_items(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, item, "", 0), (2, item.replace("six", "sechs"), "", 0), (3, "aa bb cc", "", 0), (4, "x AA-BB cc y", "", 0)], DOCS)
    got = {(r["doc_id"], r["item_id"]): r for r in leaked_items(docs, spark.createDataFrame([(7, item, ""), (8, "aa bb cc", "")], ITEMS), near=0.5).collect()}
    assert got["1", 7]["run"] == 12 and got["1", 7]["covered"] == 1.0
    assert {k for k in got if k[1] == 8} == {("3", 8), ("4", 8)}
    assert {k for k in got if k[1] == 7} == {("1", 7)}  # a changed word in each window of 12 leaves nothing of that width


def test_item_with_a_word_in_ten_changed(spark):
    rng = random.Random(4)
    item = [f"w{rng.randrange(4000)}" for _ in range(60)]
    changed = [f"new{i}" if i % 10 == 5 else w for i, w in enumerate(item)]
    moved = [x for i, w in enumerate(item) for x in ([w, "added"] if i % 12 == 4 else [] if i % 12 == 10 else [w])]
    far = [f"new{i}" if i % 3 == 1 else w for i, w in enumerate(item)]
    around = [f"v{i}" for i in range(50)]
    docs = spark.createDataFrame([(d, " ".join(around + w + around), "", 0) for d, w in enumerate([item, changed, moved, far, around])], DOCS)
    items = spark.createDataFrame([(7, " ".join(item), ""), (8, "short one here", "")], ITEMS)
    got = {r["doc_id"]: r for r in leaked_items(docs, items, whole=0.8).collect()}
    assert set(got) == {"0", "1", "2"} and got["0"]["run"] == 60
    assert got["1"]["run"] == 0 and got["1"]["similarity"] >= 0.6
    assert "1" not in {r["doc_id"] for r in leaked_items(docs, items).collect()}


@pytest.mark.parametrize("changes, least", [(0, 1.0), (1, 0.98), (2, 0.95), (4, 0.85)])
def test_wide_windows_meet_changed_words(changes, least):
    """Recall of the wide windows alone, over items of 40 to 140 words with so many words changed in every 64."""
    rng = random.Random(changes)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [[word() for _ in range(rng.randrange(40, 140))] for _ in range(150)]
    sizes = [32 * 2 ** int(math.log2(len(x) / 32)) for x in items]
    found = 0
    for i, (item, size) in enumerate(zip(items, sizes)):
        index = ItemIndex(np.array([i]), pd.Series([" ".join(item)]), size, WIDE_RADIUS, WIDE_STRIDE)
        changed = list(item)
        for k in rng.sample(range(len(item)), max(1, round(changes * len(item) / 64)) if changes else 0):
            changed[k] = "changed" + word()
        words, offsets = word_hashes([" ".join([word() for _ in range(50)] + changed + [word() for _ in range(50)])])
        at, _ = _windows(words, offsets, size)
        who, what = index.near(window_fingerprints(words, size)[at])
        found += any(index.similarity(words, at[p], w) >= WIDE_NEAR for p, w in zip(who, what))
    assert found / len(items) >= least


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    index = ItemIndex(np.array([0]), pd.Series([" ".join(f"x{i}" for i in range(400))]), 32, 8, 8)
    prints = np.concatenate([index.prints ^ sum(np.uint64(1) << np.uint64(b) for b in rng.choice(64, n, replace=False)) if n else index.prints for n in range(12)])
    got = set(zip(*(x.tolist() for x in index.near(prints, step=37))))
    true = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(index.prints) if int(p ^ q).bit_count() <= 8}
    assert got == true and len(true) > 100


def test_empty(spark):
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaked_items(*none).collect() == []
    assert leaked_items(none[0], spark.createDataFrame([(1, "a b", "")], ITEMS)).collect() == []
