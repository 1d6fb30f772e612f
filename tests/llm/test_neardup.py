import random
import re

import numpy as np
import pandas as pd

from cordonlake.llm.neardup import _sketches, codeword_keys, connect, near_duplicates, nearest_codeword

SCHEMA = "doc_id string, text string, a string, b string, n int, key string, sketch int"


def shingles(t, n):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n, threshold):
    s = {d: shingles(t, n) for d, t in docs.items()}
    s = {d: x for d, x in s.items() if x}
    group = {d: d for d in s}
    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(s[a] & s[b]) >= threshold * len(s[a] | s[b]):
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    return group


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else rng.choice(["new", "w%d" % rng.randrange(5000)]) for w in words)


def test_code_is_perfect_and_keys_meet_within_two_errors():
    assert set(np.bincount(nearest_codeword(np.arange(1 << 23)))) == {1 << 11}
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    flips = np.array([sum(1 << int(b) for b in rng.choice(23, rng.integers(0, 3), replace=False)) for _ in words])
    (a, ma), (b, mb) = codeword_keys(words), codeword_keys(words ^ flips)
    assert set(ma.sum(1)) <= {1, 6}
    assert all(np.intersect1d(x, y).size for x, y in zip(a, b))


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    docs = {}
    for g in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 500]))]
        for k in range(rng.choice([1, 1, 2, 3, 5])):
            docs[f"d{g:02d}-{k}"] = edited(rng, words, 0.0 if k == 4 else 0.03 * k)
    docs |= {"hot%03d" % i: edited(rng, ["common"] + [f"h{j}" for j in range(300)], 0.004) for i in range(60)}
    docs |= {"copy%02d" % i: "The very same Text, again and again." for i in range(20)}
    docs |= {"null": None, "empty": "", "blank": " \n", "one": "single", "one more": "Single!", "long": "lorem " * 20000}
    rows = [(d, t, "x", "y", 1, "k", 2) for d, t in docs.items()] + [("hot000", docs["hot000"], "x", "y", 1, "k", 2), (None, "no id", "", "", 1, "", 1)]
    members, links = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold=0.7, shingle=3)
    got = {r["doc"]: r["group_id"] for r in members.collect()}
    assert got == brute(docs, 3, 0.7)
    classes = {r["class_id"] for r in members.collect() if r["doc"].startswith("copy")}
    assert classes == {"copy00"}
    found = links.collect()
    assert all(r["similarity"] >= 0.7 and r["a"] < r["b"] for r in found)
    assert len({(r["a"], r["b"]) for r in found}) == len(found)
    assert sum(r["a"].startswith("hot") for r in found) < 60 * 59 / 2 / 4  # the large group does not expand into its pairs


def test_all_links_of_a_hot_group(spark):
    rng = random.Random(6)
    docs = {"hot%03d" % i: edited(rng, [f"h{j}" for j in range(300)], 0.004) for i in range(40)} | {"other": "quite another text of its own"}
    s = {d: shingles(t, 3) for d, t in docs.items()}
    df = spark.createDataFrame([(d, t, "", "", 1, "", 1) for d, t in docs.items()], SCHEMA)
    members, links = near_duplicates(df, threshold=0.7, shingle=3, all_links=True, salt_rows=7)
    heads = sorted({r["class_id"] for r in members.collect()})
    true = {(a, b) for i, a in enumerate(heads) for b in heads[i + 1 :] if len(s[a] & s[b]) >= 0.7 * len(s[a] | s[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == true and len(true) > 400
    assert {r["doc"]: r["group_id"] for r in members.collect()} == brute(docs, 3, 0.7)


def test_empty(spark):
    members, links = near_duplicates(spark.createDataFrame([], SCHEMA))
    assert members.collect() == [] and links.collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in connect(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}


def test_indexed_series_are_fine(spark):
    df = spark.createDataFrame(pd.DataFrame({"doc_id": ["a", "b"], "text": ["x y z u v w", "x y z u v w q"]}))
    members, _ = near_duplicates(df, threshold=0.8, shingle=3)
    assert len({r["group_id"] for r in members.collect()}) == 1


def test_fingerprints_of_linked_texts_stay_within_five_deviations():
    rng = np.random.default_rng(4)
    pairs = []
    for size in (66, 120, 400):
        for _ in range(300):
            words = [f"w{x}" for x in rng.integers(1 << 40, size=size)]
            at = set(rng.choice(size, size // 11, replace=False))
            pairs.append((" ".join(words), " ".join(f"v{i}" if i in at else w for i, w in enumerate(words))))
    near = np.array([len(shingles(a, 3) & shingles(b, 3)) / len(shingles(a, 3) | shingles(b, 3)) for a, b in pairs])
    bits = [np.array(_sketches(pd.Series(side), 3, 24)[2]).view(np.uint64) for side in zip(*pairs)]
    differ = np.bitwise_count(bits[0] ^ bits[1]).sum(1)
    linked = (near >= 0.55) & (near < 0.65)
    assert linked.sum() > 300 and differ[linked].max() <= 552 * 0.225 + 5 * (552 * 0.225 * 0.775) ** 0.5
    assert abs(differ[linked].mean() / 552 - (1 - near[linked].mean()) / 2) < 0.01
