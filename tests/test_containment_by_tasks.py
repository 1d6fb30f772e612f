"""Containment against brute force, however the documents are spread; no pair of documents is shuffled."""

import random

import pytest

from cordonlake.operators import corpus


def brute(left, right, threshold, n=5):
    shingles = lambda t: {tuple(w[i : i + n]) for w in [t.split()] for i in range(len(w) - n + 1)}
    out, r = set(), [(b, shingles(t)) for b, t in right]
    for a, t in left:
        if s := shingles(t):
            both, b = min((-len(s & x), b) for b, x in r if b != a)
            if both and round(-both / len(s), 6) >= threshold:
                out.add((a, b, round(-both / len(s), 6)))
    return out


def texts(name, n, rng, phrases):
    return [(f"{name}{i:03d}", " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("cells", [2_000_000, 40])
def test_containment_equals_brute_force(spark, monkeypatch, cells):
    rng = random.Random(4)
    phrases = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(2, 9))) for _ in range(30)]
    left, right = texts("c", 60, rng, phrases), texts("f", 90, rng, phrases)
    monkeypatch.setattr(corpus, "_PAIR_CELLS", cells)
    make = lambda rows: spark.createDataFrame(rows + [(None, rows[0][1]), (rows[0][0] + "x", None)], "doc_id string, text string")
    for threshold in (0.02, 0.8):
        got = [tuple(r) for r in corpus.contained(make(left), make(right), threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(left, right, threshold)
    both = left + right
    assert {tuple(r) for r in corpus.contained(make(both), make(both), 0.5).collect()} == brute(both, both, 0.5)


def test_pairs_are_not_shuffled(spark):
    left, right = (spark.createDataFrame([(x, "one two three four five six")], "doc_id string, text string") for x in "ab")
    assert "Join" not in corpus.contained(left, right)._jdf.queryExecution().executedPlan().toString()
