import os

import numpy as np
import pytest

from cordonlake.llm.mixing import TOKENIZERS, _pair, mix

DOCS, TARGETS = "doc_id long, text string, source string, size int, copies int", "source string, weight double, max_repeats int"
pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabularies here")


def test_pairs_keep_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out, held, q = _pair(size, p, rng.random(40))
        left = size[held] * q if held >= 0 else 0.0
        assert (size * out).sum() + left == pytest.approx((size * p).sum())
        total += out
        if held >= 0:
            total[held] += q
    assert np.abs(total / 3000 - p).max() < 0.06


def test_shares_are_reached_and_repeats_bounded(spark):
    docs = [(i, f"some words of text number {i} " * (1 + i % 7), s, 0, 0) for i in range(900) for s in ["a" if i % 3 else ("b" if i % 2 else "c")]]
    docs += [(1000 + i, "no source here", None, 0, 0) for i in range(20)] + [(2000, None, "a", 0, 0), (2001, "", "b", 0, 0)]
    targets = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 1), ("d", 0.1, 5)]
    copies, report = mix(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(targets, TARGETS), fan_in=2)
    r = {x["source"]: x for x in report.collect()}
    rows = copies.collect()
    assert len(rows) == len([d for d in docs if d[2]]) and len({x["doc_id"] for x in rows}) == len(rows)
    most = max(x["size"] for x in rows)
    for s, w, m in targets:
        own = sum(x["size"] for x in rows if x["source"] == s)
        assert r[s]["own_size"] == own and r[s]["reachable"] == (m * own >= r[s]["target_size"])
        assert abs(r[s]["mixed_size"] - min(r[s]["target_size"], m * own)) <= most
        assert all(x["copies"] <= m for x in rows if x["source"] == s)
        assert r[s]["mixed_size"] == sum(x["size"] * x["copies"] for x in rows if x["source"] == s)
    assert not r["d"]["reachable"] and r["d"]["mixed_rows"] == 0
    assert sum(x["actual_share"] for x in r.values()) == pytest.approx(1)


def test_empty(spark):
    copies, report = mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert copies.collect() == []
    assert [(x["reachable"], x["actual_share"]) for x in report.collect()] == [(True, None)]
