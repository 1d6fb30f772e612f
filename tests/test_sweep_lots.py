"""What the post-filter model does once instead of again and again."""

import numpy as np
from cordonlake.operators import dense
from cordonlake.queries.retrieval import postfilter_slices_full

DATA = "/root/testdata/sf0.001"


def test_offers_are_merged_in_lots(monkeypatch):
    rng, sorts, lexsort = np.random.default_rng(0), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorts.append(len(keys[0])) or lexsort(keys))
    n, k, best, every = 50, 20, dense._Best(50, 20), [[] for _ in range(50)]
    for at in range(100):
        row, score, ids = rng.integers(0, n, 10), np.round(rng.random(10), 1), np.arange(10) + 10 * at
        best.offer(row, score, ids, (ids % 7).astype(np.int32))
        for r, s, i in zip(row, score, ids):
            every[r].append((-s, i))
    best.settle()
    assert len(sorts) <= 5  # 100 before, of all places each time
    for q, found in enumerate(every):
        held = best.score[q] > -np.inf
        assert list(zip(-best.score[q][held], best.id[q][held])) == sorted(found)[:k]
        assert (best.tag[q][held] == best.id[q][held] % 7).all()


def test_slices_look_up_the_tenants_of_queries_only(spark):
    plan = postfilter_slices_full(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "% 100) = 0" in plan  # the tenants of all vectors were joined with the rules before
