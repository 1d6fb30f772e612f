"""Registered intervals take the resamples of the reference."""

import cordonlake.queries.evaluation as evaluation_queries
from cordonlake.queries import all_oracles

DATA = "/root/testdata/sf0.001"


def test_intervals_take_1000_resamples(spark, monkeypatch):
    asked, real = [], evaluation_queries.evaluation.bootstrap
    monkeypatch.setattr(evaluation_queries.evaluation, "bootstrap", lambda values, resamples=1000, **k: asked.append(resamples) or real(values, resamples, **k))
    evaluation_queries.run_compare(spark, DATA)
    evaluation_queries.bootstrap_ci_full(spark, DATA)
    evaluation_queries.bootstrap_ci(spark, DATA)
    assert asked == [1000] * 4
    assert "range(1000)" in all_oracles()["bootstrap_ci_full"]
