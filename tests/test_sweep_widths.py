"""The whole sweep of the post-filter model."""

from cordonlake.queries import all_oracles
from cordonlake.queries.retrieval import ALL_EFS, postfilter_sweep_full

DATA = "/root/testdata/sf0.001"


def test_sweep_has_five_widths(spark):
    assert {r["ef"] for r in postfilter_sweep_full(spark, DATA).collect()} == {40, 100, 200, 400, 800}
    assert all(str(ALL_EFS) in all_oracles()[f"{q}_full"] for q in ("postfilter_sweep", "postfilter_slices", "iterative_scan"))
