"""Containment counts all shingles."""

from cordonlake.operators import corpus


def test_containment_counts_all_shingles(spark):
    words = [f"w{i}" for i in range(12)]
    left = spark.createDataFrame([(f"c{i}", " ".join(words[i : i + 5])) for i in range(8)], "doc_id string, text string")
    right = spark.createDataFrame([("f", " ".join(words))], "doc_id string, text string")
    got = {r["doc_id"]: (r["dropped_for"], r["containment"]) for r in corpus.contained(left, right).collect()}
    assert got == {f"c{i}": ("f", 1.0) for i in range(8)}
    assert corpus.contained(left, right, sample=True).count() < 8
