"""Chunks are cut and counted once for a search, and counted as the columns of ``functions.text`` count."""

from cordonlake.functions.text import search_terms, words
from cordonlake.operators import lexical
from cordonlake.queries import retrieval
from pyspark.sql import functions as F

TEXTS = ["The Pear and THE pear, ab abc x1 x12", "", None, "Kelvin İndex straße naïve", "for the and", "a_b abc_abc\tabc\nabc"]


def test_counts_are_those_of_the_columns(spark):
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "chunk_id string, body string")
    for stopwords, terms in ((False, search_terms), (True, words)):
        due = chunks.select("chunk_id", F.coalesce(terms(F.col("body")), F.array().cast("array<string>")).alias("t")).collect()
        got = {r["chunk_id"]: (sorted((p["item"], p["n"]) for p in r["posts"]), r["dl"]) for r in lexical.counted(chunks, stopwords).collect()}
        assert got == {r["chunk_id"]: (sorted((w, r["t"].count(w)) for w in set(r["t"])), len(r["t"])) for r in due}


def test_a_search_cuts_the_chunks_once(spark, monkeypatch):
    cut, chunks = [], retrieval.chunks
    monkeypatch.setattr(retrieval, "chunks", lambda *a: cut.append(1) or chunks(*a))
    found = retrieval.lexical_topk(spark, "/root/testdata/sf0.001")
    assert len(cut) == 1 and found.count() > 0  # twice before, and thrice in the plan
