"""What a Python worker holds for the searches, and what models are asked twice."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cordonlake.functions import providers
from cordonlake.operators import lexical
from cordonlake.plans import answer


def peak(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_words_of_few_texts_are_held_at_once():
    body = pa.array([" ".join(f"w{i % 97:02d}x{k:03d}" for k in range(100)) for i in range(5_000)] + [None, "the and w"])
    got, most = peak(lambda: lexical._count(body, frozenset({"the", "and"})))
    assert most < 12_000_000  # 37 MB when the words of a whole batch were held
    one = lexical._count(body[-3:], frozenset({"the", "and"}))
    assert got[-3:].to_pylist() == one.to_pylist() and one.field("dl").to_pylist() == [100, 0, 0]
    assert lexical._count(body[:0], frozenset()).type == one.type and len(lexical._count(body[:0], frozenset())) == 0


def test_models_get_some_rows_at_a_time(spark):
    class Sizes:
        """Gives back how many rows it got at most; defined here, so that it travels with the task."""

        most = 0

        def score(self, questions, passages=()):
            self.most = max(self.most, len(questions))
            return np.full(len(questions), float(self.most))

        def embed(self, texts):
            return np.stack([self.score(texts)] * 2, 1)

    df = spark.range(0, 3_500, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("word").alias("question"), F.lit("word").alias("passage"))
    v = providers.embed(df, "id", "question", Sizes()).select("id", F.col("v")[0].alias("n"))
    assert v.agg(F.count("*"), F.countDistinct("id"), F.max("n")).first()[:] == (3_500, 3_500, providers.MODEL_ROWS)
    s = providers.scores(df, Sizes())
    assert s.agg(F.count("*"), F.max("score")).first()[:] == (3_500, providers.MODEL_ROWS)


def test_null_texts_count_as_empty(spark):
    df = spark.createDataFrame([("a", "fine words", "words"), ("b", None, "words"), ("c", "words", None)], "id string, question string, passage string")
    assert {r["id"]: r["score"] for r in providers.scores(df, providers.SharedWords()).collect()} == {"a": 0.5, "b": 0.0, "c": 0.0}


def test_a_passage_that_comes_again_is_read_once(monkeypatch):
    read, terms = [], providers.terms
    monkeypatch.setattr(providers, "terms", lambda t: read.append(t) or terms(t))
    got = providers.SharedWords().score(["one two", "two six", "six one"], ["two words here", "two words here", "one six"])
    assert got.tolist() == [0.5, 0.5, 1.0] and read.count("two words here") == 1


def test_models_are_asked_once_in_the_whole_chain(spark):
    q = spark.createDataFrame([("q1", "alpha beta"), ("q2", "nothing")], "query_id string, question string")
    c = spark.createDataFrame([("c1", "alpha beta gamma delta " * 4), ("c2", "other text " * 9)], "chunk_id string, body string")
    found = spark.createDataFrame([("q1", "c2", 1), ("q1", "c1", 2)], "query_id string, chunk_id string, rank int")
    stages = answer.answer_questions(q, found, c, providers.SharedWords(), answer.Extracts())
    for name in ("gate", "verified", "reranked", "shown"):
        assert "ArrowEvalPython" not in stages[name]._jdf.queryExecution().executedPlan().toString()
    assert {r["answer_id"] for r in stages["gate"].collect()} == {"q1", "q2"}
