"""Lists of several searches as one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordonlake.functions.providers import Scorer, scores
from cordonlake.operators.lexical import top_k


def reciprocal_rank(lexical: DataFrame, dense: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """``query_id, chunk_id, lexical_rank, dense_rank, rrf, rank`` by the sum of 1 / (c + rank) over both lists.

    Both give ``query_id, chunk_id, rank``. Ties go to the better lexical rank, then to the chunk id.
    """
    a, b = (x.select("query_id", "chunk_id", F.col("rank").alias(n)) for x, n in ((lexical, "lexical_rank"), (dense, "dense_rank")))
    share = lambda n: F.coalesce(1 / (c + F.col(n)), F.lit(0.0))
    fused = a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("rrf", F.round(share("lexical_rank") + share("dense_rank"), 9))
    tie = F.format_string("%09d/%s", F.coalesce("lexical_rank", F.lit(999_999_999)), "chunk_id")
    return top_k(fused.withColumn("tie", tie), k, "rrf", "tie").drop("tie")


def overlap(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """``query_id, n_both, n_lexical_only, n_dense_only`` of two lists."""
    a, b = (x.select("query_id", "chunk_id", F.lit(1).alias(n)) for x, n in ((lexical, "l"), (dense, "d")))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    return both.groupBy("query_id").agg(*(F.count_if(x).alias(n) for x, n in (
        (F.col("l").isNotNull() & F.col("d").isNotNull(), "n_both"), (F.col("d").isNull(), "n_lexical_only"), (F.col("l").isNull(), "n_dense_only"))))


def movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """``query_id, max_promotion, n_unchanged`` between two rankings of the same items."""
    a = before.select("query_id", "chunk_id", F.col("rank").alias("was"))
    moved = after.select("query_id", "chunk_id", "rank").join(a, ["query_id", "chunk_id"])
    return moved.groupBy("query_id").agg(F.max(F.col("was") - F.col("rank")).alias("max_promotion"), F.count_if(F.col("was") == F.col("rank")).alias("n_unchanged"))


def rerank(fused: DataFrame, questions: DataFrame, chunks: DataFrame, model: Scorer, k: int = 10, depth: int = 50) -> DataFrame:
    """``query_id, chunk_id, was, score, rank``: the first ``depth`` of a list (``query_id, chunk_id, rank``) ranked again by a model, the best ``k``.

    The model reads each question with each of its passages. Ties keep their order. Chunks that are gone are left out.
    """
    pairs = fused.where(F.col("rank") <= depth).select("query_id", "chunk_id", F.col("rank").alias("was"))
    read = pairs.join(questions.select("query_id", "question"), "query_id").join(chunks.select("chunk_id", F.col("body").alias("passage")), "chunk_id")
    scored = scores(read, model).select("query_id", "chunk_id", "was", F.round("score", 6).alias("score"))
    return top_k(scored, k, "score", "was")
