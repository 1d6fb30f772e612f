"""From questions to answers that stand: rerank, show, write, parse, resolve, verify, gate."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordonlake.functions.providers import Scorer, Writer
from cordonlake.functions.text import fence
from cordonlake.operators import contract, fusion, grounding
from cordonlake.session import materialize

SHOWN, SHOWN_CHARS = 5, 700
_MARK = "\nPassages:\n"


class Extracts:
    """Stand-in for a writer: quotes twelve words of the first passage shown; one answer in eight has a word changed, one in sixteen is no JSON."""

    def write(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            question, _, shown = prompt.partition(_MARK)
            if not shown:
                out.append(json.dumps({"answer": "Not stated.", "abstained": True, "claims": []}))
                continue
            head, _, body = shown.partition("\n")
            words, digit = body.split("\n")[0].split(" ")[:12], hashlib.md5(question.encode()).hexdigest()[0]
            if digit in "01":
                words[len(words) // 2] = "altered"
            passage = head.removeprefix("<<<PASSAGE ").rsplit(" page ", 1)[0]
            answer = {"answer": "See the passage.", "abstained": False, "claims": [{"text": "quoted", "chunk_id": passage, "quote": " ".join(words)}]}
            out.append("no answer" if digit == "2" else json.dumps(answer, ensure_ascii=False))
        return out


def shown_passages(ranked: DataFrame, chunks: DataFrame, n: int = SHOWN, chars: int = SHOWN_CHARS) -> DataFrame:
    """``query_id, rank, chunk_id, body``: the first ``n`` chunks of each question, each cut at ``chars`` characters."""
    return ranked.where(F.col("rank") <= n).join(chunks.select("chunk_id", F.substring("body", 1, chars).alias("body")), "chunk_id").select("query_id", "rank", "chunk_id", "body")


def prompts(questions: DataFrame, shown: DataFrame) -> DataFrame:
    """``query_id, prompt``: each question and its passages between delimiters, in order; a question without passages has none."""
    block = F.struct("rank", fence(F.col("chunk_id"), F.lit(1), F.col("body")).alias("text"))
    one = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(block)).alias("b"))  # at most ``n`` passages of a bounded length
    text = F.array_join(F.transform("b", lambda b: b["text"]), "\n\n")
    return questions.select("query_id", "question").join(one, "query_id", "left").select("query_id", F.when(F.col("b").isNull(), F.col("question")).otherwise(F.concat("question", F.lit(_MARK), text)).alias("prompt"))


def written(asked: DataFrame, writer: Writer) -> DataFrame:
    """``answer_id, response`` of ``query_id, prompt``."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(writer.write(p.fillna("").tolist()))

    return asked.select(F.col("query_id").alias("answer_id"), run("prompt").alias("response"))


def answer_questions(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, scorer: Scorer, writer: Writer) -> dict[str, DataFrame]:
    """Every stage by name: ``reranked``, ``shown``, ``parsed``, ``verified``, ``gate``.

    ``candidates`` (``query_id, chunk_id, rank``) is a fused list of chunks that the asking role may read: access is decided before
    this. An answer that breaks the contract does not stand, with the reason ``contract: ...``. What the models gave is written, as
    several stages read it: each pair is scored and each question answered once.
    """
    reranked = materialize(fusion.rerank(candidates, questions, chunks, scorer), "reranked")
    shown = shown_passages(reranked, chunks)
    parsed = materialize(contract.answers(written(prompts(questions, shown), writer)), "answers")
    passages = shown.select(F.concat_ws("|", "query_id", "chunk_id").alias("passage_id"), "body")
    # a passage counts only for the question that it was shown to
    cited = contract.claims_of(parsed).withColumn("passage_id", F.concat_ws("|", "answer_id", "passage_id"))
    verified = grounding.verify(grounding.resolve(cited, passages))
    gate = grounding.gate(parsed.select("answer_id", "answer", "abstained"), verified)
    problems = parsed.select("answer_id", "problem")
    gate = gate.join(problems, "answer_id").select("answer_id", F.col("abstained") | F.col("problem").isNotNull(), F.coalesce(F.concat(F.lit("contract: "), "problem"), F.col("reason"))).toDF("answer_id", "abstained", "reason")
    return {"reranked": reranked, "shown": shown, "parsed": parsed, "verified": verified, "gate": gate}
