"""Responses of a model as data: JSON wherever it stands in a text, answers held to their contract, judgments brought into one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordonlake.functions.text import bound
from cordonlake.session import stacked

# The fields of an answer and of its claims.
ANSWER = "struct<answer:string,abstained:string,abstain_reason:string,claims:array<struct<text:string,chunk_id:string,quote:string>>>"
GRADES = (0, 3)


def json_in(text: Column, brackets: tuple[str, ...] = ("[]", "{}")) -> Column:
    """The JSON of a response as a string, null if there is none: the whole, without a fence, or what the outermost brackets hold.

    ``brackets`` are tried in order: where an object is expected curly ones should go first, or a list within it is taken for the whole.
    """
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    bare = F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, r"^```[a-z]*\s*", ""), r"\s*```$", "")).otherwise(bare)

    def pick(t: Column) -> Column:
        def between(open_: str, close: str) -> Column:
            i, j = F.locate(open_, t), F.length(t) - F.locate(close, F.reverse(t)) + 1
            return F.when((i > 0) & F.contains(t, F.lit(close)) & (j > i), F.substring(t, i, j - i + 1))

        ok = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
        return F.coalesce(ok(t), *(ok(between(*b)) for b in brackets))

    return bound(bare, pick)


def answers(responses: DataFrame) -> DataFrame:
    """``answer_id, problem, answer, abstained, abstain_reason, claims`` of ``answer_id, response``; ``problem`` is null where the contract is kept.

    The contract: an object with ``answer`` (trimmed), ``abstained`` (a boolean; false if absent) and ``claims`` (none if
    absent), each claim with a ``text``, a ``chunk_id`` and a ``quote``, none of them empty. Problems, the first that holds: ``no json``,
    ``not an object``, ``answer missing``, ``abstained not a boolean``, ``claim incomplete``. With a problem the fields are null.
    """
    empty = lambda c: F.coalesce(c, F.lit("")) == ""

    def parse(j: Column) -> Column:
        return F.struct(j.alias("j"), F.schema_of_variant(F.try_parse_json(j)).alias("kind"), F.from_json(j, ANSWER).alias("a"), F.schema_of_variant(F.try_variant_get(F.try_parse_json(j), "$.abstained", "variant")).alias("flag"))

    def judge(p: Column) -> Column:
        broken = F.coalesce(F.exists(p["a"]["claims"], lambda c: c.isNull() | empty(c["text"]) | empty(c["chunk_id"]) | empty(c["quote"])), F.lit(False))
        problem = (F.when(p["j"].isNull(), "no json").when(~F.startswith(p["kind"], F.lit("OBJECT")), "not an object").when(p["a"]["answer"].isNull(), "answer missing")
                   .when(p["flag"].isNotNull() & ~p["flag"].isin("BOOLEAN", "VOID"), "abstained not a boolean").when(broken, "claim incomplete"))
        return F.struct(problem.alias("problem"), p["a"].alias("a"))

    def keep(r: Column) -> Column:
        kept = lambda c: F.when(r["problem"].isNull(), c)
        return F.struct(
            r["problem"].alias("problem"), kept(F.trim(r["a"]["answer"])).alias("answer"), kept(F.coalesce(r["a"]["abstained"] == "true", F.lit(False))).alias("abstained"),
            kept(r["a"]["abstain_reason"]).alias("abstain_reason"), kept(F.coalesce(r["a"]["claims"], F.array().cast("array<struct<text:string,chunk_id:string,quote:string>>"))).alias("claims"),
        )

    # each step is bound, so that the JSON is read once however often its parts are used
    one = bound(bound(bound(json_in(F.col("response"), ("{}", "[]")), parse), judge), keep)
    return responses.select("answer_id", one.alias("r")).select("answer_id", "r.*")


def claims_of(parsed: DataFrame) -> DataFrame:
    """``answer_id, claim_no, passage_id, quote`` of the claims of :func:`answers`, as grounding takes them."""
    return parsed.select("answer_id", F.posexplode("claims").alias("claim_no", "c")).select("answer_id", "claim_no", F.col("c.chunk_id").alias("passage_id"), "c.quote")


def clamped_grade(value: Column) -> Column:
    """A whole grade from 0 to 3; what is no number is 0, numbers outside go to the nearer end."""
    return F.greatest(F.lit(GRADES[0]), F.least(F.lit(GRADES[1]), F.coalesce(value.try_cast("double").try_cast("int"), F.lit(0))))


def judgments(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """``query_id, chunk_id, grade, why`` for every chunk that was put to a judge, whatever came back.

    Args:
        responses: ``query_id, batch, response``. The JSON is an array of ``id, grade, why``, an object that has it under
            ``judgments`` or ``results``, or a single such object.
        asked: ``query_id, batch, chunk_id``. A chunk without an entry, and every chunk of a response without JSON, gets 0; of
            several entries the last counts. ``why`` is cut at 120 characters.
    """
    row = "array<struct<id:string,grade:string,why:string>>"
    j = F.col("j")
    rows = F.when(F.startswith(F.ltrim(j), F.lit("[")), F.from_json(j, row)).otherwise(F.coalesce(
        F.from_json(F.get_json_object(j, "$.judgments"), row), F.from_json(F.get_json_object(j, "$.results"), row), F.array(F.from_json(j, "struct<id:string,grade:string,why:string>"))))
    given = responses.select("query_id", "batch", json_in(F.col("response")).alias("j")).select("query_id", "batch", F.posexplode(rows).alias("i", "r"))
    last = given.where("r.id is not null").groupBy("query_id", "batch", F.col("r.id").alias("chunk_id")).agg(F.max_by("r", "i").alias("r"))
    return asked.join(last, ["query_id", "batch", "chunk_id"], "left").select("query_id", "chunk_id", clamped_grade(F.col("r.grade")).alias("grade"), F.substring(F.coalesce("r.why", F.lit("")), 1, 120).alias("why"))


def pool(found: DataFrame, sources: DataFrame, size: int = 5) -> DataFrame:
    """``query_id, batch, chunk_id, is_source``: what a judge reads, in batches of ``size``: what a search found and a query's own sources.

    Both give ``query_id, chunk_id``; found ones come with ``rank`` and go first, sources that were not found follow.
    """
    both = stacked(found.select("query_id", "chunk_id", "rank", F.lit(False).alias("s")), sources.select("query_id", "chunk_id", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("s")))
    one = both.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.max("s").alias("is_source"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rank").asc_nulls_last(), "chunk_id"))
    return one.withColumn("n", order).select("query_id", F.floor((F.col("n") - 1) / size).cast("int").alias("batch"), "chunk_id", "is_source")
