"""Whether answers rest on what was shown: citations resolve, quotes are verbatim, otherwise abstain."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordonlake.functions.text import collapsed


def longest_run(quote: Column, body: Column) -> Column:
    """Longest run of the quote's words that stands verbatim in the body, as a share of its words; 0 for an empty quote."""

    @F.pandas_udf("double")
    def run(quotes: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for q, b in zip(quotes, bodies):
            words, best, first = [w for w in (q or "").split(" ") if w], 0, 0
            while words and b and first + best < len(words):
                # only a longer run than the best so far counts
                if " ".join(words[first : first + best + 1]) in b:
                    best += 1
                else:
                    first += 1
            out.append(best / len(words) if words else 0.0)
        return pd.Series(out)

    return run(quote, body)


def resolve(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """``claims`` (``answer_id, claim_no, passage_id, quote``) with the passage's ``body`` (null: not shown) and ``resolved``."""
    shown = passages.select("passage_id", "body", F.lit(True).alias("r")).dropDuplicates(["passage_id"])
    return claims.join(shown, "passage_id", "left").withColumn("resolved", F.coalesce("r", F.lit(False))).drop("r")


def verify(resolved: DataFrame) -> DataFrame:
    """Adds ``verified``: the quote, white space and case aside, is in the body. An empty or null quote is not."""
    q = collapsed(F.col("quote"))
    return resolved.withColumn("verified", F.coalesce(F.col("resolved") & (q != "") & F.contains(collapsed(F.col("body")), q), F.lit(False)))


def overlaps(verified: DataFrame) -> DataFrame:
    """Adds ``overlap``: 1 for verified quotes, else their longest verbatim run; verified ones are not sent to Python."""
    open_ = lambda c: F.when(~F.col("verified"), collapsed(F.col(c)))
    run = longest_run(open_("quote"), open_("body"))
    return verified.withColumn("_run", run).withColumn("overlap", F.when(F.col("verified"), 1.0).otherwise(F.coalesce("_run", F.lit(0.0)))).drop("_run")


def gate(answers: DataFrame, verified: DataFrame, substantial: int = 40) -> DataFrame:
    """``answer_id, abstained, reason``: an answer stands only if it has claims, all resolved and all verified.

    ``answers`` gives ``answer_id, answer, abstained``; an abstention whose answer is longer than ``substantial``
    characters is judged by its claims.
    """
    sums = verified.groupBy("answer_id").agg(F.count("*").alias("claims"), F.count_if(~F.col("resolved")).alias("open"), F.count_if(~F.col("verified")).alias("false"))
    means = F.coalesce("abstained", F.lit(False)) & (F.length(F.trim(F.coalesce("answer", F.lit("")))) <= substantial)
    reason = (F.when(means, "abstained").when(F.coalesce("claims", F.lit(0)) == 0, "no citations").when(F.col("open") > 0, F.format_string("%d unresolved", "open")).when(F.col("false") > 0, F.format_string("%d unverified", "false")))
    return answers.join(sums, "answer_id", "left").select("answer_id", reason.isNotNull().alias("abstained"), reason.alias("reason"))


def citation_metrics(answers: DataFrame, verified: DataFrame) -> DataFrame:
    """``answer_id, n_claims, n_cited, accuracy, coverage, abstention_correct``.

    ``answers`` gives ``answer_id, abstained, answerable, n_claims``; ``verified`` are the claims that carry a citation. Accuracy is the share of
    citations that resolve and are verbatim, null without citations; coverage the share of claims that are cited, 1 at most, null
    without claims. An abstention is correct where the question cannot be answered, an answer where it can.
    """
    cited = verified.groupBy("answer_id").agg(F.count("*").alias("n_cited"), F.round(F.avg((F.col("resolved") & F.col("verified")).cast("double")), 6).alias("accuracy"))
    coverage = F.when(F.col("n_claims") > 0, F.round(F.least(F.coalesce("n_cited", F.lit(0)), F.col("n_claims")) / F.col("n_claims"), 6))
    return answers.join(cited, "answer_id", "left").select("answer_id", "n_claims", F.coalesce("n_cited", F.lit(0)).alias("n_cited"), "accuracy", coverage.alias("coverage"), (F.col("abstained") != F.col("answerable")).alias("abstention_correct"))
