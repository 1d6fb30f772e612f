"""Graded retrieval metrics over all queries at once, with intervals, agreement and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordonlake.session import stacked

RELEVANT = 2


def with_grades(results: DataFrame, grades: DataFrame) -> DataFrame:
    """Adds ``grade`` to ``query_id, chunk_id, rank``; without a judgment it is 0. Queries without any judgment drop out."""
    judged = grades.select("query_id").distinct()
    return results.join(judged, "query_id", "left_semi").join(grades.select("query_id", "chunk_id", "grade"), ["query_id", "chunk_id"], "left").fillna(0, ["grade"])


def override_grades(model: DataFrame, human: DataFrame) -> DataFrame:
    """``query_id, chunk_id, grade, by``: the human grade where there is one."""
    m, h = (x.select("query_id", "chunk_id", F.col("grade").alias(n)) for x, n in ((model, "m"), (human, "h")))
    return m.join(h, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", F.coalesce("h", "m").alias("grade"), F.when(F.col("h").isNotNull(), "human").otherwise("model").alias("by"))


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))


def query_scores(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, hit, reciprocal_rank, ndcg, precision`` at ``k``, rounded to 6 decimals.

    Judged queries with an empty result score 0. The ideal order is that of all judged chunks of the query; ndcg is 0 where
    nothing is relevant. Precision divides by what was returned.
    """
    ideal = grades.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "chunk_id"))).where(F.col("i") <= k)
    best = ideal.groupBy("query_id").agg(F.sum(_gain(F.col("grade"), F.col("i"))).alias("idcg"))
    got = with_grades(results.where(F.col("rank") <= k), grades)
    good = F.col("grade") >= RELEVANT
    per = got.groupBy("query_id").agg(
        F.max(good.cast("double")).alias("hit"), F.min(F.when(good, F.col("rank"))).alias("first"), F.sum(_gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.avg(good.cast("double")).alias("precision")
    )
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return best.join(per, "query_id", "left").select(
        "query_id", zero(F.col("hit")).alias("hit"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"), zero(F.col("precision")).alias("precision")
    )


def bootstrap(values: DataFrame, resamples: int = 1000, level: float = 0.95) -> DataFrame:
    """``metric, value, lo, hi, n`` of ``metric, item, value``: mean and percentile interval over resamples.

    Each item is drawn into a resample Poisson(1) times, by a hash of resample and item, so that no resample is gathered: each
    row is read once and adds to all resamples. ``resamples`` bounds the fan-out; sums are combined before the shuffle.
    Nulls are left out; a metric with one value has that value as its interval.
    """
    rows = values.where("value is not null").select("metric", "item", F.col("value").cast("double").alias("value"))
    draws = rows.select("metric", "value", "item", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    u = F.conv(F.substring(F.md5(F.concat_ws("/", "metric", "item", F.col("r").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    # Poisson(1) by its cumulative probabilities
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    times = sum(((u >= b).cast("int") for b in bounds[1:]), (u >= bounds[0]).cast("int"))
    means = draws.withColumn("t", times).groupBy("metric", "r").agg(F.try_divide(F.sum(F.col("value") * F.col("t")), F.sum("t")).alias("m")).where("m is not null")
    order = Window.partitionBy("metric").orderBy("m", "r")
    tail = (1 - level) / 2
    placed = means.withColumn("i", F.row_number().over(order) - 1).withColumn("c", F.count("*").over(Window.partitionBy("metric")))
    ends = placed.groupBy("metric").agg(F.max(F.when(F.col("i") == F.floor(F.col("c") * tail), F.col("m"))).alias("lo"), F.max(F.when(F.col("i") == F.least(F.floor(F.col("c") * (1 - tail)), F.col("c") - 1), F.col("m"))).alias("hi"))
    mean = rows.groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    six = lambda c: F.round(c, 6).alias(c)
    return mean.join(ends, "metric").select("metric", six("value"), six("lo"), six("hi"), "n")


def agreement(pairs: DataFrame, key: str) -> DataFrame:
    """``key, n, exact, within_1, apart`` of ``key, grade, model_grade``, and a total row whose key is ``total``.

    ``apart`` counts pairs of which only one grade is relevant.
    """
    d = F.abs(F.col("grade") - F.col("model_grade"))
    aggs = [F.count("*").alias("n"), F.count_if(d == 0).alias("exact"), F.count_if(d <= 1).alias("within_1"), F.count_if((F.col("grade") >= RELEVANT) != (F.col("model_grade") >= RELEVANT)).alias("apart")]
    return pairs.rollup(key).agg(*aggs, F.grouping(key).alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col(key)).alias(key), "n", "exact", "within_1", "apart")


def grade_histogram(grades: DataFrame, top: int = 3) -> DataFrame:
    """``grade, n, share`` for each grade from 0 to ``top``, also those that do not occur."""
    domain = grades.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("grade"))
    n = grades.groupBy("grade").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("whole"))
    return domain.join(n, "grade", "left").crossJoin(F.broadcast(whole)).select("grade", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("whole"), 6).alias("share"))


def consistency_issues(queries: DataFrame, grades: DataFrame) -> DataFrame:
    """``query_id, issue`` for queries that contradict their judgments.

    ``answerless``: not answerable, yet a chunk is relevant. ``source_irrelevant``: a source chunk is judged not relevant.
    ``nothing_relevant``: judged, yet no chunk is relevant. ``unjudged``: no judgment.
    """
    best = grades.groupBy("query_id").agg(F.max("grade").alias("best"))
    q = queries.select("query_id", F.coalesce("answerable", F.lit(True)).alias("answerable"), "source_chunk_ids").dropDuplicates(["query_id"]).join(best, "query_id", "left")
    sources = q.where("answerable").select("query_id", F.explode("source_chunk_ids").alias("chunk_id")).join(grades, ["query_id", "chunk_id"]).where(F.col("grade") < RELEVANT)
    name = lambda df, issue: df.select("query_id", F.lit(issue).alias("issue")).distinct()
    return stacked(name(q.where(~F.col("answerable") & (F.col("best") >= RELEVANT)), "answerless"), name(sources, "source_irrelevant"), name(q.where(F.col("best") < RELEVANT), "nothing_relevant"), name(q.where("best is null"), "unjudged"))


def stratified(df: DataFrame, stratum: str, item: str, share: float = 0.25) -> DataFrame:
    """A repeatable sample: of each stratum the ``share`` of items that come first by hash, at least one."""
    by = Window.partitionBy(stratum)
    placed = df.withColumn("_h", F.row_number().over(by.orderBy(F.md5(F.col(item).cast("string")), item))).withColumn("_n", F.count("*").over(by))
    return placed.where(F.col("_h") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.5))).drop("_h", "_n")


#: Metrics of which less is better begin with one of these.
LOWER_IS_BETTER = ("latency", "cost", "seconds")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``metric, delta, separated, better``: of two runs' ``metric, value, lo, hi``.

    ``separated`` where the intervals do not meet; ``better`` whether b moved the right way, null without a move. A metric that one
    run lacks has nulls.
    """
    x, y = (d.select("metric", *(F.col(c).alias(f"{c}_{s}") for c in ("value", "lo", "hi"))) for d, s in ((a, "a"), (b, "b")))
    apart = (F.col("hi_a") < F.col("lo_b")) | (F.col("hi_b") < F.col("lo_a"))
    delta = F.round(F.col("value_b") - F.col("value_a"), 6)
    less = F.lit(False)
    for name in LOWER_IS_BETTER:
        less = less | F.startswith("metric", F.lit(name))
    return x.join(y, "metric", "full_outer").select("metric", delta.alias("delta"), apart.alias("separated"), F.when(delta != 0, (delta > 0) != less).alias("better"))


def config_diff(a: dict[str, str], b: dict[str, str], spark) -> DataFrame:
    """``key, a, b`` of the settings in which two runs differ; null where one lacks the key."""
    rows = [(k, a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)]
    return spark.createDataFrame(rows, "key string, a string, b string")


def judged_counts(results: DataFrame, grades: DataFrame) -> DataFrame:
    """One row ``n_judged, n_unjudged``: queries with results that have judgments, and those that have none and are not scored."""
    judged = grades.select("query_id").distinct().withColumn("j", F.lit(1))
    return results.select("query_id").distinct().join(judged, "query_id", "left").agg(F.count("j").alias("n_judged"), F.count_if(F.col("j").isNull()).alias("n_unjudged"))


def graded_run(results: DataFrame, grades: DataFrame, clause: str, stamp: str, config: dict[str, str], resamples: int = 1000, latency: DataFrame | None = None) -> DataFrame:
    """A run as rows: ``run_id, config, metric, value, lo, hi, n, n_judged, n_unjudged``.

    ``run_id`` is ``clause-stamp``, the stamp (``yyyyMMddHHmmss``) comes from the caller, so a run can be repeated. Metrics are the means of
    :func:`query_scores` over judged queries with bootstrap intervals. ``latency`` (``item, value``) adds its percentiles without intervals.
    """
    per = query_scores(results, grades).select(F.col("query_id").alias("item"), F.expr("stack(4, 'hit', hit, 'reciprocal_rank', reciprocal_rank, 'ndcg', ndcg, 'precision', precision) as (metric, value)"))
    rows = bootstrap(per, resamples)
    if latency is not None:
        p = latency.where("value is not null").agg(*(F.round(F.percentile("value", F.lit(q)), 6).alias(f"latency_p{int(q * 100)}") for q in (0.5, 0.95, 0.99)), F.count("*").alias("n"))
        long = p.select("n", F.expr("stack(3, 'latency_p50', latency_p50, 'latency_p95', latency_p95, 'latency_p99', latency_p99) as (metric, value)"))
        rows = stacked(rows, long, allow_missing=True)
    settings = F.to_json(F.create_map(*[F.lit(x) for kv in sorted(config.items()) for x in kv])) if config else F.lit("{}")
    return rows.crossJoin(F.broadcast(judged_counts(results, grades))).select(F.lit(f"{clause}-{stamp}").alias("run_id"), settings.alias("config"), "metric", "value", "lo", "hi", "n", "n_judged", "n_unjudged")


def modal_share(grades: DataFrame, limit: float = 0.8) -> DataFrame:
    """One row ``grade, share, degenerate``: the most frequent grade, ties to the smaller, and whether it has more than ``limit`` of all."""
    n = grades.groupBy("grade").agg(F.count("*").alias("n"))
    return n.agg(F.max_by("grade", F.struct("n", -F.col("grade"))).alias("grade"), F.round(F.max("n") / F.sum("n"), 6).alias("share")).where("grade is not null").withColumn("degenerate", F.col("share") > limit)


def review(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, chunk_id, grade, gain, dcg, idcg, first_relevant``: each result of a judged query with what it adds, summed up to it."""
    got = with_grades(results.where(F.col("rank") <= k), grades)
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ideal = grades.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "chunk_id"))).where(F.col("i") <= k).groupBy("query_id").agg(F.round(F.sum(_gain(F.col("grade"), F.col("i"))), 6).alias("idcg"))
    gain = _gain(F.col("grade"), F.col("rank"))
    first = F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank"))).over(Window.partitionBy("query_id"))
    return got.withColumn("gain", F.round(gain, 6)).withColumn("dcg", F.round(F.sum(gain).over(upto), 6)).withColumn("first_relevant", first).join(ideal, "query_id").select("query_id", "rank", "chunk_id", "grade", "gain", "dcg", "idcg", "first_relevant")


def worked_example(pairs: DataFrame, least: int = 3) -> DataFrame:
    """One row ``query_id, n``: the query with the most verified judgments, at least ``least``; ties to the smaller id."""
    return pairs.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "query_id").limit(1)


def verification_report(pairs: DataFrame) -> DataFrame:
    """``query_id, chunk_id, grade, model_grade, diverged, crosses``: grades that differ, and such of which only one is relevant."""
    return pairs.select("query_id", "chunk_id", "grade", "model_grade", (F.col("grade") != F.col("model_grade")).alias("diverged"), ((F.col("grade") >= RELEVANT) != (F.col("model_grade") >= RELEVANT)).alias("crosses"))


def grade_deltas(pairs: DataFrame) -> DataFrame:
    """``delta, n``: how often a model's grade lies so far above (or below) the human one, from -3 to 3, zeros included."""
    domain = pairs.sparkSession.range(-3, 4).select(F.col("id").cast("int").alias("delta"))
    n = pairs.groupBy((F.col("model_grade") - F.col("grade")).alias("delta")).agg(F.count("*").alias("n"))
    return domain.join(n, "delta", "left").select("delta", F.coalesce("n", F.lit(0)).alias("n"))
