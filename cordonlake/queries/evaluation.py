"""Queries that score retrieval on questions with known answers, check the golden set, and hold answers against what was shown."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordonlake.functions.providers import SharedWords
from cordonlake.functions.text import collapsed
from cordonlake.operators import contract, evaluation, grounding
from cordonlake.plans import answer
from cordonlake.queries.corpus import CHUNKS, DOCS, chunks, documents
from cordonlake.queries.retrieval import _FUSE, _LEX, _QS, _RERANKED, _STOP, _dense_by_question, _fused, _lexical, questions
from cordonlake.session import materialize, stacked, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden queries, each id once; repeated rows are equal."""
    return table(spark, sf_dir, "queries").where("query_id is not null").dropDuplicates(["query_id"])


_GOLD = "gold AS (SELECT query_id, any_value(category) AS category, any_value(question) AS question, any_value(answer) AS answer, any_value(answerable) AS answerable, any_value(source_chunk_ids) AS source_chunk_ids, any_value(source_doc_ids) AS source_doc_ids, any_value(requires_chunks) AS requires_chunks, any_value(supporting_quote) AS supporting_quote, any_value(human_verified) AS human_verified FROM queries WHERE query_id IS NOT NULL GROUP BY query_id)"


# Questions with known answers: of every document one chunk is asked for by every second of 16 of its words. The chunk is
# graded 3, its neighbours in the document 2, the document's other chunks 1.


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, category, question, source_chunk, ordinal`` of one chunk of every document, the one of the smallest hash of its id."""
    c = chunks(spark, sf_dir)
    one = c.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "ordinal", "source", F.slice(F.split("body", " "), 9, 16).alias("w")), F.struct(F.md5("chunk_id"), "chunk_id")).alias("c"))
    words = F.filter("c.w", lambda w, i: i % 2 == 0)
    return one.select(F.col("doc_id").alias("query_id"), F.col("c.source").alias("category"), F.array_join(words, " ").alias("question"), F.col("c.chunk_id").alias("source_chunk"), F.col("c.ordinal").alias("ordinal"))


def known_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = known(spark, sf_dir).select("query_id", F.col("ordinal").alias("at"))
    apart = F.abs(F.col("ordinal") - F.col("at"))
    c = chunks(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "chunk_id", "ordinal")
    return c.join(own, "query_id").select("query_id", "chunk_id", F.when(apart == 0, 3).when(apart == 1, 2).otherwise(1).alias("grade"))


_KNOWN = """kn AS (SELECT doc_id AS query_id, source AS category, chunk_id AS source_chunk, ordinal AS src_ord, string_split(body, ' ')[9:24] AS w FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(chunk_id), chunk_id) = 1),
    qs AS (SELECT query_id, array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ') AS question FROM kn),
    grades AS (SELECT kept.doc_id AS query_id, chunk_id, CASE abs(ordinal - src_ord) WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS grade FROM kept JOIN kn ON kn.query_id = kept.doc_id)"""
_K_LEX, _K_FUSE = _LEX.replace(_QS, _KNOWN), _FUSE.replace(_QS, _KNOWN)
_SCORES = """got AS (SELECT r.query_id, r.rank, coalesce(g.grade, 0) AS grade FROM res r LEFT JOIN grades g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id WHERE r.rank <= 10 AND r.query_id IN (SELECT query_id FROM grades)),
    ideal AS (SELECT query_id, sum((2 ** grade - 1) / log2(i + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS i FROM grades) WHERE i <= 10 GROUP BY query_id),
    per AS (SELECT query_id, max((grade >= 2)::INTEGER)::DOUBLE AS hit, min(CASE WHEN grade >= 2 THEN rank END) AS first, sum((2 ** grade - 1) / log2(rank + 1)) AS dcg, avg((grade >= 2)::INTEGER) AS precision FROM got GROUP BY query_id),
    scores AS (SELECT query_id, round(coalesce(hit, 0), 6) AS hit, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(precision, 0), 6) AS precision FROM ideal LEFT JOIN per USING (query_id))"""
_LEXICAL_SCORES = f"{_K_LEX}, res AS (SELECT query_id, chunk_id, rank FROM lexical), {_SCORES}"
_DENSE_SCORES = f"{_K_FUSE}, res AS (SELECT query_id, chunk_id, rank FROM dense), {_SCORES}"
_MEANS = "SELECT metric, item, value FROM (SELECT query_id AS item, hit, reciprocal_rank, ndcg, precision FROM scores) UNPIVOT (value FOR metric IN (hit, reciprocal_rank, ndcg, precision))"


def _list(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    asked = known(spark, sf_dir).select("query_id", "question")
    return {"lexical": _lexical, "dense": _dense_by_question, "fused": _fused}[which](spark, sf_dir, asked).select("query_id", "chunk_id", "rank")


def _scores(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return evaluation.query_scores(_list(spark, sf_dir, which), known_grades(spark, sf_dir))


def _long(scores: DataFrame) -> DataFrame:
    return scores.select(F.col("query_id").alias("item"), F.expr("stack(4, 'hit', hit, 'reciprocal_rank', reciprocal_rank, 'ndcg', ndcg, 'precision', precision) as (metric, value)"))


@query(f"WITH {_LEXICAL_SCORES} SELECT * FROM scores")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit, reciprocal rank, ndcg and precision at 10 of lexical search, per question with a known answer."""
    return _scores(spark, sf_dir, "lexical")


@query(f"WITH {_DENSE_SCORES} SELECT * FROM scores")
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of dense search."""
    return _scores(spark, sf_dir, "dense")


@query(f"WITH {_K_FUSE}, res AS (SELECT query_id, chunk_id, rank FROM fused), {_SCORES} SELECT * FROM scores")
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the fused list."""
    return _scores(spark, sf_dir, "fused")


_BOOT = """, {x}long AS ({means}), {x}d AS (SELECT metric, value, item, unnest(range(1000)) AS r FROM {x}long),
    {x}u AS (SELECT metric, value, r, ('0x' || substr(md5(metric || '/' || item || '/' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM {x}d),
    {x}t AS (SELECT *, (u >= 0.36787944117144233::DOUBLE)::INT + (u >= 0.7357588823428847::DOUBLE)::INT + (u >= 0.9196986029286058::DOUBLE)::INT + (u >= 0.9810118431238462::DOUBLE)::INT + (u >= 0.9963401531726563::DOUBLE)::INT + (u >= 0.9994058151824183::DOUBLE)::INT + (u >= 0.9999167588507119::DOUBLE)::INT AS t FROM {x}u),
    {x}m AS (SELECT metric, r, sum(value * t) / sum(t) AS m FROM {x}t GROUP BY metric, r HAVING sum(t) > 0), {x}o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY m, r) - 1 AS i, count(*) OVER (PARTITION BY metric) AS c FROM {x}m),
    {x}boot AS (SELECT {x}long.metric, round(avg(value), 6) AS value, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n FROM {x}long JOIN (SELECT metric, round(max(CASE WHEN i = floor(c * 0.025) THEN m END), 6) AS lo, round(max(CASE WHEN i = least(floor(c * 0.975), c - 1) THEN m END), 6) AS hi FROM {x}o GROUP BY metric) e USING (metric) GROUP BY {x}long.metric)"""


def _boot_sql(x: str = "", means: str = _MEANS) -> str:
    return _BOOT.replace("{x}", x).replace("{means}", means)


@query(f"WITH {_LEXICAL_SCORES}{_boot_sql()} SELECT * FROM boot")
def bootstrap_ci_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the lexical scores with their bootstrap intervals over 1,000 resamples."""
    return evaluation.bootstrap(_long(_scores(spark, sf_dir, "lexical")))


@query(f"WITH {_DENSE_SCORES}{_boot_sql()} SELECT * FROM boot")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of dense search."""
    return evaluation.bootstrap(_long(_scores(spark, sf_dir, "dense")))


def _named(scores: str) -> str:
    """The blocks of :data:`_SCORES` under names of their own, so that two lists can be scored in one statement."""
    return re.sub(r"\b(res|got|ideal|per|scores)\b(?= AS \(| r\b| USING| WHERE| LEFT| GROUP|\))", r"l_\1", scores)


@query(f"""WITH {_DENSE_SCORES}{_boot_sql()}, {_named("res AS (SELECT query_id, chunk_id, rank FROM lexical), " + _SCORES)}{_boot_sql("l_", _MEANS.replace("FROM scores)", "FROM l_scores)"))}
    SELECT metric, round(b.value - a.value, 6) AS delta, a.hi < b.lo OR b.hi < a.lo AS separated, CASE WHEN round(b.value - a.value, 6) <> 0 THEN round(b.value - a.value, 6) > 0 END AS better FROM l_boot a JOIN boot b USING (metric)""")
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense against lexical search: differences of means, whether their intervals are apart, and whether dense is better."""
    a, b = (evaluation.bootstrap(_long(_scores(spark, sf_dir, w))) for w in ("lexical", "dense"))
    return evaluation.compare_runs(a, b)


@query(f"""WITH {_LEX.replace(_QS, _KNOWN.replace("qs AS (", "kq AS (") + ", qs AS (FROM kq UNION ALL SELECT query_id, min(question) FROM queries WHERE query_id IS NOT NULL AND question IS NOT NULL GROUP BY query_id)")}, res AS (SELECT query_id, chunk_id, rank FROM lexical), {_SCORES}{_boot_sql()},
    c AS (SELECT count(*) FILTER (query_id IN (SELECT query_id FROM grades)) AS n_judged, count(*) FILTER (query_id NOT IN (SELECT query_id FROM grades)) AS n_unjudged FROM (SELECT DISTINCT query_id FROM res)),
    p AS (SELECT 'latency_p50' AS metric, round(quantile_cont(value, 0.5), 6) AS value, count(*) AS n FROM events WHERE value IS NOT NULL UNION ALL SELECT 'latency_p95', round(quantile_cont(value, 0.95), 6), count(*) FROM events WHERE value IS NOT NULL UNION ALL SELECT 'latency_p99', round(quantile_cont(value, 0.99), 6), count(*) FROM events WHERE value IS NOT NULL)
    SELECT 'lexical-20240501120000' AS run_id, '{{"k":"10","list":"lexical"}}' AS config, metric, value, lo, hi, n, n_judged, n_unjudged FROM (SELECT metric, value, lo, hi, n FROM boot UNION ALL SELECT metric, value, NULL, NULL, n FROM p), c""")
def graded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the questions with known answers and the golden ones, which nobody judged: metrics, intervals, percentiles, counts."""
    asked = stacked(known(spark, sf_dir).select("query_id", "question"), questions(spark, sf_dir))
    latency = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("item"), "value")
    # written, as scores and counts both read it
    return evaluation.graded_run(materialize(_lexical(spark, sf_dir, asked), "found"), known_grades(spark, sf_dir), "lexical", "20240501120000", {"list": "lexical", "k": "10"}, latency=latency)


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of a measured value per kind of event."""
    six = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return table(spark, sf_dir, "events").where("value is not null").groupBy("event_type").agg(F.count("*").alias("n"), six(0.5).alias("p50"), six(0.95).alias("p95"), six(0.99).alias("p99"))


@query(f"WITH {_LEXICAL_SCORES}, rv AS (SELECT r.query_id, r.chunk_id, r.rank, coalesce(g.grade, 0) AS grade FROM res r LEFT JOIN grades g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id WHERE r.rank <= 10) SELECT query_id, rank::INTEGER AS rank, chunk_id, grade::INTEGER AS grade, round((2 ** grade - 1) / log2(rank + 1), 6) AS gain, round(sum((2 ** grade - 1) / log2(rank + 1)) OVER (PARTITION BY query_id ORDER BY rank), 6) AS dcg, round(idcg, 6) AS idcg, min(CASE WHEN grade >= 2 THEN rank END) OVER (PARTITION BY query_id)::INTEGER AS first_relevant FROM rv JOIN ideal USING (query_id)")
def query_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result of every judged question with its grade and what it adds."""
    return evaluation.review(_list(spark, sf_dir, "lexical"), known_grades(spark, sf_dir))


# A judge reads the found chunks of a question and its source. The stand-in grades by the share of the question's words that a chunk has,
# and writes what a model would write: JSON in several shapes, now and then with an odd grade, an entry left out, or no JSON at all.

_ODD = ['"grade": %d', '"grade": "%d"', '"grade": %d.0', '"grade": 7', '"grade": "high"', '"grade": null', '"grade": %d', '"grade": %d']


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = materialize(known(spark, sf_dir), "known")
    # written, as the responses and the grades both read it
    return materialize(contract.pool(_lexical(spark, sf_dir, k.select("query_id", "question")), k.select("query_id", F.col("source_chunk").alias("chunk_id"))), "pool")


def _responses(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    from cordonlake.functions.text import search_terms

    q = known(spark, sf_dir).select("query_id", F.array_distinct(search_terms(F.col("question"))).alias("qt"))
    c = chunks(spark, sf_dir).select("chunk_id", F.array_distinct(search_terms(F.col("body"))).alias("ct"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("qt", "ct")), F.size("qt")), F.lit(0.0))
    read = asked.join(q, "query_id").join(c, "chunk_id").withColumn("g", F.floor(share * 3 + 0.5).cast("int")).withColumn("h", F.conv(F.substring(F.md5(F.concat_ws("|", "query_id", "chunk_id")), 1, 1), 16, 10).cast("int"))
    odd = F.get(F.array(*map(F.lit, _ODD)), F.pmod("h", F.lit(len(_ODD))))
    entry = F.when(F.col("h") < 15, F.concat(F.lit('{"id": "'), "chunk_id", F.lit('", '), F.replace(odd, F.lit("%d"), F.col("g").cast("string")), F.lit(', "why": "words shared"}')))
    body = read.groupBy("query_id", "batch").agg(F.array_join(F.array_sort(F.collect_list(entry)), ", ").alias("e"))
    shape = F.conv(F.substring(F.md5(F.concat_ws("|", "query_id", "batch")), 1, 1), 16, 10).cast("int")
    text = (F.when(shape < 4, F.concat(F.lit("["), "e", F.lit("]"))).when(shape < 7, F.concat(F.lit('{"judgments": ['), "e", F.lit("]}"))).when(shape < 10, F.concat(F.lit('{"results": ['), "e", F.lit("]}")))
            .when(shape < 13, F.concat(F.lit("```json\n["), "e", F.lit("]\n```"))).when(shape < 15, F.concat(F.lit("Here are the grades: ["), "e", F.lit("] as asked."))).otherwise(F.lit("I could not grade these.")))
    return body.select("query_id", "batch", text.alias("response"))


_JUDGED = f"""{_K_LEX}, po AS (SELECT query_id, chunk_id, min(rank) AS rank, max(s) AS is_source FROM (SELECT query_id, chunk_id, rank, false AS s FROM lexical UNION ALL SELECT query_id, source_chunk, NULL, true FROM kn) GROUP BY ALL),
    pool AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS LAST, chunk_id) - 1) // 5 AS batch FROM po),
    qd AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN {_STOP})) AS t FROM qs), cd AS (SELECT chunk_id, list_distinct(t) AS t FROM tk),
    rd AS (SELECT pool.*, floor(CASE WHEN len(qd.t) = 0 THEN 0 ELSE len(list_intersect(qd.t, cd.t)) / len(qd.t) END * 3 + 0.5)::INTEGER AS g, ('0x' || substr(md5(query_id || '|' || chunk_id), 1, 1))::INTEGER AS h, ('0x' || substr(md5(query_id || '|' || batch), 1, 1))::INTEGER AS sh FROM pool JOIN qd USING (query_id) JOIN cd USING (chunk_id)),
    model AS (SELECT query_id, chunk_id, is_source, batch::INTEGER AS batch, CASE WHEN h = 15 OR sh = 15 OR h % 8 IN (4, 5) THEN 0 WHEN h % 8 = 3 THEN 3 ELSE g END AS model_grade, CASE WHEN h = 15 OR sh = 15 THEN '' ELSE 'words shared' END AS why FROM rd),
    pairs AS (SELECT m.query_id, m.chunk_id, coalesce(g.grade, 0)::INTEGER AS grade, model_grade FROM model m LEFT JOIN grades g ON g.query_id = m.query_id AND g.chunk_id = m.chunk_id)"""


def _model_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _asked(spark, sf_dir)
    return contract.judgments(_responses(spark, sf_dir, asked), asked)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the questions with known answers (human) beside those of the judge (model)."""
    human = known_grades(spark, sf_dir)
    return _model_grades(spark, sf_dir).select("query_id", "chunk_id", F.col("grade").alias("model_grade")).join(human, ["query_id", "chunk_id"], "left").fillna(0, ["grade"])


@query(f"WITH {_JUDGED} SELECT query_id, chunk_id, batch, is_source FROM model")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge is given: up to 20 found chunks of a question and its source, in batches of five."""
    return _asked(spark, sf_dir).select("query_id", "chunk_id", "batch", "is_source")


@query(f"WITH {_JUDGED} SELECT query_id, chunk_id, model_grade AS grade, why FROM model")
def judge_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades out of the responses of a judge, whatever their form."""
    return _model_grades(spark, sf_dir)


@query(f"""WITH {_JUDGED} SELECT CASE WHEN grouping(category) = 1 THEN 'total' ELSE category END AS category, count(*) AS n, count_if(grade = model_grade) AS exact, count_if(abs(grade - model_grade) <= 1) AS within_1, count_if((grade >= 2) <> (model_grade >= 2)) AS apart
    FROM pairs JOIN kn USING (query_id) GROUP BY ROLLUP (category)""")
def agreement_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the judge with the known grades, per category and in total."""
    pairs = _pairs(spark, sf_dir).join(known(spark, sf_dir).select("query_id", "category"), "query_id")
    return evaluation.agreement(pairs, "category")


@query(f"WITH {_JUDGED} SELECT d.grade, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM pairs), 6) AS share FROM (SELECT unnest([0, 1, 2, 3]) AS grade) d LEFT JOIN (SELECT model_grade AS grade, count(*) AS n FROM pairs GROUP BY ALL) p USING (grade)")
def grade_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the judge gave each grade."""
    return evaluation.grade_histogram(_model_grades(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT d.delta, coalesce(n, 0) AS n FROM (SELECT unnest(range(-3, 4))::INTEGER AS delta) d LEFT JOIN (SELECT model_grade - grade AS delta, count(*) AS n FROM pairs GROUP BY ALL) p USING (delta)")
def grade_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the judge's grades lie from the known ones."""
    return evaluation.grade_deltas(_pairs(spark, sf_dir))


@query(f"WITH {_JUDGED}, h AS (SELECT model_grade AS grade, count(*) AS n FROM pairs GROUP BY ALL) SELECT arg_max(grade, n * 10 - grade) AS grade, round(max(n) / sum(n), 6) AS share, round(max(n) / sum(n), 6) > 0.8 AS degenerate FROM h")
def modal_share_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the judge gives nearly always the same grade."""
    return evaluation.modal_share(_model_grades(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT query_id, chunk_id, grade, model_grade, grade <> model_grade AS diverged, (grade >= 2) <> (model_grade >= 2) AS crosses FROM pairs")
def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of known and judged grades, and where they part."""
    return evaluation.verification_report(_pairs(spark, sf_dir))


@query(f"WITH {_JUDGED} SELECT query_id, count(*) AS n FROM pairs GROUP BY query_id HAVING n >= 3 ORDER BY n DESC, query_id LIMIT 1")
def worked_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question with the most judgments, as an example to show."""
    return evaluation.worked_example(_pairs(spark, sf_dir))


@query(f"""WITH {_JUDGED}, m AS (SELECT query_id, chunk_id, model_grade AS grade FROM model) SELECT coalesce(g.query_id, m.query_id) AS query_id, coalesce(g.chunk_id, m.chunk_id) AS chunk_id, coalesce(g.grade, m.grade)::INTEGER AS grade, CASE WHEN g.grade IS NULL THEN 'model' ELSE 'human' END AS "by"
    FROM m FULL OUTER JOIN grades g ON g.query_id = m.query_id AND g.chunk_id = m.chunk_id""")
def merge_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge's grades, overridden by the known ones."""
    return evaluation.override_grades(_model_grades(spark, sf_dir), known_grades(spark, sf_dir))


@query(f"""WITH {_JUDGED}, best AS (SELECT query_id, max(model_grade) AS best FROM model GROUP BY query_id), a AS (SELECT kn.query_id, ('0x' || substr(md5(kn.query_id), 1, 1))::INTEGER <> 3 AS answerable, source_chunk, best FROM kn LEFT JOIN best USING (query_id)
        UNION ALL SELECT query_id, coalesce(any_value(answerable), true), NULL, NULL FROM queries WHERE query_id IS NOT NULL GROUP BY query_id)
    SELECT query_id, 'answerless' AS issue FROM a WHERE NOT answerable AND best >= 2 UNION SELECT query_id, 'nothing_relevant' FROM a WHERE best < 2 UNION SELECT query_id, 'unjudged' FROM a WHERE best IS NULL
    UNION SELECT a.query_id, 'source_irrelevant' FROM a JOIN model m ON m.query_id = a.query_id AND m.chunk_id = a.source_chunk WHERE answerable AND model_grade < 2""")
def consistency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that contradict the judge's grades; one in sixteen of those with known answers is called unanswerable, golden ones are unjudged."""
    k = known(spark, sf_dir).select("query_id", (F.substring(F.md5("query_id"), 1, 1) != "3").alias("answerable"), F.array("source_chunk").alias("source_chunk_ids"))
    g = golden(spark, sf_dir).select("query_id", "answerable", F.lit(None).cast("array<string>").alias("source_chunk_ids"))
    return evaluation.consistency_issues(stacked(k, g), _model_grades(spark, sf_dir))


@query(f"WITH {_GOLD} SELECT category, query_id FROM (SELECT category, query_id, row_number() OVER (PARTITION BY category ORDER BY md5(query_id), query_id) AS h, count(*) OVER (PARTITION BY category) AS n FROM gold) WHERE h <= greatest(1, floor(n * 0.25 + 0.5))")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the queries of each category, the same on every run."""
    return evaluation.stratified(golden(spark, sf_dir).select("category", "query_id"), "category", "query_id")


@query(f"""WITH {CHUNKS}, {_GOLD}, r AS (SELECT query_id, unnest(source_chunk_ids) AS chunk_id FROM gold) SELECT query_id, chunk_id FROM r WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM kept)""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source chunks of golden queries that the corpus does not have: a reference to a chunk past the document's end."""
    refs = golden(spark, sf_dir).select("query_id", F.explode("source_chunk_ids").alias("chunk_id")).where("chunk_id is not null")
    return refs.join(chunks(spark, sf_dir).select("chunk_id"), "chunk_id", "left_anti").select("query_id", "chunk_id")


# Answers to the questions with known answers, as a model would write them: JSON whose claims quote the source chunk, by the hash of the
# document word for word, changed, made up, from a passage that was not shown, or not at all; some responses break the contract.

_HEX = "0123456789abcdef"


def _answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select("chunk_id", "body")
    k = known(spark, sf_dir).select("query_id", F.col("source_chunk").alias("chunk_id")).join(c, "chunk_id")
    digit = lambda n: F.substring(F.md5("query_id"), n, 1)
    w = F.filter(F.transform(F.slice(F.split("body", " "), 3, 12), lambda x: F.regexp_replace(x, r'["\\]', "")), lambda x: x != "")
    words = k.select("query_id", "chunk_id", w.alias("w"), digit(1).alias("v"), digit(2).alias("form"), (digit(3) < "c").alias("answerable"))
    altered = F.transform("w", lambda x, i: F.when(i == 5, F.lit("altered")).otherwise(x))
    return words.withColumn("good", F.array_join(F.transform("w", lambda x: F.upper(x)), "  ")).withColumn("bad", F.array_join(altered, " "))


def _claim_json(chunk, quote):
    return F.concat(F.lit('{"text": "a claim", "chunk_id": "'), chunk, F.lit('", "quote": "'), quote, F.lit('"}'))


def _answer_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``answer_id, response, answerable``."""
    p = _answer_parts(spark, sf_dir)
    good, bad = _claim_json(F.col("chunk_id"), F.col("good")), _claim_json(F.col("chunk_id"), F.col("bad"))
    v = F.col("v")
    claims = (F.when(v < "8", good).when(v < "a", bad).when(v == "a", _claim_json(F.lit("nowhere::fixed-512::00000"), F.col("good"))).when(v == "b", _claim_json(F.col("chunk_id"), F.lit("")))
              .when(v.isin("c", "d"), F.lit("")).when(v == "e", good).otherwise(F.concat(good, F.lit(", "), bad)))
    answer = F.when(v == "d", "Not stated.").when(v == "e", "It is not stated as such, but the passage names what was asked for.").otherwise("  As the passage says. ")
    flag = F.when(v.isin("d", "e"), "true").otherwise("false")
    whole = F.concat(F.lit('{"answer": "'), answer, F.lit('", "abstained": '), F.when(F.col("form") == "e", F.lit('"no"')).otherwise(flag), F.lit(', "claims": ['), claims, F.lit("]}"))
    form = F.col("form")
    text = (F.when(form < "6", whole).when(form < "9", F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(form < "c", F.concat(F.lit("Sure: "), whole, F.lit(" (end)")))
            .when(form == "c", F.substring(whole, 1, 40)).when(form == "d", F.lit('["a list"]')).when(form == "f", F.replace(whole, F.lit('"answer"'), F.lit('"reply"'))).otherwise(whole))
    return p.select(F.col("query_id").alias("answer_id"), text.alias("response"), "answerable")


_NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_ANSWERS = f"""{CHUNKS}, {_KNOWN}, an AS (SELECT query_id AS answer_id, source_chunk, substr(md5(query_id), 1, 1) AS v, substr(md5(query_id), 2, 1) AS form, substr(md5(query_id), 3, 1) < 'c' AS answerable,
        list_filter(list_transform(string_split(body, ' ')[3:14], lambda x: regexp_replace(x, '["\\\\]', '', 'g')), lambda x: x <> '') AS w, body FROM kn JOIN kept ON chunk_id = source_chunk),
    ct AS (SELECT *, CASE WHEN form = 'c' THEN 'no json' WHEN form = 'd' THEN 'not an object' WHEN form = 'f' THEN 'answer missing' WHEN form = 'e' THEN 'abstained not a boolean' WHEN v = 'b' THEN 'claim incomplete' END AS problem FROM an),
    ok AS (SELECT *, array_to_string(list_transform(w, lambda x: upper(x)), '  ') AS good, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 6 THEN 'altered' ELSE x END), ' ') AS bad FROM ct WHERE problem IS NULL),
    cl AS (SELECT answer_id, 0 AS claim_no, CASE WHEN v = 'a' THEN 'nowhere::fixed-512::00000' ELSE source_chunk END AS passage_id, CASE WHEN v IN ('8', '9') THEN bad ELSE good END AS quote FROM ok WHERE v NOT IN ('c', 'd') UNION ALL SELECT answer_id, 1, source_chunk, bad FROM ok WHERE v = 'f'),
    v AS (SELECT cl.*, kept.chunk_id IS NOT NULL AS resolved, coalesce({_NORM.format('quote')} <> '' AND contains({_NORM.format('kept.body')}, {_NORM.format('quote')}), false) AS verified, kept.body FROM cl LEFT JOIN kept ON kept.chunk_id = passage_id)"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.answers(_answer_responses(spark, sf_dir))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = chunks(spark, sf_dir).select(F.col("chunk_id").alias("passage_id"), "body")
    return grounding.verify(grounding.resolve(contract.claims_of(_parsed(spark, sf_dir)), shown))


@query(f"""WITH {_ANSWERS} SELECT answer_id, problem, CASE WHEN problem IS NULL THEN CASE v WHEN 'd' THEN 'Not stated.' WHEN 'e' THEN 'It is not stated as such, but the passage names what was asked for.' ELSE 'As the passage says.' END END AS answer, CASE WHEN problem IS NULL THEN v IN ('d', 'e') END AS abstained,
    CASE WHEN problem IS NULL THEN CASE WHEN v IN ('c', 'd') THEN 0 WHEN v = 'f' THEN 2 ELSE 1 END END AS n_claims FROM ct""")
def answer_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of a model held to the contract of an answer."""
    return _parsed(spark, sf_dir).select("answer_id", "problem", "answer", "abstained", F.when(F.col("claims").isNotNull(), F.size("claims")).alias("n_claims"))


@query(f"WITH {_ANSWERS} SELECT answer_id, claim_no, passage_id, resolved, verified FROM v")
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the passages that answers cite were there, and hold the quotes."""
    return _verified(spark, sf_dir).select("answer_id", "claim_no", "passage_id", "resolved", "verified")


@query(f"""WITH {_ANSWERS}, n AS (SELECT answer_id, claim_no, verified, {_NORM.format('body')} AS b, string_split({_NORM.format('quote')}, ' ') AS q FROM v WHERE resolved),
    r AS (SELECT answer_id, claim_no, verified, b, q, unnest(range(1, len(q) + 1)) AS i FROM n), s AS (SELECT *, unnest(range(i, len(q) + 1)) AS j FROM r)
    SELECT answer_id, claim_no, round(CASE WHEN bool_or(verified) THEN 1.0 ELSE coalesce(max(CASE WHEN contains(b, array_to_string(q[i:j], ' ')) THEN j - i + 1 END), 0) / max(len(q)) END, 6) AS overlap FROM s GROUP BY answer_id, claim_no""")
def quote_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long a run of a quote's words stands in its passage: all of it, or less where the quote was changed."""
    v = grounding.overlaps(_verified(spark, sf_dir).where("resolved"))
    return v.select("answer_id", "claim_no", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {_ANSWERS}, a AS (SELECT answer_id, v IN ('d', 'e') AS abstained, answerable, CASE WHEN v IN ('c', 'd') THEN 0 WHEN v = 'f' THEN 2 ELSE 1 END AS n_claims FROM ok), c AS (SELECT answer_id, count(*) AS n_cited, round(avg((resolved AND verified)::INTEGER), 6) AS accuracy FROM v GROUP BY answer_id)
    SELECT answer_id, n_claims, coalesce(n_cited, 0) AS n_cited, accuracy, CASE WHEN n_claims > 0 THEN round(coalesce(n_cited, 0) / n_claims, 6) END AS coverage, abstained <> answerable AS abstention_correct FROM a LEFT JOIN c USING (answer_id)""")
def citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per answer that keeps the contract: citations that hold, claims that are cited, and whether abstaining was right."""
    asked = _answer_responses(spark, sf_dir).select("answer_id", "answerable")
    a = _parsed(spark, sf_dir).where("problem is null").join(asked, "answer_id").select("answer_id", "abstained", "answerable", F.size("claims").alias("n_claims"))
    return grounding.citation_metrics(a, _verified(spark, sf_dir))


@query(f"""WITH {_ANSWERS}, s AS (SELECT answer_id, count(*) AS claims, count_if(NOT resolved) AS open, count_if(NOT verified) AS wrong FROM v GROUP BY answer_id),
    g AS (SELECT ok.answer_id, CASE WHEN v = 'd' THEN 'abstained' WHEN coalesce(claims, 0) = 0 THEN 'no citations' WHEN open > 0 THEN open || ' unresolved' WHEN wrong > 0 THEN wrong || ' unverified' END AS reason FROM ok LEFT JOIN s USING (answer_id))
    SELECT answer_id, reason IS NOT NULL AS abstained, reason FROM g""")
def abstention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answers stand, and why the others do not."""
    answers = _parsed(spark, sf_dir).where("problem is null").select("answer_id", "answer", "abstained")
    return grounding.gate(answers, _verified(spark, sf_dir))


@query(f"""WITH {_RERANKED}, top AS (SELECT query_id, chunk_id, substr(body, 1, 700) AS body FROM reranked JOIN kept USING (chunk_id) WHERE rank = 1),
    a AS (SELECT qs.query_id AS answer_id, top.chunk_id, substr(md5(question), 1, 1) AS h FROM qs LEFT JOIN top USING (query_id))
    SELECT answer_id, CASE WHEN chunk_id IS NULL THEN 'abstained' WHEN h = '2' THEN 'contract: no json' WHEN h IN ('0', '1') THEN '1 unverified' END AS reason, chunk_id IS NULL OR h IN ('0', '1', '2') AS abstained FROM a""")
def answer_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions through the whole chain: lists of 20 fused, 50 reranked to 10, 5 shown, written, parsed, resolved, verified, gated."""
    asked = questions(spark, sf_dir)
    stages = answer.answer_questions(asked, _fused(spark, sf_dir, asked, 50), chunks(spark, sf_dir), SharedWords(), answer.Extracts())
    return stages["gate"].select("answer_id", "reason", "abstained")


@query(f"WITH {_GOLD} SELECT query_id, {_NORM.format('question')} AS question FROM gold WHERE question IS NOT NULL")
def collapsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in the form in which quotes are compared."""
    return golden(spark, sf_dir).where("question is not null").select("query_id", collapsed(F.col("question")).alias("question"))
