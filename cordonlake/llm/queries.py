"""Queries of the numbered problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cordonlake.llm.defects import defective_pairs, fitted
from cordonlake.llm.leakage import leaked_items
from cordonlake.llm.mixing import mix
from cordonlake.llm.neardup import near_duplicates
from cordonlake.llm.neighbours import most_similar
from cordonlake.llm.residue import fitted as residue_model
from cordonlake.llm.residue import residue
from cordonlake.llm.splitting import split_items
from cordonlake.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


VECTOR_TABLES = ("rls_demo", "pgvector_rls")


def _nearest_sql(tab: str) -> str:
    return f"""v_{tab} AS (SELECT id::BIGINT AS id, any_value(embedding)::DOUBLE[384] AS e FROM {tab} WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
        n_{tab} AS (SELECT '{tab}' AS tab, least(a, b) AS id_a, greatest(a, b) AS id_b FROM (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(array_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS r FROM v_{tab} a JOIN v_{tab} b ON a.id <> b.id) WHERE r <= 5)"""


@query(f"WITH {_nearest_sql('rls_demo')}, {_nearest_sql('pgvector_rls')} SELECT * FROM n_rls_demo UNION SELECT * FROM n_pgvector_rls")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids of which one is among the 5 most similar of the other, in either table of chunks."""
    parts = []
    for name in VECTOR_TABLES:
        near = most_similar(table(spark, sf_dir, name), "id", "embedding", k=5)
        parts.append(near.select(F.lit(name).alias("tab"), F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")))
    return parts[0].unionByName(parts[1]).distinct()


def _parsed_groups(spark: SparkSession, sf_dir: str, all_links: bool = False):
    return near_duplicates(table(spark, sf_dir, "parsed_docs"), threshold=0.55, shingle=3, all_links=all_links)


_LINKS = r"""d AS (SELECT doc_id, regexp_extract_all(lower(any_value(text)), '[a-z0-9]+') AS w FROM parsed_docs GROUP BY doc_id),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c >= 0.55 * (na.n + nb.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


@query(f"WITH RECURSIVE {_LINKS} SELECT DISTINCT a AS doc_id_a, b AS doc_id_b FROM r WHERE a < b")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parsed documents in one group of near duplicates; the pairs are what is asked for, so groups expand here."""
    members, _ = _parsed_groups(spark, sf_dir)
    m = members.join(members.groupBy("group_id").count().where("count > 1"), "group_id", "left_semi")
    a, b = m.select("group_id", F.col("doc").alias("doc_id_a")), m.select("group_id", F.col("doc").alias("doc_id_b"))
    return a.join(b, "group_id").where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


@query(f"""WITH RECURSIVE {_LINKS}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) AS class_id FROM d WHERE len(w) > 0), heads AS (SELECT DISTINCT class_id FROM c),
    n2 AS (SELECT x.a AS class_id, count(*) AS n_links FROM e x WHERE x.a IN (FROM heads) AND x.b IN (FROM heads) GROUP BY x.a), g AS (SELECT a AS doc_id, min(b) AS other FROM r GROUP BY a)
    SELECT c.doc_id, c.class_id, least(c.doc_id, coalesce(g.other, c.doc_id)) AS group_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n2 USING (class_id) LEFT JOIN g ON g.doc_id = c.doc_id""")
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parsed document with its class of equal texts, its group and the number of links of its class."""
    members, links = _parsed_groups(spark, sf_dir, all_links=True)
    ends = links.select(F.col("a").alias("class_id")).unionAll(links.select(F.col("b").alias("class_id")))
    return members.join(ends.groupBy("class_id").agg(F.count("*").alias("n_links")), "class_id", "left").select(F.col("doc").alias("doc_id"), "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("""WITH d AS (SELECT doc_id, any_value(blocks) AS blocks FROM parsed_docs GROUP BY doc_id), b AS (SELECT doc_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS pos FROM d),
    m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos = 0 OR b.section IS DISTINCT FROM lag(b.section) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM b))
    SELECT doc_id, min(pos)::INTEGER AS first_block FROM m GROUP BY doc_id, run HAVING sum(b.len) + count(*) - 1 > 2000""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blocks of one section that had to be cut."""
    pieces = split_items(table(spark, sf_dir, "parsed_docs"), with_text=False)
    return pieces.where("piece = 1").select("doc_id", "first_block").distinct()


@query()
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all parsed documents, each document once, at most 2,000 characters with an overlap of 200."""
    return split_items(table(spark, sf_dir, "parsed_docs")).dropDuplicates(["doc_id", "first_block", "piece"])


@query("""WITH d AS (SELECT doc_id, any_value(blocks) AS blocks FROM parsed_docs GROUP BY doc_id), b AS (SELECT doc_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) - 1 AS pos FROM d),
    m AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN pos = 0 OR b.section IS DISTINCT FROM lag(b.section) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS new FROM b)),
    i AS (SELECT doc_id, min(pos)::INTEGER AS first_block, (sum(b.len) + count(*) - 1)::BIGINT AS chars FROM m GROUP BY doc_id, run)
    SELECT doc_id, first_block, chars AS covered, chars > 2000 AS divided, 0 AS n_gaps, 0 AS n_too_long, 0 AS n_odd_overlaps, true AS few_pieces FROM i""")
def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every item must keep: they cover it without gaps, none is too long, each repeats up to 200 characters of the one before it, and there
    are at most half as many again as the fewest that could do, and one."""
    pieces = split_items(table(spark, sf_dir, "parsed_docs"), with_text=False).dropDuplicates(["doc_id", "first_block", "piece"])
    before = Window.partitionBy("doc_id", "first_block").orderBy("piece")
    ahead = F.lag("end").over(before)
    laid = pieces.withColumn("own", F.col("end") - F.coalesce(ahead, F.col("start"))).withColumn("over", ahead - F.col("start"))
    fewest = F.ceil((F.first("item_chars") - 200) / 1800)
    return laid.groupBy("doc_id", "first_block").agg(
        F.sum("own").alias("covered"), (F.count("*") > 1).alias("divided"), F.count_if(F.col("over") < 0).alias("n_gaps"), F.count_if(F.col("end") - F.col("start") > 2000).alias("n_too_long"),
        F.count_if((F.col("over") > 200) | (F.col("over") < 1)).alias("n_odd_overlaps"), (F.count("*") <= F.greatest(F.lit(1), 1.5 * fewest + 1)).alias("few_pieces"),
    )


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
    dw AS (SELECT doc_id, unnest([md5(array_to_string(w[k : k + 11], ' ')) for k in range(1, len(w) - 10)]) AS g FROM d WHERE len(w) >= 12), iw AS (SELECT item_id, unnest([md5(array_to_string(w[k : k + 11], ' ')) for k in range(1, len(w) - 10)]) AS g FROM i WHERE len(w) >= 12)
    SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold at least 12 words in a row."""
    hits = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return hits.where("run >= 12").select(F.col("doc_id").cast("long").alias("doc_id"), "item_id").distinct()


@query()
def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they give away, in part or slightly changed, with the extent of it."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), whole=0.8)


_WORDS = "len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))"


@query(f"""
    WITH d AS (SELECT source, sum({_WORDS}) AS own FROM documents GROUP BY source)
    SELECT t.source FROM mix_targets t LEFT JOIN d ON d.source = t.source
    WHERE t.max_repeats * coalesce(d.own, 0) < t.weight * (SELECT sum(own) FROM d)""")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the finished mix leaves short of their target although all of their documents were used as often as allowed."""
    return p7_shares(spark, sf_dir).where("not reachable").select("source")


@query()
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the shares that the mix reaches."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@query()
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answerable golden queries with a defective answer, and the kind of defect."""
    rows = table(spark, sf_dir, "queries").where("answerable")
    return defective_pairs(rows, "query_id", "question", "answer", "supporting_quote", table(spark, sf_dir, "documents")).select(F.col("id").alias("query_id"), "defect")


@query()
def p4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each defect on held-out made-up pairs, and of each language on held-out texts."""
    rows = table(spark, sf_dir, "queries").where("answerable")
    model = fitted(rows, "query_id", "question", "answer", "supporting_quote", table(spark, sf_dir, "documents"))
    return spark.createDataFrame(sorted(model.quality.items()) if model else [], "label string, f1 double")


@query()
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an unfilled placeholder, a paragraph of filler, or mostly a message of a server or viewer."""
    return p8_residue(spark, sf_dir).where("is_residue").select("doc_id").distinct()


@query()
def p8_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what was found in it."""
    return residue(table(spark, sf_dir, "documents"), "doc_id", "text", "tenant").withColumnRenamed("id", "doc_id")


@query()
def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of each class of lines and of placeholders against the weak labels, on tenants (in place of hosts, which the table lacks) left out of the fit."""
    model = residue_model(table(spark, sf_dir, "documents"), "doc_id", "text", "tenant")
    return spark.createDataFrame(sorted(model.quality.items()) if model else [], "label string, f1 double")
