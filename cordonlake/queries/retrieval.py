"""Retrieval queries: access rules, lexical and dense search, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordonlake.functions.providers import HashedWords, SharedWords, embed
from cordonlake.operators import dense, fusion, lexical, security
from cordonlake.queries.corpus import CHUNKS, chunks
from cordonlake.session import stacked, table

QUERIES, ORACLE = {}, {}
EFS = [40, 100, 200]
ALL_EFS = [40, 100, 200, 400, 800]  # the whole sweep, in the queries named _full


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions, each id once; repeated rows are equal."""
    return table(spark, sf_dir, "queries").where("query_id is not null and question is not null").groupBy("query_id").agg(F.min("question").alias("question"))


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tenant_acl")


def role_of(spark: SparkSession, sf_dir: str) -> str:
    """The role with the most tenants but for the one that has all: a middle-sized scope of these tables."""
    return acl(spark, sf_dir).groupBy("role_name").agg(F.countDistinct("tenant").alias("n")).orderBy(F.col("n").desc(), "role_name").limit(2).collect()[-1][0]


_ROLE = "(SELECT role_name FROM (SELECT role_name, count(DISTINCT tenant) AS n FROM tenant_acl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2) ORDER BY n, role_name DESC LIMIT 1)"
_STOP = "('the','and','for','that','this','with','from','not','any','all','shall','will','may','such','which','has','have','had','was','were','are','our','its','his','her','their','been','other','under','into','upon','than','then','there','these','those','each','also','including')"
_QS = "qs AS (SELECT query_id, min(question) AS question FROM queries WHERE query_id IS NOT NULL AND question IS NOT NULL GROUP BY query_id)"
_POSTS = CHUNKS + f""",
    tk AS (SELECT chunk_id, tenant, list_filter(regexp_extract_all(lower(body), '[a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN {_STOP}) AS t FROM kept),
    posts AS (SELECT chunk_id, tenant, len(t) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, tenant, t, unnest(t) AS term FROM tk) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
    {_QS}"""
_TERMS = _POSTS + """,
    pruned AS (SELECT * FROM df WHERE df < 0.3 * (SELECT count(*) FROM kept)),
    qt AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: len(w) > 2)) AS term FROM qs),
    terms AS (SELECT query_id, term, df FROM qt LEFT JOIN pruned USING (term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df NULLS LAST, term) <= 8)"""
_LEX = _TERMS + """,
    lex AS (SELECT query_id, chunk_id, tenant, round(sum(tf) * 0.1, 6) AS score FROM terms JOIN posts USING (term) GROUP BY ALL),
    lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex QUALIFY rank <= 20)"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, tenant, posts, dl`` of all chunks, cut and counted once: frequencies and scores both come from it."""
    return lexical.indexed(chunks(spark, sf_dir).select("chunk_id", "tenant", "body"))


def _terms(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The rarest words of each question; frequencies are those of all chunks."""
    return lexical.selective_terms(asked, lexical.prune_frequent(lexical.document_frequency(index), index.agg(F.count("*").alias("n"))))


def _lexical(spark: SparkSession, sf_dir: str, asked: DataFrame, role: str | None = None, k: int = 20) -> DataFrame:
    """A role's chunks are picked before anything is ranked."""
    index = _index(spark, sf_dir)
    seen = security.secure_view(index, acl(spark, sf_dir), role) if role else index
    return lexical.or_search(_terms(index, asked), seen, k)


@query("SELECT role_name, count(DISTINCT tenant) AS n_tenants, md5(string_agg(DISTINCT tenant, ',' ORDER BY tenant)) AS tenants FROM tenant_acl GROUP BY role_name")
def permitted_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants of every role."""
    return security.role_tenants(acl(spark, sf_dir)).select("role_name", F.size("tenants").cast("long").alias("n_tenants"), F.md5(F.array_join("tenants", ",")).alias("tenants"))


def _seen(spark: SparkSession, sf_dir: str, roles: list[str | None]) -> DataFrame:
    """``role, tenant, n`` of what each role sees through the secured view, the only way in; nothing else limits the rows."""
    held, rules = chunks(spark, sf_dir).select("tenant"), acl(spark, sf_dir)
    parts = [security.secure_view(held, rules, r).groupBy("tenant").agg(F.count("*").alias("n")).select(F.lit(r).alias("role"), "tenant", "n") for r in roles]
    return stacked(*parts)


@query(f"""WITH {CHUNKS}, r AS (SELECT DISTINCT role_name FROM tenant_acl), t AS (SELECT DISTINCT tenant FROM kept WHERE tenant IS NOT NULL), n AS (SELECT tenant, count(*) AS n FROM kept GROUP BY tenant)
    SELECT r.role_name, t.tenant, EXISTS (SELECT 1 FROM tenant_acl a WHERE a.role_name = r.role_name AND a.tenant = t.tenant) AS due, CASE WHEN EXISTS (SELECT 1 FROM tenant_acl a WHERE a.role_name = r.role_name AND a.tenant = t.tenant) THEN n.n ELSE 0 END AS n_seen, 0::BIGINT AS n_leaked FROM r CROSS JOIN t JOIN n USING (tenant)""")
def role_tenant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per role and tenant whether access is due, and what the role sees of the tenant through the secured view; leaks would be counted."""
    roles = [r[0] for r in acl(spark, sf_dir).select("role_name").distinct().orderBy("role_name").limit(security.MAX_ROLES + 1).collect()]
    return security.access_matrix(acl(spark, sf_dir), chunks(spark, sf_dir), _seen(spark, sf_dir, roles))


FORGED_ROLES = ["", " ", "*", "ALL_TENANTS", "all_tenants ", "%", "nobody", "all_tenants'--", "analyst_mid", "Analyst_Mid", "ANALYST_MID", "analyst_mid\x00", "аnalyst_mid", "single_tenant", "single_tenant,all_tenants"]


@query(f"""WITH {CHUNKS}, r AS (SELECT unnest([{", ".join("'" + r.replace("'", "''").replace(chr(0), "' || chr(0) || '") + "'" for r in FORGED_ROLES)}]) AS role) SELECT r.role AS role, count(kept.chunk_id) AS n_visible, count(DISTINCT kept.tenant) AS n_tenants FROM r
    LEFT JOIN (SELECT DISTINCT role_name, tenant FROM tenant_acl) a ON a.role_name = r.role LEFT JOIN kept ON kept.tenant = a.tenant GROUP BY r.role""")
def forged_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forged names of roles see through the secured view, beside names that exist; names match exactly."""
    roles = spark.range(1).select(F.explode(F.array(*map(F.lit, FORGED_ROLES))).alias("role"))
    seen = _seen(spark, sf_dir, FORGED_ROLES).groupBy("role").agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    return roles.join(seen, "role", "left").select("role", F.coalesce("n", F.lit(0)).alias("n_visible"), F.coalesce("t", F.lit(0)).alias("n_tenants"))


@query(f"""WITH {CHUNKS}, p AS (SELECT DISTINCT tenant FROM tenant_acl WHERE role_name = {_ROLE}) SELECT tenant, count(*) AS n_chunks, count(*) AS n_with_predicate FROM kept WHERE tenant IN (FROM p) GROUP BY tenant""")
def predicate_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant the chunks that a role sees through the secured view alone, and with the predicate on top: they must agree."""
    role, rules = role_of(spark, sf_dir), acl(spark, sf_dir)
    seen = security.secure_view(chunks(spark, sf_dir).select("tenant"), rules, role)
    mine = security.permitted(rules, role).withColumn("ok", F.lit(True))
    return seen.join(F.broadcast(mine), "tenant", "left").groupBy("tenant").agg(F.count("*").alias("n_chunks"), F.count("ok").alias("n_with_predicate"))


@query(f"WITH {_POSTS} SELECT term, df FROM df")
def lexeme_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks per search term."""
    return lexical.document_frequency(chunks(spark, sf_dir))


@query(f"WITH {_TERMS} SELECT term, df FROM pruned")
def lexeme_df_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in less than 30 of 100 chunks."""
    return lexical.prune_frequent(lexeme_df(spark, sf_dir), chunks(spark, sf_dir).agg(F.count("*").alias("n")))


@query(f"WITH {_TERMS} SELECT query_id, term, df FROM terms")
def selective_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rarest words of each question."""
    return _terms(_index(spark, sf_dir), questions(spark, sf_dir))


@query(f"WITH {_LEX} SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM lexical WHERE rank <= 10")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of every question by its rarest words."""
    return _lexical(spark, sf_dir, questions(spark, sf_dir), k=10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_LEX}, s AS (SELECT * FROM lex WHERE tenant IN (SELECT tenant FROM tenant_acl WHERE role_name = {_ROLE}))
    SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def lexical_topk_secure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the chunks that a role may read."""
    return _lexical(spark, sf_dir, questions(spark, sf_dir), role_of(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


_BM25 = _POSTS + f""",
    bq AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN {_STOP})) AS term FROM qs),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM posts)),
    bs AS (SELECT query_id, chunk_id, tenant, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM bq JOIN posts USING (term) JOIN df USING (term), st GROUP BY ALL)"""


@query(f"WITH {_BM25} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs) WHERE rank <= 50")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best chunks of every question by BM25."""
    return lexical.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 50).select("query_id", "chunk_id", "rank")


@query(f"""WITH {_BM25} SELECT query_id, chunk_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs
    WHERE tenant IN (SELECT tenant FROM tenant_acl WHERE role_name = {_ROLE})) WHERE rank <= 50""")
def bm25_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with the statistics of all chunks, ranked among those that a role may read."""
    allowed = security.secure_view(chunks(spark, sf_dir), acl(spark, sf_dir), role_of(spark, sf_dir))
    return lexical.bm25_search(questions(spark, sf_dir), chunks(spark, sf_dir), 50, allowed=allowed).select("query_id", "chunk_id", "rank")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.usable(table(spark, sf_dir, "rls_demo"))


_VEC = """ok AS (SELECT id, tenant, embedding, row_number() OVER (PARTITION BY id ORDER BY tenant NULLS FIRST) AS rn FROM rls_demo WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    v AS (SELECT id::BIGINT AS id, tenant, embedding::DOUBLE[384] AS e FROM ok WHERE rn = 1),
    sc AS (SELECT q.id AS query_id, d.id AS id, d.tenant AS tenant, round(array_cosine_similarity(q.e, d.e), 6) AS score FROM v q JOIN v d ON q.id <> d.id WHERE q.id % 100 = 0)"""


@query(f"WITH {_VEC} SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10")
def dense_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar chunks of every hundredth id, exactly."""
    v = _vectors(spark, sf_dir)
    return dense.exact_top_k(v.where("id % 100 = 0"), v).select("query_id", "id", "score", "rank")


@query(f"""WITH {_VEC} SELECT query_id, id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc WHERE tenant IN (SELECT tenant FROM tenant_acl WHERE role_name = {_ROLE})) WHERE rank <= 10""")
def dense_secure_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the chunks that a role may read."""
    v = _vectors(spark, sf_dir)
    seen = security.secure_view(v, acl(spark, sf_dir), role_of(spark, sf_dir))
    return dense.exact_top_k(v.where("id % 100 = 0"), seen).select("query_id", "id", "score", "rank")


_SWEEP = _VEC + """,
    roles AS (SELECT DISTINCT role_name, tenant FROM tenant_acl WHERE tenant IS NOT NULL), efs AS (SELECT unnest([40, 100, 200]) AS ef),
    ex AS (SELECT role_name, query_id, id FROM (SELECT role_name, sc.*, row_number() OVER (PARTITION BY role_name, query_id ORDER BY score DESC, id) AS e FROM sc JOIN roles USING (tenant)) WHERE e <= 10),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS g FROM sc),
    ret AS (SELECT role_name, query_id, id, ef FROM (SELECT role_name, g.*, ef, row_number() OVER (PARTITION BY role_name, query_id, ef ORDER BY g) AS p FROM g JOIN roles USING (tenant) JOIN efs ON g <= ef) WHERE p <= 10),
    h AS (SELECT ret.role_name, ret.query_id, ef, count(*) AS n_returned, count(ex.id) AS n_hit FROM ret LEFT JOIN ex ON ret.role_name = ex.role_name AND ret.query_id = ex.query_id AND ret.id = ex.id GROUP BY ALL),
    sweep AS (SELECT s.role_name, s.query_id, efs.ef, n_exact, coalesce(n_returned, 0) AS n_returned, coalesce(n_hit, 0) AS n_hit FROM (SELECT role_name, query_id, count(*) AS n_exact FROM ex GROUP BY ALL) s CROSS JOIN efs
        LEFT JOIN h ON h.role_name = s.role_name AND h.query_id = s.query_id AND h.ef = efs.ef)"""


def _sweep(spark: SparkSession, sf_dir: str, efs: list[int] = EFS) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return dense.postfilter_sweep(v.where("id % 100 = 0"), v, acl(spark, sf_dir), efs)


@query(f"WITH {_SWEEP} SELECT role_name, ef, round(sum(n_hit) / sum(n_exact), 6) AS recall, count_if(n_returned = 0) AS n_empty FROM sweep GROUP BY role_name, ef")
def postfilter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall against exact search of a filter after the best 40, 100 and 200, per role."""
    return dense.recall_by_role(_sweep(spark, sf_dir))


_SCAN = "SELECT role_name, query_id, min(CASE WHEN n_returned >= 10 THEN ef END) IS NOT NULL AS filled, coalesce(min(CASE WHEN n_returned >= 10 THEN ef END), max(ef))::INTEGER AS ef FROM sweep GROUP BY role_name, query_id"
# every width up to the first that covers all vectors
_WIDENING = _SWEEP.replace("(SELECT unnest([40, 100, 200]) AS ef)", f"(SELECT ef FROM (SELECT ef, lag(ef, 1, 0) OVER (ORDER BY ef) AS narrower FROM (SELECT unnest({ALL_EFS + [ALL_EFS[-1] << i for i in range(1, 22)]}) AS ef)) WHERE narrower < (SELECT count(*) FROM v))")


@query(f"WITH {_WIDENING} {_SCAN}")
def iterative_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a widening scan has to go until a role gets ten chunks: widths double after 800, and only the end of the vectors leaves a role with less."""
    v = _vectors(spark, sf_dir)
    return _filled(dense.scan_until_filled(v.where("id % 100 = 0"), v, acl(spark, sf_dir), ALL_EFS))


def _filled(scan: DataFrame) -> DataFrame:
    return scan.select("role_name", "query_id", (F.col("n_returned") >= 10).alias("filled"), "ef")


@query(f"""WITH {_SWEEP}, own AS (SELECT DISTINCT role_name, v.id AS query_id FROM v JOIN roles USING (tenant))
    SELECT ef, own.query_id IS NOT NULL AS on_topic, count(*) AS n, round(avg(n_hit / n_exact), 6) AS recall, round(avg(n_returned), 6) AS returned FROM sweep LEFT JOIN own ON own.role_name = sweep.role_name AND own.query_id = sweep.query_id GROUP BY ALL""")
def postfilter_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same averaged over queries whose own tenant the role may read, and the others."""
    return _slices(spark, sf_dir, EFS)


def _slices(spark: SparkSession, sf_dir: str, efs: list[int]) -> DataFrame:
    own = _vectors(spark, sf_dir).where("id % 100 = 0").select(F.col("id").alias("query_id"), "tenant").join(acl(spark, sf_dir).distinct(), "tenant").select("role_name", "query_id").distinct()
    sliced = _sweep(spark, sf_dir, efs).join(own.withColumn("on_topic", F.lit(True)), ["role_name", "query_id"], "left").fillna(False, ["on_topic"])
    return sliced.groupBy("ef", "on_topic").agg(F.count("*").alias("n"), F.round(F.avg(F.col("n_hit") / F.col("n_exact")), 6).alias("recall"), F.round(F.avg("n_returned"), 6).alias("returned"))


_FULL = _SWEEP.replace("[40, 100, 200]", str(ALL_EFS))


@query(ORACLE["postfilter_sweep"].replace(_SWEEP, _FULL))
def postfilter_sweep_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`postfilter_sweep` at all five widths, up to 800."""
    return dense.recall_by_role(_sweep(spark, sf_dir, ALL_EFS))


@query(f"WITH {_FULL} {_SCAN}")
def iterative_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`iterative_scan` that ends at 800, filled or not: the five widths of the sweep."""
    return _filled(dense.widening_scan(_sweep(spark, sf_dir, ALL_EFS)))


@query(ORACLE["postfilter_slices"].replace(_SWEEP, _FULL))
def postfilter_slices_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`postfilter_slices` at all five widths, up to 800."""
    return _slices(spark, sf_dir, ALL_EFS)


def _dense_by_question(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int = 20) -> DataFrame:
    """Questions and chunks through the same embedding model; hashed words stand in for it."""
    model = HashedWords()
    found = dense.exact_top_k(embed(asked, "query_id", "question", model), embed(chunks(spark, sf_dir), "chunk_id", "body", model, "tenant"), k, with_itself=True)
    return found.select("query_id", F.col("id").alias("chunk_id"), "score", "rank")


_EMBEDDED = f"""cbk AS (SELECT chunk_id, b, count(*) AS n FROM (SELECT chunk_id, ('0x' || substr(md5(unnest(t)), 1, 6))::INTEGER % 384 AS b FROM tk) GROUP BY ALL), cn AS (SELECT chunk_id, sqrt(sum(n * n)) AS norm FROM cbk GROUP BY chunk_id),
    qw AS (SELECT query_id, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda w: len(w) > 2 AND w NOT IN {_STOP}) AS t FROM qs),
    qbk AS (SELECT query_id, b, count(*) AS n FROM (SELECT query_id, ('0x' || substr(md5(unnest(t)), 1, 6))::INTEGER % 384 AS b FROM qw) GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qbk GROUP BY query_id),
    dsc AS (SELECT query_id, chunk_id, round(sum(q.n * c.n) / any_value(qn.norm) / any_value(cn.norm), 6) AS score FROM qbk q JOIN cbk c USING (b) JOIN qn USING (query_id) JOIN cn USING (chunk_id) GROUP BY query_id, chunk_id),
    dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dsc QUALIFY rank <= 20)"""
_FUSE = _LEX + f""", {_EMBEDDED},
    fu AS (SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.chunk_id, d.chunk_id) AS chunk_id, l.rank AS lexical_rank, d.rank AS dense_rank, round(coalesce(1 / (60 + l.rank), 0) + coalesce(1 / (60 + d.rank), 0), 9) AS rrf
        FROM (SELECT query_id, chunk_id, rank FROM lexical) l FULL OUTER JOIN dense d ON l.query_id = d.query_id AND l.chunk_id = d.chunk_id),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(lexical_rank, 999999999), chunk_id) AS rank FROM fu)"""


def _fused(spark: SparkSession, sf_dir: str, asked: DataFrame, k: int = 10) -> DataFrame:
    return fusion.reciprocal_rank(_lexical(spark, sf_dir, asked), _dense_by_question(spark, sf_dir, asked), k)


@query(f"WITH {_FUSE} SELECT query_id, chunk_id, lexical_rank::INTEGER AS lexical_rank, dense_rank::INTEGER AS dense_rank, rank::INTEGER AS rank FROM fused WHERE rank <= 10")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and dense lists of 20 fused by reciprocal ranks."""
    return _fused(spark, sf_dir, questions(spark, sf_dir)).select("query_id", "chunk_id", "lexical_rank", "dense_rank", "rank")


@query(f"WITH {_FUSE} SELECT query_id, count_if(lexical_rank IS NOT NULL AND dense_rank IS NOT NULL) AS n_both, count_if(dense_rank IS NULL) AS n_lexical_only, count_if(lexical_rank IS NULL) AS n_dense_only FROM fu GROUP BY query_id")
def retrieval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the two lists of a question share."""
    asked = questions(spark, sf_dir)
    return fusion.overlap(_lexical(spark, sf_dir, asked), _dense_by_question(spark, sf_dir, asked))


_RERANKED = f"""{_FUSE}, f50 AS (SELECT * FROM fused WHERE rank <= 50), qd AS (SELECT query_id, list_distinct(t) AS t FROM qw), dw AS (SELECT chunk_id, list_distinct(t) AS t FROM tk),
    rs AS (SELECT f50.query_id, f50.chunk_id, f50.rank AS was, round(CASE WHEN len(qd.t) = 0 THEN 0 ELSE len(list_intersect(qd.t, dw.t)) / len(qd.t) END, 6) AS score FROM f50 JOIN qd USING (query_id) JOIN dw USING (chunk_id)),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM rs QUALIFY rank <= 10)"""


def _reranked(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    return fusion.rerank(_fused(spark, sf_dir, asked, 50), asked, chunks(spark, sf_dir), SharedWords())


@query(f"WITH {_RERANKED} SELECT query_id, chunk_id, was::INTEGER AS was, score, rank::INTEGER AS rank FROM reranked")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused list read again by a scoring model: ten of up to fifty; shared words stand in for the model."""
    return _reranked(spark, sf_dir, questions(spark, sf_dir)).select("query_id", "chunk_id", "was", "score", "rank")


@query(f"WITH {_RERANKED} SELECT query_id, max(was - rank)::INTEGER AS max_promotion, count_if(was = rank) AS n_unchanged FROM reranked GROUP BY query_id")
def rerank_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far chunks move when the fused list is ranked again."""
    again = _reranked(spark, sf_dir, questions(spark, sf_dir))
    return fusion.movement(again.select("query_id", "chunk_id", F.col("was").alias("rank")), again)
