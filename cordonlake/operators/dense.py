"""Dense retrieval of a stated query set against all vectors, exact and as an index with a later filter would answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordonlake.session import bounded_pandas, giving_back, in_order, materialize, names_at, read_batches, stacked, unique_rows

QUERY_ROWS = 10_000
BROADCAST_QUERIES = 5_000
TASK_QUERIES = 2_500
ROLE_ROWS = 1_000_000
_NEAR = 3e-5  # more than single precision can be off in a cosine


def usable(df: DataFrame, dim: int = 384) -> DataFrame:
    """``id, tenant, v``, one row per id: of repeated ids the first by tenant. Null, all-zero and other vectors are left out.

    Read from files, no vector is shuffled for it.
    """
    ok = df.where(F.col("id").isNotNull() & (F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0))
    return unique_rows(ok, "id", ["tenant"]).select("id", F.col("tenant").cast("string").alias("tenant"), F.col("embedding").alias("v"))


def similarities(queries: DataFrame, vectors: DataFrame, block: int = 500, best: int | None = None) -> DataFrame:
    """``query_id, id, tenant, score`` of every query against every vector; both from :func:`usable` or ``providers.embed``.

    The query set is broadcast in parts of about ``QUERY_ROWS`` and multiplied with each batch of vectors where it is read; scores are cosines rounded to 6 decimals. Callers rank at once, so a query's rows never gather. With ``best`` a
    batch gives only what its ``best`` highest scores per query reach, ties included, which is all that a top-k needs.
    """
    def unit(column: pd.Series) -> np.ndarray:
        v = np.stack(column.to_numpy()).astype(np.float64)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    kinds = dict(queries.dtypes)["id"], dict(vectors.dtypes)["id"]
    schema = "query_id {}, id {}, tenant string, score double".format(*(k if k == "string" else "long" for k in kinds))

    def score(batches, shared):
        q_ids, q = shared.value
        for pdf in batches:
            if not len(pdf) or not len(q_ids):
                continue
            v = unit(pdf["v"])
            for lo in range(0, len(q_ids), block):
                s = np.round(q[lo : lo + block] @ v.T, 6)
                if best and s.shape[1] > best:
                    row, col = np.nonzero(s >= np.partition(s, -best, axis=1)[:, -best, None])
                    yield pd.DataFrame({"query_id": q_ids[lo + row], "id": pdf["id"].to_numpy()[col], "tenant": pdf["tenant"].to_numpy()[col], "score": s[row, col]})
                    continue
                yield pd.DataFrame({
                    "query_id": np.repeat(q_ids[lo : lo + block], len(v)), "id": np.tile(pdf["id"].to_numpy(), len(s)),
                    "tenant": np.tile(pdf["tenant"].to_numpy(), len(s)), "score": s.ravel(),
                })

    parts = max(1, -(-queries.count() // QUERY_ROWS))
    out = None
    for part in range(parts):
        asked = bounded_pandas(queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).select("id", "v"), 2 * QUERY_ROWS, "query vectors of one part")
        matrix = unit(asked["v"]) if len(asked) else np.zeros((0, 1))
        shared = vectors.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(object if kinds[0] == "string" else "int64"), matrix))
        scored = vectors.select("id", "tenant", "v").mapInPandas(lambda batches, shared=shared: score(batches, shared), schema)
        out = scored if out is None else stacked(out, scored)
    return out


def ranked(scores: DataFrame, k: int, name: str = "rank") -> DataFrame:
    """The k best per query, ties to the smaller id; partial top-k lists are taken before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


class _Best:
    """The k best ids of each of ``n`` queries so far, ties to the smaller id, each with a tag; free places have the score -inf.

    Offers are gathered until they are a quarter of all places, then merged; the lists are complete after :meth:`settle`.
    """

    def __init__(self, n: int, k: int):
        self.score, self.id, self.tag = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1, np.int32)
        self._offered: list[tuple[np.ndarray, ...]] = []

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, tag: np.ndarray) -> None:
        self._offered.append((row, score, ids, tag))
        if sum(len(x[0]) for x in self._offered) > self.score.size // 4:
            self.settle()

    def settle(self) -> None:
        if not self._offered:
            return
        row, score, ids, tag = (np.concatenate(x) for x in zip(*self._offered))
        self._offered = []
        mine, k = np.unique(row), self.score.shape[1]
        row = np.concatenate([np.repeat(mine, k), row])
        score, ids, tag = (np.concatenate([held[mine].ravel(), new]) for held, new in ((self.score, score), (self.id, ids), (self.tag, tag)))
        order = np.lexsort((ids, -score, row))
        first = order[np.searchsorted(row[order], mine)[:, None] + np.arange(k)]
        self.score[mine], self.id[mine], self.tag[mine] = score[first], ids[first], tag[first]


def _unit(flat: pa.Array, n: int) -> np.ndarray:
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v


def _offer(best: _Best, lo: int, near: np.ndarray, cols: np.ndarray | None, q: np.ndarray, v: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> None:
    """Puts a block of cosines in single precision before ``best``: those near enough to count are computed exactly."""
    floor, k = best.score[lo : lo + len(near), -1], best.score.shape[1]
    row, col = np.nonzero(near >= (floor - _NEAR).astype(np.float32)[:, None])
    if len(row) > 2 * k * len(near) and near.shape[1] > k:
        kth = np.partition(near, -k, axis=1)[:, -k]
        row, col = np.nonzero(near >= (np.maximum(floor, kth) - _NEAR).astype(np.float32)[:, None])
    good = np.isfinite(near[row, col])  # a query itself is not
    row, col = row[good], col[good] if cols is None else cols[col[good]]
    exact = np.empty(len(row))
    for a in range(0, len(row), 4096):
        exact[a : a + 4096] = np.einsum("ij,ij->i", q[lo + row[a : a + 4096]], v[col[a : a + 4096]])
    exact = np.round(exact, 6)
    good = exact >= floor[row]
    row, col, exact = row[good], col[good], exact[good]
    if len(row):
        best.offer(lo + row, exact, ids[col], tags[col])


def _read(q_ids: pa.Array, files: list[str], named: bool, columns: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of all vectors: the batch, its ids, its vectors at length 1, and which query a row is, -1 for none.

    ``named``: ids are strings; their places in the files, which are in order of them, stand for them.
    """
    base = 0
    for batch in read_batches(files, ["id", *columns, "v"], 4096):
        n = batch.num_rows
        ids = base + np.arange(n) if named else batch.column("id").to_numpy(zero_copy_only=False)
        base += n
        itself = pc.fill_null(pc.index_in(batch.column("id"), value_set=q_ids), -1).to_numpy(zero_copy_only=False)
        yield batch, ids, _unit(batch.column("v").flatten(), n), itself


def _near(near_q: np.ndarray, v: np.ndarray, itself: np.ndarray | None, block: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """Cosines in single precision by blocks of queries, with the place of the first; where a query meets itself they are -inf."""
    near_v = v.astype(np.float32).T
    own = np.flatnonzero(itself >= 0) if itself is not None else np.array([], int)
    for lo in range(0, len(near_q), block):
        near = near_q[lo : lo + block] @ near_v
        if len(own):
            here = own[(itself[own] >= lo) & (itself[own] < lo + block)]
            near[itself[here] - lo, here] = -np.inf
        yield lo, near


def _scan(q_ids: pa.Array, q: np.ndarray, files: list[str], named: bool, searches: list[tuple[_Best, np.ndarray | None]], tenants: dict[str, int], with_itself: bool) -> None:
    """Puts all vectors before each search: its best, and which tenants (by their number in ``tenants``) it may see, None for all vectors.

    Vectors are tagged with these numbers; if no search is limited, tenants are numbered as they come.
    """
    near_q, closed = q.astype(np.float32), any(seen is not None for _, seen in searches)
    for batch, ids, v, itself in _read(q_ids, files, named, ["tenant"]):
        coded = batch.column("tenant").dictionary_encode()
        number = [tenants.get(t, -1) if closed else tenants.setdefault(t, len(tenants)) for t in coded.dictionary.to_pylist()]
        tags = np.array([*number, -1], np.int32)[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)]
        picks = [None if seen is None else np.flatnonzero(seen[tags]) for _, seen in searches]  # the last place of ``seen`` is for no tenant
        for lo, near in _near(near_q, v, None if with_itself else itself):
            for (best, _), cols in zip(searches, picks):
                if cols is None or len(cols):
                    _offer(best, lo, near if cols is None else near[:, cols], cols, q, v, ids, tags)
    for best, _ in searches:
        best.settle()


def _places(q_ids: pa.Array, q: np.ndarray, files: list[str], named: bool, lists: list[_Best]) -> tuple[np.ndarray, int]:
    """Per list and query the place of the last entry among all vectors but the query itself, and the number of vectors, which stands for a list with free places.

    Vectors are counted by their cosines in single precision; those too near to the entry's are computed exactly.
    """
    near_q, total, counts = q.astype(np.float32), 0, np.zeros((len(lists), len(q)), np.int64)
    ends = np.array([np.where(best.score[:, -1] > -np.inf, best.score[:, -1], np.inf) for best in lists]).reshape(counts.shape)
    for _, ids, v, itself in _read(q_ids, files, named, []):
        total += len(ids)
        for lo, near in _near(near_q, v, itself):
            for best, end, count in zip(lists, ends, counts):
                end, last, count = (x[lo : lo + len(near)] for x in (end, best.id[:, -1], count))
                before = near > (end + _NEAR).astype(np.float32)[:, None]
                maybe = near >= (end - _NEAR).astype(np.float32)[:, None]
                count += np.count_nonzero(before, axis=1)
                row, col = np.nonzero(maybe & ~before)
                for a in range(0, len(row), 4096):
                    r, c = row[a : a + 4096], col[a : a + 4096]
                    exact = np.round(np.einsum("ij,ij->i", q[lo + r], v[c]), 6)
                    count += np.bincount(r[(exact > end[r]) | ((exact == end[r]) & (ids[c] <= last[r]))], minlength=len(near))
    return np.where(np.isfinite(ends), counts, total), total


def _by_query(queries: DataFrame, vectors: DataFrame, ask, schema: str) -> DataFrame:
    """``ask(q_ids, q, files, named)`` for parts of the queries, each in a task of its own that reads all vectors from the shared folder.

    The vectors are written once (those with strings as ids in order of them); nothing but the queries is shuffled.
    """
    named = dict(vectors.dtypes)["id"] == "string"
    kept = vectors.select("id" if named else F.col("id").cast("long").alias("id"), "tenant", F.col("v").cast("array<float>").alias("v"))
    files = in_order(kept, "vectors", "id") if named else sorted(materialize(kept, "vectors").inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            t = pa.Table.from_batches(rows).combine_chunks()
            yield from ask(t.column("id").combine_chunks(), _unit(t.column("v").combine_chunks().flatten(), t.num_rows), files, named)

    asked = materialize(queries.select("id" if named else F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v")), "asked")
    parts = max(2 * queries.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // TASK_QUERIES))
    return asked.repartition(parts, "id").mapInArrow(giving_back(run), schema)


def _many_top_k(queries: DataFrame, vectors: DataFrame, k: int, with_itself: bool) -> DataFrame:
    """``query_id, id, tenant, score, rank`` for any number of queries: none of their lists but the last is shuffled or sent."""
    kind = "string" if dict(vectors.dtypes)["id"] == "string" else "long"

    def ask(q_ids: pa.Array, q: np.ndarray, files: list[str], named: bool) -> Iterator[pa.RecordBatch]:
        best, tenants = _Best(len(q), k), {}
        _scan(q_ids, q, files, named, [(best, None)], tenants, with_itself)
        row, at = np.nonzero(best.score > -np.inf)
        ids = best.id[row, at]
        if named:
            found, place = np.unique(ids, return_inverse=True)
            names = names_at(files, "id", found).take(pa.array(place))
        else:
            names = pa.array(ids)
        tenant = pa.array([*tenants, None], pa.string()).take(pa.array(best.tag[row, at] % (len(tenants) + 1)))
        for a in range(0, len(row), 50_000):
            b = a + 50_000
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(row[a:b])), names[a:b], tenant[a:b], pa.array(best.score[row[a:b], at[a:b]]), pa.array((at[a:b] + 1).astype(np.int32))], ["query_id", "id", "tenant", "score", "rank"])

    return _by_query(queries, vectors, ask, f"query_id {kind}, id {kind}, tenant string, score double, rank int")


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, with_itself: bool = False) -> DataFrame:
    """``query_id, id, tenant, score, rank``; a query that is one of the vectors is left out of its own list unless ``with_itself``.

    Up to ``BROADCAST_QUERIES`` queries go to where the vectors are read; of more, each task has some and reads all vectors.
    """
    if queries.count() > BROADCAST_QUERIES:
        return _many_top_k(queries, vectors, k, with_itself)
    if with_itself:
        return ranked(similarities(queries, vectors, best=k), k)
    return ranked(similarities(queries, vectors, best=k + 1).where("query_id <> id"), k)


def _tenants_seen(acl: DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Roles, tenants and which role sees which; refused beyond ``ROLE_ROWS`` tenants of roles."""
    rules = bounded_pandas(acl.select("role_name", F.col("tenant").cast("string").alias("tenant")).where("role_name is not null and tenant is not null").distinct(), ROLE_ROWS, "tenants of roles")
    tenants, roles = sorted(set(rules["tenant"])), sorted(set(rules["role_name"]))
    seen = np.zeros((len(roles), len(tenants) + 1), bool)  # the last is for tenants of no role
    seen[rules["role_name"].map({r: i for i, r in enumerate(roles)}).to_numpy(int), rules["tenant"].map({t: i for i, t in enumerate(tenants)}).to_numpy(int)] = True
    return roles, tenants, seen


def postfilter_sweep(queries: DataFrame, vectors: DataFrame, acl: DataFrame, efs: list[int], k: int = 10) -> DataFrame:
    """``role_name, query_id, ef, n_exact, n_returned, n_hit``: what is lost when a policy filters the best ``ef`` of all.

    Exact: the best k that the role may read. Returned: of the best ``ef`` of everything those that it may read, k at
    most. A task has some of the queries and reads all vectors; of a query it holds the best ``max(efs)`` and the best k of each role, and gives
    only counts. Refused beyond ``ROLE_ROWS`` tenants of roles.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(_tenants_seen(acl))
    kind = "string" if dict(vectors.dtypes)["id"] == "string" else "long"

    def ask(q_ids: pa.Array, q: np.ndarray, files: list[str], named: bool) -> Iterator[pa.RecordBatch]:
        roles, tenants, seen = shared.value
        head, exact = _Best(len(q), max(efs)), [_Best(len(q), k) for _ in roles]
        _scan(q_ids, q, files, named, [(head, None), *zip(exact, seen)], {t: i for i, t in enumerate(tenants)}, False)
        for role, own, best in zip(roles, seen, exact):
            n_exact = (best.score > -np.inf).sum(1)
            for a in range(0, len(q), 500):
                b = min(len(q), a + 500)
                due = np.flatnonzero(n_exact[a:b])
                allowed = own[head.tag[a:b]] & (head.score[a:b] > -np.inf)
                returned = allowed & (np.cumsum(allowed, 1) <= k)
                hit = returned & (head.id[a:b, :, None] == best.id[a:b, None, :]).any(2)
                for ef in efs:
                    out = {"query_id": q_ids.take(pa.array(a + due)), "n_exact": n_exact[a:b][due], "n_returned": returned[due, :ef].sum(1), "n_hit": hit[due, :ef].sum(1)}
                    same = [pa.array([role] * len(due), pa.string()), out["query_id"], pa.array(np.full(len(due), ef, np.int32))]
                    yield pa.RecordBatch.from_arrays([*same, *(pa.array(out[c].astype(np.int64)) for c in ("n_exact", "n_returned", "n_hit"))], ["role_name", "query_id", "ef", "n_exact", "n_returned", "n_hit"])

    return _by_query(queries, vectors, ask, f"role_name string, query_id {kind}, ef int, n_exact long, n_returned long, n_hit long")


def recall_by_role(sweep: DataFrame) -> DataFrame:
    """``role_name, ef, recall, n_empty``: hits over exact ones of all queries, and queries that got nothing."""
    return sweep.groupBy("role_name", "ef").agg(F.round(F.sum("n_hit") / F.sum("n_exact"), 6).alias("recall"), F.count_if(F.col("n_returned") == 0).alias("n_empty"))


def widening_scan(sweep: DataFrame, k: int = 10) -> DataFrame:
    """``role_name, query_id, ef, n_returned``: the first step at which a scan that widens step by step has k rows, or the last."""
    order = Window.partitionBy("role_name", "query_id").orderBy((F.col("n_returned") >= k).desc(), F.when(F.col("n_returned") >= k, F.col("ef")).otherwise(-F.col("ef")))
    return sweep.withColumn("r", F.row_number().over(order)).where("r = 1").select("role_name", "query_id", "ef", "n_returned")


def scan_until_filled(queries: DataFrame, vectors: DataFrame, acl: DataFrame, widths: list[int], k: int = 10) -> DataFrame:
    """``role_name, query_id, ef, n_returned`` as :func:`widening_scan` has them, but only k rows or the end of the vectors stop the scan.

    The last of ``widths`` is doubled until it covers all vectors. A task has some of the queries and reads all vectors twice: for the best k of each
    role, then to count those before the k-th. Roles that see nothing are left out. Refused beyond ``ROLE_ROWS`` tenants of roles.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(_tenants_seen(acl))
    kind = "string" if dict(vectors.dtypes)["id"] == "string" else "long"

    def ask(q_ids: pa.Array, q: np.ndarray, files: list[str], named: bool) -> Iterator[pa.RecordBatch]:
        roles, tenants, seen = shared.value
        exact = [_Best(len(q), k) for _ in roles]
        _scan(q_ids, q, files, named, list(zip(exact, seen)), {t: i for i, t in enumerate(tenants)}, False)
        places, total = _places(q_ids, q, files, named, exact)
        steps = list(widths)
        while steps[-1] < total:
            steps.append(2 * steps[-1])
        for role, best, place in zip(roles, exact, places):
            n = (best.score > -np.inf).sum(1)
            due = np.flatnonzero(n)
            ef = np.array(steps)[np.searchsorted(steps, place[due])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([role] * len(due), pa.string()), q_ids.take(pa.array(due)), pa.array(ef), pa.array(n[due].astype(np.int64))], ["role_name", "query_id", "ef", "n_returned"])

    return _by_query(queries, vectors, ask, f"role_name string, query_id {kind}, ef int, n_returned long")
