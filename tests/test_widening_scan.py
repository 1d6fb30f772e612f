"""A widening scan ends when a role has its rows or the vectors end, at no width before."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cordonlake.operators import dense
from cordonlake.queries import all_oracles
from cordonlake.queries.retrieval import iterative_scan


def test_scan_goes_on_after_the_widths_of_the_sweep(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.05, (2500, 384)).astype(np.float32)
    tenants = np.array(["many"] * 2486 + ["far"] * 10 + ["few"] * 4)
    v[:, 0] += np.where(tenants == "many", 1, -1)
    pq.write_table(pa.table({"id": pa.array(np.arange(2500), pa.int32()), "tenant": tenants, "embedding": pa.array(list(v), pa.list_(pa.float32()))}), tmp_path / "rls_demo.parquet")
    pq.write_table(pa.table({"role_name": ["all", "all", "all", "far", "few"], "tenant": ["many", "far", "few", "far", "few"]}), tmp_path / "tenant_acl.parquet")
    rows = iterative_scan(spark, str(tmp_path)).collect()
    # "far" was given up at 200 before, with nothing found
    assert {(r["role_name"], r["filled"], r["ef"]) for r in rows} == {("all", True, 40), ("far", True, 3200), ("few", False, 3200)}
    con = duckdb.connect()
    for name in ("rls_demo", "tenant_acl"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    rel = con.sql(all_oracles()["iterative_scan"])
    assert sorted(tuple(r[c] for c in rel.columns) for r in rows) == sorted(rel.fetchall())


def _brute(v, ids, tenants, asked, rules, widths, k):
    at, found = np.argsort(ids), {}
    v, ids, tenants = v[at] / np.linalg.norm(v[at], axis=1, keepdims=True), ids[at], tenants[at]
    for q in np.flatnonzero(np.isin(ids, asked)):
        order = np.argsort(-np.round(np.einsum("ij,ij->i", np.broadcast_to(v[q], v.shape).copy(), v), 6), kind="stable")
        order = order[order != q]
        for role, own in rules.items():
            place = np.flatnonzero(np.isin(tenants[order], list(own))) + 1
            if len(place):
                end = place[k - 1] if len(place) >= k else len(v)
                found[role, int(ids[q])] = next(w for w in widths if w >= end), min(k, len(place))
    return found


@pytest.mark.parametrize("kind", ["long", "string"])
def test_places_equal_brute_force_with_many_ties(spark, kind):
    rng = np.random.default_rng(1)
    n = 5000  # more than a batch; some 600 different vectors
    v = rng.integers(-2, 3, (n, 4)).astype(float)
    v[(v == 0).all(1)] = 1
    ids, tenants = rng.permutation(n), rng.choice(["a", "b", "c", ""], n, p=[0.9, 0.02, 0.001, 0.079])
    rules = {"wide": {"a", "b"}, "narrow": {"b"}, "short": {"c"}, "stranger": {"x"}}
    frame = spark.createDataFrame([(int(i), t or None, e.tolist()) for i, t, e in zip(ids, tenants, v)], "id long, tenant string, v array<double>")
    acl = spark.createDataFrame([(r, t) for r, own in rules.items() for t in own] + [(None, "a"), ("wide", None)], "role_name string, tenant string")
    if kind == "string":
        frame = frame.selectExpr("format_string('%05d', id) AS id", "tenant", "v")
    got = dense.scan_until_filled(frame.where("id % 250 = 0"), frame, acl, [20, 50]).collect()
    due = _brute(v, ids, tenants, np.arange(0, n, 250), rules, [20, 50, 100, 200, 400, 800, 1600, 3200, 6400], 10)
    assert len(got) == len(due) and {(r["role_name"], int(r["query_id"])): (r["ef"], r["n_returned"]) for r in got} == due
    assert len({ef for ef, _ in due.values()}) > 3
    assert not dense.scan_until_filled(frame.where("id < 5"), frame, acl.limit(0), [20, 50]).collect()
