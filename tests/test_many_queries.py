"""Search of many queries: tasks hold what is best so far, and lists of parts of the data are never shuffled."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from cordonlake.operators import dense, lexical


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexical_lists_are_whole_where_they_are_made(spark):
    chunks = spark.createDataFrame([(f"c{i:02d}", "pear " * (i % 3 + 1)) for i in range(40)], "chunk_id string, body string").repartition(7)
    found = lexical.or_search(spark.createDataFrame([(f"q{i}", "pear") for i in range(9)], "query_id string, term string"), chunks, 3)
    assert "Window" not in plan(found)
    assert {r["query_id"]: 0 for r in found.collect()}.keys() == {f"q{i}" for i in range(9)}
    assert {(r["chunk_id"], r["rank"], r["score"]) for r in found.collect()} == {("c02", 1, 0.3), ("c05", 2, 0.3), ("c08", 3, 0.3)}


def test_memory_of_lexical_search_is_that_of_its_lists(tmp_path):
    rng = np.random.default_rng(0)
    n, queries = 6_000, 4_000
    posts = [[{"item": f"w{t}", "n": 1} for t in np.unique(rng.integers(0, 200, 20))] for _ in range(n)]
    table = pa.table({"chunk_id": [f"c{i:05d}" for i in range(n)], "posts": pa.array(posts, pa.list_(pa.struct([("item", pa.string()), ("n", pa.int32())]))), "dl": pa.array([20] * n, pa.int32())})
    pq.write_table(table, tmp_path / "a.parquet")
    terms = [(f"q{q}", f"w{t}", 0.1) for q in range(queries) for t in np.unique(rng.integers(0, 200, 8))]
    weights = lexical._Weights(pa.table({c: x for c, x in zip(("query_id", "term", "weight"), zip(*terms))}))
    tracemalloc.start()
    got = sum(b.num_rows for b in lexical._search(weights, [f"file://{tmp_path}/a.parquet"], lambda tf, dl: tf, 20, 1_000_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == 20 * queries and peak < 60e6  # what a batch found at every step was held before


def test_many_dense_queries_give_what_few_give(spark, monkeypatch):
    rng = random.Random(5)
    data = [(f"v{i % 90:03d}" if i < 90 else f"v{i:03d}", rng.choice("abc"), [float(rng.randrange(3)) for _ in range(4)] + [1.0]) for i in range(300)]
    v = spark.createDataFrame(data, "id string, tenant string, v array<float>").repartition(5)
    q = v.where("id < 'v050'")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["tenant"], r["score"]) for r in df.collect())
    for own in (True, False):
        few = key(dense.exact_top_k(q, v, 6, own))
        monkeypatch.setattr(dense, "BROADCAST_QUERIES", 10)
        many = dense.exact_top_k(q, v, 6, own)
        assert key(many) == few and len(few) == 300 and "Window" not in plan(many)
        monkeypatch.undo()


def test_sweep_gives_counts_and_no_pairs(spark):
    rng = random.Random(2)
    v = spark.createDataFrame([(i, rng.choice("abc"), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)], "id long, tenant string, v array<float>")
    roles = spark.createDataFrame([("all", t) for t in "abc"] + [("one", "a"), ("none", "x"), ("void", None)], "role_name string, tenant string")
    sweep = dense.postfilter_sweep(v.where("id < 5"), v, roles, [5, 20], 3)
    assert "Window" not in plan(sweep) and "Join" not in plan(sweep)
    assert {(r["role_name"], r["query_id"], r["ef"]) for r in sweep.collect()} == {(r, i, e) for r in ("all", "one") for i in range(5) for e in (5, 20)}
