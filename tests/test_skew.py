import random

from pyspark.sql import functions as F

from cordonlake.operators.skew import clean_label, heavy_keys, ordered_by_key

SCHEMA = "tenant string, id long, w double, key string, n_rows string"


def brute(rows):
    out = {}
    for t, i, w, *_ in rows:
        t = (t or "").strip(" \t\n ").lower() or None
        out.setdefault(t, []).append((i, w or 0.0))
    res = {}
    for t, xs in out.items():
        ids = sorted(i for i, _ in xs if i is not None)
        gaps = [b - a for a, b in zip(ids, ids[1:])]
        res[t] = (len(xs), len(set(ids)), ids[0] if ids else None, ids[-1] if ids else None, max(gaps, default=0) if ids else None, sum(w for _, w in xs))
    return res


def run(spark, rows, partitions=5):
    df = spark.createDataFrame(rows, SCHEMA)
    got = ordered_by_key(df, clean_label("tenant"), F.col("id"), F.col("w"), partitions).collect()
    return got, {r["key"]: (r["n_rows"], r["n_orders"], r["first_order"], r["last_order"], r["max_gap"], r["total"]) for r in got}


def test_heavy_key_is_split_and_stitched(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["A", " a\t", "a", "b", "c", None, "  ", "d" + str(rng.randrange(30))]), rng.randrange(4000), 1.0, "x", "y") for _ in range(3000)]
    rows += [("hot", i // 2, 0.5, None, None) for i in range(4000)] + [("late", None, 2.0, None, None), ("late", 5, None, None, None), ("none", None, 1.0, None, None)]
    got, res = run(spark, rows)
    assert res == brute(rows)
    assert next(r for r in got if r["key"] == "hot")["n_states"] > 1


def test_equal_rows_spread(spark):
    rows = [("one", 7, 1.0, None, None)] * 5000
    got, res = run(spark, rows, 4)
    assert res == {"one": (5000, 1, 7, 7, 0, 5000.0)}


def test_empty_and_shares(spark):
    assert run(spark, [])[0] == []
    df = spark.createDataFrame([("a", i, 0.0, "", "") for i in range(5)] + [(None, i, 0.0, "", "") for i in range(95)], SCHEMA)
    per = ordered_by_key(df, clean_label("tenant"), F.col("id"), partitions=3)
    assert [(r["key"], r["share"]) for r in heavy_keys(per, 0.05).collect()] == [("a", 0.05)]
    assert heavy_keys(per, 0.06).collect() == []
