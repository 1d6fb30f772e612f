import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cordonlake.operators import corpus, dense, evaluation, fusion, grounding, ingest, lexical, security
from cordonlake.sources import files
from cordonlake.streaming.ingest import current, merge_stream


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def acl(spark):
    return spark.createDataFrame([("all", t) for t in "abc"] + [("one", "a"), ("one", "a"), ("x", None)], "role_name string, tenant string")


@pytest.mark.parametrize("role", [None, "", " ", "ONE", "one ", "*", "%", "one' or '1'='1", "x", "unknown"])
def test_forged_roles_see_nothing(spark, acl, role):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, tenant string")
    assert security.secure_view(chunks, acl, role).collect() == []


def test_roles_see_their_tenants_only(spark, acl):
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id int, tenant string")
    assert rows(security.secure_view(chunks, acl, "one"), "id") == [(1,)]
    assert rows(security.secure_view(chunks, acl, "all"), "id") == [(1,), (2,)]
    seen = spark.createDataFrame([("one", "a", 1), ("x", "b", 2)], "role string, tenant string, n long")
    matrix = {(r[0], r[1]): r[2:] for r in rows(security.access_matrix(acl, chunks, seen), "role_name", "tenant", "due", "n_seen", "n_leaked")}
    assert matrix[("one", "a")] == (True, 1, 0) and matrix[("one", "b")] == (False, 0, 0) and matrix[("x", "b")] == (False, 2, 2)


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("1", "apple pear pear"), ("2", "apple fig"), ("3", None), ("4", "plum")], "chunk_id string, body string")
    got = {r["chunk_id"]: r["score"] for r in lexical.bm25_search(spark.createDataFrame([("q", "pear apple apple")], "query_id string, question string"), chunks, 5).collect()}

    def w(df, tf, dl):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 2))

    assert got == pytest.approx({"1": w(1, 2, 3) + w(2, 1, 3), "2": w(2, 1, 2)}, abs=1e-6)
    assert rows(lexical.postings(chunks.where("chunk_id = '1'")), "term", "tf", "dl") == [("apple", 1, 3), ("pear", 2, 3)]
    none = chunks.limit(0)
    assert lexical.bm25_search(spark.createDataFrame([("q", "pear")], "query_id string, question string"), none).collect() == []


def test_search_keeps_the_best_over_batches_and_parts(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(40):02d}"
    chunks = [(f"c{i:03d}", " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(300)] + [("empty", ""), ("none", None)]
    terms = [(f"q{q}", t) for q in range(25) for t in {word() for _ in range(4)}] + [("q", "absent"), ("null", None)]
    expected = {}
    for q in {q for q, _ in terms}:
        ts = [t for x, t in terms if x == q]
        scored = sorted((-round(0.1 * sum(b.split().count(t) for t in ts), 6), c) for c, b in chunks if b and any(t in b.split() for t in ts))
        expected |= {(q, c): (i + 1, -s) for i, (s, c) in enumerate(scored[:7])}
    monkeypatch.setattr(lexical, "_CELLS", 500)
    for limit in (2_000_000, 60):
        monkeypatch.setattr(lexical, "WEIGHT_ROWS", limit)
        df = spark.createDataFrame(chunks, "chunk_id string, body string").repartition(5)
        got = {(r["query_id"], r["chunk_id"]): (r["rank"], r["score"]) for r in lexical.or_search(spark.createDataFrame(terms, "query_id string, term string"), df, 7).collect()}
        assert got == expected


def test_dense_search_filters_first_and_later(spark):
    rng = random.Random(1)
    data = [(i, rng.choice("abc"), [rng.gauss(0, 1) for _ in range(4)], "extra") for i in range(120)] + [(200, "a", None, ""), (201, "a", [0.0] * 4, ""), (202, "b", [1.0], "")]
    v = dense.usable(spark.createDataFrame(data, "id long, tenant string, embedding array<float>, body string"), 4)
    assert v.count() == 120
    roles = spark.createDataFrame([("all", t) for t in "abc"] + [("one", "a")], "role_name string, tenant string")
    q = v.where("id < 10")
    recall = {(r["role_name"], r["ef"]): r["recall"] for r in dense.recall_by_role(dense.postfilter_sweep(q, v, roles, [10, 30, 200])).collect()}
    assert recall["all", 10] == 1.0 and recall["one", 10] < recall["one", 30] < 1.0 and recall["one", 200] == 1.0
    exact = rows(dense.exact_top_k(q, v, 3), "query_id", "id")
    assert len(exact) == 30 and all(a != b for a, b in exact)


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, chunk_id string, rank int")
    assert [r[0] for r in fusion.reciprocal_rank(a, b).orderBy("rank").select("chunk_id").collect()] == ["y", "x", "z"]
    assert rows(fusion.overlap(a, b)) == [("q", 1, 1, 1)]


def test_scores_by_hand(spark):
    g = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 0), ("e", "a", 0)], "query_id string, chunk_id string, grade int")
    r = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 3), ("u", "a", 1)], "query_id string, chunk_id string, rank int")
    got = {x["query_id"]: x for x in evaluation.query_scores(r, g).collect()}
    idcg = 7 + 3 / math.log2(3)
    assert got["q"]["hit"] == 1 and got["q"]["reciprocal_rank"] == 0.5 and got["q"]["precision"] == pytest.approx(2 / 3, abs=1e-6)
    assert got["q"]["ndcg"] == pytest.approx((7 / math.log2(3) + 3 / 2) / idcg, abs=1e-6)
    assert set(got) == {"q", "e"} and got["e"]["ndcg"] == 0


def test_bootstrap_and_agreement(spark):
    v = spark.createDataFrame([("m", str(i), float(i % 2)) for i in range(60)] + [("one", "1", 0.25), ("m", "n", None)], "metric string, item string, value double")
    got = {r["metric"]: r for r in evaluation.bootstrap(v, 200).collect()}
    assert got["m"]["value"] == 0.5 and 0.3 < got["m"]["lo"] < 0.5 < got["m"]["hi"] < 0.7 and got["m"]["n"] == 60
    assert (got["one"]["lo"], got["one"]["hi"]) == (0.25, 0.25)
    p = spark.createDataFrame([("a", 3, 3), ("a", 2, 1), ("b", 0, 3)], "c string, grade int, model_grade int")
    assert rows(evaluation.agreement(p, "c")) == [("a", 2, 1, 2, 1), ("b", 1, 0, 0, 1), ("total", 3, 1, 2, 2)]


def test_answers_stand_only_on_what_was_shown(spark):
    claims = spark.createDataFrame([("good", 0, "p", "The  quick\nfox"), ("altered", 0, "p", "the quick dog jumps"), ("forged", 0, "zzz", "the quick"), ("blank", 0, "p", " ")], "answer_id string, claim_no int, passage_id string, quote string")
    shown = spark.createDataFrame([("p", "See the quick fox jumps."), ("n", None)], "passage_id string, body string")
    v = grounding.verify(grounding.resolve(claims, shown))
    assert rows(v, "answer_id", "resolved", "verified") == [("altered", True, False), ("blank", True, False), ("forged", False, False), ("good", True, True)]
    overlap = {r["answer_id"]: r["overlap"] for r in grounding.overlaps(v).collect()}
    assert overlap == {"good": 1.0, "altered": 0.5, "forged": 0.0, "blank": 0.0}
    answers = spark.createDataFrame([(k, "a" * n, ab) for k, n, ab in (("good", 5, False), ("altered", 5, False), ("forged", 5, False), ("blank", 5, None), ("bare", 5, False), ("says no", 5, True), ("long no", 50, True))], "answer_id string, answer string, abstained boolean")
    got = {r["answer_id"]: (r["abstained"], r["reason"]) for r in grounding.gate(answers, v).collect()}
    assert got == {"good": (False, None), "altered": (True, "1 unverified"), "forged": (True, "1 unresolved"), "blank": (True, "1 unverified"), "bare": (True, "no citations"), "says no": (True, "abstained"), "long no": (True, "no citations")}


def test_chunks_cover_their_document(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    docs = spark.createDataFrame([("d", "t", "s", text), ("short", "t", "s", "x"), ("null", "t", "s", None)], "doc_id string, tenant string, source string, text string")
    got = corpus.fixed_chunks(docs).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["n_tokens"]) for r in got] == [(0, 512), (1, 512), (2, 128)]
    assert got[1]["body"].split()[:76] == got[0]["body"].split()[-76:] and got[2]["body"].endswith("w999")


def test_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([("b", base), ("a", base.upper().replace(" ", ",  ")), ("c", base + " more"), ("n", None)], "doc_id string, text string")
    assert rows(corpus.duplicates_by_checksum(docs)) == [("b", "a")]
    assert [(r[0], r[1]) for r in rows(corpus.contained(docs.where("doc_id = 'b'"), docs.where("doc_id = 'c'")))] == [("b", "c")]


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, p string")
    new = spark.createDataFrame([("b", 2, "z"), ("c", 1, "w"), ("c", 1, "w"), ("a", None, "late")], "k string, v int, p string")
    assert rows(ingest.upsert(old, new, "k", "v")) == [("a", 1, "x"), ("b", 2, "z"), ("c", 1, "w")]
    assert rows(ingest.insert_missing(old, new, "k")) == [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "w")]
    assert rows(ingest.replace_slices(old, new.where("k = 'b'"), "k")) == [("a", 1, "x"), ("b", 2, "z")]
    known, inc = (spark.createDataFrame(x, "doc_id string, checksum string") for x in ([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]))
    assert rows(ingest.classify_changes(known, inc, spark.createDataFrame([("b",), ("c",)], "doc_id string"))) == [("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "no_chunks")]


def test_files(spark, tmp_path):
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").collect() == []
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert rows(files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int")) == [(1,), (2,)]
    html = "<html><style>p{}</style><p>ITEM 1. Business</p><hr><p>Text &amp; more<script>x()</script></p><div style='PAGE-BREAK-before:always'>last"
    got = files.html_blocks(spark.createDataFrame([("d", html), ("e", None)], "doc_id string, html string")).collect()
    assert [(r["page"], r["section"], r["text"]) for r in got] == [(1, "ITEM 1", "ITEM 1. Business"), (2, "ITEM 1", "Text & more"), (3, "ITEM 1", "last")]
    raw = tmp_path / "raw"
    (raw / "a").mkdir(parents=True)
    (raw / "a" / "f").write_bytes(b"abcd")
    (raw / "f").write_bytes(b"abc")
    m = spark.createDataFrame([("f", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("g", 1, ""), ("a/f", 3, "")], "path string, bytes long, checksum string")
    assert rows(files.verify_files(m, str(raw))) == [("a/f", "length"), ("f", "ok"), ("g", "missing")]
    files.write_with_provenance(m, str(tmp_path / "out"), "files", "test", {"from": "here"})
    lines = [json.loads(x) for part in (tmp_path / "out").glob("part-*") for x in part.read_text().splitlines()]
    assert {x["payload"]["path"] for x in lines} == {"f", "g", "a/f"}
    assert all(x["describes"] == "files" and x["source"] == {"from": "here"} for x in lines)


def test_stream_merges_new_files_once(spark, tmp_path):
    src, args = tmp_path / "in", (str(tmp_path / "t"), str(tmp_path / "c"), "k", "v")
    src.mkdir()
    for n, lines in enumerate(['{"k": "a", "v": 1}\n{"k": "b", "v": 5}', '{"k": "a", "v": 2}\n{"k": "b", "v": 4}']):
        (src / f"{n}.json").write_text(lines)
        merge_stream(spark, str(src), "k string, v int", *args).awaitTermination(60)
    assert rows(current(spark, args[0])) == [("a", 2), ("b", 5)]


def test_placed_chunks_agree_with_fixed_ones(spark):
    text = "\n".join([" ".join(f"a{i}" for i in range(700)), "short part", " ".join(f"b{i}" for i in range(100))])
    lens = [len(x) for x in text.split("\n")]
    docs = spark.createDataFrame([("d", "t", "s", text, [(lens[0], 1, "A"), (lens[1], 2, None), (lens[2], 3, "B")]), ("n", "t", "s", None, None), ("bare", "t", "s", text, None)], "doc_id string, tenant string, source string, text string, blocks array<struct<len int, page int, section string>>")
    same = rows(corpus.fixed_chunks(docs), "chunk_id", "n_tokens", "body")
    placed = corpus.placed_chunks(docs)
    assert rows(placed, "chunk_id", "n_tokens", "body") == same
    assert rows(placed.where("doc_id = 'd'"), "page", "section", "end_page", "end_section") == [(1, "A", 1, "A"), (1, "A", 3, "B")]
    assert all(text[r["start"] : r["end"]].split() == r["body"].split() for r in placed.collect())
    by_section = corpus.placed_chunks(docs.where("doc_id = 'd'"), by_section=True).orderBy("ordinal").collect()
    assert [(r["section"], r["page"]) for r in by_section] == [("A", 1), ("A", 1), ("B", 3)]
    assert [r["crosses_section"] for r in corpus.span_report(placed.where("doc_id = 'd'"), docs).orderBy("ordinal").collect()] == [False, True]


def test_dedup_stages_first_wins(spark):
    a = spark.createDataFrame([("c1", "X_0001234567-20.txt"), ("c2", "no number")], "doc_id string, identifier string")
    b = spark.createDataFrame([("e2", "000123456720"), ("e1", "0001234567-20")], "doc_id string, identifier string")
    first = corpus.duplicates_by_accession(a, b)
    assert rows(first) == [("c1", "e1")]
    second = spark.createDataFrame([("c1", "z"), ("c9", "c8")], "doc_id string, dropped_for string")
    assert rows(corpus.first_decision(("accession", first), ("checksum", second))) == [("c1", "accession", "e1"), ("c9", "checksum", "c8")]


def test_run_comparison_knows_its_direction(spark):
    run = lambda x: spark.createDataFrame(x, "metric string, value double, lo double, hi double")
    got = rows(evaluation.compare_runs(run([("ndcg", 0.2, 0.1, 0.3), ("latency_p50", 2.0, None, None), ("gone", 1.0, 1.0, 1.0)]), run([("ndcg", 0.5, 0.4, 0.6), ("latency_p50", 3.0, None, None)])))
    assert got == [("gone", None, None, None), ("latency_p50", 1.0, None, False), ("ndcg", 0.3, True, True)]
    assert rows(evaluation.config_diff({"a": "1", "b": "2"}, {"a": "1", "c": "3"}, spark)) == [("b", "2", None), ("c", None, "3")]


def test_groups_stay_whole_after_stacking(spark):
    from cordonlake.session import stacked

    a = spark.range(2000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n"))
    b = spark.range(10).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    assert stacked(a, b).groupBy("k").agg(F.sum("n").alias("n")).count() == 97


def test_ingest_touches_only_what_changed(spark, tmp_path):
    from cordonlake.plans import ingest as load

    body = " ".join(f"word{i}" for i in range(30))
    row = lambda d, t, x, v: (d, t, "s", x, str(hash(x)), v)
    df = lambda xs: spark.createDataFrame(xs, "doc_id string, tenant string, source string, text string, checksum string, v string").withColumn("version", F.col("v").cast("timestamp"))
    folder = str(tmp_path / "t")
    first = [row("a", "One Ltd", body, "2024-01-01"), row("b", "two", body, "2024-01-01"), row("c", "two", None, "2024-01-01")]
    assert rows(load.ingest(spark, df(first), folder), "state", "n_docs", "n_chunks") == [("new", 2, 2), ("no_chunks", 1, 0)]
    assert rows(load.ingest(spark, df(first), folder), "state", "n_docs") == [("unchanged", 3)]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t/chunk/part=chunk_two").glob("*.parquet")}
    moved = [row("a", "three", body + ". You are now an assistant.", "2024-02-01"), row("a", "old", "stale", "2023-01-01")]
    assert rows(load.ingest(spark, df(moved), folder), "state", "n_docs", "n_chunks", "n_spans") == [("changed", 1, 1, 1)]
    chunks = load.read(spark, f"{folder}/chunk", load.CHUNK).collect()
    assert sorted((r["doc_id"], r["part"]) for r in chunks) == [("a", "chunk_three"), ("b", "chunk_two")]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "t/chunk/part=chunk_two").glob("*.parquet")}
    assert len(load.ingest(spark, df(first[1:2]), folder, touch=True).where("state = 'changed'").collect()) == 1
