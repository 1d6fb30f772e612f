import json

from cordonlake.operators import contract


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def test_contract_of_an_answer(spark):
    good = {"answer": " yes ", "abstained": False, "claims": [{"text": "t", "chunk_id": "c", "quote": "q"}]}
    responses = {
        "good": json.dumps(good), "fenced": f"```json\n{json.dumps(good)}\n```", "prose": f"Sure: {json.dumps(good)} - done", "bare": '{"answer": ""}', "null": None, "none": "no", "cut": json.dumps(good)[:30], "list": "[1]",
        "nameless": '{"claims": []}', "flag": '{"answer": "a", "abstained": "no"}', "quoteless": '{"answer": "a", "claims": [{"text": "t", "chunk_id": "c"}]}', "empty": '{"answer": "a", "claims": [{"text": "t", "chunk_id": "c", "quote": ""}]}',
    }
    df = spark.createDataFrame(list(responses.items()), "answer_id string, response string")
    got = {r["answer_id"]: r for r in contract.answers(df).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {
        "good": None, "fenced": None, "prose": None, "bare": None, "null": "no json", "none": "no json", "cut": "no json", "list": "not an object", "nameless": "answer missing", "flag": "abstained not a boolean",
        "quoteless": "claim incomplete", "empty": "claim incomplete",
    }
    assert got["good"]["answer"] == "yes" and got["good"]["abstained"] is False and got["bare"]["claims"] == [] and got["cut"]["claims"] is None
    assert rows(contract.claims_of(contract.answers(df)).where("answer_id = 'good'")) == [("good", 0, "c", "q")]


def test_judgments_in_every_form(spark):
    entries = [{"id": "a", "grade": 2, "why": "w" * 200}, {"id": "b", "grade": "3"}, {"id": "c", "grade": 9}, {"id": "d", "grade": "high"}, {"id": "zz", "grade": 1}]
    forms = [json.dumps(entries), json.dumps({"judgments": entries}), json.dumps({"results": entries}), "ok ```" + json.dumps(entries) + "``` end", json.dumps(entries[0]), "none", None]
    responses = spark.createDataFrame([(f"q{i}", 0, x) for i, x in enumerate(forms)], "query_id string, batch int, response string")
    asked = spark.createDataFrame([(f"q{i}", 0, c) for i in range(len(forms)) for c in "abcde"], "query_id string, batch int, chunk_id string")
    got = {(r["query_id"], r["chunk_id"]): r["grade"] for r in contract.judgments(responses, asked).collect()}
    full, first = dict(zip("abcde", (2, 3, 3, 0, 0))), dict(zip("abcde", (2, 0, 0, 0, 0)))
    for i in range(len(forms)):
        want = full if i < 4 else first if i == 4 else dict.fromkeys("abcde", 0)
        assert {c: got[f"q{i}", c] for c in "abcde"} == want
    assert max(len(r["why"]) for r in contract.judgments(responses, asked).collect()) == 120


def test_pool_puts_sources_last(spark):
    found = spark.createDataFrame([("q", f"c{i}", i) for i in range(1, 7)], "query_id string, chunk_id string, rank int")
    sources = spark.createDataFrame([("q", "c2"), ("q", "s")], "query_id string, chunk_id string")
    got = rows(contract.pool(found, sources), "chunk_id", "batch", "is_source")
    assert got == [("c1", 0, False), ("c2", 0, True), ("c3", 0, False), ("c4", 0, False), ("c5", 0, False), ("c6", 1, False), ("s", 1, True)]
