import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cordonlake.llm.defects import DefectModel, PairReader, defective_pairs, fitted
from cordonlake.llm.language import Languages
from cordonlake.llm.linear import LinearModel
from cordonlake.llm.residue import residue

PAIRS = "query_id string, question string, answer string, quote string, defect string, score int"
TEXTS = "doc_id long, text string, host string, lines int"


def test_linear_model_separates():
    rows = [{"a": 1.0, f"n{i % 7}": 0.3} if i % 2 else {"b": 1.0} for i in range(200)]
    y = np.array([[i % 2] for i in range(200)], float)
    m = LinearModel(["odd"], bits=10).fit(rows, y)
    assert m.calibrate(rows, y)["odd"] == 1.0
    assert ((m.scores(rows)[:, 0] >= m.thresholds[0]) == (y[:, 0] > 0)).all()


def labelled(spark, rng):
    english, german = ["The owner of the harbour shall", "Each party must", "A tenant may"], ["Der Mieter der Halle soll", "Jede Partei muss", "Die Frist ist, und man darf"]
    rows = [(" ".join(f"{rng.choice(s)} {rng.choice(e)} {rng.randrange(90)}." for _ in range(4)), lang) for s, lang, e in ((english, "en", ["keep the records in the office", "return it within the days after notice"]), (german, "de", ["die Rechnung bis dahin vorlegen", "das Buch nach Ablauf der Tage geben"])) for _ in range(150)]
    return spark.createDataFrame([*rows, (None, "en"), ("x", None), ("odd", "xx")], "text string, lang string")


def good_pair(rng):
    n, name = rng.randrange(2, 400), rng.choice(["Alder", "Birch", "Cedar", "Maple"]) + rng.choice([" Works", " Farms", " Mills"])
    thing = rng.choice(["harbour", "ledger", "archive", "licence", "warehouse"])
    if rng.random() < 0.3:
        return f"Bis wann muss {name} die Rechnung für {thing} vorlegen?", f"Die Frist für {name} beträgt {n} Tage, und die Rechnung für {thing} ist bis dahin vorzulegen."
    return rng.choice([
        (f"How long must {name} keep the {thing}?", f"{name} must keep the {thing} for {n} months, and the records are to be held in the office."),
        (f"Who has to repair the {thing} of {name}?", f"The owner of the {thing} has to repair it within {n} days after notice by {name}."),
        (f"What is the limit for the {thing}?", f"{n} units"),
    ])


def test_defects(spark):
    rng = random.Random(4)
    rows = [(f"g{i}", *good_pair(rng), None, "", 0) for i in range(700)]
    q = "How long must Cedar Farms keep the archive?"
    bad = {
        "empty": [None, "", "  ", "?", "n/a", "​"], "refusal": ["I'm sorry, but I can't help with that.", "I must decline to respond to this."],
        "truncated": ["Cedar Farms must keep the archive for 20 months, and the records are to be held", "Cedar Farms must keep the archive for 33 months, and the rec"],
        "copies_question": [q, q.upper(), "how long must cedar farms keep the archive"], "other_language": ["Die Frist für Birch Mills beträgt 12 Tage, und die Rechnung für archive ist bis dahin vorzulegen."],
    }
    rows += [(f"{d}-{i}", q, a, None, "", 0) for d, xs in bad.items() for i, a in enumerate(xs)]
    rows += [(None, q, "x", None, "", 0), rows[0], ("null", None, "An answer that stands alone for 12 days.", None, "", 0), ("long", q, "Cedar Farms must keep the archive for 20 months. " * 2000, None, "", 0)]
    got = {r["id"]: r["defect"] for r in defective_pairs(spark.createDataFrame(rows, PAIRS), "query_id", "question", "answer", "quote", labelled(spark, rng)).collect()}
    right = sum(got.get(f"{d}-{i}") == d for d, xs in bad.items() for i in range(len(xs)))
    assert right >= sum(map(len, bad.values())) - 2
    assert sum(k.startswith("g") for k in got) <= 14
    assert all(got[f"empty-{i}"] == "empty" for i in range(6))


def test_no_pairs(spark):
    assert defective_pairs(spark.createDataFrame([], PAIRS), "query_id", "question", "answer", "quote").collect() == []
    none = pd.DataFrame({"text": pd.Series(dtype=object), "lang": pd.Series(dtype=object)})
    assert "wordless" in PairReader(Languages(none), frozenset()).features([(None, None, None)])[0]


def test_without_a_fit_only_silence_is_judged(spark):
    rows = [(f"x{i}", None, "Some answer.", None, "", 0) for i in range(30)] + [("e", None, " ", None, "", 0)]
    assert [(r["id"], r["defect"]) for r in defective_pairs(spark.createDataFrame(rows, PAIRS), "query_id", "question", "answer", "quote").collect()] == [("e", "empty")]


def test_samples_are_never_empty(spark, monkeypatch):
    from cordonlake.llm import linear

    df = spark.range(1000).withColumn("x", F.lit("y"))
    first = linear.hash_sample(df, "id", 20, 3)
    assert len(first) == 20
    h = sorted((r["h"], r["id"]) for r in df.select("id", F.xxhash64(F.col("id").cast("string"), F.lit(3)).alias("h")).collect())
    assert sorted(first["id"]) == sorted(i for _, i in h[:20])
    # a count that is far too high draws nothing, and all rows are sorted instead
    monkeypatch.setattr(type(df), "count", lambda self: 10**12)
    assert sorted(linear.hash_sample(df, "id", 20, 3)["id"]) == sorted(first["id"])


def test_languages_are_learnt(spark):
    model = Languages(labelled(spark, random.Random(1)).toPandas())
    got = model.shares(["The owner shall return the ledger.", "Der Mieter soll die Rechnung vorlegen.", "12", ""])
    assert model.names == ["de", "en"] and got[0].argmax() == 1 and got[1].argmax() == 0 and got[2].tolist() == [0.5, 0.5]


def prose(rng):
    return " ".join(rng.choice(["The owner", "Each party", "A tenant"]) + " " + rng.choice(["shall keep", "must return", "may inspect"]) + " the " + rng.choice(["ledger", "harbour", "licence"]) + f" within {rng.randrange(90)} days." for _ in range(rng.randrange(3, 9)))


def test_residue(spark):
    rng = random.Random(6)
    rows, cases = [], set()
    marks = ["{{name}}", "[INSERT DATE]", "<%= owner %>", "[TBD: fee]", "%%AMOUNT%%", "TODO: fill in year", "XX/XX/20XX"]
    notices = ["404 Not Found", "Please enable JavaScript to view this page.", "503 Service Unavailable", "Access denied. You are not permitted to view this resource.", "The page you asked for was not found."]
    filler = ["Lorem ipsum dolor sit amet, consectetur elit aliqua veniam.", "Sample text goes here. Sample text goes here. Sample text goes here. Sample text goes here."]
    for i in range(600):
        text, kind = "\n".join(prose(rng) for _ in range(3)), i % 12
        if kind == 0:
            words = text.split(" ")
            words.insert(rng.randrange(len(words)), rng.choice(marks))
            text = " ".join(words)
        elif kind == 1:
            text += "\n" + rng.choice(filler)
        elif kind == 2:
            text = rng.choice(notices)
        elif kind == 3:
            text += "\n" + rng.choice(["Signature: ____________________ Dated 3 May", "The variable ${HOME} names the folder of the ledger.", "Amounts marked [***] were left out on request.", "See note [12] of the licence."])
        if kind < 3:
            cases.add(i)
        rows.append((i, text, f"h{i % 11}", 1))
    rows += [(900, None, None, 0), (901, "", "h", 0), (902, " \n ", "h", 0), (903, prose(rng) * 3000, None, 0), (None, "{{x}}", "h", 0)]
    got = {r["id"]: r["is_residue"] for r in residue(spark.createDataFrame(rows, TEXTS).repartition(3), "doc_id", "text", "host").collect()}
    assert set(got) == set(range(600)) | {903}
    found = {i for i, x in got.items() if x}
    assert len(found & cases) >= 0.95 * len(cases) and len(found - cases) <= 6


def test_no_texts(spark):
    assert residue(spark.createDataFrame([], TEXTS), "doc_id", "text", "host").collect() == []
    assert residue(spark.createDataFrame(pd.DataFrame({"doc_id": [1], "text": [" "], "host": ["h"]})), "doc_id", "text", "host").collect() == []
