"""The weak phrases are tried on few texts: on those that have a looser form of one."""

import re

import pyarrow as pa
import pyarrow.compute as pc
from cordonlake.llm import residue
from pyspark.sql import functions as F


def loose(texts):
    return [any(x) for x in zip(*(pc.match_substring_regex(pa.array(texts, pa.string()), p).to_pylist() for p in residue._LOOSE))]


def test_loose_forms_match_where_phrases_do():
    texts = ["HTTP/1.1 404 Not Found", "a\n503\x0bService Unavailable", "\rserver: nginx", "a retry-after: 12", "status: 'Bad  gateway'", "error code: 500", "Traceback (most", " file \"a.py\", line 3", "x\r\nValueError: no",
             "the page could\nnot be found. We cannot find that page", "Access was denied", "accès refusé", "please turn on JavaScript", "captcha", "Name lookup", "lorem x ipsum y dolor", "asdf \x0bjkla lkjh fdsa\x0b kkkk ", "qwerty asdf hjkl",
             "dummy words", "a copy\nto be replaced", "{{ a }}", "[Insert name]", "TODO: b", "[●]", "__x", "{0}"]
    due = [bool(residue._NOTICE.search(t) or re.search("(?im)" + residue._NOTICE.pattern, t) or residue._FILLER.search(t) or re.search("(?i)" + residue._OPENED, t)) for t in texts]
    assert sum(due) > 20 and all(got for got, must in zip(loose(texts), due) if must)
    assert loose(["All of it is said in plain words, and said once.", "The parties agree on a term of 30 days."]) == [False, False]


def test_all_marked_rows_of_a_table_are_found(spark):
    rows = residue._texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", "tenant")
    again = spark.createDataFrame([(10**7, "go, " * 9, "h"), (10**7 + 1, "We sell the boats. Then we rest. We sell the boats.", "h")], "id long, text string, host string")
    rows = rows.unionByName(again).localCheckpoint()
    hint = F.col("text").rlike("(?im)" + residue._NOTICE.pattern) | F.col("text").rlike("(?is)" + residue._FILLER.pattern) | F.col("text").rlike("(?i)" + residue._OPENED)
    due = rows.where(hint).orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(4)), "id").toPandas()
    got = residue._marked(rows, 10**6, 10**6, 4)
    assert list(got["id"]) == list(due["id"]) and {10**7, 10**7 + 1} <= set(got["id"])


def test_phrases_are_tried_on_few_rows(spark, monkeypatch):
    rows = spark.range(400).select("id", F.lit("All of it is said in plain words.").alias("text"), F.lit("h").alias("host"))
    monkeypatch.setattr(residue, "_LOOSE", ["never"])  # then nothing but a repetition is looked at
    assert len(residue._marked(rows.withColumn("text", F.lit("TODO: amount")), 5, 400, 4)) == 0
    assert len(residue._marked(rows.withColumn("text", F.lit("go, " * 9)), 5, 400, 4)) == 5
