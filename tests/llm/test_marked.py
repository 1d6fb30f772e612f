"""Rows that weak phrases mark are looked for in slices of the hash."""

from cordonlake.llm import residue
from pyspark.sql import functions as F


def test_slices_give_what_one_pass_gives(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.pmod(F.hash("id"), F.lit(7)) == 0, "TODO: amount").otherwise("All is said here.").alias("text"), F.lit("h").alias("host")).cache()
    h = F.xxhash64(F.col("id").cast("string"), F.lit(4))
    for share, n in ((7, 5), (7, 60), (7, 400), (7, 2000), (10**6, 10)):
        data = rows if share == 7 else rows.withColumn("text", F.lit("All is said here."))
        for among in (600, 3000, 10**6):
            wide = data if among >= 3000 else data.where(h < F.lit(int(-(2**63) + 2**64 * (among / 3000))))
            due = wide.where(F.contains("text", F.lit("TODO:"))).orderBy(h, "id").limit(n).toPandas()
            got = residue._marked(data, n, among, 4)
            assert list(got["id"]) == list(due["id"]) and list(got.columns) == ["id", "text", "host"]
