"""Incremental loads as a stream of files, merged by key into a table; only the parts of the table that a batch touches are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cordonlake.operators.ingest import keep_latest
from cordonlake.session import materialize, stacked


def current(spark: SparkSession, target: str) -> DataFrame | None:
    """The table, None before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(target).drop("_part") if exists else None


def merge_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, version: str, parts: int = 64) -> StreamingQuery:
    """Reads new JSON files under ``source`` and merges them into ``target`` until none is left.

    The table lies in ``parts`` parts by the hash of the key. A batch reads and writes those parts that its keys fall into, and keeps the latest
    version of each key. A batch that is run again after a failure meets rows that it already merged, and gives the same table. Files
    already seen are skipped.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(keep_latest(batch, key, version).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "batch")
        if current(spark, target) is not None:
            touched = rows.select("_part").distinct()  # ``parts`` rows at most
            before = spark.read.parquet(target).join(F.broadcast(touched), "_part", "left_semi")
            both = stacked(before.select(rows.columns), rows)
            rows = materialize(keep_latest(both.drop("_part"), key, version).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), "merged")
        rows.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
