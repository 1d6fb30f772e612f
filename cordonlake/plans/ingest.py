"""From fetched documents to a table of chunks: classify, sanitise, cut, replace, and write only the tenants that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordonlake.functions.text import injection_counts, injections, partition_name, sanitised
from cordonlake.operators.corpus import fixed_chunks
from cordonlake.operators.ingest import classify_changes, keep_latest
from cordonlake.session import bounded_pandas, materialize, stacked

MAX_TENANTS = 100_000

CHUNK = "chunk_id string, doc_id string, tenant string, source string, ordinal int, n_tokens int, body string, part string"
DOCUMENT = "doc_id string, tenant string, source string, checksum string, sanitised_spans int, version timestamp, part string"


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table that :func:`ingest` keeps, empty if it was never written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(folder) if fs.exists(path) else spark.createDataFrame([], schema)


def _replace_parts(rows: DataFrame, folder: str) -> None:
    """Writes the partitions that ``rows`` have and leaves the others as they are."""
    rows.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)


def _drop_parts(parts: DataFrame, folder: str) -> None:
    """Deletes partitions that have no row left; there are no more of them than tenants."""
    jvm = parts.sparkSession.sparkContext._jvm
    for name in bounded_pandas(parts, MAX_TENANTS, "partitions without rows")["part"]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/part={name}")
        path.getFileSystem(parts.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ingest(spark: SparkSession, incoming: DataFrame, folder: str, touch: bool = False) -> DataFrame:
    """Brings documents into ``folder/document`` and ``folder/chunk``, both partitioned by tenant; ``state, n_docs, n_chunks, n_spans`` of what was done.

    A document whose checksum is the one held is left alone, unless ``touch``; one without text has no chunks and is counted as ``no_chunks``;
    the text of the others is sanitised and cut, and its chunks replace all that the document had, also under another tenant. Only
    partitions of tenants that a change touches are read and written again. Loading the same documents twice changes nothing.

    Args:
        incoming: ``doc_id, tenant, source, text, checksum, version``; of several rows of a document the latest version counts.
    """
    latest = keep_latest(incoming.where("tenant is not null").select("doc_id", "tenant", "source", "text", "checksum", "version"), "doc_id", "version")
    held = read(spark, f"{folder}/document", DOCUMENT)
    with_text = latest.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    states = classify_changes(held.select("doc_id", "checksum"), latest, with_text)
    states = states.withColumn("state", F.when(F.lit(touch) & (F.col("state") == "unchanged"), "changed").otherwise(F.col("state")))
    # written out, as they are read from the table that is replaced below
    states = materialize(states, "states")
    work = latest.join(states, "doc_id").where("state <> 'unchanged'")
    pieces = work.withColumn("pieces", injections(F.coalesce("text", F.lit(""))))
    spans = sum(injection_counts(F.col("pieces")).values(), F.lit(0))
    clean = materialize(pieces.select("doc_id", "tenant", "source", "checksum", "version", "state", spans.alias("sanitised_spans"), sanitised(F.col("pieces")).alias("text"), partition_name(F.col("tenant")).alias("part")), "ingest")
    cut = materialize(fixed_chunks(clean.where("state <> 'no_chunks'")).withColumn("part", partition_name(F.col("tenant"))), "chunks")
    # the parts to write: those of the new rows, and those that lose rows because a document moved; tenants are counted in hundreds or thousands
    changed = clean.select("doc_id")
    old_parts = held.join(changed, "doc_id", "left_semi").select("part")
    touched = materialize(stacked(clean.select("part"), old_parts).distinct(), "touched")
    for name, schema, rows in (("document", DOCUMENT, clean.drop("text", "state")), ("chunk", CHUNK, cut)):
        table = read(spark, f"{folder}/{name}", schema)
        columns = [c.split()[0] for c in schema.split(", ")]
        kept = table.join(F.broadcast(touched), "part", "left_semi").join(changed, "doc_id", "left_anti")
        new = materialize(stacked(kept.select(columns), rows.select(columns)), name)
        _replace_parts(new, f"{folder}/{name}")
        _drop_parts(touched.join(new.select("part").distinct(), "part", "left_anti"), f"{folder}/{name}")
    chunks_of = cut.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    spans_of = clean.select("doc_id", "sanitised_spans")
    report = states.join(chunks_of, "doc_id", "left").join(spans_of, "doc_id", "left").groupBy("state").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), F.coalesce(F.sum("sanitised_spans"), F.lit(0)).alias("n_spans"))
    return materialize(report, "report")
