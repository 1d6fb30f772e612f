"""Incremental loading: what changed, keep-latest merges, replaced slices, verification, embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordonlake.session import stacked


def keep_latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: that of the latest version, a null one last, ties to the smallest remaining values."""
    rest = [c for c in df.columns if c not in (key, version)]
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), *rest)
    return df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """``existing`` with the rows of ``incoming`` merged in by key; the later version stays."""
    return keep_latest(stacked(existing, incoming), key, version)


def insert_missing(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` and those rows of ``incoming`` whose key it lacks, one per key."""
    return stacked(existing, incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(existing.columns))


def replace_slices(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` without the rows of every key that ``incoming`` has, and all rows of ``incoming``."""
    return stacked(existing.join(incoming.select(key).distinct(), key, "left_anti").select(existing.columns), incoming)


def classify_changes(known: DataFrame, incoming: DataFrame, with_chunks: DataFrame) -> DataFrame:
    """``doc_id, state`` of incoming documents: ``unchanged``, ``changed``, ``new``, or ``no_chunks``.

    ``known`` and ``incoming`` give ``doc_id, checksum`` once per document, ``with_chunks`` the documents that have chunks.
    """
    k = known.select("doc_id", F.col("checksum").alias("was"), F.lit(True).alias("known"))
    c = with_chunks.select("doc_id").distinct().withColumn("chunked", F.lit(True))
    state = (F.when(F.col("known") & F.col("checksum").eqNullSafe(F.col("was")), "unchanged").when(F.col("chunked").isNull(), "no_chunks").when(F.col("known"), "changed").otherwise("new"))
    return incoming.select("doc_id", "checksum").join(k, "doc_id", "left").join(c, "doc_id", "left").select("doc_id", state.alias("state"))


def verify_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, state``: ``ok``, ``mismatch``, ``missing`` (in the manifest only) or ``unlisted`` (found only); both ``doc_id, checksum``."""
    m, f = manifest.select("doc_id", F.col("checksum").alias("m"), F.lit(1).alias("in_m")), found.select("doc_id", F.col("checksum").alias("f"), F.lit(1).alias("in_f"))
    state = F.when(F.col("in_f").isNull(), "missing").when(F.col("in_m").isNull(), "unlisted").when(F.col("m").eqNullSafe(F.col("f")), "ok").otherwise("mismatch")
    return m.join(f, "doc_id", "full_outer").select("doc_id", state.alias("state"))


def cache_key(body: str = "body"):
    """Key of a body in an embedding cache; equal bodies share it."""
    return F.substring(F.sha2(body, 256), 1, 32)


def cache_lookup(bodies: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``chunk_id, key, hit`` of bodies against the keys of a model's cache."""
    held = cache.where(F.col("model") == model).select("key").distinct().withColumn("h", F.lit(True))
    return bodies.select("chunk_id", cache_key().alias("key")).join(held, "key", "left").select("chunk_id", "key", F.coalesce("h", F.lit(False)).alias("hit"))


def cache_put(cache: DataFrame | None, bodies: DataFrame, model: str) -> DataFrame:
    """The cache (``key, model, body``) with those bodies that it lacks for a model, each once; None is an empty cache."""
    new = bodies.select(cache_key().alias("key"), F.lit(model).alias("model"), "body").dropDuplicates(["key"])
    return new if cache is None else stacked(cache, new.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti"))
