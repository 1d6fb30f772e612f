"""Queries on the chunks of the policy experiment, per tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordonlake.operators.skew import clean_label, heavy_keys, ordered_by_key
from cordonlake.session import table

_TENANT = r"nullif(lower(regexp_replace(tenant, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '')"


def _per_tenant(spark: SparkSession, sf_dir: str, value=None) -> DataFrame:
    return ordered_by_key(table(spark, sf_dir, "rls_demo"), clean_label("tenant"), F.col("id"), value)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants that hold at least a twentieth of all chunk rows."""
    return heavy_keys(_per_tenant(spark, sf_dir), 0.05).select(F.col("key").alias("tenant"))


def p5_per_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant: rows, distinct ids, first and last id, the largest gap between ids, rows that have an embedding."""
    has = F.col("embedding").isNotNull().cast("double")
    return _per_tenant(spark, sf_dir, has).select(
        F.col("key").alias("tenant"), "n_rows", F.col("n_orders").alias("n_ids"), F.col("first_order").alias("first_id"),
        F.col("last_order").alias("last_id"), "max_gap", F.col("total").cast("long").alias("n_embedded"),
    )


QUERIES = {"p5_found": p5_found, "p5_per_tenant": p5_per_tenant}

ORACLE = {
    "p5_found": f"""
        SELECT tenant FROM (SELECT {_TENANT} AS tenant, count(*) AS n FROM rls_demo GROUP BY 1)
        WHERE tenant IS NOT NULL AND n >= 0.05 * (SELECT count(*) FROM rls_demo)""",
    "p5_per_tenant": f"""
        WITH r AS (SELECT {_TENANT} AS tenant, id, embedding FROM rls_demo),
        g AS (SELECT *, id - lag(id) OVER (PARTITION BY tenant ORDER BY id) AS gap FROM r)
        SELECT tenant, count(*) AS n_rows, count(DISTINCT id) AS n_ids, min(id)::BIGINT AS first_id, max(id)::BIGINT AS last_id,
               coalesce(max(gap), 0)::BIGINT AS max_gap, count(embedding) AS n_embedded
        FROM g GROUP BY tenant""",
}
