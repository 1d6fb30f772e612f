"""Which rows a role may read. Every retrieval takes its chunks through :func:`secure_view`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACL_ROWS = 100_000
MAX_ROLES = 1_000


def permitted(acl: DataFrame, role: str | None) -> DataFrame:
    """Tenants of a role, ``tenant``; none for a null, empty or unknown role. Roles match exactly: case and spaces count."""
    return acl.where(F.col("role_name") == F.lit(role)).where("tenant is not null").select("tenant").distinct()


def secure_view(df: DataFrame, acl: DataFrame, role: str | None) -> DataFrame:
    """Rows of ``df`` whose tenant the role may read; rows without a tenant are never among them.

    A semi join, so it stands before any ranking. The tenants of a role are broadcast while there are at most
    ``ACL_ROWS`` of them.
    """
    tenants = permitted(acl, role)
    if tenants.limit(ACL_ROWS + 1).count() <= ACL_ROWS:
        tenants = F.broadcast(tenants)
    return df.join(tenants, "tenant", "left_semi")


def role_tenants(acl: DataFrame) -> DataFrame:
    """``role_name, tenants`` (sorted) of every role; a role without tenants has an empty list."""
    return acl.groupBy("role_name").agg(F.array_sort(F.collect_set("tenant")).alias("tenants"))


def privileges_hold(spark, names: list[str]) -> None:
    """Refuses to go on if any of these tables can be read past :func:`secure_view` through the session's catalog."""
    if bare := [n for n in names if spark.catalog.tableExists(n)]:
        raise PermissionError(f"readable without the access rules: {', '.join(bare)}")


def access_matrix(acl: DataFrame, chunks: DataFrame, seen: DataFrame) -> DataFrame:
    """Per role and tenant of the chunks: whether access is due, the rows seen, and rows seen though none were due.

    ``seen`` (``role, tenant, n``) is what was observed. Roles are at most ``MAX_ROLES``, and chunks are counted per tenant
    before they meet the roles.
    """
    roles = acl.select("role_name").where("role_name is not null").distinct()
    if roles.limit(MAX_ROLES + 1).count() > MAX_ROLES:
        raise ValueError(f"more than {MAX_ROLES} roles")
    tenants = chunks.where("tenant is not null").select("tenant").distinct()
    due = acl.select("role_name", "tenant").distinct().withColumn("due", F.lit(True))
    got = seen.select(F.col("role").alias("role_name"), "tenant", "n")
    every = tenants.crossJoin(F.broadcast(roles)).join(due, ["role_name", "tenant"], "left").join(got, ["role_name", "tenant"], "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("role_name", "tenant", F.coalesce("due", F.lit(False)).alias("due"), n.alias("n_seen"), F.when(F.col("due").isNull(), n).otherwise(0).alias("n_leaked"))
