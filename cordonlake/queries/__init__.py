"""Registered queries of the core, by module."""

from __future__ import annotations

from cordonlake.queries import corpus, evaluation, retrieval, tenants

MODULES = [tenants, corpus, retrieval, evaluation]


def all_queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return retrieval.lexical_topk_secure(spark, sf_dir)
