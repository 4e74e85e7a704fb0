"""All queries of the engine, by name, with their SQL."""

from __future__ import annotations

from readloom.plans import queries_alignments, queries_kernels,queries_more, queries_reads, queries_relational, queries_scalar, queries_variants  # noqa: F401
from readloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
