"""All queries of the library with their SQL."""

from __future__ import annotations

from graphtide.plans import coverage_queries, kb_queries, lattice_queries, roundtrip_queries, scale_queries, sim_queries, stream_queries

MODULES = [kb_queries, sim_queries, coverage_queries, scale_queries, stream_queries, roundtrip_queries, lattice_queries]


def flagship(spark, sf_dir):
    return kb_queries.flagship(spark, sf_dir)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
