"""Collects the query bindings and their oracle SQL from all plan modules."""

from __future__ import annotations

import functools

from tessera.session import configure


def _configured(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        configure(spark)
        return fn(spark, sf_dir)
    return run


def _modules():
    from tessera.plans import context, driver, ingest, oracle, reports
    return [(driver.QUERIES, oracle.SQL), (ingest.QUERIES, ingest.SQL),
            (context.QUERIES, context.SQL), (reports.QUERIES, reports.SQL)]


def all_queries() -> dict:
    out = {}
    for queries, _ in _modules():
        for name, fn in queries.items():
            out[name] = _configured(fn)
    return out


def all_oracle_sql() -> dict[str, str]:
    out = {}
    for queries, sql in _modules():
        for name in queries:
            if name in sql:
                out[name] = sql[name]
    return out
