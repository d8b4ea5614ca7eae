"""Queries over the package's own operators and their SQL, by name."""

from __future__ import annotations

import functools

from progdf.functions.parts import cut

from . import call_queries, dependence_queries, evaluation_queries, flow_queries, package_queries, reach_queries, source_queries


def _cut(query):
    @functools.wraps(query)
    def run(spark, sf_dir):
        cut(spark, sf_dir)
        return query(spark, sf_dir)

    return run


_PARTS = (flow_queries, evaluation_queries, call_queries, dependence_queries, source_queries, package_queries, reach_queries)
QUERIES = {k: _cut(q) for p in _PARTS for k, q in p.QUERIES.items()}
ORACLES = {k: q for p in _PARTS for k, q in p.ORACLES.items()}
