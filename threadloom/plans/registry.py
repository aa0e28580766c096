"""All queries of the core library, with their SQL where SQL can express them."""

from __future__ import annotations

from threadloom.plans import corpus, dates, evaluation, graph, pipeline, resolution, spans, stages

MODULES = (dates, corpus, spans, graph, resolution, evaluation, stages, pipeline)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark, sf_dir):
    return graph.co_occurrence(spark, sf_dir)
