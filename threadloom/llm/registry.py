"""All queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from threadloom.llm import components, lookalikes, markup, mixing, name_variants, packing, page_template, repeated_lines, truncation

MODULES = (name_variants, page_template, lookalikes, markup, repeated_lines, components, packing, mixing, truncation)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
