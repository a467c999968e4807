"""Registered queries of the document engine and their SQL counterparts."""

from __future__ import annotations

from treeloom.plans import markup, relational

QUERIES: dict = {**relational.QUERIES, **markup.QUERIES}
ORACLE: dict = {**relational.ORACLE, **markup.ORACLE}


def flagship(spark, sf_dir):
    """Cardinality violations with paths."""
    return QUERIES["cardinality_violations"](spark, sf_dir)
