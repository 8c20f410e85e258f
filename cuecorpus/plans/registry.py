"""Where queries are put, with the SQL that checks them."""

from __future__ import annotations

from cuecorpus.plans.fixtures import with_views

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name or ``name``; ``sql`` may name the views of the fixtures."""

    def put(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = with_views(sql) if sql else None
        return f

    return put
