"""Registration of queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from rippleframe.sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    """Registers a function of (spark, sf_dir) under its name; ``sql`` names tables and views in braces."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, recursive)
        return f

    return register
