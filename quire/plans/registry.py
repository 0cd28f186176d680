"""Query and oracle registries; modules of this folder fill them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) function, with its oracle if SQL has one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from quire.plans import curves, linking, markup, merges, pages, rates, texts, vault  # noqa: E402, F401  (they register their queries)
