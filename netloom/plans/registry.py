"""Named queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.plans.views import VIEW_SQL, sql_text
from netloom.session import adopt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", oracle: str | None = None):
    """Register ``fn(spark, sf_dir)``. ``views`` names the shared views the SQL may read."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(adopt(spark), str(sf_dir))
        if oracle:
            ORACLES[name] = with_views(views, oracle)
        return fn
    return register


def with_views(views: str, body: str) -> str:
    """Prefix the body with the view definitions; it may open with more named parts."""
    parts = [f"{v} AS ({sql_text(v)})" for v in views.split()]
    assert all(v in VIEW_SQL for v in views.split())
    body = body.strip()
    if not parts:
        return body if body.upper().startswith("SELECT") else "WITH " + body
    glue = " " if body.upper().startswith("SELECT") else ", "
    return "WITH " + ", ".join(parts) + glue + body
