"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storyrank.fixtures import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def with_views(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` clause holding the named fixture views (and what they need), then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for needed in CTES[name][0]:
            add(needed)
        order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({s})" for n, s in extra.items()]
    if not parts:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = body.lstrip()
    if body[:5].lower() == "with ":
        return head + ",\n".join(parts) + ",\n" + body[5:]
    return head + ",\n".join(parts) + "\n" + body
