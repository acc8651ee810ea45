"""Registry of runnable queries and the SQL that states what each must return."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agentmeter.plans.adapters import Tables, duckdb_prelude

_builders: dict[str, Callable[[Tables], DataFrame]] = {}
_checks: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a builder; ``sql`` continues the shared WITH clause."""

    def register(build):
        if name in _builders:
            raise ValueError(f"query {name} is registered twice")
        _builders[name] = build
        if sql:
            _checks[name] = sql
        return build

    return register


def _load() -> None:
    from agentmeter.plans import (  # noqa: F401
        catalog_audit,
        catalog_calls,
        catalog_commands,
        catalog_rollouts,
        catalog_sources,
        catalog_streams,
        catalog_tokens,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(build):
        return lambda spark, directory: build(Tables(spark, directory))

    return {name: bind(build) for name, build in _builders.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: _with_views(sql.strip()) for name, sql in _checks.items()}


def _with_views(sql: str) -> str:
    """The check behind the shared views; its own WITH list joins theirs."""
    prelude = duckdb_prelude().rstrip()
    if sql.startswith("WITH RECURSIVE "):
        recursive = prelude.replace("WITH ", "WITH RECURSIVE ", 1)
        return f"{recursive},\n{sql.removeprefix('WITH RECURSIVE ')}"
    if sql.startswith("WITH "):
        return f"{prelude},\n{sql.removeprefix('WITH ')}"
    return f"{prelude}\n{sql}"
