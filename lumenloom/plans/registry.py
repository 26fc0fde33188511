"""Queries over the driver's tables, each beside SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from lumenloom.plans import command_queries, guide_queries, lookup_queries, page_queries, playlist_queries, source_queries, text_queries  # noqa: F401

    return dict(QUERIES), dict(SQL)
