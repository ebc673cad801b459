"""Registered queries: a Spark function each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(
    name: str, sql: str | None = None, views: list[str] | None = None,
    extra: dict[str, str] | None = None,
):
    """Register a function of ``Tables`` as a query."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_views(sql, views or [], extra) if (views or extra) else sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that both engines' last bits compare equal."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(
        *[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


def sql_round(columns: list[str], digits: int = 6) -> str:
    """The same in SQL; adding zero turns a negative zero into zero."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
