"""Where queries and their check SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state it, the SQL that gives the same rows."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def big(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def span_table(df: DataFrame, spans: str = "spans", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans as rows in the shape the checks use."""
    from ..operators.spans import explode_spans

    long = explode_spans(df.select(*keys, spans), list(keys), spans)
    return long.select(
        *keys,
        "entity_type",
        big("start").alias("span_start"),
        big("end").alias("span_end"),
        F.round("score", 6).alias("score"),
        F.col("text").alias("span_text"),
    )
