"""Registered queries with their SQL oracles over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pricemesh.functions.common import fixed4
from pricemesh.plans.domain import Domain

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[Domain], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = sql


def publish(df: DataFrame) -> DataFrame:
    """Comparable types: fractions to the nearest 1e-4 (ties upward), dates and lists as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = fixed4(c)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def runner(build: Callable[[Domain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: publish(build(Domain.of(spark, sf_dir)))
