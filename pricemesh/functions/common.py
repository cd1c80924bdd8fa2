"""Small column and join helpers."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the named keys of two aliased frames; still a hashable equi-join."""
    return reduce(and_, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def must(rows: DataFrame, holds: Column, message: Column) -> DataFrame:
    """Fail the job on the first row for which `holds` is not true.

    The check is a filter: as a projected column it would be pruned wherever nobody reads that column.
    """
    return rows.filter(F.when(F.coalesce(holds, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def let(value: Column, body) -> Column:
    """Bind `value` once inside an expression: body receives a lambda variable."""
    return F.transform(F.array(value), body)[0]


def add_array(df: DataFrame, values: DataFrame, column: str, alias: str) -> DataFrame:
    """Attach the distinct values of a bounded dimension column as one sorted array.

    Used to spread a row over a dimension (days, windows) with `explode`. The dimension is
    bounded by its domain: calendar days or booking windows, never by the number of quotes.
    """
    packed = values.select(column).distinct().agg(F.array_sort(F.collect_set(column)).alias(alias))
    return df.withColumn(alias, packed.scalar())


def fixed4(value: Column) -> Column:
    """Nearest 1e-4 with ties upward, immune to the last bits of a floating-point mean."""
    return F.floor(value.cast("double") * 10000 + 0.500001).cast("double") / 10000


def canonical_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))
