"""Exact order statistics from price histograms.

A median over raw rows would send a whole group to one task. Here rows are first counted per
(group, price) with map-side partial aggregation, so a group that holds a third of all quotes
is spread over many tasks and arrives at the ranking step as at most one row per distinct
price. Prices are two-decimal amounts inside the plausibility bounds, so a group's histogram
is bounded by the price domain, whatever the number of quotes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemesh.functions.common import same_keys

#: Width of a bucket of the selection, in units of the value.
BUCKET = 100.0


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (keys, value) with its multiplicity `cnt`."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))


def ranked(hist: DataFrame, keys: list[str], order: str, prefix: str = "") -> DataFrame:
    """Add group size `n` and the half-open rank range [lo, hi) each histogram row covers.

    One window per group: for groups of bounded size, such as one day of one cell.
    """
    up_to = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return (
        hist.withColumn(f"{prefix}hi", F.sum("cnt").over(up_to))
        .withColumn(f"{prefix}lo", F.col(f"{prefix}hi") - F.col("cnt"))
        .withColumn("n", F.sum("cnt").over(whole))
    )


def order_statistic(value: Column, rank: Column, lo: str, hi: str) -> Column:
    """The value covering a zero-based rank, null on every other histogram row."""
    return F.when((F.col(lo) <= rank) & (rank < F.col(hi)), value)


def interpolated(value: Column, p: float, lo: str, hi: str, reduce_) -> tuple[Column, Column, Column]:
    """The two order statistics around a quantile and its position; `reduce_` picks the one
    non-null row of the group."""
    pos = (F.col("n") - 1) * F.lit(float(p))
    below = reduce_(order_statistic(value, F.floor(pos), lo, hi))
    above = reduce_(order_statistic(value, F.ceil(pos), lo, hi))
    return below, above, pos


def quantile_over(hist: DataFrame, keys: list[str], value: Column, p: float, lo: str, hi: str) -> Column:
    """Quantile of the group on every histogram row, as a window expression."""
    whole = Window.partitionBy(*keys)
    below, above, pos = interpolated(value, p, lo, hi, lambda c: F.max(c).over(whole))
    return below + (above - below) * (pos - F.floor(pos))


def _ranks(p: float) -> tuple[Column, Column]:
    """The two zero-based ranks around a quantile of a group of n."""
    pos = (F.col("n") - 1) * F.lit(float(p))
    return F.floor(pos), F.ceil(pos)


def _picks(value: str, probs: dict[str, float]) -> list[Column]:
    """The order statistics around every quantile, as aggregates over rows with their ranks [lo, hi) and n."""
    x = F.col(value).cast("double")
    return [
        F.max(order_statistic(x, rank, "lo", "hi")).alias(f"_{name}_{side}")
        for name, p in probs.items()
        for side, rank in zip(("lo", "hi"), _ranks(p))
    ]


def _totals(value: str) -> list[Column]:
    return [
        F.sum("cnt").alias("n"), F.sum(F.col(value) * F.col("cnt")).alias("total"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
    ]


def chosen_rows(hist: DataFrame, keys: list[str], value: str, probs: dict[str, float], width: float = BUCKET) -> DataFrame:
    """Selection in two steps for groups of any size: the totals of buckets of `width` say which bucket holds each wanted
    rank, and only the rows of those are ordered. Returns them with their ranks [lo, hi) in the group and its totals.

    A group has as many buckets as its value range holds, and at most two of them per quantile are chosen.
    """
    rows = hist.withColumn("_bucket", F.floor(F.col(value).cast("double") / width))
    held = rows.groupBy(*keys, "_bucket").agg(*_totals(value))
    group = Window.partitionBy(*keys)
    below = F.sum("n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_below", F.coalesce(below, F.lit(0))).withColumn("_held", F.col("n"))
    held = held.withColumns(
        {
            "n": F.sum("_held").over(group), "total": F.sum("total").over(group),
            "min_value": F.min("min_value").over(group), "max_value": F.max("max_value").over(group),
        }
    )
    wanted = [(F.col("_below") <= r) & (r < F.col("_below") + F.col("_held")) for p in probs.values() for r in _ranks(p)]
    chosen = held.filter(reduce(or_, wanted)).drop("_held")
    group_totals = ["n", "total", "min_value", "max_value", "_below"]
    joined = rows.alias("r").join(chosen.alias("t"), same_keys("r", "t", [*keys, "_bucket"]))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        joined.select("r.*", *[f"t.{c}" for c in group_totals])
        .withColumn("hi", F.col("_below") + F.sum("cnt").over(inside))
        .withColumn("lo", F.col("hi") - F.col("cnt"))
        .drop("_bucket", "_below")
    )


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], bounded: bool = False) -> DataFrame:
    """One row per group: n, total, min_value, max_value and the exact quantiles asked for.

    bounded says that no group outgrows a task, as one day of a cell does not: then one window ranks a group as a whole.
    """
    hist = histogram(df, keys, value)
    if bounded:
        totals = [F.max("n").alias("n"), *_totals(value)[1:]]
        out = ranked(hist, keys, value).groupBy(*keys).agg(*totals, *_picks(value, probs))
    else:
        same = [F.max(c).alias(c) for c in ("n", "total", "min_value", "max_value")]
        out = chosen_rows(hist, keys, value, probs).groupBy(*keys).agg(*same, *_picks(value, probs))
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos))).drop(f"_{name}_lo", f"_{name}_hi")
    return out
