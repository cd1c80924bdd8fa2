"""Fare levels against the booking window: statistics, ratios, pivots and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pricemesh.functions.stats import grouped_quantiles
from pricemesh.operators import elasticity


def with_code(rows: DataFrame, routes: DataFrame) -> DataFrame:
    return rows.join(routes.select("route_id", "route_code"), "route_id")


def fare_stats(usable: DataFrame, keys: list[str], start=None, end=None) -> DataFrame:
    """Count, mean (two decimals), minimum and exact median of usable fares per group."""
    rows = usable
    if start is not None:
        rows = rows.filter(F.col("scrape_date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("scrape_date") <= F.lit(end))
    q = grouped_quantiles(rows, keys, "total_fare", {"median_fare": 0.5}, bounded="scrape_date" in keys)
    return q.select(
        *keys,
        "n",
        F.round(F.col("total") / F.col("n"), 2).cast("decimal(12,2)").alias("mean_fare"),
        F.col("min_value").alias("min_fare"),
        "median_fare",
    )


def leadtime_stats(usable: DataFrame, routes: DataFrame, start=None, end=None) -> DataFrame:
    return fare_stats(with_code(usable, routes), ["route_code", "window_days"], start, end)


def leadtime_by_day(usable: DataFrame, routes: DataFrame) -> DataFrame:
    return fare_stats(with_code(usable, routes), ["route_code", "window_days", "scrape_date"])


def ratio_to_longest(stats: DataFrame) -> DataFrame:
    """Rounded mean over the rounded mean of the longest window, half-even at four places."""
    route = Window.partitionBy("route_code").orderBy("window_days").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    longest = F.last("mean_fare").over(route)
    ratio = F.col("mean_fare") / F.nullif(longest, F.lit(0))
    return stats.select(
        "*",
        F.bround(ratio, 4).cast("decimal(12,4)").alias("ratio_to_longest_window"),
        F.bround(F.col("median_fare").cast("decimal(20,6)"), 2).cast("decimal(12,2)").alias("median_2dp"),
    )


def premium(stats: DataFrame) -> DataFrame:
    """Nearest-window mean over farthest-window mean, per route with two windows or more."""
    return (
        stats.groupBy("route_code")
        .agg(
            F.min("window_days").alias("near_window"),
            F.max("window_days").alias("far_window"),
            F.min_by("mean_fare", "window_days").cast("double").alias("near_fare"),
            F.max_by("mean_fare", "window_days").cast("double").alias("far_fare"),
        )
        .filter(F.col("near_window") != F.col("far_window"))
        .withColumn("ratio", F.col("near_fare") / F.col("far_fare"))
    )


def by_window(stats: DataFrame, route_codes: list[str]) -> DataFrame:
    """One row per window, one mean-fare column per route."""
    return stats.groupBy("window_days").pivot("route_code", route_codes).agg(F.first("mean_fare").cast("double"))


def multiplier(amplitude, tau, window):
    return 1.0 + amplitude * F.exp(-window / tau)


def response_for_route(usable: DataFrame, routes: DataFrame, code: str, start=None, end=None) -> DataFrame:
    """Observed points of one route in a date range beside the fit over the same fares.

    An unknown code is refused with the list of known ones; the route register is small.
    """
    one = routes.filter(F.col("route_code") == code.strip().upper())
    if not one.take(1):
        known = sorted(r.route_code for r in routes.select("route_code").collect())
        raise ValueError(f"unknown route {code!r}; known: {', '.join(known)}")
    days = F.lit(True)
    if start is not None:
        days = days & (F.col("scrape_date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days & (F.col("scrape_date") <= F.lit(end).cast("date"))
    rows = with_code(usable.filter(days).join(one.select("route_id"), "route_id", "left_semi"), routes)
    fit = elasticity.parameters(elasticity.fit_routes(rows, ["route_code"]), ["route_code"])
    points = ratio_to_longest(leadtime_stats(usable, one, start, end))
    return points.join(fit.select("route_code", "fitted", "floor", "amplitude", "decay_days", "r_squared", "warnings"), "route_code", "left")


def fitted_curve(fits: DataFrame, stats: DataFrame) -> DataFrame:
    """Evaluate each fit on a half-day grid up to the longest window, with observed means."""
    reach = stats.groupBy("route_code").agg(F.greatest(F.max("window_days"), F.lit(45)).alias("reach"))
    half_days = F.sequence(F.lit(2), (F.col("reach") * 2).cast("int"))
    curve = (
        fits.filter("fitted")
        .join(reach, "route_code")
        .select("route_code", "floor", "amplitude", "decay_days", F.explode(half_days).alias("h"))
        .withColumn("window_days", F.col("h") / 2.0)
        .withColumn("fitted_fare", F.col("floor") * multiplier(F.col("amplitude"), F.col("decay_days"), F.col("window_days")))
    )
    seen = stats.select("route_code", F.col("window_days").cast("double").alias("window_days"), "mean_fare")
    return curve.join(seen, ["route_code", "window_days"], "left").select(
        "route_code", "window_days", "fitted_fare", F.col("mean_fare").cast("double").alias("observed")
    )


def daily_lookup(by_day: DataFrame, route_code: str, window_days: int, value: str, date: str) -> DataFrame:
    """The calendar series of one route and window."""
    return by_day.filter((F.col("route_code") == route_code) & (F.col("window_days") == window_days)).select(date, value)


def index_in_money(stats: DataFrame, basket: DataFrame, headline: DataFrame, window_days: int = 7) -> DataFrame:
    """What the index movement means on the busiest route: typical fare, now and at the peak."""
    busiest = basket.agg(F.max_by("route_code", "weight").alias("route_code"))
    moves = headline.filter("frequency = 'daily'").agg(
        (F.max_by("index_value", "index_date").cast("double") - 100).alias("change_pct"),
        (F.max("index_value").cast("double") - 100).alias("peak_pct"),
    )
    typical = stats.filter(F.col("window_days") == window_days).join(busiest, "route_code")
    t = F.col("mean_fare").cast("double")
    return (
        typical.withColumn("_m", moves.select(F.struct("change_pct", "peak_pct")).scalar())
        .select(
            "route_code",
            t.alias("typical"),
            (t * (1 + F.col("_m.change_pct") / 100)).alias("now"),
            (t * (1 + F.col("_m.peak_pct") / 100)).alias("peak"),
        )
    )


SORT_MODES = {
    "weight": ("weight", False),
    "cheapest": ("mean_fare", True),
    "dearest": ("mean_fare", False),
    "rising": ("index_value", False),
    "falling": ("index_value", True),
}


def sort_order(mode: str):
    """Ordering of a sector list; a sector without a fare sorts as if it were dearest."""
    column, ascending = SORT_MODES[mode]
    c = F.col(column)
    if column == "mean_fare":
        return c.asc_nulls_last() if ascending else c.desc_nulls_first()
    return c.asc() if ascending else c.desc()


def sector_list(route_rows: DataFrame, stats: DataFrame, window_days: int, mode: str, limit: int | None = None) -> DataFrame:
    fares = stats.filter(F.col("window_days") == window_days).select("route_code", "mean_fare")
    out = route_rows.join(fares, "route_code", "left").orderBy(sort_order(mode), "route_code")
    return out.limit(limit) if limit else out


def heat_matrix(route_rows: DataFrame, route_codes: list[str], last: int = 14) -> DataFrame:
    """Route values on the last dates as a date x route matrix."""
    newest = route_rows.select("index_date").distinct().orderBy(F.desc("index_date")).limit(last)
    return (
        route_rows.join(newest, "index_date", "left_semi")
        .groupBy("index_date")
        .pivot("route_code", route_codes)
        .agg(F.first("index_value").cast("double"))
    )


def cheapest_and_peak(series: DataFrame, keys: list[str], value: str = "value", date: str = "index_date") -> DataFrame:
    """Lowest and highest point of every series; the earlier day wins a tie."""
    first_low = F.struct(F.col(value), F.datediff(F.col(date), F.lit("1970-01-01")))
    first_high = F.struct(F.col(value), -F.datediff(F.col(date), F.lit("1970-01-01")))
    return series.groupBy(*keys).agg(
        F.min(value).alias("min_value"),
        F.min_by(date, first_low).alias("cheapest_day"),
        F.max(value).alias("max_value"),
        F.max_by(date, first_high).alias("peak_day"),
    )
