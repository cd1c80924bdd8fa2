"""Stored fares: canonical routes, storage identity, usable rows and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemesh import schema as S
from pricemesh.functions.common import must
from pricemesh.functions.stats import grouped_quantiles
from pricemesh.operators.cleaning import first_arrivals


class ReferenceMissing(Exception):
    """A row names a route or source the reference tables do not know."""


def with_route(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Attach route_id by unordered endpoints; unknown pairs get null."""
    ends = routes.select("route_id", F.col("origin").alias("_a"), F.col("destination").alias("_b"))
    return (
        rows.withColumns(
            {"_o": F.least("origin", "destination"), "_d": F.greatest("origin", "destination")}
        )
        .join(ends, (F.col("_o") == F.col("_a")) & (F.col("_d") == F.col("_b")), "left")
        .drop("_a", "_b", "_o", "_d")
    )


def unknown_routes(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Pairs in the data that the route table lacks; a load must find none."""
    return with_route(rows, routes).filter(F.col("route_id").isNull()).groupBy(
        F.least("origin", "destination").alias("origin"), F.greatest("origin", "destination").alias("destination")
    ).agg(F.count(F.lit(1)).alias("quotes"))


def require_known_routes(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Fail the job on the first row of an unknown pair, inside the tasks that read it."""
    pair = F.concat_ws("-", F.least("origin", "destination"), F.greatest("origin", "destination"))
    return must(with_route(rows, routes), F.col("route_id").isNotNull(), F.concat(F.lit("route not in the basket: "), pair))


def storage_rank():
    """Arrival order at the store: clean rows first, then outliers, then sold-out rows."""
    lane = F.when(F.col("is_sold_out"), 2).when(F.col("is_outlier"), 1).otherwise(0)
    return F.struct(lane.alias("lane"), F.col("ingest_seq").alias("seq"))


def stored_fares(persistable: DataFrame) -> DataFrame:
    """Storage identity: flights are unique per key, rows without a flight number all stay."""
    own = F.when(F.col("flight_number").isNull(), F.col("ingest_seq"))
    keyed = persistable.drop("copies").withColumn("_own", own)
    return first_arrivals(keyed, [*S.FARE_IDENTITY, "_own"], storage_rank()).drop("copies", "_own")


def usable(fares: DataFrame) -> DataFrame:
    return fares.filter(~F.col("is_outlier") & ~F.col("is_sold_out"))


def price_table(fares: DataFrame) -> DataFrame:
    """Lowest usable fare and usable quote count per carrier cell and day, in one pass.

    Carrier cells whose fares are all flagged keep a row with a null price, so the table also
    knows every collection day. Its size is days x carrier cells, independent of quote volume.
    """
    ok = ~F.col("is_outlier") & ~F.col("is_sold_out")
    return fares.groupBy("scrape_date", *S.CARRIER_CELL).agg(
        F.min(F.when(ok, F.col("total_fare"))).alias("price"), F.count_if(ok).alias("n_quotes")
    )


def daily_prices(table: DataFrame) -> DataFrame:
    return table.filter(F.col("price").isNotNull())


def quote_counts(prices: DataFrame) -> DataFrame:
    return prices.groupBy("scrape_date", *S.CELL).agg(F.sum("n_quotes").alias("n_quotes"))


def scrape_dates(fares: DataFrame, start=None, end=None) -> DataFrame:
    """Days on which any fare exists; only these are ever processed."""
    days = fares.select("scrape_date")
    if start is not None:
        days = days.filter(F.col("scrape_date") >= F.lit(start))
    if end is not None:
        days = days.filter(F.col("scrape_date") <= F.lit(end))
    return days.distinct()


def base_prices(
    prices: DataFrame, start, end, min_observations: int = S.MIN_BASE_OBSERVATIONS
) -> DataFrame:
    """Geometric mean of daily prices over the reference period, stored at four decimals."""
    period = prices.filter(F.col("scrape_date").between(F.lit(start), F.lit(end)) & (F.col("price") > 0))
    return (
        period.groupBy(*S.CARRIER_CELL)
        .agg(F.exp(F.avg(F.ln(F.col("price").cast("double")))).alias("g"), F.count(F.lit(1)).alias("n_observations"))
        .filter(F.col("n_observations") >= min_observations)
        .select(
            *S.CARRIER_CELL,
            F.col("g").cast("decimal(12,4)").alias("base_price"),
            F.col("n_observations").cast("int"),
            F.lit(start).cast("date").alias("price_ref_start"),
            F.lit(end).cast("date").alias("price_ref_end"),
        )
    )


def naive_mean(fares: DataFrame) -> DataFrame:
    """Unweighted mean of usable fares per day: the benchmark the index must differ from."""
    return usable(fares).groupBy("scrape_date").agg(F.avg(F.col("total_fare").cast("double")).alias("mean_fare"))


def prices_by_concept(fares: DataFrame) -> DataFrame:
    """One row per (concept, day, carrier cell): the day's lowest, median, mean and highest fare.

    All four come from one price histogram per carrier cell and day.
    """
    keys = ["scrape_date", *S.CARRIER_CELL]
    q = grouped_quantiles(usable(fares), keys, "total_fare", {"median": 0.5}, bounded=True)
    return q.select(
        *keys,
        F.expr(
            "stack(4, 'lowest', cast(min_value as double), 'median', median,"
            " 'mean', cast(total as double) / n, 'highest', cast(max_value as double)) as (concept, price)"
        ),
    )
