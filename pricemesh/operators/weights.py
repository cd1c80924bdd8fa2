"""Route weights from city-pair traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pricemesh.functions.common import must


def pair_totals(traffic: DataFrame, start: int, end: int) -> DataFrame:
    """Passengers of both directions per unordered pair over an inclusive yyyymm range.

    Expects text columns as released; a direction that is not a number counts as zero.
    """
    period = F.col("Year").try_cast("int") * 100 + F.col("Month").try_cast("int")
    pax = lambda c: F.coalesce(F.col(c).try_cast("double").cast("bigint"), F.lit(0))
    a, b = F.upper(F.trim("City1")), F.upper(F.trim("City2"))
    return (
        traffic.filter(period.between(start, end) & a.isNotNull() & b.isNotNull() & (a != b))
        .groupBy(F.least(a, b).alias("origin"), F.greatest(a, b).alias("destination"))
        .agg(F.sum(pax("PaxToCity2") + pax("PaxFromCity2")).alias("passengers"))
    )


def to_codes(totals: DataFrame, cities: DataFrame) -> DataFrame:
    """Translate city names to codes; pairs with an unknown city drop out."""
    o = cities.select(F.upper("traffic_city").alias("origin"), F.col("iata").alias("_o"))
    d = cities.select(F.upper("traffic_city").alias("destination"), F.col("iata").alias("_d"))
    named = totals.join(o, "origin").join(d, "destination")
    return named.groupBy(F.least("_o", "_d").alias("origin"), F.greatest("_o", "_d").alias("destination")).agg(
        F.sum("passengers").alias("passengers")
    )


def basket_traffic(totals: DataFrame, basket: DataFrame) -> DataFrame:
    """Traffic of every basket route; a route without traffic fails the job."""
    rows = basket.select("origin", "destination").join(totals, ["origin", "destination"], "left")
    code = F.concat_ws("-", "origin", "destination")
    return must(rows, F.col("passengers").isNotNull(), F.concat(F.lit("no traffic found for "), code))


def route_weights(totals: DataFrame, basket: DataFrame, places: int = 7) -> DataFrame:
    """Shares rounded half-up that sum to exactly one: the residual goes to the busiest route."""
    kept = basket_traffic(totals, basket).withColumn("_all", F.lit(1))
    # The basket is a register of routes, so one ordering over it stays small.
    everything = Window.partitionBy("_all")
    share = (F.col("passengers").cast("decimal(20,0)") / F.sum("passengers").over(everything).cast("decimal(20,0)")).cast(
        "decimal(20,15)"
    )
    rounded = kept.withColumn("w", F.round(share, places).cast(f"decimal(12,{places})"))
    first = F.row_number().over(everything.orderBy(F.desc("passengers"), "origin", "destination"))
    residual = F.lit(1) - F.sum("w").over(everything)
    return rounded.select(
        "origin", "destination", F.concat_ws("-", "origin", "destination").alias("route_code"), "passengers",
        (F.col("w") + F.when(first == 1, residual).otherwise(0)).cast("decimal(12,10)").alias("weight"),
    )


def coverage(totals: DataFrame, basket: DataFrame) -> DataFrame:
    """Share of all traffic the basket covers."""
    marked = totals.join(basket.select("origin", "destination", F.lit(1).alias("hit")), ["origin", "destination"], "left")
    inside = F.sum(F.when(F.col("hit") == 1, F.col("passengers")).otherwise(0))
    return marked.agg(
        inside.alias("basket_passengers"), F.sum("passengers").alias("all_passengers"),
        (inside / F.sum("passengers")).alias("coverage"),
    )


def top_omitted(totals: DataFrame, basket: DataFrame, k: int = 3) -> DataFrame:
    """Busiest pairs outside the basket."""
    rest = totals.join(basket.select("origin", "destination"), ["origin", "destination"], "left_anti")
    return rest.orderBy(F.desc("passengers"), "origin", "destination").limit(k)
