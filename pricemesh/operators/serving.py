"""The queries behind the published views of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest(headline: DataFrame, frequency: str = "daily") -> DataFrame:
    """Newest row with its change against the previous and the 31st newest row."""
    newest = headline.filter(F.col("frequency") == frequency).orderBy(F.desc("index_date")).limit(31)
    order = Window.partitionBy("frequency").orderBy("index_date")
    v = F.col("index_value").cast("decimal(20,8)")
    change = lambda back: F.bround((v / F.lag(v, back).over(order) - 1) * 100, 4)
    c = newest.withColumn("change_1d", change(1)).withColumn("change_30d", change(30))
    return c.groupBy("frequency").agg(
        F.max_by(F.struct(*[x for x in c.columns if x != "frequency"]), "index_date").alias("r")
    ).select("frequency", "r.*")


def series(headline: DataFrame, frequency="daily", start=None, end=None, limit: int | None = None) -> DataFrame:
    """Ordered series inside an inclusive date range; the first `limit` points only where a caller asks."""
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError("start must not be after end")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    rows = headline.filter(F.col("frequency") == frequency)
    if start is not None:
        rows = rows.filter(F.col("index_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.col("index_date") <= F.lit(end).cast("date"))
    ordered = rows.orderBy("index_date")
    return ordered if limit is None else ordered.limit(limit)


def route_breakdown(route_rows: DataFrame, headline: DataFrame, routes: DataFrame, frequency="daily", date=None) -> DataFrame:
    """Routes of one period by contribution, with the headline they add up to."""
    head = headline.filter(F.col("frequency") == frequency)
    if date is None:
        one = head.agg(F.max_by(F.struct("index_date", "index_value"), "index_date").alias("h"))
    else:
        one = head.filter(F.col("index_date") == F.lit(date).cast("date")).agg(
            F.first(F.struct("index_date", "index_value")).alias("h")
        )
    rows = route_rows.filter(F.col("frequency") == frequency).withColumn("_h", one.scalar())
    return (
        rows.filter(F.col("index_date") == F.col("_h.index_date"))
        .join(routes.select("route_id", "route_code", "origin", "destination"), "route_id")
        .select(
            "index_date", "route_code", "origin", "destination", "index_value", "weight", "contribution",
            F.col("_h.index_value").alias("headline"),
        )
        .orderBy(F.desc("contribution"))
    )


def newest_routes(route_rows: DataFrame, frequency: str = "daily") -> DataFrame:
    """Route rows of the newest period."""
    rows = route_rows.filter(F.col("frequency") == frequency)
    return rows.withColumn("_d", rows.agg(F.max("index_date")).scalar()).filter(F.col("index_date") == F.col("_d")).drop("_d")


def route_series(route_rows: DataFrame, routes: DataFrame, code: str, frequency="daily", start=None, end=None) -> DataFrame:
    rows = route_rows.join(routes.filter(F.col("route_code") == code.strip().upper()), "route_id", "left_semi")
    return series(rows, frequency, start, end).select("index_date", "index_value", "weight", "contribution")


def cells(stored: DataFrame, routes: DataFrame, date=None, code: str | None = None) -> DataFrame:
    """Elementary cells of one day, or of all days when no date is given."""
    rows = stored.join(routes.select("route_id", "route_code"), "route_id")
    if date is not None:
        rows = rows.filter(F.col("index_date") == F.lit(date).cast("date"))
    if code is not None:
        rows = rows.filter(F.col("route_code") == code.strip().upper())
    return rows


def basket(routes: DataFrame, airports: DataFrame, route_weights: DataFrame, ref_start: str) -> DataFrame:
    """Routes with city names and the weight of one reference period, heaviest first."""
    w = route_weights.filter(F.col("weight_ref_start") == F.lit(ref_start).cast("date")).select("route_id", "passengers", "weight")
    o = airports.select(F.col("iata").alias("origin"), F.col("city_name").alias("origin_city"))
    d = airports.select(F.col("iata").alias("destination"), F.col("city_name").alias("destination_city"))
    return routes.join(o, "origin").join(d, "destination").join(w, "route_id", "left").orderBy(F.desc_nulls_last("weight"))


def basket_total(listing: DataFrame) -> DataFrame:
    return listing.agg(F.sum(F.coalesce("weight", F.lit(0))).alias("total_weight"))


def endpoints(routes: DataFrame) -> DataFrame:
    return routes.select(F.col("origin").alias("iata")).union(routes.select("destination")).distinct()


def reachable(routes: DataFrame) -> DataFrame:
    """Airports each airport is paired with in the basket."""
    there = routes.select(F.col("origin").alias("iata"), F.col("destination").alias("partner"))
    back = routes.select(F.col("destination").alias("iata"), F.col("origin").alias("partner"))
    return there.union(back).distinct().groupBy("iata").agg(F.array_sort(F.collect_set("partner")).alias("partners"))


def known_routes(routes: DataFrame) -> DataFrame:
    return routes.filter("in_basket").select("route_code").orderBy("route_code")
