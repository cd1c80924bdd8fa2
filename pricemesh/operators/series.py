"""Ordered operators over (series_id, index_date, value). Every window is per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered():
    return Window.partitionBy("series_id").orderBy("index_date")


def whole():
    return ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def percent_change(current: Column, previous: Column) -> Column:
    """Percent change, null on a missing or zero predecessor."""
    return F.when(previous != 0, (current / previous - 1) * 100)


def change_over(series: DataFrame, rows_back: int, alias: str, places: int | None = None) -> DataFrame:
    """Change against the value `rows_back` rows earlier, whatever the calendar says."""
    c = percent_change(F.col("value"), F.lag("value", rows_back).over(ordered()))
    if places is not None:
        c = F.bround(c, places)
    return series.withColumn(alias, c)


def first_to_last(series: DataFrame) -> DataFrame:
    """Change from first to last point and over the last step, as fractions."""
    last_step = Window.partitionBy("series_id").orderBy("index_date")
    stepped = series.withColumn("_prev", F.lag("value").over(last_step))
    return (
        stepped.groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("value", "index_date").alias("first"),
            F.max_by("value", "index_date").alias("last"),
            F.max_by("_prev", "index_date").alias("before_last"),
        )
        .filter(F.col("n") >= 2)
        .select(
            "series_id", "n", "first", "last",
            ((F.col("last") - F.col("first")) / F.nullif(F.col("first"), F.lit(0.0))).alias("period_change"),
            ((F.col("last") - F.col("before_last")) / F.nullif(F.col("before_last"), F.lit(0.0))).alias("last_change"),
        )
    )


def transform(series: DataFrame, how: str) -> DataFrame:
    """Comparison transforms; differences lose the first observation of each series."""
    v, prev = F.col("value"), F.lag("value").over(ordered())
    if how == "level":
        return series
    if how == "rebased_level":
        return series.withColumn("value", 100.0 * v / F.first("value").over(whole()))
    if how == "pct_change":
        return series.withColumn("value", (v - prev) / F.nullif(prev, F.lit(0.0))).filter(F.col("value").isNotNull())
    if how == "log_diff":
        return series.withColumn("value", F.ln(v) - F.ln(prev)).filter(F.col("value").isNotNull())
    raise ValueError(f"unknown transform {how!r}")


def rebase(series: DataFrame, anchor: int = 1) -> DataFrame:
    """Scale every series so that its anchor-th observation reads 100."""
    at = F.nth_value("value", anchor).over(whole())
    return series.withColumn("rebased", F.when(at != 0, F.col("value") / at * 100))


def average_ranks(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Ranks in which equal values share the mean of their positions."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(alias, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def latest_per(df: DataFrame, keys: list[str], date: str = "index_date") -> DataFrame:
    """Newest row per key, by aggregation rather than ranking."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, date).alias("_r")).select("_r.*")


def previous_before(df: DataFrame, before, keys: list[str]) -> DataFrame:
    return latest_per(df.filter(F.col("index_date") < F.lit(before)), keys)


def gaps(series: DataFrame, step_days: int = 1) -> DataFrame:
    """Pairs of neighbouring observations further apart than one step."""
    nxt = F.lead("index_date").over(ordered())
    return (
        series.withColumn("next_date", nxt)
        .withColumn("gap_days", F.datediff("next_date", "index_date"))
        .filter(F.col("gap_days") > step_days)
        .select("series_id", "index_date", "next_date", "gap_days")
    )


def monthly_mean(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id", F.trunc("index_date", "month").alias("month")).agg(F.avg("value").alias("value"))


def dispersion(series: DataFrame) -> DataFrame:
    """Spread of the daily values inside each month against one observation near the 15th."""
    near = F.struct(F.abs(F.dayofmonth("index_date") - 15), F.col("index_date"))
    return series.groupBy("series_id", F.trunc("index_date", "month").alias("ref_month")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("value").alias("min_index"),
        F.max("value").alias("max_index"),
        F.avg("value").alias("mean_index"),
        F.stddev_samp("value").alias("sd_index"),
        (F.max("value") - F.min("value")).alias("range_index"),
        F.min_by("value", near).alias("sampled_on_15th"),
    )


def blind_spot(disp: DataFrame) -> DataFrame:
    """What a mid-month visit misses of the month's peak."""
    missed = F.col("max_index") - F.col("sampled_on_15th")
    return disp.withColumn("missed", missed).withColumn(
        "missed_pct", F.when(F.col("sampled_on_15th") != 0, missed / F.col("sampled_on_15th") * 100)
    )


def worst_blind_spot(disp: DataFrame, min_days: int = 20) -> DataFrame:
    spots = blind_spot(disp).filter(F.col("n_days") >= min_days)
    first_max = F.struct(F.col("missed"), -F.datediff("ref_month", F.lit("1970-01-01")))
    return spots.groupBy("series_id").agg(
        F.max_by("ref_month", first_max).alias("ref_month"), F.max("missed").alias("missed")
    )


def weekly_factors(series: DataFrame, season: int = 7) -> DataFrame:
    """Additive factors by position modulo the season, as deviation from a centred mean."""
    half = season // 2
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    centred = F.avg("value").over(ordered().rowsBetween(-half, half))
    pos = series.withColumn("pos", F.row_number().over(ordered()) - 1).withColumn("n", n).withColumn(
        "dev", F.col("value") - centred
    )
    inside = (F.col("pos") >= half) & (F.col("pos") < F.col("n") - half) & (F.col("n") >= 2 * season)
    slots = (
        pos.groupBy("series_id", (F.col("pos") % season).alias("slot"))
        .agg(F.coalesce(F.avg(F.when(inside, F.col("dev"))), F.lit(0.0)).alias("raw"))
    )
    mean = F.avg("raw").over(Window.partitionBy("series_id"))
    return slots.select("series_id", "slot", (F.col("raw") - mean).alias("factor"))


def seasonal_scale(series: DataFrame, season: int = 7) -> DataFrame:
    """Mean absolute seasonal-naive error, the denominator of the scaled scores."""
    err = F.abs(F.col("value") - F.lag("value", season).over(ordered()))
    return series.withColumn("e", err).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_observations"), F.coalesce(F.avg("e"), F.lit(0.0)).alias("scale")
    )


def cpi_overlay(monthly: DataFrame, cpi: DataFrame, sector: str = "combined") -> DataFrame:
    """Monthly series against an official one, both 100 in their first common month."""
    ref = cpi.filter(F.col("sector") == sector).select(
        F.trunc("ref_month", "month").alias("month"), F.col("index_value").cast("double").alias("cpi")
    )
    both = monthly.join(ref, "month").withColumn("value", F.col("value").cast("double"))
    first = Window.partitionBy("series_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return both.select(
        "series_id", "month",
        (F.col("value") / F.nullif(F.first("value").over(first), F.lit(0.0)) * 100).alias("series"),
        (F.col("cpi") / F.nullif(F.first("cpi").over(first), F.lit(0.0)) * 100).alias("cpi"),
    )
