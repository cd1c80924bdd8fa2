"""Identity checks, robustness runs and benchmarks over the published tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemesh import schema as S, staging
from pricemesh.operators import index as index_ops
from pricemesh.operators.metrics import correlation
from pricemesh.operators.series import percent_change


def _check(df: DataFrame, name: str, passed: Column, value: Column, tolerance: float | None, severity="error") -> DataFrame:
    return df.select(
        F.lit(name).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        value.cast("double").alias("value"),
        F.lit(tolerance).cast("double").alias("tolerance"),
        F.lit(severity).alias("severity"),
    )


def base_period(daily: DataFrame, start, end, tolerance: float = 2.0) -> DataFrame:
    """The index averages 100 over the price reference period."""
    inside = daily.filter(F.col("index_date").between(F.lit(start), F.lit(end)))
    m = inside.agg(F.avg(F.col("index_value").cast("double")).alias("m"))
    return _check(m, "base_period_is_100", F.abs(F.col("m") - 100) <= tolerance, F.col("m"), tolerance)


def period_gaps(daily: DataFrame, aggregates: DataFrame, frequency: str) -> DataFrame:
    """Published period value minus the mean of its daily values, per period."""
    means = daily.groupBy(index_ops.period_start("index_date", frequency).alias("index_date")).agg(
        F.avg(F.col("index_value").cast("double")).alias("expected")
    )
    return aggregates.join(means, "index_date").select(
        "index_date", F.abs(F.col("index_value").cast("double") - F.col("expected")).alias("gap")
    )


def temporal(daily: DataFrame, aggregates: DataFrame, frequency: str, tolerance: float = 0.0001) -> DataFrame:
    worst = period_gaps(daily, aggregates, frequency).agg(F.max("gap").alias("gap"))
    return _check(worst, f"{frequency}_equals_mean_of_daily", F.col("gap") <= tolerance, F.col("gap"), tolerance)


def contribution_gaps(daily: DataFrame, routes_daily: DataFrame) -> DataFrame:
    parts = routes_daily.groupBy("index_date").agg(F.sum(F.col("contribution").cast("double")).alias("total"))
    return daily.join(parts, "index_date").select(
        "index_date", F.abs(F.col("total") - F.col("index_value").cast("double")).alias("gap")
    )


def contributions(daily: DataFrame, routes_daily: DataFrame, tolerance: float = 0.001) -> DataFrame:
    worst = contribution_gaps(daily, routes_daily).agg(F.max("gap").alias("gap"))
    return _check(worst, "contributions_sum_to_headline", F.col("gap") <= tolerance, F.col("gap"), tolerance)


def _count_bad(rows: DataFrame, name: str, bad: Column, severity="error") -> DataFrame:
    n = rows.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))
    return _check(n, name, F.col("bad") == 0, F.col("bad"), 0.0, severity)


def coverage_reported(daily: DataFrame) -> DataFrame:
    return _count_bad(daily, "every_value_reports_coverage", ~((F.col("coverage_ratio") > 0) & (F.col("coverage_ratio") <= 1)))


def coverage_arithmetic(daily: DataFrame, total_cells: int, tolerance: float = 0.02) -> DataFrame:
    """Full basket means coverage one; a partial one must report less."""
    cov = F.col("coverage_ratio").cast("double")
    full = F.col("n_cells") >= total_cells
    bad = (full & (F.abs(cov - 1) > tolerance)) | (~full & (cov >= 1))
    return _count_bad(daily, "coverage_matches_cells", bad)


def possible_values(daily: DataFrame) -> DataFrame:
    ok = (F.col("index_value") > 0) & (F.col("coverage_ratio") > 0) & (F.col("coverage_ratio") <= 1)
    return _count_bad(daily, "no_impossible_values", ~ok)


def continuity(daily: DataFrame) -> DataFrame:
    """Gaps in the daily series; a warning, since an outage is disclosed rather than failed.

    Distinct days within the covered span, counted without ordering the series in one task.
    """
    span = daily.agg(
        (F.datediff(F.max("index_date"), F.min("index_date")) + 1 - F.count_distinct("index_date")).alias("absent")
    )
    return _check(span, "daily_series_has_no_gaps", F.col("absent") == 0, F.col("absent"), 0.0, "warning")


def checksums(rows: DataFrame, part: Column) -> DataFrame:
    """Count and two order-free sums of row hashes per part: equal for equal multisets of rows. Fixed width, so summed
    per task; small enough to be kept beside the table it describes."""
    hashed = rows.select(part.alias("part"), F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)]).alias("h"))
    return hashed.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor("h").alias("mixed")
    )


def _comparable(series: DataFrame) -> DataFrame:
    return series.select(F.col("index_date").cast("date").alias("index_date"), F.col("index_value").cast("double").alias("index_value"))


def changed_rows(first: DataFrame, second: DataFrame, kept: DataFrame | None = None) -> DataFrame | None:
    """index_date, first_value and second_value of the days on which two builds differ; None where they are equal.

    Builds are compared by the checksums of their months (`kept`: those of the first build, where they were stored), one
    scan each; only months whose sums differ are joined row by row. Days that one build lacks have a null there.
    """
    month = F.trunc("index_date", "month")
    a, b = _comparable(first), _comparable(second)
    sums = (checksums(a, month) if kept is None else kept).alias("a").join(checksums(b, month).alias("b"), "part", "full")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "total", "mixed")]
    months = staging.written(sums.filter(~(same[0] & same[1] & same[2])).select("part"), "changed-months")
    if months.isEmpty():
        return None
    a, b = (x.join(months, month == F.col("part"), "left_semi") for x in (a, b))
    joined = a.withColumnRenamed("index_value", "first_value").join(b.withColumnRenamed("index_value", "second_value"), "index_date", "full")
    return joined.filter(~F.col("first_value").eqNullSafe(F.col("second_value")))


def reproducible(first: DataFrame, second: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Two builds agree on every date and value; two empty ones do."""
    changed = changed_rows(first, second, kept)
    if changed is None:
        empty = first.sparkSession.range(1).select(F.lit(0.0).alias("d"))
        return _check(empty, "rebuild_is_reproducible", F.col("d") == 0, F.col("d"), 0.0)
    gap = F.coalesce(F.abs(F.col("first_value") - F.col("second_value")), F.lit(float("inf")))
    d = changed.agg(F.max(gap).alias("d"))
    return _check(d, "rebuild_is_reproducible", F.coalesce(F.col("d") == 0, F.lit(True)), F.coalesce("d", F.lit(0.0)), 0.0)


def sufficient_history(daily: DataFrame, required: int = 30) -> DataFrame:
    return _check(
        daily.agg(F.count(F.lit(1)).alias("n")), f"at_least_{required}_daily_observations",
        F.col("n") >= required, F.col("n"), float(required),
    )


def roll_up(checks: list[DataFrame]) -> DataFrame:
    """All check rows in one table."""
    return reduce(lambda a, b: a.unionByName(b), checks)


def summarise(checks: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if("passed").alias("n_passed"),
        F.count_if(failed & (F.col("severity") == "error")).alias("failures"),
        F.count_if(failed & (F.col("severity") == "warning")).alias("warnings"),
    ).withColumn("passed", F.col("failures") == 0)


def scenario_series(elementary: DataFrame, route_weights: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Headline per (scenario, day) under alternative window weights.

    Cells are first summed to (day, window) with route weights, so a scenario multiplies a
    table of at most one row per window and day.
    """
    rw = route_weights.select("route_id", F.col("weight").cast("double").alias("rw"))
    by_window = (
        elementary.filter(F.col("index_value").isNotNull())
        .join(rw, "route_id")
        .groupBy("index_date", "window_days")
        .agg(F.sum(F.col("rw") * F.col("index_value").cast("double")).alias("num"), F.sum("rw").alias("den"))
    )
    return (
        by_window.join(scenarios, "window_days")
        .groupBy("scenario_no", "scenario", "index_date")
        .agg((F.sum(F.col("window_weight") * F.col("num")) / F.sum(F.col("window_weight") * F.col("den"))).alias("index_value"))
    )


def window_weight_robustness(elementary: DataFrame, route_weights: DataFrame, scenarios: DataFrame) -> DataFrame:
    """What the window weights are worth: spread of each scenario and gap to the first one."""
    s = scenario_series(elementary, route_weights, scenarios)
    baseline = F.min_by("index_value", "scenario_no").over(
        Window.partitionBy("index_date").orderBy("scenario_no").rowsBetween(Window.unboundedPreceding, 0)
    )
    g = s.withColumn("gap", F.abs(F.col("index_value") - baseline))
    return g.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("index_value", "index_date").alias("first"),
        F.max_by("index_value", "index_date").alias("last"),
        F.min("index_value").alias("min"),
        F.max("index_value").alias("max"),
        F.avg("index_value").alias("mean"),
        F.max("gap").alias("max_gap_vs_baseline"),
        F.avg("gap").alias("mean_gap_vs_baseline"),
    )


def price_concept_series(concept_prices: DataFrame, base: DataFrame, weights: DataFrame) -> DataFrame:
    """Headline per (concept, day): observed cells only, no carry-forward."""
    relative = F.ln(F.col("price").cast("double") / F.col("base_price").cast("double"))
    cells = (
        concept_prices.join(base.select(*S.CARRIER_CELL, "base_price"), S.CARRIER_CELL)
        .groupBy("concept", "scrape_date", *S.CELL)
        .agg((S.INDEX_BASE * F.exp(F.avg(relative))).alias("index_value"))
        .withColumnRenamed("scrape_date", "index_date")
    )
    return index_ops.young_index(cells, weights, ["concept", "index_date"])


def price_concept_robustness(concept_prices: DataFrame, base: DataFrame, weights: DataFrame) -> DataFrame:
    return price_concept_series(concept_prices, base, weights).groupBy("concept").agg(
        F.count(F.lit(1)).alias("n"), F.avg("index_value").alias("mean"),
        F.min("index_value").alias("min"), F.max("index_value").alias("max"),
    )


def benchmark_naive(daily: DataFrame, naive: DataFrame) -> DataFrame:
    """The index against the unweighted mean fare: correlation of changes, rebased divergence."""
    p = daily.select(F.lit(1).alias("k"), "index_date", F.col("index_value").cast("double").alias("a")).join(
        naive.select(F.col("scrape_date").alias("index_date"), F.col("mean_fare").alias("b")), "index_date"
    )
    w = Window.partitionBy("k").orderBy("index_date")
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({f"c{c}": percent_change(F.col(c), F.lag(c).over(w)) for c in "ab"})
    p = p.withColumns({f"r{c}": F.col(c) / F.first(c).over(first) * 100 for c in "ab"})
    gap = F.abs(F.col("ra") - F.col("rb"))
    return p.agg(
        F.count(F.lit(1)).alias("n"),
        correlation("ca", "cb").alias("correlation_on_changes"),
        F.max(gap).alias("max_divergence_points"),
        F.avg(gap).alias("mean_divergence_points"),
        F.min("a").alias("index_min"), F.max("a").alias("index_max"),
        F.min("b").alias("naive_min"), F.max("b").alias("naive_max"),
    )
