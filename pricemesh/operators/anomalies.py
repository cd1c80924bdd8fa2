"""Surge detection on a price series, its episodes and candidate explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemesh import schema as S
from pricemesh.functions.common import let

# Recurring demand windows (start month, start day, end month, label).
SEASONAL_WINDOWS = [
    (10, 15, 11, "Diwali travel period (date varies by year; verify)"),
    (12, 20, 1, "Christmas and New Year peak"),
    (3, 1, 3, "financial year end, business travel"),
    (5, 1, 6, "summer school holidays"),
]
NO_CANDIDATE = "no candidate identified; cause unknown"
# End of fixed values.


def _median(values: Column) -> Column:
    """Median of a short non-empty array; null on an empty one."""
    n = F.size(values)
    mid = F.floor(n / 2).cast("int")
    return let(
        F.array_sort(values),
        lambda s: F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2.0),
    )


def _step(state: Column, point: Column, window: int, threshold: float, min_history: int) -> Column:
    """Judge one change against the unflagged changes of the trailing window, then remember it."""
    history = F.filter(state["recent"], lambda c: c.isNotNull())
    judged = let(
        history,
        lambda h: let(
            _median(h),
            lambda med: F.struct(
                F.size(h).alias("n"),
                med.alias("med"),
                _median(F.transform(h, lambda c: F.abs(c - med))).alias("mad"),
            ),
        ),
    )

    def with_score(j: Column) -> Column:
        score = F.when(
            (j["n"] >= min_history) & (j["mad"] > 0), S.MAD_SCALE * (point["change"] - j["med"]) / j["mad"]
        )
        return F.struct(score.alias("score"), j["med"].alias("med"))

    def advance(s: Column) -> Column:
        hit = F.coalesce(F.abs(s["score"]) > threshold, F.lit(False))
        remembered = F.concat(state["recent"], F.array(F.when(hit, F.lit(None)).otherwise(point["change"])))
        flag = F.struct(
            point["index_date"].alias("index_date"),
            point["value"].alias("index_value"),
            (point["change"] * 100).alias("change_pct"),
            s["score"].alias("score"),
            F.when(point["change"] > s["med"], "spike").otherwise("drop").alias("direction"),
        )
        return F.struct(
            F.slice(remembered, F.greatest(F.size(remembered) - window + 1, F.lit(1)), window).alias("recent"),
            F.when(hit, F.concat(state["flags"], F.array(flag))).otherwise(state["flags"]).alias("flags"),
        )

    return let(let(judged, with_score), advance)


FLAGS = "array<struct<index_date:date,index_value:double,change_pct:double,score:double,direction:string>>"


def detect(series: DataFrame, window: int = 14, threshold: float = 3.5, min_history: int = 10) -> DataFrame:
    """Days whose change is extreme against their own trailing baseline.

    A flagged day leaves the baseline of later days, so a series is folded in time order. The
    fold runs in the JVM on one array per series (one element per day) and in parallel over
    series.
    """
    order = Window.partitionBy("series_id").orderBy("index_date")
    prev = F.lag("value").over(order)
    change = F.when(prev != 0, (F.col("value") - prev) / prev)
    points = series.withColumn("value", F.col("value").cast("double")).withColumn("change", change)
    per_series = points.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.struct("index_date", "value", "change"))).alias("points")
    )
    start = F.struct(
        F.array().cast("array<double>").alias("recent"), F.array().cast(FLAGS).alias("flags")
    )
    folded = F.aggregate(
        F.slice("points", F.lit(2), F.greatest(F.size("points") - 1, F.lit(0))),
        start,
        lambda acc, p: _step(acc, p, window, threshold, min_history).cast(
            f"struct<recent:array<double>,flags:{FLAGS}>"
        ),
        lambda acc: acc["flags"],
    )
    return per_series.select("series_id", F.inline(folded))


def hypotheses(date: Column) -> Column:
    """Candidate labels whose calendar window covers the date, for a person to check."""
    md = F.month(date) * 100 + F.dayofmonth(date)
    labels = []
    for m0, d0, m1, label in SEASONAL_WINDOWS:
        after, before = md >= m0 * 100 + d0, F.month(date) <= m1
        inside = (after & before) if m0 <= m1 else (after | before)
        labels.append(F.when(inside, F.lit(f"candidate: {label}")))
    found = F.array_compact(F.array(*labels))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_CANDIDATE)))


def with_episode(flags: DataFrame, max_gap_days: int = 2) -> DataFrame:
    """Number flags into episodes by closeness in time; direction plays no part."""
    order = Window.partitionBy("series_id").orderBy("index_date")
    apart = F.datediff("index_date", F.lag("index_date").over(order)) > max_gap_days
    return flags.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "episode", F.sum("_new").over(order)
    ).drop("_new")


def episodes(flags: DataFrame, max_gap_days: int = 2) -> DataFrame:
    """One row per episode: span, peak by absolute score (earliest on a tie), direction, days."""
    rank = F.struct(F.abs("score"), -F.datediff("index_date", F.lit("1970-01-01")))
    peak = F.struct("index_date", "index_value", "change_pct", "score", "direction")
    return (
        with_episode(flags, max_gap_days)
        .groupBy("series_id", "episode")
        .agg(
            F.min("index_date").alias("start"),
            F.max("index_date").alias("end"),
            F.max_by(peak, rank).alias("p"),
            F.array_sort(F.collect_list("index_date")).alias("days"),
        )
        .select(
            "series_id", "episode", "start", "end",
            F.col("p.direction").alias("direction"),
            F.col("p.index_date").alias("peak_date"),
            F.round("p.change_pct", 4).alias("peak_change_pct"),
            F.col("p.index_value").alias("peak_index_value"),
            F.round("p.score", 4).alias("score"),
            hypotheses(F.col("p.index_date")).alias("hypotheses"),
            "days",
        )
    )


def detect_and_group(series: DataFrame, window: int = 14, threshold: float = 3.5, min_history: int = 10) -> DataFrame:
    return episodes(detect(series, window, threshold, min_history))
