"""Outlier detectors on price histograms.

Every verdict is a function of (comparison group, price), so detectors score the histogram and
only flagged prices are joined back to rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemesh import schema as S
from pricemesh.functions.common import same_keys
from pricemesh.functions.stats import histogram, quantile_over, ranked


def mad_log(hist: DataFrame, keys: list[str], threshold: float = S.MAD_THRESHOLD) -> DataFrame:
    """Modified z-score on log fares; unassessed below five quotes or without dispersion."""
    logs = ranked(hist, keys, "total_fare").withColumn("x", F.ln(F.col("total_fare").cast("double")))
    logs = logs.withColumn("centre", quantile_over(logs, keys, F.col("x"), 0.5, "lo", "hi"))
    logs = logs.withColumn("dev", F.abs(F.col("x") - F.col("centre")))
    devs = ranked(logs, keys, "dev", "d_")
    devs = devs.withColumn("spread", quantile_over(devs, keys, F.col("dev"), 0.5, "d_lo", "d_hi"))
    assessed = (F.col("n") >= S.MIN_GROUP_FOR_DISPERSION) & (F.col("spread") > 0)
    score = F.when(assessed, S.MAD_SCALE * (F.col("x") - F.col("centre")) / F.col("spread"))
    reason = (
        F.when(
            F.col("n") < S.MIN_GROUP_FOR_DISPERSION,
            F.format_string("sample of %d below minimum 5; not assessed", F.col("n")),
        )
        .when(F.col("spread") == 0, "zero median absolute deviation; not assessed")
        .when(
            F.abs("raw_score") > threshold,
            F.concat(
                F.format_string("modified z-score %.2f exceeds ", F.col("raw_score")),
                F.lit(f"{threshold} on log fares"),
            ),
        )
        .otherwise("")
    )
    return devs.withColumn("raw_score", score).withColumn(
        "flag", F.coalesce(F.abs("raw_score") > threshold, F.lit(False))
    ).withColumn("reason", reason)


def iqr(hist: DataFrame, keys: list[str], k: float = S.IQR_K) -> DataFrame:
    """Tukey fences on the raw scale; the score counts interquartile ranges past the fence."""
    r = ranked(hist, keys, "total_fare").withColumn("x", F.col("total_fare").cast("double"))
    r = r.withColumn("q1", quantile_over(r, keys, F.col("x"), 0.25, "lo", "hi"))
    r = r.withColumn("q3", quantile_over(r, keys, F.col("x"), 0.75, "lo", "hi"))
    r = r.withColumn("spread", F.col("q3") - F.col("q1"))
    r = r.withColumn("fence_lo", F.col("q1") - k * F.col("spread"))
    r = r.withColumn("fence_hi", F.col("q3") + k * F.col("spread"))
    assessed = (F.col("n") >= S.MIN_GROUP_FOR_DISPERSION) & (F.col("spread") > 0)
    score = F.when(
        assessed,
        F.when(F.col("x") < F.col("fence_lo"), (F.col("fence_lo") - F.col("x")) / F.col("spread"))
        .when(F.col("x") > F.col("fence_hi"), (F.col("x") - F.col("fence_hi")) / F.col("spread"))
        .otherwise(0.0),
    )
    outside = assessed & ((F.col("x") < F.col("fence_lo")) | (F.col("x") > F.col("fence_hi")))
    reason = (
        F.when(
            F.col("n") < S.MIN_GROUP_FOR_DISPERSION,
            F.format_string("sample of %d below minimum; not assessed", F.col("n")),
        )
        .when(F.col("spread") == 0, "zero interquartile range; not assessed")
        .when(
            F.col("flag"),
            F.concat(
                F.format_string("outside Tukey fences [%.0f, %.0f]", F.col("fence_lo"), F.col("fence_hi")),
                F.lit(f" with k={k}"),
            ),
        )
        .otherwise("")
    )
    return r.withColumn("raw_score", score).withColumn("flag", outside).withColumn("reason", reason)


def no_detector(hist: DataFrame, keys: list[str]) -> DataFrame:
    return ranked(hist, keys, "total_fare").select(
        "*", F.lit(0.0).alias("raw_score"), F.lit(False).alias("flag"), F.lit("").alias("reason")
    )


METHODS = {"mad_log": mad_log, "iqr": iqr, "none": no_detector}


def score_histogram(priced: DataFrame, keys: list[str], method: str, **options) -> DataFrame:
    """Histogram of priced quotes per group, with the detector's score on every price."""
    if method not in METHODS:
        raise ValueError(f"unknown outlier method {method!r}; known: {sorted(METHODS)}")
    return METHODS[method](histogram(priced, keys, "total_fare"), keys, **options)


def attach_verdicts(rows: DataFrame, scored: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Carry flags back to rows by (group, price); sold-out rows were never assessed."""
    join_keys = [*keys, "total_fare"]
    hits = scored.filter("flag").select(*join_keys, F.round("raw_score", 4).alias("outlier_score"))
    joined = rows.alias("r").join(
        hits.alias("h"), same_keys("r", "h", join_keys) & ~F.col("r.is_sold_out"), "left"
    )
    hit = F.col("h.outlier_score").isNotNull()
    return joined.select(
        "r.*",
        hit.alias("is_outlier"),
        F.when(hit, F.lit(method)).alias("outlier_method"),
        F.col("h.outlier_score").alias("outlier_score"),
    )


def group_summary(scored: DataFrame, keys: list[str], method: str) -> DataFrame:
    """One row per comparison group: size, whether it was too small, flagged quotes."""
    small = F.lit(False) if method == "none" else F.max("n") < S.MIN_GROUP_FOR_DISPERSION
    return scored.groupBy(*keys).agg(
        F.max("n").alias("n"),
        small.alias("too_small"),
        F.sum(F.when(F.col("flag"), F.col("cnt")).otherwise(0)).alias("flagged"),
    )
