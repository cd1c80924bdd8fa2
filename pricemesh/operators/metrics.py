"""Agreement scores between two aligned series.

One set of operators with explicit parameters; two presets reproduce the two published
conventions (`growth`: scores on a transform; `levels`: changes in percent, ranks on levels).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemesh.operators.series import average_ranks, percent_change


@dataclass(frozen=True)
class Preset:
    min_correlation: int
    min_any: int
    direction_tolerance: float


GROWTH = Preset(min_correlation=8, min_any=3, direction_tolerance=0.0)
LEVELS = Preset(min_correlation=6, min_any=1, direction_tolerance=0.05)

PAIR = "pair_id"


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of two (pair_id, period, value) series on the period."""
    return a.select(PAIR, "period", F.col("value").alias("a")).join(
        b.select(PAIR, "period", F.col("value").alias("b")), [PAIR, "period"]
    )


def complete_pairs(pairs: DataFrame) -> DataFrame:
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return pairs.filter(ok("a") & ok("b"))


def correlation(a: str, b: str) -> Column:
    """Pearson r, null when one side does not vary or fewer than two pairs exist."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    varies = (F.count(x) >= 2) & (F.max(x) != F.min(x)) & (F.max(y) != F.min(y))
    # Spelled out because the built-in corr fails on a constant side under ANSI arithmetic.
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(varies, F.covar_pop(x, y) / spread)


def mae(a: str = "a", b: str = "b") -> Column:
    return F.avg(F.abs(F.col(a) - F.col(b)))


def rmse(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(F.avg((F.col(a) - F.col(b)) ** 2))


def mape(a: str = "a", b: str = "b", denominator: str = "b") -> Column:
    """Mean absolute percentage error; zero denominators are left out."""
    d = F.col(denominator)
    return F.avg(F.abs((F.col(a) - F.col(b)) / F.when(d != 0, d))) * 100


def sign(x: Column, tolerance: float) -> Column:
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)


def direction_agreement(a: str = "a", b: str = "b", tolerance: float = 0.0) -> Column:
    same = sign(F.col(a), tolerance) == sign(F.col(b), tolerance)
    return F.avg(same.cast("int"))


def theil_u2(a: str = "a", b: str = "b") -> Column:
    scale = F.sqrt(F.avg(F.col(b) ** 2))
    return F.when(scale != 0, rmse(a, b) / scale)


def with_changes(pairs: DataFrame) -> DataFrame:
    """Percent changes of both sides in period order; the first row of a pair has none."""
    w = Window.partitionBy(PAIR).orderBy("period")
    return pairs.withColumns(
        {c2: percent_change(F.col(c), F.lag(c).over(w)) for c, c2 in (("a", "ca"), ("b", "cb"))}
    )


def with_transform(pairs: DataFrame, how: str) -> DataFrame:
    """Both sides under one comparison transform; differences drop the first period."""
    w = Window.partitionBy(PAIR).orderBy("period")
    first = w.rowsBetween(Window.unboundedPreceding, 0)
    if how == "level":
        return pairs
    if how == "rebased_level":
        return pairs.withColumns({c: 100.0 * F.col(c) / F.first(c).over(first) for c in "ab"})
    prev = {c: F.lag(c).over(w) for c in "ab"}
    if how == "pct_change":
        new = {c: (F.col(c) - prev[c]) / F.nullif(prev[c], F.lit(0.0)) for c in "ab"}
    elif how == "log_diff":
        new = {c: F.ln(c) - F.ln(prev[c]) for c in "ab"}
    else:
        raise ValueError(f"unknown transform {how!r}")
    return pairs.withColumns(new).withColumn("_rn", F.row_number().over(w)).filter("_rn > 1").drop("_rn")


# Reading of a correlation coefficient.
STRENGTHS = [(0.7, "strong"), (0.4, "moderate"), (0.2, "weak")]
# End of fixed values.


def read_correlation(r: Column, on_levels: bool) -> Column:
    """Strength and sign of a growth-rate correlation; levels are refused a reading."""
    if on_levels:
        return F.when(r.isNotNull(), "correlation on levels mostly measures a shared trend; read the growth rates")
    strength = F.lit("negligible")
    for bound, word in reversed(STRENGTHS):
        strength = F.when(F.abs(r) >= bound, word).otherwise(strength)
    direction = F.when(r >= 0, "positive").otherwise("negative")
    return F.when(r.isNotNull(), F.concat_ws(" ", strength, direction, F.lit("co-movement in growth rates")))


def _with_ranks(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return average_ranks(average_ranks(pairs, [PAIR], a, "ra"), [PAIR], b, "rb")


def compare_growth(pairs: DataFrame, how: str = "log_diff", preset: Preset = GROWTH) -> DataFrame:
    """All scores under one transform, long form: metric, value, n, reliable, interpretation."""
    on_levels = how in ("level", "rebased_level")
    t = _with_ranks(with_transform(pairs, how))
    w = Window.partitionBy(PAIR).orderBy("period")
    if on_levels:
        t = t.withColumns({"da": F.col("a") - F.lag("a").over(w), "db": F.col("b") - F.lag("b").over(w)})
    else:
        t = t.withColumns({"da": F.col("a"), "db": F.col("b")})
    moved = F.col("da").isNotNull() & F.col("db").isNotNull()
    agree = F.avg(F.when(moved, (sign(F.col("da"), 0.0) == sign(F.col("db"), 0.0)).cast("int")))
    n, nd = F.count(F.lit(1)), F.count(F.when(moved, 1))
    wide = t.groupBy(PAIR).agg(
        n.alias("n"),
        nd.alias("n_moves"),
        F.when(n >= preset.min_correlation, correlation("a", "b")).alias("pearson"),
        F.when(n >= preset.min_correlation, correlation("ra", "rb")).alias("spearman"),
        F.when(n >= preset.min_any, mae()).alias("mae"),
        F.when(n >= preset.min_any, rmse()).alias("rmse"),
        (F.when(n >= preset.min_any, mape()) if on_levels else F.lit(None).cast("double")).alias("mape"),
        F.when(nd >= preset.min_any, agree).alias("direction_agreement"),
        (F.lit(None).cast("double") if on_levels else F.when(n >= preset.min_any, theil_u2())).alias("theil_u2"),
    )
    long = wide.selectExpr(
        PAIR, "n", "n_moves",
        "stack(7, 'pearson', pearson, 'spearman', spearman, 'mae', mae, 'rmse', rmse, 'mape', mape,"
        " 'direction_agreement', direction_agreement, 'theil_u2', theil_u2) as (metric, value)",
    )
    used = F.when(F.col("metric") == "direction_agreement", F.col("n_moves")).otherwise(F.col("n"))
    return long.select(
        PAIR, "metric", "value", used.alias("n"),
        (F.col("value").isNotNull() & (used >= preset.min_correlation)).alias("reliable"),
        F.when(F.col("metric") == "pearson", read_correlation(F.col("value"), on_levels)).alias("interpretation"),
    )


def compare_levels(pairs: DataFrame, preset: Preset = LEVELS) -> DataFrame:
    """Scores of an index against a reference of another basis, long form."""
    p = _with_ranks(with_changes(complete_pairs(pairs)))
    first = Window.partitionBy(PAIR).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumns({f"r_{c}": F.col(c) / F.first(c).over(first) * 100 for c in "ab"})
    moved = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    tol = preset.direction_tolerance
    p = p.withColumns({"ma": F.when(moved, F.col("ca")), "mb": F.when(moved, F.col("cb"))})
    agree = F.avg(F.when(moved, (sign(F.col("ca"), tol) == sign(F.col("cb"), tol)).cast("int")))
    wide = p.groupBy(PAIR).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ma").alias("n_changes"),
        correlation("ma", "mb").alias("pearson_r_on_changes"),
        correlation("ra", "rb").alias("spearman_rho_on_levels"),
        agree.alias("direction_agreement"),
        mape("r_a", "r_b", "r_a").alias("mape_rebased"),
        rmse("r_a", "r_b").alias("rmse_rebased"),
    )
    long = wide.selectExpr(
        PAIR, "n", "n_changes",
        "stack(5, 'pearson_r_on_changes', pearson_r_on_changes, 'spearman_rho_on_levels', spearman_rho_on_levels,"
        " 'direction_agreement', direction_agreement, 'mape_rebased', mape_rebased, 'rmse_rebased', rmse_rebased)"
        " as (metric, value)",
    )
    on_changes = F.col("metric").isin("pearson_r_on_changes", "direction_agreement")
    used = F.when(on_changes, F.col("n_changes")).otherwise(F.col("n"))
    return long.select(PAIR, "metric", "value", used.alias("n"), (used >= preset.min_correlation).alias("reliable"))
