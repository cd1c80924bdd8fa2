"""Lead-time models fitted from sufficient statistics.

Both fits depend on fares only through count, mean and centred sum of squares per
(route, window). Those are one map-side combined aggregation over the fare rows; what remains
per route is an array of at most one element per booking window, solved with expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pricemesh.functions.common import let

# Identification limits, bounds of the decay fit, normal quantile.
MIN_OBSERVATIONS = 12
MIN_DISTINCT_WINDOWS = 4
FLOOR_MIN = 1.0
AMPLITUDE_MAX = 20.0
TAU_MIN, TAU_MAX = 0.5, 400.0
Z95 = 1.959963984540054
# End of fixed values.
GRID = 40
#: Rounds of the grid over tau, and halvings of the last cell by the sign of the slope.
ROUNDS = 2
HALVINGS = 50
#: Beyond this condition number of the Jacobian half of a double's digits are lost: no errors are given.
MAX_CONDITION = 1e7


def window_moments(usable: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean and centred sum of squares of fares and of log fares per window."""
    y = F.col("total_fare").cast("double")
    ly = F.ln(y)
    return usable.groupBy(*keys, "window_days").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(y).alias("mean"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("ss"),
        F.avg(ly).alias("lmean"),
        (F.var_pop(ly) * F.count(F.lit(1))).alias("lss"),
    )


def pack(moments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per fitted group: the array of window moments, at most 365 elements."""
    w = F.col("window_days").cast("double").alias("w")
    packed = moments.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(w, "n", "mean", "ss", "lmean", "lss"))).alias("m")
    )
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda acc, p: acc + f(p))
    return (
        packed.withColumn("n", total(lambda p: p["n"]))
        .withColumn("distinct_windows", F.size("m"))
        .withColumn("sy", total(lambda p: p["n"] * p["mean"]))
        .withColumn("within", total(lambda p: p["ss"]))
    )


def _sums(points: Column, x) -> Column:
    """Weighted sums over windows for a regressor x(point)."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "xx", "xy", "g", "gg")])
    return F.aggregate(
        points,
        zero,
        lambda s, p: F.struct(
            (s["x"] + p["n"] * x(p)).alias("x"),
            (s["xx"] + p["n"] * x(p) * x(p)).alias("xx"),
            (s["xy"] + p["n"] * x(p) * p["mean"]).alias("xy"),
            (s["g"] + p["n"] * (1 + AMPLITUDE_MAX * x(p)) * p["mean"]).alias("g"),
            (s["gg"] + p["n"] * (1 + AMPLITUDE_MAX * x(p)) * (1 + AMPLITUDE_MAX * x(p))).alias("gg"),
        ),
    )


def _solve(points: Column, n: Column, sy: Column, tau: Column) -> Column:
    """Best floor and amplitude for one tau inside the bounds, the cost between windows, and `pull`: positive where the
    cost falls as tau grows (at the best floor and amplitude, bounded or not, only tau itself moves the cost)."""
    x = lambda p: F.exp(-p["w"] / tau)

    def free(s: Column) -> Column:
        det = n * s["xx"] - s["x"] * s["x"]
        slope = F.when(det > 0, (n * s["xy"] - s["x"] * sy) / det).otherwise(0.0)
        return F.struct(
            ((sy - slope * s["x"]) / n).alias("floor"), slope.alias("slope"), s["g"].alias("g"), s["gg"].alias("gg"),
            s["xx"].alias("xx"), s["x"].alias("x"), s["xy"].alias("xy"),
        )

    def bounded(f: Column) -> Column:
        pinned = F.greatest(F.lit(0.0), F.least(F.lit(AMPLITUDE_MAX), (f["xy"] - FLOOR_MIN * f["x"]) / f["xx"]))
        floor = (
            F.when(f["floor"] < FLOOR_MIN, F.lit(FLOOR_MIN))
            .when(f["slope"] < 0, sy / n)
            .when(f["slope"] > AMPLITUDE_MAX * f["floor"], f["g"] / f["gg"])
            .otherwise(f["floor"])
        )
        amp = (
            F.when(f["floor"] < FLOOR_MIN, pinned)
            .when(f["slope"] < 0, F.lit(0.0))
            .when(f["slope"] > AMPLITUDE_MAX * f["floor"], F.lit(AMPLITUDE_MAX))
            .otherwise(f["slope"] / f["floor"])
        )
        return F.struct(floor.alias("floor"), amp.alias("amp"))

    def cost(q: Column) -> Column:
        err = lambda p: p["mean"] - q["floor"] * (1 + q["amp"] * x(p))
        c = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["n"] * err(p) * err(p))
        pull = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["n"] * err(p) * x(p) * p["w"])
        return F.struct(
            c.alias("cost"), tau.alias("tau"), q["floor"].alias("floor"), q["amp"].alias("amp"), pull.alias("pull")
        )

    return let(let(let(_sums(points, x), free), bounded), cost)


_BEST = "struct<cost:double,tau:double,floor:double,amp:double,pull:double>"


def _profile(points: Column, n: Column, sy: Column) -> Column:
    """Minimise the cost over tau: a log-spaced grid, narrowed around its best point, then halvings of that cell by the
    sign of the slope. A cost is flat at its least and fixes tau to half the digits only; its slope fixes all of them."""

    def one_round(state: Column, _: Column) -> Column:
        step = (state["hi"] - state["lo"]) / GRID
        grid = F.transform(F.sequence(F.lit(0), F.lit(GRID)), lambda i: F.exp(state["lo"] + i * step))
        best = F.array_min(F.transform(grid, lambda tau: _solve(points, n, sy, tau)))
        return let(
            best,
            lambda b: F.struct(
                F.greatest(F.ln(b["tau"]) - step, F.log(F.lit(TAU_MIN))).alias("lo"),
                F.least(F.ln(b["tau"]) + step, F.log(F.lit(TAU_MAX))).alias("hi"),
                b.alias("best"),
            ),
        )

    def halve(state: Column, _: Column) -> Column:
        middle = (state["lo"] + state["hi"]) / 2
        return let(
            _solve(points, n, sy, F.exp(middle)),
            lambda b: F.struct(
                F.when(b["pull"] > 0, middle).otherwise(state["lo"]).alias("lo"),
                F.when(b["pull"] > 0, state["hi"]).otherwise(middle).alias("hi"),
                b.alias("best"),
            ),
        )

    start = F.struct(
        F.log(F.lit(TAU_MIN)).alias("lo"), F.log(F.lit(TAU_MAX)).alias("hi"), F.lit(None).cast(_BEST).alias("best")
    )
    shape = f"struct<lo:double,hi:double,best:{_BEST}>"
    coarse = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, i: one_round(s, i).cast(shape))

    def finish(c: Column) -> Column:
        fine = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), c, lambda s, i: halve(s, i).cast(shape))
        # Without amplitude no tau differs from another: the grid's first stands.
        return F.when(c["best"]["amp"] == 0, c["best"]).otherwise(fine["best"])

    return let(coarse, finish)


def estimate(value: Column, se: Column, critical: Column | float = Z95) -> Column:
    """A parameter with its uncertainty; significant when the interval excludes zero."""
    lo, hi = value - critical * se, value + critical * se
    return F.struct(
        value.alias("value"), se.alias("std_error"), lo.alias("ci_low"), hi.alias("ci_high"),
        F.coalesce((lo > 0) | (hi < 0), F.lit(False)).alias("significant"),
    )


def fit_exponential(packed: DataFrame, keys: list[str], keep: list[str] = []) -> DataFrame:
    """fare(w) = L (1 + a exp(-w / tau)), with standard errors from the Jacobian at the optimum.

    An amplitude of zero, or columns that are one another's multiples (`condition` above MAX_CONDITION), identify no
    errors: they are null and `converged` is false.
    """
    ok = (F.col("n") >= MIN_OBSERVATIONS) & (F.col("distinct_windows") >= MIN_DISTINCT_WINDOWS)
    fit = packed.withColumn("b", F.when(ok, _profile(F.col("m"), F.col("n"), F.col("sy"))))
    L, a, tau = F.col("b.floor"), F.col("b.amp"), F.col("b.tau")
    x = lambda p: F.exp(-p["w"] / tau)
    jac = {
        "l": lambda p: 1 + a * x(p),
        "a": lambda p: L * x(p),
        "t": lambda p: L * a * x(p) * p["w"] / (tau * tau),
    }
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda acc, p: acc + p["n"] * f(p))
    # The Jacobian's columns are made orthogonal one after the other: u holds what earlier columns explain of later ones,
    # s the squares that remain, so nothing is subtracted that the determinant of their products would lose.
    own = lambda p: jac["l"](p)
    fit = fit.withColumns({f"q_{k}": total(lambda p, k=k: jac[k](p) * jac[k](p)) for k in "lat"})
    fit = fit.withColumns({f"u_l{k}": total(lambda p, k=k: own(p) * jac[k](p)) / F.col("q_l") for k in "at"})
    left = {k: (lambda p, k=k: jac[k](p) - F.col(f"u_l{k}") * own(p)) for k in "at"}
    fit = fit.withColumn("s_a", total(lambda p: left["a"](p) * left["a"](p)))
    fit = fit.withColumn("u_at", F.when(F.col("s_a") > 0, total(lambda p: left["a"](p) * left["t"](p)) / F.col("s_a")))
    last = lambda p: left["t"](p) - F.col("u_at") * left["a"](p)
    fit = fit.withColumn("s_t", total(lambda p: last(p) * last(p)))
    shares = F.least(F.col("s_a") / F.nullif(F.col("q_a"), F.lit(0.0)), F.col("s_t") / F.nullif(F.col("q_t"), F.lit(0.0)))
    fit = fit.withColumn("condition", F.when((F.col("s_a") > 0) & (F.col("s_t") > 0), 1 / F.sqrt(shares)))
    spread = {
        "l": 1 / F.col("q_l") + F.col("u_la") ** 2 / F.col("s_a")
        + (F.col("u_lt") - F.col("u_la") * F.col("u_at")) ** 2 / F.col("s_t"),
        "a": 1 / F.col("s_a") + F.col("u_at") ** 2 / F.col("s_t"),
        "t": 1 / F.col("s_t"),
    }
    mean = F.col("sy") / F.col("n")
    between = total(lambda p: (p["mean"] - mean) * (p["mean"] - mean))
    fit = (
        fit.withColumn("sse", F.col("within") + F.col("b.cost"))
        .withColumn("sst", F.col("within") + between)
        .withColumn("s2", F.col("sse") / (F.col("n") - 3))
    )
    usable = (F.col("condition") <= MAX_CONDITION) & (F.col("s2") > 0)
    se = lambda k: F.when(usable, F.sqrt(F.col("s2") * spread[k]))
    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("n") < MIN_OBSERVATIONS,
                F.format_string("exponential fit not identified: %.0f observations, need 12", F.col("n")),
            ).when(
                F.col("distinct_windows") < MIN_DISTINCT_WINDOWS,
                F.format_string(
                    "exponential fit not identified: %d distinct windows, need 4", F.col("distinct_windows")
                ),
            ),
            F.when(
                F.col("amplitude.ci_low") <= 0,
                "the amplitude's confidence interval includes zero: this route shows no statistically"
                " distinguishable last-minute premium",
            ),
        )
    )
    return (
        fit.withColumn("floor", F.when(ok, estimate(L, se("l"))))
        .withColumn("amplitude", F.when(ok, estimate(a, se("a"))))
        .withColumn("decay_days", F.when(ok, estimate(tau, se("t"))))
        .select(
            *keys, *keep, "n", "distinct_windows", ok.alias("fitted"), "floor", "amplitude", "decay_days",
            F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).otherwise(0.0).alias("r_squared"),
            F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
            F.coalesce(usable, F.lit(False)).alias("converged"), F.when(ok, F.col("condition")).alias("condition"),
            warnings.alias("warnings"),
        )
    )


def t_quantile_975(df: Column) -> Column:
    """Student-t 97.5 % point by its expansion in the degrees of freedom (ten or more here)."""
    z = Z95
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return F.lit(z) + g1 / df + g2 / df**2 + g3 / df**3 + g4 / df**4


def _with_log_linear(packed: DataFrame) -> DataFrame:
    """Add the log-linear fit to packed moments; null where it is not identified."""
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda acc, p: acc + f(p))
    enough = F.col("n") >= MIN_OBSERVATIONS
    s = packed.withColumn("wbar", F.when(enough, total(lambda p: p["n"] * p["w"]) / F.col("n")))
    s = s.withColumn("ybar", F.when(enough, total(lambda p: p["n"] * p["lmean"]) / F.col("n")))
    dw, dy = (lambda p: p["w"] - F.col("wbar")), (lambda p: p["lmean"] - F.col("ybar"))
    s = s.withColumns(
        {
            "sxx": total(lambda p: p["n"] * dw(p) * dw(p)),
            "sxy": total(lambda p: p["n"] * dw(p) * dy(p)),
            "syy": total(lambda p: p["lss"] + p["n"] * dy(p) * dy(p)),
        }
    )
    s = s.withColumn("b", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")))
    s = s.withColumns(
        {
            "a": F.col("ybar") - F.col("b") * F.col("wbar"),
            "s2": F.when(F.col("b").isNotNull(), (F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2)),
            "t": F.when(enough, t_quantile_975(F.col("n") - 2)),
        }
    )
    known = F.col("b").isNotNull()
    se_b = F.sqrt(F.col("s2") / F.col("sxx"))
    se_a = F.sqrt(F.col("s2") * (1 / F.col("n") + F.col("wbar") ** 2 / F.col("sxx")))
    return s.select(
        *packed.columns,
        F.when(known, estimate(F.col("a"), se_a, F.col("t"))).alias("intercept"),
        F.when(known, estimate(F.col("b"), se_b, F.col("t"))).alias("slope"),
        F.when(known, F.when(F.col("syy") > 0, F.col("b") * F.col("sxy") / F.col("syy")).otherwise(0.0)).alias("log_r_squared"),
        (F.col("b") * 100).alias("percent_per_day"),
    )


def fit_log_linear(packed: DataFrame, keys: list[str]) -> DataFrame:
    """ln fare on window: slope, intercept, t-intervals, R2 and percent per day."""
    return _with_log_linear(packed).filter(F.col("slope").isNotNull()).select(
        *keys, "n", "intercept", "slope", F.col("log_r_squared").alias("r_squared"), "percent_per_day"
    )


def fit_routes(usable: DataFrame, keys: list[str]) -> DataFrame:
    """Both models per route from one pass over fares, with warnings in place of a missing fit."""
    packed = pack(window_moments(usable, keys), keys)
    out = _with_log_linear(fit_exponential(packed, keys, ["m"])).drop("m")
    thin = F.when(
        F.col("slope").isNull(),
        F.array(F.format_string("log-linear fit not identified: %.0f observations, need 12", F.col("n"))),
    ).otherwise(F.array().cast("array<string>"))
    return out.withColumn("warnings", F.concat("warnings", thin))


def parameters(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Flat parameter table, the input of curve evaluation."""
    return fits.select(
        *keys, "fitted", "n",
        F.col("floor.value").alias("floor"), F.col("amplitude.value").alias("amplitude"),
        F.col("amplitude.ci_low").alias("amplitude_ci_low"), F.col("amplitude.ci_high").alias("amplitude_ci_high"),
        F.col("decay_days.value").alias("decay_days"),
        F.col("decay_days.ci_low").alias("decay_ci_low"), F.col("decay_days.ci_high").alias("decay_ci_high"),
        "r_squared", "rmse", "percent_per_day", "warnings",
    )
