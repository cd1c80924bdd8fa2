"""Rolling-origin scoring of short-horizon forecasts, and the verdict on them.

Baselines are lags. The damped-trend models are linear recursions in time: blocks of a series are summed up on
their own by a small vectorised helper, put together in order, and only then followed once more, so a long series
spreads over tasks and its cost grows with its length. Everything before and after (blocks, pairing with actuals,
scores, verdicts) is relational.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricemesh import staging
from pricemesh.operators.series import ordered, seasonal_scale

# Season, smallest training window, horizons, parameter grid of the damped trend.
SEASON = 7
MIN_TRAIN = 21
HORIZONS = (1, 7)
GRID_ALPHA = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
GRID_BETA = (0.02, 0.05, 0.1, 0.2, 0.4)
GRID_PHI = (0.80, 0.90, 0.95, 0.98)
# End of fixed values.
#: Observations of a block, a whole number of seasons; series followed side by side in a task.
HALF = SEASON // 2
BLOCK = 16 * SEASON
ROWS = 256


def positions(series: DataFrame) -> DataFrame:
    return series.select("series_id", "index_date", F.col("value").cast("double").alias("value")).withColumn(
        "pos", F.row_number().over(ordered()) - 1
    )


def _naive(h: int) -> Column:
    return F.lag("value", h).over(ordered())


def _seasonal_naive(h: int) -> Column:
    origin = F.col("pos") - (h - 1)
    seasonal = F.lag("value", SEASON * ((h - 1) // SEASON + 1)).over(ordered())
    return F.when(origin < SEASON, _naive(h)).otherwise(seasonal)


def _drift(h: int) -> Column:
    first = F.first("value").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    last, origin = _naive(h), F.col("pos") - (h - 1)
    return last + F.when(origin >= 2, (last - first) / (origin - 1)).otherwise(0.0) * h


#: Baselines are lags of the series: all of them, at all horizons, come from one pass over it.
LAGS = {"naive": _naive, "seasonal_naive": _seasonal_naive, "drift": _drift}


def lag_pairs(series: DataFrame, horizons: tuple[int, ...], min_train: int, models: list[str]) -> DataFrame:
    """(predicted, actual) of the named baselines wherever the origin saw at least min_train points."""
    asked = [(m, h) for m in models for h in horizons]
    pos = positions(series).withColumns({f"p{k}": LAGS[m](h) for k, (m, h) in enumerate(asked)})
    pairs = [
        F.struct(
            F.lit(m).alias("model"), (F.col("pos") - (h - 1)).alias("origin"), F.lit(h).alias("horizon"),
            F.col(f"p{k}").alias("predicted"), F.col("value").alias("actual"),
        )
        for k, (m, h) in enumerate(asked)
    ]
    return pos.select("series_id", F.inline(F.array(*pairs))).filter(F.col("origin") >= min_train)


def _blocks(series: DataFrame) -> DataFrame:
    """(series_id, block, n, base, x, dev): each series cut into blocks of BLOCK observations, as arrays.

    x are values less the series' first one; dev, where six values came before, is how far the value three places back
    lies from the mean of the seven around it, known from this observation on.
    """
    order = ordered()
    near = order.rowsBetween(-2 * HALF, 0)
    at = positions(series).withColumns(
        {
            "base": F.first("value").over(order),
            "dev": F.when(F.col("pos") >= 2 * HALF, F.lag("value", HALF).over(order) - F.avg("value").over(near)),
        }
    )
    point = F.struct("pos", (F.col("value") - F.col("base")).alias("x"), "dev")
    packed = at.groupBy("series_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.first("base").alias("base"), F.array_sort(F.collect_list(point)).alias("p")
    )
    return packed.select("series_id", "block", "base", F.col("p.x").alias("x"), F.col("p.dev").alias("dev"))


class _Scan:
    """Damped Holt over blocks of observations, for all grid points and many series at once.

    Level and trend follow an affine map per observation, s -> A s + b x, and the one-step error is x - c s. So the state
    after a block is affine in the state before it, and the block's sum of squared errors quadratic in that: blocks are
    summed up on their own and put together in order. Weekly factors differ per origin but enter linearly: besides the
    values, the seven indicators of the weekday are followed as inputs. For factors f the state is that of the values
    less f times those of the indicators, and the sum of squares (1, -f) G (1, -f) with G the products of errors. What
    concerns the indicators alone is the same for every series.
    """

    def __init__(self, seasonal: bool):
        import numpy as np

        grid = [(a, b, p) for a in GRID_ALPHA for b in GRID_BETA for p in GRID_PHI]
        alpha, beta, self.phi = (np.array(c) for c in zip(*grid))
        self.n, self.seasonal = len(grid), seasonal
        self.a = np.array([[1 - alpha, (1 - alpha) * self.phi], [-alpha * beta, self.phi * (1 - alpha * beta)]])
        self.b = np.array([alpha, alpha * beta])
        # Over a whole block: A^BLOCK, and the sum of (c A^j)' (c A^j), the weight of the incoming state in the squares.
        power, weight = np.tile(np.eye(2)[:, :, None], self.n), np.zeros((2, 2, self.n))
        rows = np.empty((BLOCK, 2, self.n))
        for j in range(BLOCK):
            rows[j] = power[0] + self.phi * power[1]
            weight += rows[j][:, None] * rows[j][None, :]
            power = np.einsum("ikg,klg->ilg", self.a, power)
        self.power, self.weight, self.rows = power, weight, rows
        self.starts = [(np.zeros((2, SEASON, self.n)), np.zeros((SEASON, SEASON, self.n)))]

    def step(self, state, x):
        """Error of each prediction and the state after observing x; state: (2, ..., grid), x: (..., 1) or wider."""
        error = x - state[0] - self.phi * state[1]
        level = self.a[0, 0] * state[0] + self.a[0, 1] * state[1] + self.b[0] * x
        trend = self.a[1, 0] * state[0] + self.a[1, 1] * state[1] + self.b[1] * x
        return error, (level, trend)

    def weekdays(self, block: int):
        """Indicator states before `block`, their error products so far, and the errors in the block: (BLOCK, 7, grid)."""
        import numpy as np

        while True:
            k = min(block, len(self.starts) - 1)
            state, products = self.starts[k]
            state, errors = (state[0], state[1]), np.zeros((BLOCK, SEASON, self.n))
            for j in range(BLOCK):
                x = (np.arange(SEASON) == j % SEASON).astype(float)[:, None]
                if k == 0 and j == 0:  # the first two values set the state
                    state = (x + np.zeros(self.n), (np.arange(SEASON) == 1).astype(float)[:, None] - x + np.zeros(self.n))
                else:
                    errors[j], state = self.step(state, x)
            if k == block:
                return self.starts[k][0], products, errors
            total = products + np.einsum("jsg,jtg->stg", errors, errors)
            self.starts.append((np.array(state), total))

    def follow(self, block: int, x, state):
        """(place, errors, state) after every observation of the blocks x (rows, length), from the state before them;
        the first two values of a series set its state, so its first place has no error."""
        import numpy as np

        for j in range(x.shape[1]):
            error = None
            if block == 0 and j == 0:
                slope = x[:, 1:2] if x.shape[1] > 1 else np.zeros((len(x), 1))
                state = np.zeros((len(x), self.n)), np.repeat(slope, self.n, axis=1)
            else:
                error, state = self.step(state, x[:, j : j + 1])
            yield j, error, state


def _pack(arrays) -> list:
    import numpy as np

    return np.concatenate([np.ravel(a) for a in arrays]).tolist()


def _summed(seasonal: bool):
    """Helper for mapInPandas: what a full block adds, whatever the state before it.

    Numbers of a block: state after, from none; sums of errors by the incoming state's share in them; squares; products.
    """

    def run(batches: Iterable):
        import numpy as np
        import pandas as pd

        scan = _Scan(seasonal)
        slot = (np.arange(BLOCK) - HALF) % SEASON
        for batch in batches:
            for block, part in batch.groupby("block"):
                known = scan.weekdays(int(block))[2] if seasonal else None
                for first in range(0, len(part), ROWS):
                    some = part.iloc[first : first + ROWS]
                    x, dev = (np.array([list(v) for v in some[c]], float) for c in ("x", "dev"))
                    rows = len(x)
                    state = np.zeros((rows, scan.n)), np.zeros((rows, scan.n))
                    errors, squares = np.zeros((rows, 2, scan.n)), np.zeros((rows, scan.n))
                    products = np.zeros((rows, SEASON if seasonal else 0, scan.n))
                    for j, error, state in scan.follow(int(block), x, state):
                        if error is not None:
                            squares += error * error
                            errors += error[:, None] * scan.rows[j] if block else 0
                            products += error[:, None] * known[j] if seasonal else 0
                    parts = zip(state[0], state[1], errors, squares, products)
                    yield pd.DataFrame(
                        {
                            "series_id": some["series_id"].to_numpy(), "block": block, "sums": [_pack(p) for p in parts],
                            "dev_sums": [[np.nansum(d[slot == s]) for s in range(SEASON)] for d in dev],
                            "dev_counts": [[float(np.isfinite(d[slot == s]).sum()) for s in range(SEASON)] for d in dev],
                        }
                    )

    return run


def _carried(seasonal: bool):
    """Helper for applyInPandas: the numbers before every block of a series, by putting its blocks together in order."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        scan = _Scan(seasonal)
        n = scan.n
        state, squares = np.zeros((2, n)), np.zeros(n)
        products = np.zeros((SEASON, n))
        sums, counts = np.zeros(SEASON), np.zeros(SEASON)
        out = []
        for row in pdf.sort_values("block").itertuples(index=False):
            numbers = np.asarray(row.sums, float)
            after, errors, own = numbers[: 2 * n].reshape(2, n), numbers[2 * n : 4 * n].reshape(2, n), numbers[4 * n : 5 * n]
            shift = np.einsum("ig,ijg,jg->g", state, scan.weight, state)
            squares = squares + own - 2 * (errors * state).sum(axis=0) + (shift if row.block else 0)
            if seasonal:
                known = scan.weekdays(int(row.block))[2]
                cross = np.einsum("jig,jsg->isg", scan.rows, known)
                products = products + numbers[5 * n :].reshape(SEASON, n) - (np.einsum("isg,ig->sg", cross, state) if row.block else 0)
            state = after + np.einsum("ijg,jg->ig", scan.power, state)
            sums, counts = sums + np.asarray(row.dev_sums), counts + np.asarray(row.dev_counts)
            out.append((row.series_id, row.block + 1, _pack([state, squares, products]), sums.tolist(), counts.tolist()))
        return pd.DataFrame(out, columns=["series_id", "block", "before", "dev_sums", "dev_counts"])

    return run


def _forecasts(horizons: tuple[int, ...], seasonal: bool, min_train: int):
    """Helper for mapInPandas: forecasts at every origin of a block, from the numbers before it."""

    def run(batches: Iterable):
        import numpy as np
        import pandas as pd

        scan = _Scan(seasonal)
        n = scan.n
        for batch in batches:
            size = batch["x"].map(len)
            for (block, length), part in batch.groupby(["block", size]):
                for first in range(0, len(part), ROWS):
                    some = part.iloc[first : first + ROWS]
                    yield from block_rows(scan, n, int(block), int(length), some, np, pd)

    def block_rows(scan, n, block, length, some, np, pd):
        rows, index = len(some), np.arange(len(some))
        x, dev = (np.array([list(v) for v in some[c]], float) for c in ("x", "dev"))
        width = n * (3 + SEASON)
        before = np.array([np.zeros(width) if b is None else np.asarray(b, float) for b in some["before"]])
        squares, products = before[:, 2 * n : 3 * n].copy(), before[:, 3 * n :].reshape(rows, SEASON, n).copy()
        zero = [0.0] * SEASON
        sums, counts = (np.array([zero if v is None else list(v) for v in some[c]], float) for c in ("dev_sums", "dev_counts"))
        if seasonal:
            days, both, errors7 = scan.weekdays(block)
            days, both = (days[0], days[1]), both.copy()
        origins, values = [], []
        for j, error, (level, trend) in scan.follow(block, x, (before[:, :n], before[:, n : 2 * n])):
            at = block * BLOCK + j
            squares += 0 if error is None else error * error
            if seasonal:
                x7 = (np.arange(SEASON) == at % SEASON).astype(float)[:, None]
                if error is None:
                    one = (np.arange(SEASON) == 1).astype(float)[:, None]
                    days = x7 + np.zeros(n), one - x7 + np.zeros(n)
                else:
                    days = scan.step(days, x7)[1]
                    products += error[:, None] * errors7[j]
                    both += errors7[j][:, None] * errors7[j][None, :]
                fresh = np.isfinite(dev[:, j])
                sums[fresh, (at - HALF) % SEASON] += dev[fresh, j]
                counts[fresh, (at - HALF) % SEASON] += 1
            origin = at + 1
            if origin < min_train:
                continue
            total = squares
            if seasonal:
                factors = sums / np.maximum(counts, 1) if origin >= 2 * SEASON else np.zeros((rows, SEASON))
                factors = factors - factors.mean(axis=1, keepdims=True)
                outer = (factors[:, :, None] * factors[:, None, :]).reshape(rows, -1)
                total = squares - 2 * np.einsum("rs,rsg->rg", factors, products) + outer @ both.reshape(-1, n)
            best = _first_least(total, np)
            level, trend = level[index, best] + some["base"].to_numpy(float), trend[index, best]
            if seasonal:
                level = level - (factors * days[0][:, best].T).sum(axis=1)
                trend = trend - (factors * days[1][:, best].T).sum(axis=1)
            damped = scan.phi[best]
            for h in horizons:
                value = level + sum(damped**k for k in range(1, h + 1)) * trend
                values.append(value + factors[:, (origin + h - 1) % SEASON] if seasonal else value)
            origins.append(origin)
        if origins:
            yield pd.DataFrame(
                {
                    "series_id": np.tile(some["series_id"].to_numpy(), len(values)),
                    "origin": np.repeat(origins, rows * len(horizons)),
                    "horizon": np.tile(np.repeat(horizons, rows), len(origins)),
                    "predicted": np.concatenate(values),
                }
            )

    return run


def _first_least(total, np):
    """First grid point whose sum of squares is the least, but for the rounding of sums put together differently."""
    least = total.min(axis=1, keepdims=True)
    return (total <= least + 1e-11 * np.maximum(np.abs(least), 1e-12 * np.abs(total).max(axis=1, keepdims=True))).argmax(axis=1)


def _trend_model(name: str, seasonal: bool):
    def build(series: DataFrame, horizons: tuple[int, ...], min_train: int) -> DataFrame:
        blocks = staging.written(_blocks(series), "nowcast-blocks")
        # Only what is followed by another block is summed up; a series of one block needs neither sum nor carry.
        full = blocks.where(F.size("x") == BLOCK)
        sums = full.mapInPandas(
            _summed(seasonal), "series_id string, block long, sums array<double>, dev_sums array<double>, dev_counts array<double>"
        )
        before = sums.groupBy("series_id").applyInPandas(
            _carried(seasonal), "series_id string, block long, before array<double>, dev_sums array<double>, dev_counts array<double>"
        )
        made = blocks.join(before, ["series_id", "block"], "left").mapInPandas(
            _forecasts(tuple(horizons), seasonal, max(min_train, 3)), "series_id string, origin long, horizon int, predicted double"
        )
        actual = positions(series).select("series_id", "pos", F.col("value").alias("actual"))
        return (
            made.withColumn("pos", F.col("origin") + F.col("horizon") - 1)
            .join(actual, ["series_id", "pos"])
            .select("series_id", F.lit(name).alias("model"), "origin", "horizon", "predicted", "actual")
        )

    return build


# The damped-trend models by name.
TRENDS = {
    "damped_trend": _trend_model("damped_trend", False),
    "seasonal_damped_trend": _trend_model("seasonal_damped_trend", True),
}
# name -> is_baseline; the order breaks ties between equal scores.
MODELS = {**dict.fromkeys(LAGS, True), **dict.fromkeys(TRENDS, False)}


def rolling_origin(
    series: DataFrame, horizons=HORIZONS, min_train: int = MIN_TRAIN, models: list[str] | None = None
) -> DataFrame:
    """(predicted, actual) of every model at every horizon and valid origin."""
    asked = list(models or MODELS)
    lags = [m for m in asked if m in LAGS]
    parts = [lag_pairs(series, tuple(horizons), min_train, lags)] if lags else []
    parts += [TRENDS[m](series, tuple(horizons), min_train) for m in asked if m in TRENDS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def eligibility(series: DataFrame, horizons=HORIZONS, min_train: int = MIN_TRAIN) -> DataFrame:
    """Per series: length, error scale, and the reason to refuse scoring if there is one."""
    need = min_train + max(horizons) + SEASON
    return seasonal_scale(series, SEASON).withColumn(
        "refusal",
        F.when(F.col("n_observations") < need, "insufficient_history").when(F.col("scale") <= 0, "degenerate_series"),
    )


def _registry_order(model: Column) -> Column:
    out = F.lit(len(MODELS))
    for i, name in enumerate(MODELS):
        out = F.when(model == name, i).otherwise(out)
    return out


def score(pairs: DataFrame, eligible: DataFrame) -> DataFrame:
    """MAE, RMSE and MASE per series, model and horizon, for series worth scoring."""
    err = F.col("predicted") - F.col("actual")
    baselines = [m for m, is_baseline in MODELS.items() if is_baseline]
    return (
        pairs.groupBy("series_id", "model", "horizon")
        .agg(
            F.count(F.lit(1)).alias("n_forecasts"),
            F.avg(F.abs(err)).alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
        )
        .join(eligible.filter(F.col("refusal").isNull()).select("series_id", "scale"), "series_id")
        .select(
            "series_id", "model", "horizon", "n_forecasts", "mae", "rmse",
            (F.col("mae") / F.col("scale")).alias("mase"),
            F.col("model").isin(baselines).alias("is_baseline"),
        )
        .withColumn("beats_mase_unit", F.col("mase") < 1.0)
    )


def _score() -> Column:
    """The score that models are compared by; equal scores must not differ in the last bits of their sums."""
    return F.round("mase", 9).alias("mase")


def _percent(x: Column, places: int) -> Column:
    return F.concat(F.format_string(f"%.{places}f", x * 100), F.lit("%"))


def scoreboard(scores: DataFrame) -> DataFrame:
    """Scores with the best baseline at the same horizon, margin and verdict."""
    row = F.struct(_score(), _registry_order(F.col("model")).alias("o"), "model", "rmse")
    at = Window.partitionBy("series_id", "horizon")
    bar = F.min(F.when(F.col("is_baseline"), row)).over(at)
    s = scores.withColumn("bar", bar).withColumn(
        "margin", F.when(~F.col("is_baseline"), (F.col("bar.mase") - F.col("mase")) / F.nullif(F.col("bar.mase"), F.lit(0.0)))
    )
    verdict = (
        F.when(F.col("is_baseline") & (F.col("bar.model") == F.col("model")), "baseline (best)")
        .when(F.col("is_baseline"), "baseline")
        .when(F.col("bar").isNull(), "no baseline to compare")
        .when(F.col("margin") > 0.05, F.concat(F.lit("BEATS "), "bar.model", F.lit(" by "), _percent(F.col("margin"), 0)))
        .when(
            F.col("margin") > 0,
            F.concat(F.lit("ties "), "bar.model", F.lit(" (+"), _percent(F.col("margin"), 0), F.lit(", inside noise)")),
        )
        .otherwise(F.concat(F.lit("LOSES to "), "bar.model", F.lit(" by "), _percent(-F.col("margin"), 0)))
    )
    return s.select(
        *scores.columns, "margin", F.col("bar.model").alias("best_baseline"),
        (F.col("bar.model") == F.col("model")).alias("is_best_baseline"), verdict.alias("verdict"),
    )


def best_at_horizon(scores: DataFrame) -> DataFrame:
    """Best candidate and best baseline per series and horizon, registry order on ties."""
    row = F.struct(_score(), _registry_order(F.col("model")).alias("o"), "model", "rmse", "n_forecasts")
    return scores.groupBy("series_id", "horizon").agg(
        F.min(row).alias("best"),
        F.min(F.when(~F.col("is_baseline"), row)).alias("m"),
        F.min(F.when(F.col("is_baseline"), row)).alias("b"),
    )


def recommend(scores: DataFrame, eligible: DataFrame, horizons=HORIZONS) -> DataFrame:
    """One line per series: whether any model earned its place, and why not otherwise."""
    best = best_at_horizon(scores).filter(F.col("m").isNotNull() & F.col("b").isNotNull())
    margin = (F.col("b.mase") - F.col("m.mase")) / F.nullif(F.col("b.mase"), F.lit(0.0))
    wins = margin > 0.05
    tail_worse = F.col("m.rmse") > F.col("b.rmse")
    at = F.format_string("At h=%d, ", F.col("horizon"))
    f3 = lambda c: F.format_string("%.3f", F.col(c))
    claim = (
        F.when(
            wins & ~tail_worse,
            F.concat(at, "m.model", F.lit(" (MASE "), f3("m.mase"), F.lit(") beats "), "b.model", F.lit(" (MASE "),
                     f3("b.mase"), F.lit(") by "), _percent(margin, 1), F.lit(". Worth publishing.")),
        )
        .when(
            wins,
            F.concat(at, "m.model", F.lit(" (MASE "), f3("m.mase"), F.lit(") beats "), "b.model", F.lit(" (MASE "),
                     f3("b.mase"), F.lit(") by "), _percent(margin, 1), F.lit(", but its RMSE is worse: not recommended.")),
        )
        .when(
            margin > 0,
            F.concat(at, "m.model", F.lit(" edges "), "b.model", F.lit(" by only "), _percent(margin, 1),
                     F.lit(": inside the noise. Use the baseline.")),
        )
        .otherwise(F.concat(at, F.lit("no model beats "), "b.model", F.lit(". Use it and say so.")))
    )
    lines = best.select(
        "series_id",
        F.struct("horizon", claim.alias("claim")).alias("line"),
        (wins & ~tail_worse).cast("int").alias("kept"),
    )
    per = lines.groupBy("series_id").agg(
        F.sum("kept").alias("kept"), F.array_sort(F.collect_list("line")).alias("lines")
    )
    head = (
        F.when(F.col("kept") == len(horizons), "A nowcast is worth shipping.")
        .when(F.col("kept") > 0, "A nowcast is worth shipping at some horizons only.")
        .otherwise("NO NOWCAST MODEL IS RECOMMENDED. Publish the baseline instead.")
    )
    text = F.concat_ws(" ", head, F.array_join(F.transform("lines", lambda p: p["claim"]), " "))
    refused = F.when(
        F.col("refusal") == "insufficient_history",
        F.format_string("Not enough history to evaluate: %d observations. No model is recommended.", F.col("n_observations")),
    ).when(F.col("refusal").isNotNull(), "The series is constant. Nothing to nowcast.")
    return eligible.join(per, "series_id", "left").select(
        "series_id", "n_observations", "refusal", F.coalesce("kept", F.lit(0)).alias("kept"),
        F.coalesce(refused, text).alias("recommendation"),
    )


def evaluate(series: DataFrame, horizons=HORIZONS, min_train: int = MIN_TRAIN, models=None) -> DataFrame:
    """Scores of all models on all eligible series; the series is computed once and read back by every model."""
    series = staging.written(series.select("series_id", "index_date", "value"), "nowcast")
    eligible = eligibility(series, horizons, min_train)
    fit_for = series.join(eligible.filter(F.col("refusal").isNull()), "series_id", "left_semi")
    return score(rolling_origin(fit_for, horizons, min_train, models), eligible)
