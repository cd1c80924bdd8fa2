"""Elementary Jevons cells, carry-forward, the Young headline and its period means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pricemesh import schema as S
from pricemesh.functions.common import add_array

MONEY4 = "decimal(12,4)"


def cell_weights(route_weights: DataFrame, windows: DataFrame) -> DataFrame:
    """Separable cell weights: every basket route spread over the basket windows."""
    packed = windows.agg(
        F.array_sort(F.collect_list(F.struct("window_days", F.col("weight").alias("window_weight")))).alias("w")
    )
    return (
        route_weights.select("route_id", F.col("weight").alias("route_weight"))
        .withColumn("w", packed.scalar())
        .select("route_id", "route_weight", F.inline("w"))
        .withColumn("cell_weight", F.col("route_weight").cast("double") * F.col("window_weight").cast("double"))
        .select("route_id", "window_days", "route_weight", "cell_weight")
    )


def matched_prices(prices: DataFrame, base: DataFrame) -> DataFrame:
    """Current prices with the base price of the same carrier cell, null where there is none."""
    return prices.join(base.select(*S.CARRIER_CELL, "base_price"), S.CARRIER_CELL, "left")


def jevons_cells(prices: DataFrame, base: DataFrame) -> DataFrame:
    """Jevons index per observed cell and day over the carriers both periods share.

    Quotes of unmatched carriers still count towards n_quotes; a cell without any matched
    carrier is not returned, so it counts as missing.
    """
    relative = F.ln(F.col("price").cast("double") / F.col("base_price").cast("double"))
    matched = F.col("base_price").isNotNull()
    return (
        matched_prices(prices, base)
        .groupBy("scrape_date", *S.CELL)
        .agg(
            (S.INDEX_BASE * F.exp(F.avg(relative))).alias("index_value"),
            F.array_sort(F.collect_set(F.when(matched, F.col("carrier")))).alias("carriers_used"),
            F.count(F.when(matched, 1)).alias("n_carriers"),
            F.sum("n_quotes").alias("n_quotes"),
        )
        .filter(F.col("n_carriers") > 0)
    )


def basket_spine(cells: DataFrame, days: DataFrame) -> DataFrame:
    """Every basket cell on every processed day."""
    return add_array(cells.select(*S.CELL), days, "scrape_date", "_days").select(
        *S.CELL, F.explode("_days").alias("scrape_date")
    )


def carried_cells(
    observed: DataFrame,
    spine: DataFrame,
    max_carry: int = S.MAX_CARRY_FORWARD,
    policy: str = "reference",
    snapshot: DataFrame | None = None,
) -> DataFrame:
    """Elementary outcome per cell and day, with the state that the next day starts from (last_value, missing_days).

    Within a run of consecutive missing days the position k decides. Under `reference` a drop
    leaves no stored row, which restarts the streak, so every (max_carry+1)-th day is dropped;
    under `documented` only the first max_carry days are filled. A calendar day that was not
    processed ends the run. Windows are per cell, so a partition holds at most one row per day.

    snapshot (index_date, cell, last_value, missing_days) is the state of a day before the first one of spine; the
    outcome is then the same as if all days up to it had been in spine as well.
    """
    if policy not in ("reference", "documented"):
        raise ValueError(f"unknown carry-forward policy {policy!r}")
    history = Window.partitionBy(*S.CELL).orderBy("scrape_date")
    before = history.rowsBetween(Window.unboundedPreceding, -1)
    joined = spine.join(observed, ["scrape_date", *S.CELL], "left")
    if snapshot is None:
        held = {"_held": F.lit(None).cast(MONEY4), "_open": F.lit(0).cast("bigint"), "_from": F.lit(None).cast("date")}
        joined = joined.withColumns(held)
    else:
        state = snapshot.select(
            *S.CELL, F.col("last_value").alias("_held"), F.col("missing_days").alias("_open"), F.col("index_date").alias("_from")
        )
        joined = joined.join(state, S.CELL, "left")
    seen = F.col("index_value").isNotNull()
    day_before = F.coalesce(F.lag("scrape_date").over(history), "_from")
    gap = F.coalesce(F.datediff("scrape_date", day_before) > 1, F.lit(False))
    runs = joined.withColumn("_seen", seen).withColumn("_break", (seen | gap).cast("int"))
    value = F.col("index_value").cast(MONEY4)
    runs = runs.withColumn("_prior", F.coalesce(F.last(value, ignorenulls=True).over(before), "_held"))
    runs = runs.withColumn("_run", F.sum("_break").over(history))
    run = Window.partitionBy(*S.CELL, "_run").orderBy("scrape_date")
    opened = F.when(F.col("_run") == 0, F.coalesce("_open", F.lit(0))).otherwise(0)
    runs = runs.withColumn("_k", F.sum((~F.col("_seen")).cast("int")).over(run) + opened)
    period = max_carry + 1
    if policy == "reference":
        streak = (F.col("_k") - 1) % period
    else:
        streak = F.col("_k") - 1
    has_prior = F.col("_prior").isNotNull()
    imputed = ~F.col("_seen") & has_prior & (streak < max_carry)
    dropped = ~F.col("_seen") & ~imputed
    note = F.when(
        imputed, F.concat(F.lit("carried forward; consecutive imputed days before this one: "), streak.cast("string"))
    )
    why = F.when(
        dropped & has_prior,
        F.concat(
            F.lit("no observations and carry-forward limit reached (streak "),
            streak.cast("string"), F.lit(f" >= {max_carry})"),
        ),
    ).when(dropped, "no observations and no prior value")
    return runs.select(
        F.col("scrape_date").alias("index_date"),
        *S.CELL,
        F.when(F.col("_seen"), F.col("index_value")).when(imputed, F.col("_prior").cast("double")).alias("index_value"),
        F.coalesce("carriers_used", F.array().cast("array<string>")).alias("carriers_used"),
        F.coalesce("n_carriers", F.lit(0)).alias("n_carriers"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        imputed.alias("is_imputed"),
        dropped.alias("is_dropped"),
        note.alias("imputation_note"),
        why.alias("drop_reason"),
        F.when(F.col("_seen"), value).otherwise(F.col("_prior")).alias("last_value"),
        F.when(F.col("_seen"), 0).otherwise(F.col("_k")).cast("bigint").alias("missing_days"),
    )


CARRY_STATE = ["last_value", "missing_days"]


def carry_forward(
    observed: DataFrame,
    spine: DataFrame,
    max_carry: int = S.MAX_CARRY_FORWARD,
    policy: str = "reference",
) -> DataFrame:
    """Fill missing cell-days from the last stored value, or drop them (see carried_cells)."""
    return carried_cells(observed, spine, max_carry, policy).drop(*CARRY_STATE)


def build_elementary(prices, base, cells, days, max_carry=S.MAX_CARRY_FORWARD, policy="reference") -> DataFrame:
    """Elementary outcome of every basket cell on every processed day."""
    return carry_forward(jevons_cells(prices, base), basket_spine(cells, days), max_carry, policy)


def continue_elementary(
    prices, base, cells, days, snapshot: DataFrame | None, max_carry=S.MAX_CARRY_FORWARD, policy="reference"
) -> DataFrame:
    """build_elementary for the days after a snapshot alone, with the carry state of every day (see carried_cells)."""
    return carried_cells(jevons_cells(prices, base), basket_spine(cells, days), max_carry, policy, snapshot)


def stored_elementary(elementary: DataFrame) -> DataFrame:
    """Rows as stored: dropped cells leave no row, values at four decimals."""
    return elementary.filter(~F.col("is_dropped")).withColumn("index_value", F.col("index_value").cast(MONEY4))


def compat_view(stored: DataFrame) -> DataFrame:
    """Stored rows with the placeholder counts older consumers expect on imputed cells."""
    imputed = F.col("is_imputed")
    return stored.withColumns(
        {
            "n_carriers": F.when(imputed, 1).otherwise(F.col("n_carriers")),
            "n_quotes": F.when(imputed, 1).otherwise(F.col("n_quotes")),
            "carriers_used": F.when(imputed, F.array(F.lit("-"))).otherwise(F.col("carriers_used")),
        }
    )


def last_known(elementary: DataFrame, before) -> DataFrame:
    """Last stored value of every cell strictly before a date."""
    past = elementary.filter(F.col("index_date") < F.lit(before))
    return past.groupBy(*S.CELL).agg(
        F.max_by("index_value", "index_date").alias("index_value"), F.max("index_date").alias("index_date")
    )


def weighted_cells(elementary: DataFrame, weights: DataFrame) -> DataFrame:
    usable = elementary.filter(F.col("index_value").isNotNull())
    return usable.join(weights, S.CELL, "inner").withColumn(
        "weighted", F.col("cell_weight") * F.col("index_value").cast("double")
    )


def total_weight(weights: DataFrame):
    return weights.agg(F.sum("cell_weight").alias("t")).scalar()


def young_index(elementary: DataFrame, weights: DataFrame, keys: list[str] = ["index_date"]) -> DataFrame:
    """Weighted mean over observed cells; coverage is the share of basket weight observed."""
    return (
        weighted_cells(elementary, weights)
        .groupBy(*keys)
        .agg(F.sum("weighted").alias("num"), F.sum("cell_weight").alias("den"), F.count(F.lit(1)).alias("n_cells"))
        .filter(F.col("den") > 0)
        .withColumn("all_weight", total_weight(weights))
        .select(
            *keys,
            (F.col("num") / F.col("den")).alias("index_value"),
            "n_cells",
            (F.col("den") / F.col("all_weight")).alias("coverage_ratio"),
        )
    )


def cell_contributions(elementary: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of each cell in the day's headline; a day's contributions add up to it."""
    day = Window.partitionBy("index_date")
    return weighted_cells(elementary, weights).select(
        "index_date", *S.CELL, "index_value", "cell_weight",
        (F.col("weighted") / F.sum("cell_weight").over(day)).alias("contribution"),
    )


def share_map(shares: DataFrame):
    """Carrier shares as one map value; bounded by the carrier register."""
    entry = F.struct("carrier", F.col("share").cast("double").alias("share"))
    return shares.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def route_days(elementary: DataFrame, weights: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Everything the headline needs, pre-aggregated to (day, route) in one pass."""
    joined = elementary.join(weights, S.CELL, "left")
    usable = F.col("index_value").isNotNull() & F.col("cell_weight").isNotNull()
    seen = F.col("index_value").isNotNull() & ~F.col("is_imputed")
    weight = F.when(usable, F.col("cell_weight"))
    out = joined.groupBy("index_date", "route_id").agg(
        F.sum(weight * F.col("index_value").cast("double")).alias("num"),
        F.sum(weight).alias("weight"),
        F.count_if(usable).alias("n_cells"),
        F.max(F.col("route_weight").cast("double")).alias("route_weight"),
        F.count_if("is_imputed").alias("imputed_cells"),
        F.count_if("is_dropped").alias("dropped_cells"),
        F.count_if(seen).alias("seen_cells"),
        F.array_distinct(F.flatten(F.collect_list(F.when(seen, F.col("carriers_used"))))).alias("carriers"),
    )
    if shares is None:
        return out.withColumn("pax_share", F.lit(None).cast("double"))
    return (
        out.withColumn("_m", share_map(shares))
        .withColumn(
            "pax_share",
            F.aggregate("carriers", F.lit(0.0), lambda acc, c: acc + F.coalesce(F.element_at("_m", c), F.lit(0.0))),
        )
        .drop("_m")
    )


def route_index(elementary: DataFrame, weights: DataFrame) -> DataFrame:
    """Young index within each route, its weight in use and its part of the headline."""
    day = Window.partitionBy("index_date")
    return route_days(elementary, weights).filter(F.col("weight") > 0).select(
        "index_date", "route_id",
        (F.col("num") / F.col("weight")).alias("index_value"),
        "weight",
        (F.col("num") / F.sum("weight").over(day)).alias("contribution"),
    )


def _pax_share(has_shares: bool):
    """Traffic share weighted over observed routes; zero on a day without any observation."""
    if not has_shares:
        return F.lit(None).cast("double")
    w = F.when(F.col("seen_cells") > 0, F.coalesce("route_weight", F.lit(0.0))).otherwise(0.0)
    return F.when(F.sum(w) > 0, F.sum(w * F.col("pax_share")) / F.sum(w)).otherwise(0.0)


def observed_pax_share(elementary: DataFrame, weights: DataFrame, shares: DataFrame | None) -> DataFrame:
    """Traffic share of the carriers observed on each route, one value per processed day.

    A national carrier share stands in for the unknown share on a route.
    """
    days = route_days(elementary, weights, shares)
    return days.groupBy("index_date").agg(_pax_share(shares is not None).alias("observed_pax_share"))


def outcome_counts(elementary: DataFrame) -> DataFrame:
    return elementary.groupBy("index_date").agg(
        F.count_if("is_imputed").alias("imputed_cells"), F.count_if("is_dropped").alias("dropped_cells")
    )


def daily_headline(elementary: DataFrame, weights: DataFrame, shares: DataFrame | None) -> DataFrame:
    """The daily index row: value, cells, coverage, traffic share, imputed and dropped cells.

    Two partial aggregations over one pass of the elementary table: cells to routes, routes
    to the day. A day without a usable cell gets no row.
    """
    return (
        route_days(elementary, weights, shares)
        .groupBy("index_date")
        .agg(
            F.sum("num").alias("num"),
            F.sum("weight").alias("den"),
            F.sum("n_cells").alias("n_cells"),
            _pax_share(shares is not None).alias("observed_pax_share"),
            F.sum("imputed_cells").alias("imputed_cells"),
            F.sum("dropped_cells").alias("dropped_cells"),
        )
        .filter(F.col("den") > 0)
        .withColumn("all_weight", total_weight(weights))
        .select(
            "index_date", F.lit("daily").alias("frequency"), (F.col("num") / F.col("den")).alias("index_value"),
            "n_cells", (F.col("den") / F.col("all_weight")).alias("coverage_ratio"),
            "observed_pax_share", "imputed_cells", "dropped_cells",
        )
    )


PERIOD_UNITS = {"weekly": "week", "monthly": "month"}


def period_start(column: str, frequency: str):
    """Monday of the week or first day of the month."""
    return F.trunc(column, PERIOD_UNITS[frequency])


def period_headline(daily: DataFrame, frequency: str) -> DataFrame:
    """Mean of the daily rows of each period; partial periods are published too."""
    return (
        daily.groupBy(period_start("index_date", frequency).alias("index_date"))
        .agg(
            F.avg("index_value").alias("index_value"),
            F.max("n_cells").alias("n_cells"),
            F.avg("coverage_ratio").alias("coverage_ratio"),
            F.avg("observed_pax_share").alias("observed_pax_share"),
            F.sum("imputed_cells").alias("imputed_cells"),
            F.sum("dropped_cells").alias("dropped_cells"),
        )
        .withColumn("frequency", F.lit(frequency))
    )


def period_routes(routes_daily: DataFrame, frequency: str) -> DataFrame:
    """Mean route value per period; weight and contribution are not defined there and read 0."""
    return (
        routes_daily.groupBy(period_start("index_date", frequency).alias("index_date"), "route_id")
        .agg(F.avg("index_value").alias("index_value"))
        .withColumns({"weight": F.lit(0.0), "contribution": F.lit(0.0), "frequency": F.lit(frequency)})
    )


def _period_keys():
    """(frequency, period start) of a daily row: itself, its week and its month."""
    keys = [F.struct(F.lit("daily").alias("frequency"), F.col("_day").alias("index_date"))]
    keys += [
        F.struct(F.lit(f).alias("frequency"), period_start("_day", f).alias("index_date")) for f in PERIOD_UNITS
    ]
    return F.inline(F.array(*keys))


def all_frequencies(daily: DataFrame) -> DataFrame:
    """Daily, weekly and monthly rows in one aggregation: every daily row feeds its three periods."""
    rows = daily.drop("frequency").withColumnRenamed("index_date", "_day")
    return rows.select("*", _period_keys()).groupBy("frequency", "index_date").agg(
        F.avg("index_value").alias("index_value"),
        F.max("n_cells").alias("n_cells"),
        F.avg("coverage_ratio").alias("coverage_ratio"),
        F.avg("observed_pax_share").alias("observed_pax_share"),
        F.sum("imputed_cells").alias("imputed_cells"),
        F.sum("dropped_cells").alias("dropped_cells"),
    )


def all_route_frequencies(routes_daily: DataFrame) -> DataFrame:
    """Route rows of all frequencies; weight and contribution exist on daily rows only."""
    rows = routes_daily.withColumnRenamed("index_date", "_day")
    only_daily = lambda c: F.sum(F.when(F.col("frequency") == "daily", F.col(c)).otherwise(0.0)).alias(c)
    return rows.select("*", _period_keys()).groupBy("frequency", "index_date", "route_id").agg(
        F.avg("index_value").alias("index_value"), only_daily("weight"), only_daily("contribution")
    )


def stored_index(headline: DataFrame) -> DataFrame:
    """Published precision of the headline table."""
    return headline.withColumns(
        {
            "index_value": F.col("index_value").cast(MONEY4),
            "n_cells": F.col("n_cells").cast("int"),
            "coverage_ratio": F.col("coverage_ratio").cast("decimal(6,4)"),
            "observed_pax_share": F.col("observed_pax_share").cast("decimal(6,4)"),
        }
    )
