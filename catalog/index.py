"""Prices, elementary cells, headline, periods, validation and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import add
from catalog.views import big, day, num, sql, text_list
from pricemesh import schema as S
from pricemesh.operators import fares as f
from pricemesh.operators import index as x
from pricemesh.operators import series as so
from pricemesh.operators import serving as q
from pricemesh.operators import validation as v
from pricemesh.plans.domain import MIN_BASE_OBS, PRICE_REF_END, PRICE_REF_START, Domain
from pricemesh.sources import defaults

CELL = f"{big('route_id')} AS route_id, {big('window_days')} AS window_days"

add(
    "s6_stored_quote_scan",
    lambda d: d.usable.filter(F.col("scrape_date").between("2024-01-05", "2024-01-10")).groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("quotes"), F.min("total_fare").alias("lowest")
    ),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS quotes, {num('min(total_fare)')} AS lowest FROM usable"
        " WHERE scrape_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-10' GROUP BY 1"
    ),
)
add(
    "s9_collection_dates",
    lambda d: f.scrape_dates(d.fares).orderBy("scrape_date"),
    sql(f"SELECT {day('scrape_date')} AS scrape_date FROM days ORDER BY 1"),
)
add(
    "a1_lowest_price",
    lambda d: f.daily_prices(f.price_table(d.fares)).select("scrape_date", *S.CARRIER_CELL, "price"),
    sql(f"SELECT {day('scrape_date')} AS scrape_date, {CELL}, carrier, {num('price')} AS price FROM prices"),
)
add(
    "a2_quote_counts",
    lambda d: f.quote_counts(d.prices),
    sql(f"SELECT {day('scrape_date')} AS scrape_date, {CELL}, count(*) AS n_quotes FROM usable GROUP BY ALL"),
)
add(
    "a3_geometric_mean",
    lambda d: d.prices.groupBy("route_id", "carrier").agg(
        F.exp(F.avg(F.ln(F.col("price").cast("double")))).alias("geometric_mean"), F.count(F.lit(1)).alias("n")
    ),
    sql(
        f"SELECT {big('route_id')} AS route_id, carrier, {num('exp(avg(ln(cast(price AS double))))')} AS geometric_mean,"
        " count(*) AS n FROM prices GROUP BY ALL"
    ),
)
BASE_SQL = sql(
    f"SELECT {CELL}, carrier, {num('base_price')} AS base_price, n_observations FROM base"
)
add("a4_base_prices", lambda d: d.base.select(*S.CARRIER_CELL, "base_price", "n_observations"), BASE_SQL)
add(
    "i2_build_base_prices",
    lambda d: f.base_prices(f.daily_prices(f.price_table(d.fares)), PRICE_REF_START, PRICE_REF_END, MIN_BASE_OBS).select(
        *S.CARRIER_CELL, "base_price", "n_observations"
    ),
    BASE_SQL,
)
add(
    "j1_cell_weights",
    lambda d: d.weights.join(d.prices.select(*S.CELL).distinct(), S.CELL, "left_semi"),
    sql(
        f"SELECT {CELL}, {num('route_weight')} AS route_weight, {num('cell_weight')} AS cell_weight FROM cells"
        " WHERE (route_id, window_days) IN (SELECT route_id, window_days FROM prices)"
    ),
)
add(
    "p15_basket_cell_filter",
    lambda d: d.prices.join(d.weights.select(*S.CELL), S.CELL, "left_semi").groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("basket_prices")
    ),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS basket_prices FROM prices WHERE (route_id, window_days) IN"
        " (SELECT route_id, window_days FROM cells) GROUP BY 1"
    ),
)
add(
    "j2_matched_model",
    lambda d: x.matched_prices(d.prices, d.base).select("scrape_date", *S.CARRIER_CELL, "price", "base_price"),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, {CELL}, carrier, {num('price')} AS price, {num('base_price')} AS base_price"
        " FROM prices LEFT JOIN base USING (route_id, window_days, carrier)"
    ),
)
add(
    "j3_basket_spine",
    lambda d: x.basket_spine(d.weights, d.days).join(
        d.prices.select("scrape_date", *S.CELL).distinct().withColumn("seen", F.lit(1)), ["scrape_date", *S.CELL], "left"
    ).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("cells"), F.count("seen").alias("seen")),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS cells, count(s) AS seen FROM spine LEFT JOIN"
        " (SELECT DISTINCT scrape_date, route_id, window_days, 1 AS s FROM prices) USING (scrape_date, route_id, window_days) GROUP BY 1"
    ),
)
add(
    "j4_last_known",
    lambda d: x.last_known(x.stored_elementary(d.elementary), "2024-01-20").select(*S.CELL, "index_value", "index_date"),
    sql(
        f"SELECT {CELL}, {num('arg_max(round(index_value, 4), index_date)')} AS index_value, {day('max(index_date)')} AS index_date"
        " FROM elementary WHERE index_date < DATE '2024-01-20' AND index_value IS NOT NULL GROUP BY route_id, window_days"
    ),
)
add(
    "u3_carrier_intersection",
    lambda d: d.prices.select(*S.CARRIER_CELL).distinct().join(d.base.select(*S.CARRIER_CELL), S.CARRIER_CELL),
    sql(
        f"SELECT DISTINCT {CELL}, carrier FROM prices JOIN base USING (route_id, window_days, carrier)"
    ),
)
add(
    "a5_jevons_cells",
    lambda d: x.jevons_cells(d.prices, d.base),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, {CELL}, {num('index_value')} AS index_value,"
        f" {text_list('carriers_used')} AS carriers_used, n_carriers, {big('n_quotes')} AS n_quotes FROM jevons"
    ),
)
ELEM = (
    f"{day('index_date')} AS index_date, {CELL}, {num('index_value')} AS index_value, {text_list('carriers_used')} AS carriers_used,"
    f" {big('n_carriers')} AS n_carriers, {big('n_quotes')} AS n_quotes, is_imputed, is_dropped"
)
add(
    "w1_carry_forward",
    lambda d: d.elementary.drop("imputation_note", "drop_reason"),
    sql(f"SELECT {ELEM} FROM elementary"),
)
DOCUMENTED = """
    SELECT scrape_date AS index_date, route_id, window_days, NOT seen AND prior IS NOT NULL AND k <= 2 AS is_imputed,
           NOT seen AND NOT (prior IS NOT NULL AND k <= 2) AS is_dropped FROM streaks"""
add(
    "w1_carry_forward_documented",
    lambda d: x.build_elementary(d.prices, d.base, d.weights, d.days, policy="documented")
    .groupBy("index_date").agg(F.count_if("is_imputed").alias("imputed"), F.count_if("is_dropped").alias("dropped")),
    sql(
        f"SELECT {day('index_date')} AS index_date, count(*) FILTER (is_imputed) AS imputed, count(*) FILTER (is_dropped) AS dropped"
        " FROM documented GROUP BY 1",
        documented=DOCUMENTED,
    ),
)
add(
    "w2_imputation_notes",
    lambda d: d.elementary.select("index_date", *S.CELL, "imputation_note", "drop_reason"),
    sql(f"SELECT {day('index_date')} AS index_date, {CELL}, imputation_note, drop_reason FROM elementary"),
)
add(
    "i3_build_elementary",
    lambda d: x.stored_elementary(x.build_elementary(d.prices, d.base, d.weights, d.days)).select(
        "index_date", *S.CELL, "index_value", "n_carriers", "is_imputed"
    ),
    sql(
        f"SELECT {day('index_date')} AS index_date, {CELL}, {num('round(index_value, 4)')} AS index_value, n_carriers, is_imputed"
        " FROM elementary WHERE NOT is_dropped"
    ),
)
add(
    "k5_compat_placeholders",
    lambda d: x.compat_view(x.stored_elementary(d.elementary)).select(
        "index_date", *S.CELL, "n_carriers", "n_quotes", "carriers_used", "is_imputed"
    ),
    sql(
        f"SELECT {day('index_date')} AS index_date, {CELL}, CASE WHEN is_imputed THEN 1 ELSE n_carriers END AS n_carriers,"
        f" CASE WHEN is_imputed THEN 1 ELSE {big('n_quotes')} END AS n_quotes,"
        f" CASE WHEN is_imputed THEN '-' ELSE {text_list('carriers_used')} END AS carriers_used, is_imputed FROM elementary WHERE NOT is_dropped"
    ),
)
add(
    "a6_young_headline",
    lambda d: x.young_index(d.elementary, d.weights),
    sql(f"SELECT {day('index_date')} AS index_date, {num('index_value')} AS index_value, n_cells, {num('coverage_ratio')} AS coverage_ratio FROM daily"),
)
ROUTE = (
    f"{day('index_date')} AS index_date, {big('route_id')} AS route_id, {num('index_value')} AS index_value,"
    f" {num('weight')} AS weight, {num('contribution')} AS contribution"
)
add("a7_route_index", lambda d: x.route_index(d.elementary, d.weights), sql(f"SELECT {ROUTE} FROM route_daily"))
add(
    "a8_cell_contributions",
    lambda d: x.cell_contributions(d.elementary, d.weights).select("index_date", *S.CELL, "contribution"),
    sql(
        f"SELECT {day('index_date')} AS index_date, {CELL},"
        f" {num('cell_weight * index_value / sum(cell_weight) OVER (PARTITION BY weighted.index_date)')} AS contribution FROM weighted"
    ),
)
add(
    "a9_observed_pax_share",
    lambda d: x.observed_pax_share(d.elementary, d.weights, d.shares),
    sql(f"SELECT {day('index_date')} AS index_date, {num('observed_pax_share')} AS observed_pax_share FROM daily"),
)
add(
    "a10_imputed_dropped_counts",
    lambda d: x.outcome_counts(d.elementary),
    sql(
        f"SELECT {day('index_date')} AS index_date, count(*) FILTER (is_imputed) AS imputed_cells,"
        " count(*) FILTER (is_dropped) AS dropped_cells FROM elementary GROUP BY 1"
    ),
)
HEAD = (
    f"{day('index_date')} AS index_date, frequency, {num('index_value')} AS index_value, {big('n_cells')} AS n_cells,"
    f" {num('coverage_ratio')} AS coverage_ratio, {num('observed_pax_share')} AS observed_pax_share,"
    f" {big('imputed_cells')} AS imputed_cells, {big('dropped_cells')} AS dropped_cells"
)
add(
    "i4_build_index",
    lambda d: x.daily_headline(d.elementary, d.weights, d.shares),
    sql(f"SELECT {HEAD} FROM daily"),
)
add(
    "a11_period_headline",
    lambda d: x.all_frequencies(d.daily).filter("frequency <> 'daily'"),
    sql(f"SELECT {HEAD} FROM all_freq WHERE frequency <> 'daily'"),
)
add(
    "i5_aggregate_period",
    lambda d: x.period_headline(d.daily, "weekly"),
    sql(f"SELECT {HEAD} FROM all_freq WHERE frequency = 'weekly'"),
)
add(
    "a11_period_routes",
    lambda d: x.all_route_frequencies(x.route_index(d.elementary, d.weights)),
    sql(f"SELECT frequency, {ROUTE} FROM route_rows"),
)
add(
    "w18_period_starts",
    lambda d: d.daily.select(
        "index_date", F.col("index_date").cast("date").alias("d")
    ).select("index_date", x.period_start("d", "weekly").alias("week_start"), x.period_start("d", "monthly").alias("month_start")),
    sql(
        f"SELECT {day('index_date')} AS index_date, {day("date_trunc('week', index_date)")} AS week_start,"
        f" {day("date_trunc('month', index_date)")} AS month_start FROM daily"
    ),
)
add(
    "u6_three_frequencies",
    lambda d: x.stored_index(x.all_frequencies(d.daily)),
    sql(f"SELECT {HEAD} FROM headline"),
)
add(
    "i6_full_index_build",
    lambda d: Domain(d.spark, d.path, staged=True).headline,
    sql(f"SELECT {HEAD} FROM headline"),
)
add(
    "a15_naive_mean",
    lambda d: f.naive_mean(d.fares),
    sql(f"SELECT {day('scrape_date')} AS scrape_date, {num('avg(cast(total_fare AS double))')} AS mean_fare FROM usable GROUP BY 1"),
)


def headline_series(d):
    return d.headline.filter("frequency = 'daily'").select(
        F.lit("headline").alias("series_id"), "index_date", F.col("index_value").cast("double").alias("value")
    )


add(
    "a16_headline_dispersion",
    lambda d: so.dispersion(headline_series(d)).drop("series_id"),
    sql(
        f"""
        SELECT {day('ref_month')} AS ref_month, count(*) AS n_days, {num('min(index_value)')} AS min_index,
               {num('max(index_value)')} AS max_index, {num('avg(cast(index_value AS double))')} AS mean_index,
               {num('stddev_samp(cast(index_value AS double))')} AS sd_index,
               {num('max(index_value) - min(index_value)')} AS range_index,
               {num('arg_min(index_value, abs(day(index_date) - 15) * 100 + day(index_date))')} AS sampled_on_15th
        FROM (SELECT *, date_trunc('month', index_date) AS ref_month FROM headline WHERE frequency = 'daily')
        GROUP BY 1"""
    ),
)


def last_month(d):
    return d.headline.filter("frequency = 'daily'")


add(
    "v1_base_period",
    lambda d: v.base_period(last_month(d), PRICE_REF_START, PRICE_REF_END),
    sql(
        f"SELECT 'base_period_is_100' AS check, abs(m - 100) <= 2 AS passed, {num('m')} AS value, 2.0::double AS tolerance, 'error' AS severity"
        " FROM (SELECT avg(cast(index_value AS double)) AS m FROM headline WHERE frequency = 'daily'"
        " AND index_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14')"
    ),
)
add(
    "v2_temporal_consistency",
    lambda d: v.temporal(last_month(d), d.headline.filter("frequency = 'monthly'"), "monthly", 0.0001),
    sql(
        f"SELECT 'monthly_equals_mean_of_daily' AS check, max(gap) <= 0.0001 AS passed, {num('max(gap)')} AS value, 0.0001::double AS tolerance,"
        " 'error' AS severity FROM (SELECT abs(cast(m.index_value AS double) - a.e) AS gap FROM headline m JOIN"
        " (SELECT date_trunc('month', index_date) AS p, avg(cast(index_value AS double)) AS e FROM headline WHERE frequency = 'daily' GROUP BY 1) a"
        " ON a.p = m.index_date WHERE m.frequency = 'monthly')"
    ),
)
add(
    "v3_contribution_gaps",
    lambda d: v.contribution_gaps(last_month(d), d.route_rows.filter("frequency = 'daily'")).select(
        "index_date", (F.col("gap") <= 0.001).alias("ok")
    ),
    sql(
        f"SELECT {day('index_date')} AS index_date, abs(t - cast(index_value AS double)) <= 0.001 AS ok FROM headline JOIN"
        " (SELECT index_date, sum(contribution) AS t FROM route_daily GROUP BY 1) USING (index_date) WHERE frequency = 'daily'"
    ),
)


def checks(d):
    daily = last_month(d)
    routes = d.route_rows.filter("frequency = 'daily'")
    return v.roll_up(
        [
            v.base_period(daily, PRICE_REF_START, PRICE_REF_END, 10.0),
            v.temporal(daily, d.headline.filter("frequency = 'monthly'"), "monthly", 0.0002),
            v.temporal(daily, d.headline.filter("frequency = 'weekly'"), "weekly", 0.0002),
            v.contributions(daily, routes, 0.001),
            v.coverage_reported(daily),
            v.coverage_arithmetic(daily, len(defaults.ROUTES) * len(defaults.WINDOWS)),
            v.possible_values(daily),
            v.continuity(daily),
            v.reproducible(daily, x.stored_index(x.daily_headline(d.elementary, d.weights, d.shares))),
            v.sufficient_history(daily),
        ]
    )


CHECKS = f"""
    SELECT * FROM (VALUES
        ('monthly_equals_mean_of_daily', 'error'), ('weekly_equals_mean_of_daily', 'error'), ('contributions_sum_to_headline', 'error'),
        ('rebuild_is_reproducible', 'error')) AS t("check", severity)"""
ROLL_UP = """
    SELECT 'base_period_is_100' AS "check", abs(avg(cast(index_value AS double)) - 100) <= 10 AS passed, 'error' AS severity FROM headline
    WHERE frequency = 'daily' AND index_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14'
    UNION ALL SELECT "check", true, severity FROM identities
    UNION ALL SELECT 'every_value_reports_coverage', bool_and(coverage_ratio > 0 AND coverage_ratio <= 1), 'error' FROM headline WHERE frequency = 'daily'
    UNION ALL SELECT 'coverage_matches_cells', bool_and(CASE WHEN n_cells >= 40 THEN abs(coverage_ratio - 1) <= 0.02 ELSE coverage_ratio < 1 END), 'error'
              FROM headline WHERE frequency = 'daily'
    UNION ALL SELECT 'no_impossible_values', bool_and(index_value > 0 AND coverage_ratio > 0 AND coverage_ratio <= 1), 'error' FROM headline WHERE frequency = 'daily'
    UNION ALL SELECT 'daily_series_has_no_gaps', date_diff('day', min(index_date), max(index_date)) + 1 = count(*), 'warning' FROM headline WHERE frequency = 'daily'
    UNION ALL SELECT 'at_least_30_daily_observations', count(*) >= 30, 'error' FROM headline WHERE frequency = 'daily'"""
add("v10_check_roll_up", lambda d: checks(d).select("check", "passed", "severity"), sql(ROLL_UP, identities=CHECKS))
add(
    "v10_report_summary",
    lambda d: v.summarise(checks(d)),
    sql(
        """
        SELECT count(*) AS n_checks, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed AND severity = 'error') AS failures,
               count(*) FILTER (NOT passed AND severity = 'warning') AS warnings, count(*) FILTER (NOT passed AND severity = 'error') = 0 AS passed FROM rolled""",
        identities=CHECKS, rolled=ROLL_UP,
    ),
)
for key, build, cond, sev in [
    ("v4_coverage_reported", lambda d: v.coverage_reported(last_month(d)), "NOT coalesce(coverage_ratio > 0 AND coverage_ratio <= 1, false)", ("every_value_reports_coverage", "error")),
    ("v5_coverage_arithmetic", lambda d: v.coverage_arithmetic(last_month(d), 40), "(n_cells >= 40 AND abs(coverage_ratio - 1) > 0.02) OR (n_cells < 40 AND coverage_ratio >= 1)", ("coverage_matches_cells", "error")),
    ("v6_impossible_values", lambda d: v.possible_values(last_month(d)), "NOT (index_value > 0 AND coverage_ratio > 0 AND coverage_ratio <= 1)", ("no_impossible_values", "error")),
]:
    add(key, build, sql(
        f"SELECT '{sev[0]}' AS check, count(*) FILTER ({cond}) = 0 AS passed, {num(f'count(*) FILTER ({cond})')} AS value,"
        f" 0.0::double AS tolerance, '{sev[1]}' AS severity FROM headline WHERE frequency = 'daily'"
    ))
add(
    "v7_continuity",
    lambda d: v.continuity(last_month(d)),
    sql(
        "SELECT 'daily_series_has_no_gaps' AS check, a = 0 AS passed, cast(a AS double) AS value, 0.0::double AS tolerance, 'warning' AS severity"
        " FROM (SELECT date_diff('day', min(index_date), max(index_date)) + 1 - count(*) AS a FROM headline WHERE frequency = 'daily')"
    ),
)
def rebuilt(d):
    """The daily headline built a second time, from the quotes on, without any stored table."""
    return x.stored_index(type(d)(d.spark, d.path).daily)


add(
    "v8_reproducible",
    lambda d: v.reproducible(last_month(d), rebuilt(d)),
    # The second build sums routes instead of cells; stored values agree to their last place or a rounding of it.
    sql(
        """
        SELECT 'rebuild_is_reproducible' AS check, gap < 0.0002 AS passed, CASE WHEN gap < 0.0002 THEN 0.0 ELSE gap END::double AS value,
               0.0::double AS tolerance, 'error' AS severity
        FROM (SELECT max(coalesce(abs(cast(h.index_value AS double) - r.index_value), 1e9)) AS gap
              FROM (SELECT * FROM headline WHERE frequency = 'daily') h
              FULL JOIN (SELECT index_date, round(sum(weight * index_value) / sum(weight), 4) AS index_value FROM route_daily GROUP BY 1) r USING (index_date))"""
    ),
)
add(
    "v9_sufficient_history",
    lambda d: v.sufficient_history(last_month(d)),
    sql(
        "SELECT 'at_least_30_daily_observations' AS check, count(*) >= 30 AS passed, cast(count(*) AS double) AS value,"
        " 30.0::double AS tolerance, 'error' AS severity FROM headline WHERE frequency = 'daily'"
    ),
)
SCEN = """
    SELECT scenario_no, scenario, index_date, sum(window_weight * r.weight * index_value) / sum(window_weight * r.weight) AS index_value
    FROM elementary JOIN route_weights r USING (route_id) JOIN scenarios USING (window_days)
    WHERE index_value IS NOT NULL GROUP BY ALL"""
SQL_V11 = sql(
    f"""
    SELECT scenario, count(*) AS n, {num('arg_min(index_value, index_date)')} AS first, {num('arg_max(index_value, index_date)')} AS last,
           {num('min(index_value)')} AS min, {num('max(index_value)')} AS max, {num('avg(index_value)')} AS mean,
           {num('max(gap)')} AS max_gap_vs_baseline, {num('avg(gap)')} AS mean_gap_vs_baseline
    FROM (SELECT s.*, abs(s.index_value - b.index_value) AS gap FROM scen s JOIN scen b USING (index_date) WHERE b.scenario_no = 0)
    GROUP BY 1""",
    scen=SCEN,
)
add(
    "v11_window_weight_robustness",
    lambda d: v.window_weight_robustness(d.elementary, d.route_weights, defaults.scenarios(d.spark)),
    SQL_V11,
)
add(
    "e7_weight_scenarios",
    lambda d: v.scenario_series(d.elementary, d.route_weights, defaults.scenarios(d.spark)),
    sql(f"SELECT {big('scenario_no')} AS scenario_no, scenario, {day('index_date')} AS index_date, {num('index_value')} AS index_value FROM scen", scen=SCEN),
)
CONCEPT = """
    SELECT concept, scrape_date, route_id, window_days, carrier, unnest([p1, p2, p3, p4]) AS price, unnest(['lowest', 'median', 'mean', 'highest']) AS concept2
    FROM (SELECT '' AS concept, scrape_date, route_id, window_days, carrier, min(cast(total_fare AS double)) AS p1,
                 quantile_cont(cast(total_fare AS double), 0.5) AS p2, avg(cast(total_fare AS double)) AS p3, max(cast(total_fare AS double)) AS p4
          FROM usable GROUP BY ALL)"""
CONCEPT_SERIES = """
    SELECT concept, scrape_date AS index_date, sum(cell_weight * iv) / sum(cell_weight) AS index_value
    FROM (SELECT concept2 AS concept, scrape_date, route_id, window_days, 100 * exp(avg(ln(price / cast(base_price AS double)))) AS iv
          FROM concepts JOIN base USING (route_id, window_days, carrier) GROUP BY ALL)
    JOIN cells USING (route_id, window_days) GROUP BY ALL"""
add(
    "v12_price_concept_robustness",
    lambda d: v.price_concept_robustness(f.prices_by_concept(d.fares), d.base, d.weights),
    sql(
        f"SELECT concept, count(*) AS n, {num('avg(index_value)')} AS mean, {num('min(index_value)')} AS min, {num('max(index_value)')} AS max"
        " FROM cseries GROUP BY 1",
        concepts=CONCEPT, cseries=CONCEPT_SERIES,
    ),
)
add(
    "e3_price_concepts",
    lambda d: f.prices_by_concept(d.fares).groupBy("concept").agg(
        F.count(F.lit(1)).alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest")
    ),
    sql(
        f"SELECT concept2 AS concept, count(*) AS n, {num('min(price)')} AS lowest, {num('max(price)')} AS highest FROM concepts GROUP BY 1",
        concepts=CONCEPT,
    ),
)
NAIVE = """
    SELECT scrape_date AS index_date, avg(cast(total_fare AS double)) AS b FROM usable GROUP BY 1"""
PAIR = """
    SELECT *, (a / lag(a) OVER w - 1) * 100 AS ca, (b / lag(b) OVER w - 1) * 100 AS cb,
           abs(a / first_value(a) OVER w * 100 - b / first_value(b) OVER w * 100) AS gap
    FROM (SELECT index_date, cast(index_value AS double) AS a, b FROM headline JOIN naive USING (index_date) WHERE frequency = 'daily')
    WINDOW w AS (ORDER BY index_date)"""
SQL_BENCH = sql(
    f"SELECT count(*) AS n, {num('corr(ca, cb)')} AS correlation_on_changes, {num('max(gap)')} AS max_divergence_points,"
    f" {num('avg(gap)')} AS mean_divergence_points, {num('min(a)')} AS index_min, {num('max(a)')} AS index_max,"
    f" {num('min(b)')} AS naive_min, {num('max(b)')} AS naive_max FROM paired",
    naive=NAIVE, paired=PAIR,
)
add("v13_benchmark_naive", lambda d: v.benchmark_naive(last_month(d), f.naive_mean(d.fares)), SQL_BENCH)
add(
    "j12_index_with_naive",
    lambda d: last_month(d).join(f.naive_mean(d.fares).withColumnRenamed("scrape_date", "index_date"), "index_date").select(
        "index_date", "index_value", "mean_fare"
    ),
    sql(f"SELECT {day('index_date')} AS index_date, {num('a')} AS index_value, {num('b')} AS mean_fare FROM paired", naive=NAIVE, paired=PAIR),
)
add(
    "q1_latest",
    lambda d: q.latest(d.headline).select("frequency", "index_date", "index_value", "n_cells", "change_1d", "change_30d"),
    sql(
        f"""
        SELECT frequency, {day('index_date')} AS index_date, {num('index_value')} AS index_value, {big('n_cells')} AS n_cells,
               {num('round_even((index_value / cast(p1 AS double) - 1) * 100, 4)')} AS change_1d,
               {num('round_even((index_value / cast(p30 AS double) - 1) * 100, 4)')} AS change_30d
        FROM (SELECT *, lag(index_value, 1) OVER w AS p1, lag(index_value, 30) OVER w AS p30 FROM headline WHERE frequency = 'daily'
              WINDOW w AS (ORDER BY index_date))
        ORDER BY 2 DESC LIMIT 1"""
    ),
)
add(
    "q2_series",
    lambda d: q.series(d.headline, "daily", "2024-01-05", "2024-01-25").select("index_date", "index_value", "n_cells", "coverage_ratio"),
    sql(
        f"SELECT {day('index_date')} AS index_date, {num('index_value')} AS index_value, {big('n_cells')} AS n_cells, {num('coverage_ratio')} AS coverage_ratio"
        " FROM headline WHERE frequency = 'daily' AND headline.index_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"
    ),
)
add(
    "p8_date_range_filter",
    lambda d: q.series(d.headline, "daily", start="2024-01-10", limit=15).select("index_date", "index_value"),
    sql(
        f"SELECT {day('index_date')} AS index_date, {num('index_value')} AS index_value FROM headline WHERE frequency = 'daily'"
        " AND headline.index_date >= DATE '2024-01-10' ORDER BY headline.index_date LIMIT 15"
    ),
)
add(
    "q3_route_breakdown",
    lambda d: q.route_breakdown(d.route_rows, d.headline, d.routes),
    sql(
        f"""
        SELECT {day('rr.index_date')} AS index_date, route_code, origin, destination, {num('rr.index_value')} AS index_value,
               {num('weight')} AS weight, {num('contribution')} AS contribution, {num('h.index_value')} AS headline
        FROM route_rows rr JOIN routes USING (route_id) JOIN headline h USING (index_date, frequency)
        WHERE frequency = 'daily' AND rr.index_date = (SELECT max(index_date) FROM headline WHERE frequency = 'daily')"""
    ),
)
add(
    "q4_route_series",
    lambda d: q.route_series(d.route_rows, d.routes, "blr-del"),
    sql(
        f"SELECT {day('index_date')} AS index_date, {num('index_value')} AS index_value, {num('weight')} AS weight,"
        f" {num('contribution')} AS contribution FROM route_rows JOIN routes USING (route_id)"
        " WHERE route_code = 'BLR-DEL' AND frequency = 'daily'"
    ),
)
add(
    "q5_elementary_cells",
    lambda d: q.cells(x.stored_elementary(d.elementary), d.routes, "2024-01-15").select(
        "route_code", "window_days", "index_date", "index_value", "n_carriers", "n_quotes", "carriers_used", "is_imputed"
    ),
    sql(
        f"SELECT route_code, {big('window_days')} AS window_days, {day('index_date')} AS index_date, {num('round(index_value, 4)')} AS index_value,"
        f" n_carriers, {big('n_quotes')} AS n_quotes, {text_list('carriers_used')} AS carriers_used, is_imputed"
        " FROM elementary JOIN routes USING (route_id) WHERE elementary.index_date = DATE '2024-01-15' AND NOT is_dropped"
    ),
)
add(
    "j7_rows_with_route_code",
    lambda d: d.route_rows.join(d.routes, "route_id").groupBy("route_code", "frequency").agg(F.avg("index_value").alias("mean_value")),
    sql(f"SELECT route_code, frequency, {num('avg(index_value)')} AS mean_value FROM route_rows JOIN routes USING (route_id) GROUP BY ALL"),
)
add(
    "w10_latest_per_frequency",
    lambda d: so.latest_per(d.headline.select("frequency", "index_date", "index_value"), ["frequency"]),
    sql(
        f"SELECT frequency, {day('max(index_date)')} AS index_date, {num('arg_max(index_value, index_date)')} AS index_value FROM headline GROUP BY 1"
    ),
)
add(
    "w10_previous_before",
    lambda d: so.previous_before(d.headline.select("frequency", "index_date", "index_value"), "2024-01-20", ["frequency"]),
    sql(
        f"SELECT frequency, {day('max(index_date)')} AS index_date, {num('arg_max(index_value, index_date)')} AS index_value FROM headline"
        " WHERE index_date < DATE '2024-01-20' GROUP BY 1"
    ),
)
add(
    "o2_series_ordered",
    lambda d: q.series(d.headline, "weekly").select("index_date", "index_value"),
    sql(f"SELECT {day('index_date')} AS index_date, {num('index_value')} AS index_value FROM headline WHERE frequency = 'weekly'"),
)
add(
    "o3_routes_by_weight",
    lambda d: q.newest_routes(d.route_rows).join(d.routes, "route_id")
    .orderBy(F.desc("weight")).select("route_code", "weight", "contribution"),
    sql(
        f"SELECT route_code, {num('weight')} AS weight, {num('contribution')} AS contribution FROM route_rows JOIN routes USING (route_id)"
        " WHERE frequency = 'daily' AND index_date = (SELECT max(index_date) FROM route_rows WHERE frequency = 'daily') ORDER BY route_rows.weight DESC"
    ),
)
add(
    "a28_contribution_totals",
    lambda d: d.route_rows.filter("frequency = 'daily'").groupBy("index_date").agg(F.sum("contribution").alias("total")),
    sql(f"SELECT {day('index_date')} AS index_date, {num('sum(contribution)')} AS total FROM route_daily GROUP BY 1"),
)
add(
    "a30_latest_coverage",
    lambda d: d.headline.filter("frequency = 'daily'").agg(
        F.max_by("coverage_ratio", "index_date").alias("coverage_ratio"),
        F.max_by("observed_pax_share", "index_date").alias("observed_pax_share"), F.max("index_date").alias("index_date"),
    ),
    sql(
        f"SELECT {num('arg_max(coverage_ratio, index_date)')} AS coverage_ratio, {num('arg_max(observed_pax_share, index_date)')} AS observed_pax_share,"
        f" {day('max(index_date)')} AS index_date FROM headline WHERE frequency = 'daily'"
    ),
)
