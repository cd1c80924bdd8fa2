"""Lead-time statistics, curves and fare lookups."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from catalog import add
from catalog.views import big, day, num, sql
from pricemesh.operators import elasticity as e
from pricemesh.operators import leadtime as lt
from pricemesh.operators import serving as q
from pricemesh.sources import defaults

CODES = [f"{o}-{t}" for _, o, t, _, _ in defaults.ROUTES]
SEEN = ["BLR-DEL", "BOM-DEL", "DEL-HYD", "CCU-DEL", "BLR-BOM"]


def stats(d):
    return lt.leadtime_stats(d.usable, d.routes)


def by_day(d):
    return lt.leadtime_by_day(d.usable, d.routes)


STATS = (
    f"route_code, {big('window_days')} AS window_days, n, {num('mean_fare')} AS mean_fare, {num('min_fare')} AS min_fare,"
    f" {num('median_fare')} AS median_fare"
)
add("a13_leadtime_stats", stats, sql(f"SELECT {STATS} FROM stats"))
add(
    "a13_leadtime_stats_in_range",
    lambda d: lt.leadtime_stats(d.usable, d.routes, "2024-01-08", "2024-01-21"),
    sql(
        f"SELECT {STATS} FROM ranged",
        ranged="""
        SELECT route_code, window_days, count(*) AS n,
               cast((2 * cast(sum(total_fare * 100) AS bigint) + count(*)) // (2 * count(*)) AS double) / 100 AS mean_fare,
               min(total_fare) AS min_fare, quantile_cont(cast(total_fare AS double), 0.5) AS median_fare
        FROM usable WHERE scrape_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY ALL""",
    ),
)
add("a14_leadtime_by_day", by_day, sql(f"SELECT {day('scrape_date')} AS scrape_date, {STATS} FROM stats_day"))
add(
    "a14_leadtime_by_day_large",
    lambda d: lt.fare_stats(d.quotes_large, ["origin", "destination", "window_days"]),
    sql(
        f"SELECT origin, destination, {big('window_days')} AS window_days, count(*) AS n,"
        f" {num('cast((2 * cast(sum(total_fare * 100) AS bigint) + count(*)) // (2 * count(*)) AS double) / 100')} AS mean_fare,"
        f" {num('min(total_fare)')} AS min_fare, {num('quantile_cont(cast(total_fare AS double), 0.5)')} AS median_fare FROM large GROUP BY origin, destination, window_days"
    ),
)
add(
    "x22_ratio_to_longest",
    lambda d: lt.ratio_to_longest(stats(d)).select("route_code", "window_days", "ratio_to_longest_window", "median_2dp"),
    sql(
        f"SELECT route_code, {big('window_days')} AS window_days,"
        f" {num('round_even(mean_fare / last_value(mean_fare) OVER (PARTITION BY route_code ORDER BY stats.window_days ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4)')} AS ratio_to_longest_window,"
        f" {num('round_even(cast(median_fare AS decimal(20,6)), 2)')} AS median_2dp FROM stats"
    ),
)
add(
    "x21_last_minute_premium",
    lambda d: lt.premium(stats(d)).orderBy(F.desc("ratio")),
    sql(
        f"SELECT route_code, {big('min(window_days)')} AS near_window, {big('max(window_days)')} AS far_window,"
        f" {num('arg_min(mean_fare, window_days)')} AS near_fare, {num('arg_max(mean_fare, window_days)')} AS far_fare,"
        f" {num('arg_min(mean_fare, window_days) / arg_max(mean_fare, window_days)')} AS ratio FROM stats GROUP BY 1 HAVING min(window_days) <> max(window_days)"
    ),
)
add(
    "x23_window_by_route_pivot",
    lambda d: lt.by_window(stats(d), SEEN),
    sql(
        f"SELECT {big('window_days')} AS window_days, "
        + ", ".join(f'{num(f"max(CASE WHEN route_code = {chr(39)}{c}{chr(39)} THEN mean_fare END)")} AS "{c}"' for c in SEEN)
        + " FROM stats GROUP BY 1"
    ),
)
add(
    "x24_daily_fare_lookup",
    lambda d: lt.daily_lookup(by_day(d), "BLR-DEL", 7, "mean_fare", "scrape_date"),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, {num('mean_fare')} AS mean_fare FROM stats_day WHERE route_code = 'BLR-DEL' AND window_days = 7"
    ),
)
add(
    "x24_cell_index_lookup",
    lambda d: lt.daily_lookup(q.cells(d.elementary.filter("NOT is_dropped"), d.routes), "BLR-DEL", 7, "index_value", "index_date"),
    sql(
        f"SELECT {day('index_date')} AS index_date, {num('index_value')} AS index_value FROM elementary JOIN routes USING (route_id)"
        " WHERE route_code = 'BLR-DEL' AND window_days = 7 AND NOT is_dropped"
    ),
)
add(
    "x19_index_to_money",
    lambda d: lt.index_in_money(stats(d), d.routes.join(d.route_weights, "route_id"), d.headline),
    sql(
        f"""
        SELECT route_code, {num('mean_fare')} AS typical, {num('mean_fare * (1 + (cast(m.l AS double) - 100) / 100)')} AS now,
               {num('mean_fare * (1 + (cast(m.p AS double) - 100) / 100)')} AS peak
        FROM stats, (SELECT arg_max(index_value, index_date) AS l, max(index_value) AS p FROM headline WHERE frequency = 'daily') m
        WHERE route_code = (SELECT arg_max(route_code, w.weight) FROM routes JOIN route_weights w USING (route_id)) AND window_days = 7"""
    ),
)


def latest_routes(d):
    return q.newest_routes(d.route_rows).join(d.routes.select("route_id", "route_code"), "route_id").select("route_code", "index_value", "weight")


def ranked_sectors(d):
    out = None
    for mode in lt.SORT_MODES:
        place = F.row_number().over(Window.orderBy(lt.sort_order(mode), "route_code"))  # one row per route of the basket
        top = lt.sector_list(latest_routes(d), stats(d), 7, mode).select(F.lit(mode).alias("mode"), "route_code", place.cast("bigint").alias("place"))
        out = top if out is None else out.unionByName(top)
    return out


_LIST = """
    SELECT route_code, rr.index_value, rr.weight, s.mean_fare FROM route_rows rr JOIN routes USING (route_id)
    LEFT JOIN (SELECT route_code, mean_fare FROM stats WHERE window_days = 7) s USING (route_code)
    WHERE frequency = 'daily' AND index_date = (SELECT max(index_date) FROM route_rows WHERE frequency = 'daily')"""
add(
    "o4_sector_sort_modes",
    ranked_sectors,
    sql(
        " UNION ALL ".join(
            f"SELECT '{m}' AS mode, route_code, row_number() OVER (ORDER BY {o}, route_code) AS place FROM sector_rows"
            for m, o in [
                ("weight", "weight DESC"), ("cheapest", "mean_fare ASC NULLS LAST"), ("dearest", "mean_fare DESC NULLS FIRST"),
                ("rising", "index_value DESC"), ("falling", "index_value ASC"),
            ]
        ),
        sector_rows=_LIST,
    ),
)
add(
    "o8_heat_matrix",
    lambda d: lt.heat_matrix(
        d.route_rows.filter("frequency = 'daily'").join(d.routes, "route_id").select("index_date", "route_code", "index_value"), SEEN
    ),
    sql(
        f"SELECT {day('index_date')} AS index_date, "
        + ", ".join(f'{num(f"max(CASE WHEN route_code = {chr(39)}{c}{chr(39)} THEN index_value END)")} AS "{c}"' for c in SEEN)
        + " FROM route_rows JOIN routes USING (route_id) WHERE frequency = 'daily' AND route_rows.index_date IN"
        " (SELECT DISTINCT index_date FROM route_daily ORDER BY 1 DESC LIMIT 14) GROUP BY 1"
    ),
)
add(
    "o7_cheapest_and_peak_day",
    lambda d: lt.cheapest_and_peak(
        by_day(d).select("route_code", "window_days", F.col("scrape_date").alias("index_date"), F.col("mean_fare").cast("double").alias("value")),
        ["route_code", "window_days"],
    ),
    sql(
        f"""
        SELECT route_code, {big('window_days')} AS window_days, {num('min(mean_fare)')} AS min_value,
               {day('min(CASE WHEN mean_fare = lo THEN scrape_date END)')} AS cheapest_day, {num('max(mean_fare)')} AS max_value,
               {day('min(CASE WHEN mean_fare = hi THEN scrape_date END)')} AS peak_day
        FROM (SELECT *, min(mean_fare) OVER w AS lo, max(mean_fare) OVER w AS hi FROM stats_day WINDOW w AS (PARTITION BY route_code, window_days))
        GROUP BY 1, 2"""
    ),
)
KEY = ["route_code"]
MOM = """
    SELECT route_code, cast(window_days AS double) AS w, cast(total_fare AS double) AS y, ln(cast(total_fare AS double)) AS ly FROM usable"""


def rows(d):
    return lt.with_code(d.usable, d.routes)


def fits(d):
    return e.fit_routes(rows(d), KEY)


def params(d):
    return e.parameters(fits(d), KEY)


# The same bounded least-squares problem restated on four nested tau grids over window moments.
MOMENTS = """
    SELECT route_code, w, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM obs GROUP BY ALL"""


def tau_level(grid: str) -> str:
    return f"""
    SELECT route_code, tau, any_value(l) AS l, any_value(a) AS a, sum(n) AS n, sum(ss) AS within, sum(n * (m - l * (1 + a * x)) * (m - l * (1 + a * x))) AS cost,
           sum(n * (m - l * (1 + a * x)) * x * w) AS pull
    FROM (SELECT *, exp(-w / tau) AS x,
                 CASE WHEN l0 < 1 THEN 1 WHEN s0 < 0 THEN sy / nn WHEN s0 > 20 * l0 THEN g / gg ELSE l0 END AS l,
                 CASE WHEN l0 < 1 THEN greatest(0, least(20, (sxy - sx) / sxx)) WHEN s0 < 0 THEN 0 WHEN s0 > 20 * l0 THEN 20 ELSE s0 / l0 END AS a
          FROM (SELECT *, (sy - s0 * sx) / nn AS l0 FROM (
                SELECT p.*, t.tau, t.nn, t.sy, t.sx, t.sxx, t.sxy, t.g, t.gg, (nn * sxy - sx * sy) / (nn * sxx - sx * sx) AS s0
                FROM pts p JOIN (
                    SELECT q.route_code, tau, sum(n) AS nn, sum(n * m) AS sy, sum(n * exp(-w / tau)) AS sx, sum(n * exp(-2 * w / tau)) AS sxx,
                           sum(n * m * exp(-w / tau)) AS sxy, sum(n * (1 + 20 * exp(-w / tau)) * m) AS g,
                           sum(n * (1 + 20 * exp(-w / tau)) * (1 + 20 * exp(-w / tau))) AS gg
                    FROM pts q JOIN ({grid}) k USING (route_code) GROUP BY 1, 2) t USING (route_code))))
    GROUP BY 1, 2"""


def finer(level: str, step: float) -> str:
    return (
        f"SELECT route_code, greatest(0.5, least(400, c * exp({step} * i / 100.0))) AS tau FROM"
        f" (SELECT route_code, arg_min(tau, (cost, tau)) AS c FROM {level} GROUP BY 1), range(-100, 101) t(i)"
    )


F1 = dict(obs=MOM, pts=MOMENTS)
F1["tau1"] = tau_level("SELECT DISTINCT route_code, 0.5 * exp(ln(800) * i / 400.0) AS tau FROM pts, range(401) t(i)")
F1["tau2"] = tau_level(finer("tau1", 0.034))
# Where the slope of the cost changes its sign inside a cell: tau by the straight line through the cell's ends.
F1["cell"] = tau_level(finer("tau2", 0.0034))


def crossing(level: str) -> str:
    return (
        "SELECT route_code, coalesce(max(tau) FILTER (pull > 0), min(tau)) AS lo, coalesce(min(tau) FILTER (pull <= 0), max(tau)) AS hi"
        f" FROM {level} GROUP BY 1"
    )


F1["ends"] = crossing("cell")
F1["cell2"] = tau_level("SELECT route_code, least(400, lo + (hi - lo) * i / 100.0) AS tau FROM ends, range(101) t(i) GROUP BY ALL")
F1["ends2"] = crossing("cell2")
F1["taus"] = """
    SELECT c.route_code, CASE WHEN c.a = 0 THEN c.tau WHEN u.pull > 0 AND v.pull < 0 THEN lo + (hi - lo) * u.pull / (u.pull - v.pull)
           WHEN u.pull > 0 THEN hi ELSE lo END AS tau
    FROM (SELECT route_code, arg_min(a, (cost, tau)) AS a, arg_min(tau, (cost, tau)) AS tau FROM tau2 GROUP BY 1) c
    JOIN ends2 USING (route_code) JOIN cell2 u ON u.route_code = c.route_code AND u.tau = lo JOIN cell2 v ON v.route_code = c.route_code AND v.tau = hi"""
F1["optimum"] = tau_level("SELECT route_code, tau FROM taus")
# Errors from the Jacobian there, its columns made orthogonal in the order floor, amplitude, tau.
F1["jac"] = """
    SELECT q.route_code, q.n, 1 + o.a * exp(-w / tau) AS jl, o.l * exp(-w / tau) AS ja, o.l * o.a * exp(-w / tau) * w / (tau * tau) AS jt
    FROM pts q JOIN optimum o USING (route_code)"""
F1["jac2"] = """
    SELECT route_code, n, jl, ll, pa, pt, aa, tt, ja - pa * jl AS ka, jt - pt * jl AS kt
    FROM jac JOIN (SELECT route_code, sum(n * jl * jl) AS ll, sum(n * jl * ja) / sum(n * jl * jl) AS pa, sum(n * jl * jt) / sum(n * jl * jl) AS pt,
                          sum(n * ja * ja) AS aa, sum(n * jt * jt) AS tt FROM jac GROUP BY 1) USING (route_code)"""
F1["pivots"] = """
    SELECT route_code, any_value(ll) AS ll, any_value(pa) AS pa, any_value(pt) AS pt, any_value(aa) AS aa, any_value(tt) AS tt,
           any_value(ka2) AS ka2, any_value(qt) AS qt, sum(n * (kt - qt * ka) * (kt - qt * ka)) AS kt2
    FROM jac2 JOIN (SELECT route_code, sum(n * ka * ka) AS ka2, sum(n * ka * kt) / sum(n * ka * ka) AS qt FROM jac2 GROUP BY 1) USING (route_code) GROUP BY 1"""
F1["best"] = """
    SELECT *, 1 - (within + cost) / sst AS r_squared, a - 1.959963984540054 * a_se AS a_low
    FROM (SELECT o.*, s.sst, s.windows, CASE WHEN sound THEN sqrt(s2 * (1 / ll + pa * pa / ka2 + (pt - pa * qt) * (pt - pa * qt) / kt2)) END AS l_se,
                 CASE WHEN sound THEN sqrt(s2 * (1 / ka2 + qt * qt / kt2)) END AS a_se, CASE WHEN sound THEN sqrt(s2 / kt2) END AS tau_se
          FROM (SELECT *, (within + cost) / (n - 3) AS s2 FROM optimum) o
          JOIN (SELECT *, ka2 > 0 AND kt2 > 0 AND ka2 >= 1e-14 * aa AND kt2 >= 1e-14 * tt AS sound FROM pivots) USING (route_code)
          JOIN (SELECT route_code, var_pop(y) * count(*) AS sst, count(DISTINCT w) AS windows FROM obs GROUP BY 1) s USING (route_code))"""
FITTED = "n >= 12 AND windows >= 4"
F1["warned"] = f"""
    SELECT *, array_to_string(list_filter([
        CASE WHEN n < 12 THEN 'exponential fit not identified: ' || cast(n AS bigint) || ' observations, need 12'
             WHEN windows < 4 THEN 'exponential fit not identified: ' || windows || ' distinct windows, need 4' END,
        CASE WHEN {FITTED} AND a_low <= 0 THEN 'the amplitude''s confidence interval includes zero: this route shows no statistically distinguishable last-minute premium' END,
        CASE WHEN n < 12 OR windows < 2 THEN 'log-linear fit not identified: ' || cast(n AS bigint) || ' observations, need 12' END],
        lambda x: x IS NOT NULL), '|') AS warnings FROM best"""
add(
    "f1_exponential_fit_quality",
    lambda d: params(d).filter("fitted").select("route_code", F.col("n").cast("bigint").alias("n"), "r_squared", F.round("rmse", 2).alias("rmse")),
    sql(
        f"""
        SELECT route_code, {big('max(n)')} AS n, {num('1 - min(within + cost) / max(sst)')} AS r_squared, {num('round(sqrt(min(within + cost) / max(n)), 2)')} AS rmse
        FROM optimum JOIN (SELECT route_code, var_pop(y) * count(*) AS sst FROM obs GROUP BY 1) USING (route_code)
        WHERE route_code IN (SELECT route_code FROM pts GROUP BY 1 HAVING sum(n) >= 12 AND count(*) >= 4) GROUP BY 1""",
        **F1,
    ),
)
LOGLIN = """
    SELECT route_code, count(*) AS n, regr_slope(ly, w) AS slope, regr_intercept(ly, w) AS intercept, regr_r2(ly, w) AS r2,
           sqrt((regr_syy(ly, w) - regr_slope(ly, w) * regr_sxy(ly, w)) / (count(*) - 2) / regr_sxx(ly, w)) AS se_slope,
           sqrt((regr_syy(ly, w) - regr_slope(ly, w) * regr_sxy(ly, w)) / (count(*) - 2) * (1.0 / count(*) + avg(w) * avg(w) / regr_sxx(ly, w))) AS se_intercept
    FROM obs GROUP BY 1 HAVING count(*) >= 12"""
Z95 = 1.959963984540054


def bounds(value: str, se: str, name: str) -> str:
    return f"{num(f'{value} - {Z95} * {se}')} AS {name}_ci_low, {num(f'{value} + {Z95} * {se}')} AS {name}_ci_high"


def fitted(x: str) -> str:
    return f"CASE WHEN {FITTED} THEN {x} END"


F1["loglin"] = LOGLIN
add(
    "f1_exponential_fit",
    params,
    sql(
        f"""
        SELECT route_code, fitted, n, floor, amplitude, {bounds('amplitude0', 'a_se', 'amplitude')}, decay_days, {bounds('tau0', 'tau_se', 'decay')},
               r_squared, rmse, percent_per_day, warnings
        FROM (SELECT route_code, {FITTED} AS fitted, w.n::double AS n, {num(fitted('l'))} AS floor, {num(fitted('a'))} AS amplitude, {fitted('a')} AS amplitude0,
                     {num(fitted('tau'))} AS decay_days, {fitted('tau')} AS tau0, {fitted('a_se')} AS a_se, {fitted('tau_se')} AS tau_se, {num(fitted('r_squared'))} AS r_squared,
                     {num(fitted('sqrt((within + cost) / w.n)'))} AS rmse, {num('slope * 100')} AS percent_per_day, warnings
              FROM (SELECT w.*, g.slope FROM warned w LEFT JOIN loglin g USING (route_code)) w)""",
        **F1,
    ),
)
add(
    "f2_log_linear_fit",
    lambda d: e.fit_log_linear(e.pack(e.window_moments(rows(d), KEY), KEY), KEY).select(
        "route_code", F.col("n").cast("bigint").alias("n"), F.col("slope.value").alias("slope"), F.col("slope.std_error").alias("se_slope"),
        F.col("intercept.value").alias("intercept"), F.col("intercept.std_error").alias("se_intercept"),
        F.col("r_squared").alias("r2"), "percent_per_day",
    ),
    sql(
        f"SELECT route_code, n, {num('slope')} AS slope, {num('se_slope')} AS se_slope, {num('intercept')} AS intercept,"
        f" {num('se_intercept')} AS se_intercept, {num('r2')} AS r2, {num('slope * 100')} AS percent_per_day FROM loglin",
        obs=MOM, loglin=LOGLIN,
    ),
)
add(
    "f2_log_linear_fit_large",
    lambda d: e.fit_log_linear(
        e.pack(e.window_moments(d.quotes_large, ["origin", "destination"]), ["origin", "destination"]), ["origin", "destination"]
    ).select("origin", "destination", F.col("n").cast("bigint").alias("n"), F.col("intercept.value").alias("intercept"), F.col("slope.std_error").alias("se_slope")),
    sql(
        f"SELECT origin, destination, count(*) AS n, {num('regr_intercept(ln(cast(total_fare AS double)), window_days)')} AS intercept,"
        f" {num('sqrt((regr_syy(ln(cast(total_fare AS double)), window_days) - regr_slope(ln(cast(total_fare AS double)), window_days) * regr_sxy(ln(cast(total_fare AS double)), window_days)) / (count(*) - 2) / regr_sxx(ln(cast(total_fare AS double)), window_days))')} AS se_slope"
        " FROM large GROUP BY ALL HAVING count(*) >= 12"
    ),
)
add(
    "f3_both_models_with_warnings",
    lambda d: fits(d).select("route_code", "fitted", F.col("slope.value").isNotNull().alias("log_linear"), "warnings"),
    sql(f"SELECT route_code, {FITTED} AS fitted, n >= 12 AND windows > 1 AS log_linear, warnings FROM warned", **F1),
)
# The 97.5 % point of Student's t by its expansion in the degrees of freedom.
T975 = (
    f"({Z95} + {(Z95**3 + Z95) / 4} / df + {(5 * Z95**5 + 16 * Z95**3 + 3 * Z95) / 96} / df ** 2"
    f" + {(3 * Z95**7 + 19 * Z95**5 + 17 * Z95**3 - 15 * Z95) / 384} / df ** 3"
    f" + {(79 * Z95**9 + 776 * Z95**7 + 1482 * Z95**5 - 1920 * Z95**3 - 945 * Z95) / 92160} / df ** 4)"
)
F1["estimates"] = f"""
    SELECT route_code, 'floor' AS parameter, l AS v, l_se AS se, {Z95} AS q, {FITTED} AS known FROM best
    UNION ALL SELECT route_code, 'amplitude', a, a_se, {Z95}, {FITTED} FROM best
    UNION ALL SELECT route_code, 'decay_days', tau, tau_se, {Z95}, {FITTED} FROM best
    UNION ALL SELECT b.route_code, 'slope', slope, se_slope, {T975}, slope IS NOT NULL
              FROM best b LEFT JOIN (SELECT *, n - 2.0 AS df FROM loglin) g USING (route_code)"""
add(
    "f4_estimates",
    lambda d: fits(d).select(
        "route_code", F.inline(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("e")) for n in ("floor", "amplitude", "decay_days", "slope")]))
    ).select("route_code", "parameter", "e.*"),
    sql(
        f"""
        SELECT route_code, parameter, {num('CASE WHEN known THEN v END')} AS value, {num('CASE WHEN known THEN se END')} AS std_error,
               {num('CASE WHEN known THEN v - q * se END')} AS ci_low, {num('CASE WHEN known THEN v + q * se END')} AS ci_high,
               CASE WHEN known THEN coalesce(v - q * se > 0 OR v + q * se < 0, false) END AS significant FROM estimates""",
        **F1,
    ),
)
# Parameters to the digits that a least-squares optimum carries: money to the paisa, the rest to four places.
BEST = f"{num('round(l, 2)')} AS floor, {num('a')} AS amplitude, {num('tau')} AS decay_days, {num('r_squared')} AS r_squared"
add(
    "f5_leadtime_response",
    lambda d: lt.ratio_to_longest(stats(d)).join(params(d).filter("fitted").select(
        "route_code", F.round("floor", 2).alias("floor"), "amplitude", "decay_days", "r_squared"
    ), "route_code", "left"),
    sql(
        f"""
        SELECT * FROM (SELECT {STATS}, {num('round_even(cast(median_fare AS decimal(20,6)), 2)')} AS median_2dp,
                  {num('round_even(mean_fare / last_value(mean_fare) OVER (PARTITION BY route_code ORDER BY stats.window_days ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4)')} AS ratio_to_longest_window
           FROM stats) LEFT JOIN (SELECT route_code, {BEST} FROM best WHERE {FITTED}) USING (route_code)""",
        **F1,
    ),
)
RANGED_OBS = """
    SELECT route_code, cast(window_days AS double) AS w, cast(total_fare AS double) AS y, ln(cast(total_fare AS double)) AS ly
    FROM usable WHERE route_code = 'CCU-DEL' AND scrape_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'"""
add(
    "q6_leadtime_with_fit",
    lambda d: lt.response_for_route(d.usable, d.routes, "ccu-del", "2024-01-01", "2024-01-20").select(
        "route_code", "window_days", "n", "mean_fare", "fitted", F.round("floor", 2).alias("floor"), "amplitude", "decay_days", "r_squared"
    ),
    sql(
        f"""
        SELECT p.route_code, {big('p.w')} AS window_days, p.n, {num('pm')} AS mean_fare, b.n >= 12 AND windows >= 4 AS fitted, {BEST}
        FROM (SELECT route_code, w, count(*) AS n, cast((2 * cast(sum(y * 100) AS bigint) + count(*)) // (2 * count(*)) AS double) / 100 AS pm FROM obs GROUP BY 1, 2) p
        JOIN best b USING (route_code)""",
        **{**F1, "obs": RANGED_OBS},
    ),
)
add("q6_leadtime_one_route", lambda d: lt.ratio_to_longest(lt.leadtime_stats(d.usable, d.routes.filter("route_code = 'BLR-DEL'"), "2024-01-01", "2024-01-20")).drop("median_2dp"), sql(
    f"""
    SELECT {STATS}, {num('round_even(mean_fare / last_value(mean_fare) OVER (ORDER BY ranged.window_days ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4)')} AS ratio_to_longest_window
    FROM ranged""",
    ranged="""
        SELECT route_code, window_days, count(*) AS n,
               cast((2 * cast(sum(total_fare * 100) AS bigint) + count(*)) // (2 * count(*)) AS double) / 100 AS mean_fare,
               min(total_fare) AS min_fare, quantile_cont(cast(total_fare AS double), 0.5) AS median_fare
        FROM usable WHERE route_code = 'BLR-DEL' AND scrape_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY ALL""",
))
add(
    "x17_multiplier_curve",
    lambda d: lt.fitted_curve(params(d), stats(d)).select("route_code", "window_days", F.round("fitted_fare", 2).alias("fitted_fare")),
    sql(
        f"""
        SELECT route_code, h / 2.0 AS window_days, {num('round(l * (1 + a * exp(-h / 2.0 / tau)), 2)')} AS fitted_fare
        FROM best JOIN (SELECT route_code, greatest(max(window_days), 45) AS reach FROM stats GROUP BY 1) USING (route_code), range(2, 2000) t(h)
        WHERE {FITTED} AND h <= 2 * reach""",
        **F1,
    ),
)
add(
    "j15_curve_with_observed_means",
    lambda d: lt.fitted_curve(params(d), stats(d)).select("route_code", "window_days", "observed"),
    sql(
        f"""
        SELECT r.route_code, h / 2.0 AS window_days, {num('s.mean_fare')} AS observed
        FROM (SELECT DISTINCT route_code, greatest(max(window_days) OVER (PARTITION BY route_code), 45) AS reach FROM stats) r
        CROSS JOIN range(2, 91) t(h) LEFT JOIN stats s ON s.route_code = r.route_code AND s.window_days = h / 2.0
        WHERE h <= 2 * r.reach AND r.route_code IN (SELECT route_code FROM stats GROUP BY 1 HAVING sum(n) >= 12 AND count(*) >= 4)"""
    ),
)
add(
    "a29_mean_percent_per_day",
    lambda d: params(d).filter("fitted").agg(F.avg("percent_per_day").alias("percent_per_day")),
    sql(f"SELECT {num('avg(slope * 100)')} AS percent_per_day FROM loglin", obs=MOM, loglin=LOGLIN),
)
add(
    "q13_leadtime_table",
    lambda d: stats(d).select("route_code", "window_days", "mean_fare", "n").orderBy("route_code", "window_days"),
    sql(f"SELECT route_code, {big('window_days')} AS window_days, {num('mean_fare')} AS mean_fare, n FROM stats ORDER BY ALL"),
)
