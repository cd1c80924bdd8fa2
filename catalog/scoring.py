"""Nowcasts: baselines, damped models, scores and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import add
from catalog.views import big, num, sql
from pricemesh.operators import nowcast as n

MIN_TRAIN = 14
H = (1, 7)



POS = """
    SELECT series_id, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n, first_value(value) OVER w AS v0,
           lag(value, 1) OVER w AS l1, lag(value, 7) OVER w AS l7 FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY index_date)"""
PRED = """
    SELECT series_id, 'naive' AS model, h AS horizon, pos - h + 1 AS origin, CASE h WHEN 1 THEN l1 ELSE l7 END AS predicted, value AS actual
    FROM pos0, (VALUES (1), (7)) t(h) WHERE pos - h + 1 >= 21
    UNION ALL
    SELECT series_id, 'seasonal_naive', h, pos - h + 1, l7, value FROM pos0, (VALUES (1), (7)) t(h) WHERE pos - h + 1 >= 21
    UNION ALL
    SELECT series_id, 'drift', h, pos - h + 1, (CASE h WHEN 1 THEN l1 ELSE l7 END) + ((CASE h WHEN 1 THEN l1 ELSE l7 END) - v0) / (pos - h) * h, value
    FROM pos0, (VALUES (1), (7)) t(h) WHERE pos - h + 1 >= 21"""
SCORES = """
    SELECT p.series_id, model, horizon, count(*) AS n_forecasts, avg(abs(predicted - actual)) AS mae,
           sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual)) / max(s.scale) AS mase
    FROM pred p JOIN (SELECT series_id, avg(abs(value - l7)) AS scale FROM pos0 GROUP BY 1) s USING (series_id) GROUP BY 1, 2, 3"""
V = dict(pos0=POS, pred=PRED, scores=SCORES)
BASELINES = ["naive", "seasonal_naive", "drift"]

# The damped models restated: every origin folds its own history, for every point of the grid; no block, no shared state.
HISTORY = """
    SELECT s.series_id, y, o FROM (SELECT series_id, list(value ORDER BY index_date) AS y FROM weekly GROUP BY 1) s,
           LATERAL (SELECT unnest(range(21, len(y))) AS o)"""
GRID_SQL = """
    SELECT (i * 5 + j) * 4 + k AS gi, a, b, p FROM (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.9])::double AS a, unnest(range(6)) AS i),
           (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.4])::double AS b, unnest(range(5)) AS j),
           (SELECT unnest([0.80, 0.90, 0.95, 0.98])::double AS p, unnest(range(4)) AS k)"""
SHAPE = """
    SELECT series_id, o, list(f - m ORDER BY slot) AS f
    FROM (SELECT *, avg(f) OVER (PARTITION BY series_id, o) AS m
          FROM (SELECT h.series_id, h.o, v.pos % 7 AS slot, avg(v.dev) AS f
                FROM (SELECT series_id, pos, n, value - avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS dev FROM pos0) v
                JOIN history h ON h.series_id = v.series_id AND v.pos BETWEEN 3 AND h.o - 4
                GROUP BY 1, 2, 3)) GROUP BY 1, 2"""


def damped_sql(shape: str) -> str:
    """Forecasts of the best grid point (first of equals) at every origin; shape: seven factors of an origin."""
    pred = "(z.l + p * z.t)"
    new = f"(a * x.v + (1 - a) * {pred})"
    return f"""
        SELECT series_id, o AS origin, h AS horizon, y[o + h] AS actual,
               r.l + list_sum(list_transform(range(1, h + 1), lambda k: pow(p, k))) * r.t + f[(o + h - 1) % 7 + 1] AS predicted
        FROM (SELECT *, row_number() OVER (PARTITION BY series_id, o ORDER BY r.s, gi) AS place
              FROM (SELECT series_id, o, y, f, gi, p, list_reduce(
                        list_concat([{{'l': y[1] - f[1], 't': (y[2] - f[2]) - (y[1] - f[1]), 's': 0::double, 'v': 0::double}}],
                                    list_transform(range(1, o), lambda i: {{'l': 0::double, 't': 0::double, 's': 0::double, 'v': y[i + 1] - f[i % 7 + 1]}})),
                        lambda z, x: {{'l': {new}, 't': b * ({new} - z.l) + (1 - b) * p * z.t, 's': z.s + (x.v - {pred}) * (x.v - {pred}), 'v': x.v}}) AS r
                    FROM ({shape}) CROSS JOIN grid)),
             (VALUES (1), (7)) t(h)
        WHERE place = 1 AND o + h - 1 < len(y)"""


V |= dict(
    history=HISTORY, grid=GRID_SQL, shape=SHAPE,
    damped=damped_sql("SELECT *, [0, 0, 0, 0, 0, 0, 0]::double[] AS f FROM history"),
    seasonal_damped=damped_sql("SELECT h.*, f FROM history h JOIN shape USING (series_id, o)"),
)
V["allpred"] = """
    SELECT series_id, model, horizon, origin, predicted, actual FROM pred
    UNION ALL SELECT series_id, 'damped_trend', horizon, origin, predicted, actual FROM damped
    UNION ALL SELECT series_id, 'seasonal_damped_trend', horizon, origin, predicted, actual FROM seasonal_damped"""
V["board"] = """
    SELECT *, (bar_mase - mase) / nullif(bar_mase, 0) AS margin0, list_position(['naive', 'seasonal_naive', 'drift'], model) IS NOT NULL AS is_baseline
    FROM (SELECT *, min(mase) FILTER (reg <= 3) OVER g AS bar_mase, arg_min(model, (round(mase, 9), reg)) FILTER (reg <= 3) OVER g AS bar,
                 arg_min(rmse, (round(mase, 9), reg)) FILTER (reg <= 3) OVER g AS bar_rmse
          FROM (SELECT p.series_id, model, horizon, count(*) AS n_forecasts, avg(abs(predicted - actual)) AS mae,
                       sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual)) / max(c.scale) AS mase,
                       list_position(['naive', 'seasonal_naive', 'drift', 'damped_trend', 'seasonal_damped_trend'], model) AS reg
                FROM allpred p JOIN (SELECT series_id, avg(abs(value - l7)) AS scale FROM pos0 GROUP BY 1) c USING (series_id) GROUP BY 1, 2, 3)
          WINDOW g AS (PARTITION BY series_id, horizon))"""


def damped_pairs(view: str) -> str:
    return sql(
        f"SELECT series_id, {big('origin')} AS origin, {big('horizon')} AS horizon, {num('predicted')} AS predicted, {num('actual')} AS actual FROM {view}", **V
    )


def percent(x: str, places: int) -> str:
    return f"printf('%.{places}f', {x} * 100) || '%'"


VERDICT = f"""CASE WHEN is_baseline AND bar = model THEN 'baseline (best)' WHEN is_baseline THEN 'baseline' WHEN bar IS NULL THEN 'no baseline to compare'
    WHEN margin0 > 0.05 THEN 'BEATS ' || bar || ' by ' || {percent('margin0', 0)}
    WHEN margin0 > 0 THEN 'ties ' || bar || ' (+' || {percent('margin0', 0)} || ', inside noise)'
    ELSE 'LOSES to ' || bar || ' by ' || {percent('-margin0', 0)} END"""


def pairs_sql(model: str) -> str:
    return sql(
        f"SELECT series_id, {big('origin')} AS origin, {big('horizon')} AS horizon, {num('predicted')} AS predicted, {num('actual')} AS actual"
        f" FROM pred WHERE model = '{model}'",
        **V,
    )


for key, model in (("n1_naive", "naive"), ("n2_seasonal_naive", "seasonal_naive"), ("n3_drift", "drift")):
    add(key, lambda d, model=model: n.rolling_origin(d.weekly, H, 21, [model]).drop("model"), pairs_sql(model))

add("n4_damped_trend", lambda d: n.rolling_origin(d.weekly, H, 21, ["damped_trend"]).drop("model"), damped_pairs("damped"))
add("n5_seasonal_damped_trend", lambda d: n.rolling_origin(d.weekly, H, 21, ["seasonal_damped_trend"]).drop("model"), damped_pairs("seasonal_damped"))
add(
    "n6_rolling_origin_pairs",
    lambda d: n.rolling_origin(d.weekly, H, 21).groupBy("series_id", "model", "horizon").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("origin").alias("first_origin"), F.max("origin").alias("last_origin"), F.avg("actual").alias("mean_actual")
    ),
    sql(
        f"""
        SELECT series_id, model, {big('h')} AS horizon, count(*) AS pairs, min(pos - h + 1) AS first_origin, max(pos - h + 1) AS last_origin, {num('avg(value)')} AS mean_actual
        FROM pos0, (VALUES (1), (7)) t(h), (VALUES ('naive'), ('seasonal_naive'), ('drift'), ('damped_trend'), ('seasonal_damped_trend')) m(model)
        WHERE pos - h + 1 >= 21 GROUP BY 1, 2, 3""",
        **V,
    ),
)


def baseline_scores(d):
    return n.evaluate(d.weekly, H, 21, BASELINES)


add(
    "n7_scores",
    baseline_scores,
    sql(
        f"SELECT series_id, model, {big('horizon')} AS horizon, n_forecasts, {num('mae')} AS mae, {num('rmse')} AS rmse, {num('mase')} AS mase,"
        " true AS is_baseline, mase < 1 AS beats_mase_unit FROM scores",
        **V,
    ),
)
add(
    "n8_refusals",
    lambda d: n.eligibility(d.series, H, 21),
    sql(
        f"""
        SELECT series_id, n_observations, {num('scale')} AS scale, CASE WHEN n_observations < 35 THEN 'insufficient_history' WHEN scale <= 0 THEN 'degenerate_series' END AS refusal
        FROM (SELECT series_id, count(*) AS n_observations, coalesce(avg(abs(value - p)), 0) AS scale
              FROM (SELECT *, lag(value, 7) OVER (PARTITION BY series_id ORDER BY index_date) AS p FROM series) GROUP BY 1)"""
    ),
)
add(
    "o9_best_baseline",
    lambda d: n.best_at_horizon(baseline_scores(d)).select("series_id", "horizon", F.col("b.model").alias("model"), F.col("b.mase").alias("mase")),
    sql(
        f"""
        SELECT series_id, {big('horizon')} AS horizon, model, {num('mase')} AS mase FROM
            (SELECT *, row_number() OVER (PARTITION BY series_id, horizon ORDER BY mase, list_position(['naive', 'seasonal_naive', 'drift'], model)) AS rn FROM scores)
        WHERE rn = 1""",
        **V,
    ),
)
add(
    "n9_verdicts_of_baselines",
    lambda d: n.scoreboard(baseline_scores(d)).select("series_id", "model", "horizon", "best_baseline", "verdict"),
    sql(
        f"""
        SELECT series_id, model, {big('horizon')} AS horizon, best AS best_baseline, CASE WHEN model = best THEN 'baseline (best)' ELSE 'baseline' END AS verdict
        FROM (SELECT *, first_value(model) OVER (PARTITION BY series_id, horizon ORDER BY mase, list_position(['naive', 'seasonal_naive', 'drift'], model)) AS best FROM scores)""",
        **V,
    ),
)
BOARD = f"""series_id, model, {big('horizon')} AS horizon, n_forecasts, {num('mae')} AS mae, {num('rmse')} AS rmse, {num('mase')} AS mase, is_baseline,
    mase < 1 AS beats_mase_unit, {num('CASE WHEN NOT is_baseline THEN margin0 END')} AS margin, bar AS best_baseline, bar = model AS is_best_baseline, {VERDICT} AS verdict"""
add("n9_verdicts", lambda d: n.scoreboard(n.evaluate(d.weekly, H, 21)), sql(f"SELECT {BOARD} FROM board", **V))
CLAIM = f"""'At h=' || horizon || ', ' || CASE
    WHEN m > 0.05 THEN model || ' (MASE ' || printf('%.3f', mase) || ') beats ' || bar || ' (MASE ' || printf('%.3f', bar_mase) || ') by ' || {percent('m', 1)}
         || CASE WHEN rmse > bar_rmse THEN ', but its RMSE is worse: not recommended.' ELSE '. Worth publishing.' END
    WHEN m > 0 THEN model || ' edges ' || bar || ' by only ' || {percent('m', 1)} || ': inside the noise. Use the baseline.'
    ELSE 'no model beats ' || bar || '. Use it and say so.' END"""
add(
    "n10_recommendation",
    lambda d: n.recommend(n.evaluate(d.weekly, H, 21), n.eligibility(d.weekly, H, 21), H),
    sql(
        f"""
        SELECT series_id, n_observations, cast(NULL AS varchar) AS refusal, kept, CASE WHEN kept = 2 THEN 'A nowcast is worth shipping.'
                   WHEN kept > 0 THEN 'A nowcast is worth shipping at some horizons only.' ELSE 'NO NOWCAST MODEL IS RECOMMENDED. Publish the baseline instead.' END
               || ' ' || lines AS recommendation
        FROM (SELECT series_id, count(*) FILTER (m > 0.05 AND rmse <= bar_rmse) AS kept, string_agg({CLAIM}, ' ' ORDER BY horizon) AS lines
              FROM (SELECT *, margin0 AS m, row_number() OVER (PARTITION BY series_id, horizon ORDER BY mase, reg) AS place FROM board WHERE reg > 3)
              WHERE place = 1 GROUP BY 1) JOIN (SELECT series_id, count(*) AS n_observations FROM weekly GROUP BY 1) USING (series_id)""",
        **V,
    ),
)
add(
    "n11_scoreboard",
    lambda d: n.scoreboard(n.evaluate(d.weekly, H, 21)).select("horizon", "series_id", "model", "mase", "margin", "is_best_baseline").orderBy("horizon", "mase"),
    sql(
        f"SELECT {big('horizon')} AS horizon, series_id, model, {num('mase')} AS mase, {num('CASE WHEN NOT is_baseline THEN margin0 END')} AS margin,"
        " bar = model AS is_best_baseline FROM board",
        **V,
    ),
)
# The five models on the daily series. Folding every history anew would be quadratic, so the damped models are followed
# day by day: errors of the values (track) and, once for all series, of the seven weekday indicators (week). Their running
# products give the sum of squares for the factors of any origin.
ZERO = "list_transform(range(1, 8), lambda s: 0::double)"
DAILY = dict(
    eligible=f"""
        SELECT series_id, n, scale FROM (SELECT series_id, count(*) AS n, avg(abs(value - p)) AS scale
              FROM (SELECT *, lag(value, 7) OVER (PARTITION BY series_id ORDER BY index_date) AS p FROM series) GROUP BY 1)
        WHERE n >= {MIN_TRAIN} + 7 + 7 AND scale > 0""",
    weekly="SELECT s.* FROM series s JOIN eligible USING (series_id)",
    grid=GRID_SQL,
    pos0=POS,
    pred=PRED.replace(">= 21", f">= {MIN_TRAIN}"),
    week=f"""
        WITH RECURSIVE go AS (
            SELECT gi, a, b, p, 0 AS i, [1, 0, 0, 0, 0, 0, 0]::double[] AS l, [-1, 1, 0, 0, 0, 0, 0]::double[] AS t, {ZERO} AS e, list_transform(range(0, 49), lambda s: 0::double) AS q
            FROM grid
            UNION ALL
            SELECT gi, a, b, p, i + 1, new_l, list_transform(range(1, 8), lambda s: b * (new_l[s] - l[s]) + (1 - b) * p * t[s]), new_e,
                   list_transform(range(0, 49), lambda k: q[k + 1] + new_e[k // 7 + 1] * new_e[k % 7 + 1])
            FROM (SELECT *, list_transform(range(1, 8), lambda s: l[s] + p * t[s] + a * new_e[s]) AS new_l
                  FROM (SELECT *, list_transform(range(1, 8), lambda s: CASE WHEN (i + 1) % 7 = s - 1 THEN 1 ELSE 0 END - l[s] - p * t[s]) AS new_e
                        FROM go WHERE i + 1 < (SELECT max(n) FROM eligible))))
        SELECT gi, i, p, l, t, e, q FROM go""",
    track="""
        WITH RECURSIVE go AS (
            SELECT z.series_id, gi, a, b, p, 0::bigint AS i, 0::double AS l, y.value - z.value AS t, 0::double AS e, z.value AS base
            FROM pos0 z JOIN pos0 y ON y.series_id = z.series_id AND z.pos = 0 AND y.pos = 1 CROSS JOIN grid
            UNION ALL
            SELECT series_id, gi, a, b, p, i + 1, l + p * t + a * new_e, b * (p * t + a * new_e) + (1 - b) * p * t, new_e, base
            FROM (SELECT go.*, v.value - base - l - p * t AS new_e FROM go JOIN pos0 v ON v.series_id = go.series_id AND v.pos = go.i + 1))
        SELECT series_id, gi, i, p, l, t, e, base FROM go""",
    shape=f"""
        SELECT series_id, o, list(f - m ORDER BY slot) AS f
        FROM (SELECT *, avg(f) OVER (PARTITION BY series_id, o) AS m
              FROM (SELECT h.series_id, h.o, v.pos % 7 AS slot, avg(v.dev) AS f
                    FROM (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS dev FROM pos0) v
                    JOIN (SELECT series_id, pos + 1 AS o FROM pos0 WHERE pos + 1 >= {MIN_TRAIN}) h ON h.series_id = v.series_id AND v.pos BETWEEN 3 AND h.o - 4
                    GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    sums="""
        SELECT k.series_id, k.i + 1 AS o, k.gi, k.p, k.l + k.base AS l, k.t, w.l AS wl, w.t AS wt, w.q, sum(k.e * k.e) OVER g AS s,
               """ + ", ".join(f"sum(k.e * w.e[{s}]) OVER g AS c{s}" for s in range(1, 8)) + """
        FROM track k JOIN week w USING (gi, i) WINDOW g AS (PARTITION BY k.series_id, k.gi ORDER BY k.i)""",
    plain="SELECT series_id, o, l, t, p, [0, 0, 0, 0, 0, 0, 0]::double[] AS f, row_number() OVER (PARTITION BY series_id, o ORDER BY s, gi) AS place FROM sums",
    seasonal="""
        SELECT series_id, o, p, f, l - list_sum(list_transform(range(1, 8), lambda s: f[s] * wl[s])) AS l, t - list_sum(list_transform(range(1, 8), lambda s: f[s] * wt[s])) AS t,
               row_number() OVER (PARTITION BY series_id, o ORDER BY s - 2 * ("""
    + " + ".join(f"f[{s}] * c{s}" for s in range(1, 8))
    + """) + list_sum(list_transform(range(0, 49), lambda k: f[k // 7 + 1] * f[k % 7 + 1] * q[k + 1])), gi) AS place
        FROM sums JOIN shape USING (series_id, o)""",
)


def followed(model: str, view: str) -> str:
    ahead = "list_sum(list_transform(range(1, h + 1), lambda k: pow(p, k)))"
    return f"""
        SELECT r.series_id, '{model}' AS model, h AS horizon, o AS origin, l + {ahead} * t + f[(o + h - 1) % 7 + 1] AS predicted, v.value AS actual
        FROM {view} r CROSS JOIN (VALUES (1), (7)) x(h) JOIN pos0 v ON v.series_id = r.series_id AND v.pos = o + h - 1
        WHERE place = 1 AND o >= {MIN_TRAIN}"""


DAILY["allpred"] = (
    "SELECT series_id, model, horizon, origin, predicted, actual FROM pred UNION ALL "
    + followed("damped_trend", "plain") + " UNION ALL " + followed("seasonal_damped_trend", "seasonal")
)
DAILY["board"] = V["board"]
add("q8_nowcast", lambda d: n.scoreboard(n.evaluate(d.series, H, MIN_TRAIN)), sql(f"SELECT {BOARD} FROM board", **DAILY))
add(
    "e1_forecaster_registry",
    lambda d: n.evaluate(d.series, (1,), MIN_TRAIN, ["naive", "drift"]).select("series_id", "model", "n_forecasts"),
    sql(
        "SELECT series_id, unnest(['naive', 'drift']) AS model, count(*) - 14 AS n_forecasts FROM series GROUP BY 1 HAVING count(*) >= 22"
    ),
)
