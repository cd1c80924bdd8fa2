"""Ordered-series operators, detectors and agreement scores over generic series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import add, loading
from catalog.views import big, day, num, sql
from pricemesh.functions.common import fixed4
from pricemesh.operators import anomalies as an
from pricemesh.operators import leadtime as lt
from pricemesh.operators import metrics as m
from pricemesh.operators import series as so
from pricemesh.sources import loaders as ld

W = "(PARTITION BY series_id ORDER BY index_date)"
ID = f"series_id, {day('index_date')} AS index_date"

add(
    "s10_series_scan",
    lambda d: d.series,
    sql(f"SELECT {ID}, value FROM series"),
)
add(
    "w3_period_change",
    lambda d: so.change_over(d.series, 1, "change_1").select("series_id", "index_date", "change_1"),
    sql(f"SELECT {ID}, {num('(value / lag(value) OVER w - 1) * 100')} AS change_1 FROM series WINDOW w AS {W}"),
)
add(
    "w4_thirty_rows_back",
    lambda d: so.change_over(d.series, 30, "change_30").select("series_id", "index_date", "change_30"),
    sql(f"SELECT {ID}, {num('(value / lag(value, 30) OVER w - 1) * 100')} AS change_30 FROM series WINDOW w AS {W}"),
)
add(
    "w5_first_to_last",
    lambda d: so.first_to_last(d.series),
    sql(
        f"""
        SELECT series_id, count(*) AS n, {num('arg_min(value, index_date)')} AS first, {num('arg_max(value, index_date)')} AS last,
               {num('arg_max(value, index_date) / arg_min(value, index_date) - 1')} AS period_change,
               {num('arg_max((value - p) / p, index_date)')} AS last_change
        FROM (SELECT *, lag(value) OVER w AS p FROM series WINDOW w AS {W}) GROUP BY 1 HAVING count(*) >= 2"""
    ),
)
add(
    "w6_percent_changes",
    lambda d: so.change_over(d.weekly, 1, "change").select("series_id", "index_date", "change"),
    sql(f"SELECT {ID}, {num('(value / nullif(lag(value) OVER w, 0) - 1) * 100')} AS change FROM weekly WINDOW w AS {W}"),
)
add(
    "w7_log_diff_transform",
    lambda d: so.transform(d.series, "log_diff"),
    sql(f"SELECT {ID}, {num('v')} AS value FROM (SELECT *, ln(value) - ln(lag(value) OVER w) AS v FROM series WINDOW w AS {W}) WHERE v IS NOT NULL"),
)
add(
    "w7_rebased_level_transform",
    lambda d: so.transform(d.weekly, "rebased_level"),
    sql(f"SELECT {ID}, {num('100 * value / first_value(value) OVER w')} AS value FROM weekly WINDOW w AS {W}"),
)
add(
    "w8_rebase",
    lambda d: so.rebase(d.weekly, 3).select("series_id", "index_date", "rebased"),
    sql(
        f"SELECT {ID}, {num('value / nth_value(value, 3) OVER w * 100')} AS rebased FROM weekly"
        " WINDOW w AS (PARTITION BY series_id ORDER BY index_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    ),
)
add(
    "w9_average_ranks",
    lambda d: so.average_ranks(d.series.withColumn("value", F.round("value", 0)), ["series_id"], "value", "avg_rank").select("series_id", "index_date", "avg_rank"),
    sql(
        f"SELECT {ID}, rank() OVER (PARTITION BY series_id ORDER BY v) + (count(*) OVER (PARTITION BY series_id, v) - 1) / 2.0 AS avg_rank"
        " FROM (SELECT *, round(value, 0) AS v FROM series)"
    ),
)
add(
    "w11_gaps",
    lambda d: so.gaps(d.series),
    sql(
        f"SELECT {ID}, {day('nx')} AS next_date, date_diff('day', index_date_raw, nx) AS gap_days FROM"
        f" (SELECT *, series.index_date AS index_date_raw, lead(index_date) OVER w AS nx FROM series WINDOW w AS {W}) WHERE date_diff('day', index_date_raw, nx) > 1"
    ),
)
add(
    "a12_monthly_mean",
    lambda d: so.monthly_mean(d.series),
    sql(f"SELECT series_id, {day('m')} AS month, {num('avg(value)')} AS value FROM (SELECT *, date_trunc('month', index_date) AS m FROM series) GROUP BY 1, 2"),
)
DISP = """
    SELECT series_id, ref_month, count(*) AS n_days, min(value) AS mn, max(value) AS mx, avg(value) AS me, stddev_samp(value) AS sd,
           arg_min(value, abs(day(index_date) - 15) * 100 + day(index_date)) AS sampled
    FROM (SELECT *, cast(date_trunc('month', index_date) AS date) AS ref_month FROM series) GROUP BY 1, 2"""
add(
    "a16_monthly_dispersion",
    lambda d: so.dispersion(d.series),
    sql(
        f"SELECT series_id, {day('ref_month')} AS ref_month, n_days, {num('mn')} AS min_index, {num('mx')} AS max_index,"
        f" {num('me')} AS mean_index, {num('sd')} AS sd_index, {num('mx - mn')} AS range_index, {num('sampled')} AS sampled_on_15th FROM disp",
        disp=DISP,
    ),
)
add(
    "j14_nearest_to_15th",
    lambda d: so.dispersion(d.series).select("series_id", "ref_month", "sampled_on_15th"),
    sql(f"SELECT series_id, {day('ref_month')} AS ref_month, {num('sampled')} AS sampled_on_15th FROM disp", disp=DISP),
)
add(
    "x25_blind_spot",
    lambda d: so.blind_spot(so.dispersion(d.series)).select("series_id", "ref_month", "missed", "missed_pct"),
    sql(
        f"SELECT series_id, {day('ref_month')} AS ref_month, {num('mx - sampled')} AS missed, {num('(mx - sampled) / sampled * 100')} AS missed_pct FROM disp",
        disp=DISP,
    ),
)
add(
    "o6_worst_blind_spot",
    lambda d: so.worst_blind_spot(so.dispersion(d.series)),
    sql(
        f"SELECT series_id, {day('arg_max(ref_month, mx - sampled)')} AS ref_month, {num('max(mx - sampled)')} AS missed FROM disp WHERE n_days >= 20 GROUP BY 1",
        disp=DISP,
    ),
)
add(
    "p16_full_months_only",
    lambda d: so.dispersion(d.series).filter("n_days >= 20").groupBy("series_id").agg(F.count(F.lit(1)).alias("months")),
    sql("SELECT series_id, count(*) AS months FROM disp WHERE n_days >= 20 GROUP BY 1", disp=DISP),
)
add(
    "o7_series_extremes",
    lambda d: lt.cheapest_and_peak(d.series, ["series_id"]),
    sql(
        f"""
        SELECT series_id, {num('min(value)')} AS min_value, {day('min(CASE WHEN value = lo THEN index_date END)')} AS cheapest_day,
               {num('max(value)')} AS max_value, {day('min(CASE WHEN value = hi THEN index_date END)')} AS peak_day
        FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM series WINDOW w AS (PARTITION BY series_id)) GROUP BY 1"""
    ),
)
FACT = """
    SELECT series_id, (pos % 7) AS slot, coalesce(avg(dev), 0) AS raw
    FROM (SELECT series_id, pos, CASE WHEN n >= 14 AND pos >= 3 AND pos < n - 3 THEN value - c END AS dev
          FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY index_date) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n,
                       avg(value) OVER (PARTITION BY series_id ORDER BY index_date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS c FROM series))
    GROUP BY 1, 2"""
add(
    "w16_weekly_factors",
    lambda d: so.weekly_factors(d.series),
    sql(f"SELECT series_id, slot, {num('raw - avg(raw) OVER (PARTITION BY series_id)')} AS factor FROM fact", fact=FACT),
)
add(
    "w17_seasonal_error_scale",
    lambda d: so.seasonal_scale(d.series),
    sql(f"SELECT series_id, count(*) AS n_observations, {num('avg(abs(value - p))')} AS scale FROM (SELECT *, lag(value, 7) OVER w AS p FROM series WINDOW w AS {W}) GROUP BY 1"),
)

CHANGES = """
    SELECT series_id, index_date, value, row_number() OVER (PARTITION BY series_id ORDER BY index_date) - 1 AS i,
           (value - lag(value) OVER (PARTITION BY series_id ORDER BY index_date))
           / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY index_date), 0) AS change FROM weekly"""
FLAGS = """
    SELECT c.series_id, c.index_date, c.value, c.i, c.change, cast([] AS double[]) AS recent, cast(NULL AS double) AS score, cast(NULL AS double) AS med
    FROM changes c WHERE c.i = 0
    UNION ALL
    SELECT s.series_id, s.index_date, s.value, s.i, s.change,
           list_append(s.tail, CASE WHEN abs(s.sc) > 3.0 THEN NULL ELSE s.change END) AS recent,
           CASE WHEN abs(s.sc) > 3.0 THEN s.sc END AS score, s.med
    FROM (SELECT t.*, CASE WHEN t.n >= 10 AND t.mad > 0 THEN 0.6745 * (t.change - t.med) / t.mad END AS sc
          FROM (SELECT h.*, list_aggregate(list_transform(h.hist, lambda z: abs(z - h.med)), 'median') AS mad
                FROM (SELECT g.*, len(g.hist) AS n, list_aggregate(g.hist, 'median') AS med
                      FROM (SELECT c.series_id, c.index_date, c.value, c.i, c.change,
                                   list_slice(f.recent, greatest(len(f.recent) - 13, 1), len(f.recent)) AS hist0,
                                   list_filter(list_slice(f.recent, greatest(len(f.recent) - 13, 1), len(f.recent)), lambda z: z IS NOT NULL) AS hist,
                                   list_slice(f.recent, greatest(len(f.recent) - 12, 1), len(f.recent)) AS tail
                            FROM flagwalk f JOIN changes c ON c.series_id = f.series_id AND c.i = f.i + 1) g) h) t) s"""
SQL_FLAGS = f"""
    WITH RECURSIVE {{views}}, changes AS ({CHANGES}), flagwalk AS ({FLAGS}),
    flags AS (SELECT series_id, index_date, value, change, score, med FROM flagwalk WHERE score IS NOT NULL)
    {{body}}"""


def flags_sql(body: str, view: str = "weekly", threshold: str = "3.0") -> str:
    """Flags of a known view, or of a query that gives series_id, index_date and value."""
    from catalog.views import VIEWS

    text = SQL_FLAGS.format(views=f"weekly AS ({VIEWS.get(view, view)})", body=body)
    return text.replace("abs(s.sc) > 3.0", f"abs(s.sc) > {threshold}")


def flags(d):
    return an.detect(d.weekly, threshold=3.0)


add(
    "d4_series_anomalies",
    flags,
    flags_sql(
        f"SELECT {ID}, {num('value')} AS index_value, {num('change * 100')} AS change_pct, {num('score')} AS score,"
        " CASE WHEN change > med THEN 'spike' ELSE 'drop' END AS direction FROM flags"
    ),
)
def episodes_sql(gap: int) -> str:
    return EPI.replace("> 15, true", f"> {gap}, true")


EPI = """SELECT *, sum(brk) OVER (PARTITION BY series_id ORDER BY index_date) AS episode FROM (SELECT *, CASE WHEN
    coalesce(date_diff('day', lag(index_date) OVER (PARTITION BY series_id ORDER BY index_date), index_date) > 15, true) THEN 1 ELSE 0 END AS brk FROM flags)"""
add(
    "w14_episode_grouping",
    lambda d: an.with_episode(flags(d), 15).select("series_id", "index_date", "episode"),
    flags_sql(f"SELECT {ID}, {big('episode')} AS episode FROM ({EPI})"),
)
add(
    "w15_episode_peaks",
    lambda d: an.episodes(flags(d), 15).drop("hypotheses"),
    flags_sql(
        f"""
        SELECT series_id, {big('episode')} AS episode, {day('min(index_date)')} AS start, {day('max(index_date)')} AS "end",
               arg_max(CASE WHEN change > med THEN 'spike' ELSE 'drop' END, abs(score)) AS direction,
               {day('arg_max(index_date, abs(score))')} AS peak_date, {num('round(arg_max(change * 100, abs(score)), 4)')} AS peak_change_pct,
               {num('arg_max(value, abs(score))')} AS peak_index_value, {num('round(arg_max(score, abs(score)), 4)')} AS score,
               array_to_string(list_sort(list(strftime(index_date, '%Y-%m-%d'))), '|') AS days
        FROM ({EPI}) GROUP BY 1, 2"""
    ),
)
add(
    "x15_hypothesis_labels",
    lambda d: d.table("orders").select(F.col("o_orderdate").cast("date").alias("index_date")).distinct().select(
        "index_date", an.hypotheses(F.col("index_date")).alias("hypotheses")
    ),
    f"""
    SELECT {day('dt')} AS index_date, CASE WHEN l = '' THEN 'no candidate identified; cause unknown' ELSE l END AS hypotheses
    FROM (SELECT dt, array_to_string(list_filter([
            CASE WHEN (month(dt), day(dt)) >= (10, 15) AND month(dt) <= 11 THEN 'candidate: Diwali travel period (date varies by year; verify)' END,
            CASE WHEN (month(dt), day(dt)) >= (12, 20) OR month(dt) <= 1 THEN 'candidate: Christmas and New Year peak' END,
            CASE WHEN (month(dt), day(dt)) >= (3, 1) AND month(dt) <= 3 THEN 'candidate: financial year end, business travel' END,
            CASE WHEN (month(dt), day(dt)) >= (5, 1) AND month(dt) <= 6 THEN 'candidate: summer school holidays' END],
            lambda z: z IS NOT NULL), '|') AS l
          FROM (SELECT DISTINCT cast(o_orderdate AS date) AS dt FROM orders))""",
)
HYP = """CASE WHEN l = '' THEN 'no candidate identified; cause unknown' ELSE l END AS hypotheses
    FROM (SELECT *, array_to_string(list_filter([
            CASE WHEN (month(peak), day(peak)) >= (10, 15) AND month(peak) <= 11 THEN 'candidate: Diwali travel period (date varies by year; verify)' END,
            CASE WHEN (month(peak), day(peak)) >= (12, 20) OR month(peak) <= 1 THEN 'candidate: Christmas and New Year peak' END,
            CASE WHEN (month(peak), day(peak)) >= (3, 1) AND month(peak) <= 3 THEN 'candidate: financial year end, business travel' END,
            CASE WHEN (month(peak), day(peak)) >= (5, 1) AND month(peak) <= 6 THEN 'candidate: summer school holidays' END],
            lambda z: z IS NOT NULL), '|') AS l"""
add(
    "d5_detect_label_group",
    lambda d: an.episodes(flags(d), 15).select("series_id", "start", "end", "peak_date", "hypotheses"),
    flags_sql(
        f"""
        SELECT series_id, {day('st')} AS start, {day('en')} AS "end", {day('peak')} AS peak_date, {HYP}
        FROM (SELECT series_id, episode, min(index_date) AS st, max(index_date) AS en, arg_max(index_date, abs(score)) AS peak FROM ({EPI}) GROUP BY 1, 2))"""
    ),
)
add(
    "q7_anomalies_daily",
    lambda d: an.detect_and_group(d.series, window=14, threshold=3.5),
    flags_sql(
        f"""
        SELECT series_id, {big('episode')} AS episode, {day('st')} AS start, {day('en')} AS "end", direction, {day('peak')} AS peak_date,
               {num('round(pc, 4)')} AS peak_change_pct, {num('pv')} AS peak_index_value, {num('round(sc, 4)')} AS score, days, {HYP}
        FROM (SELECT series_id, episode, min(index_date) AS st, max(index_date) AS en, arg_max(index_date, abs(score)) AS peak,
                     arg_max(CASE WHEN change > med THEN 'spike' ELSE 'drop' END, abs(score)) AS direction, arg_max(change * 100, abs(score)) AS pc,
                     arg_max(value, abs(score)) AS pv, arg_max(score, abs(score)) AS sc,
                     array_to_string(list_sort(list(strftime(index_date, '%Y-%m-%d'))), '|') AS days
              FROM ({episodes_sql(2)}) GROUP BY 1, 2))""",
        "series",
        "3.5",
    ),
)
add(
    "e5_period_key",
    lambda d: d.series.groupBy("series_id", F.trunc("index_date", "quarter").alias("period")).agg(F.avg("value").alias("value")),
    sql(f"SELECT series_id, {day('p')} AS period, {num('avg(value)')} AS value FROM (SELECT *, date_trunc('quarter', index_date) AS p FROM series) GROUP BY 1, 2"),
)


def pairs(d):
    """Every priority's weekly mean against the all-order weekly mean."""
    ref = d.table("orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "week").alias("period")).agg(
        fixed4(F.avg("o_totalprice")).alias("b")
    )
    return d.weekly.select(F.col("series_id").alias("pair_id"), F.col("index_date").alias("period"), F.col("value").alias("a")).join(ref, "period")


PAIRS = f"""
    SELECT series_id AS pair_id, index_date AS period, value AS a, b FROM weekly JOIN
    (SELECT cast(date_trunc('week', o_orderdate) AS date) AS index_date, {num('avg(o_totalprice)')} AS b FROM orders GROUP BY 1) USING (index_date)"""
DIFF = """
    SELECT * FROM (SELECT pair_id, period, ln(a) - ln(lag(a) OVER w) AS a, ln(b) - ln(lag(b) OVER w) AS b FROM pairs0
                   WINDOW w AS (PARTITION BY pair_id ORDER BY period)) WHERE a IS NOT NULL"""
RANKS = """
    SELECT *, rank() OVER (PARTITION BY pair_id ORDER BY a) + (count(*) OVER (PARTITION BY pair_id, a) - 1) / 2.0 AS ra,
           rank() OVER (PARTITION BY pair_id ORDER BY b) + (count(*) OVER (PARTITION BY pair_id, b) - 1) / 2.0 AS rb FROM {t}"""
P = dict(pairs0=PAIRS, diff=DIFF, rdiff=RANKS.format(t="diff"), rlev=RANKS.format(t="pairs0"))

add("j11_series_alignment", lambda d: pairs(d).select("pair_id", "period", "a", "b"), sql(f"SELECT pair_id, {day('period')} AS period, a, b FROM pairs0", **P))


def diffed(d):
    return m.with_transform(pairs(d), "log_diff")


add("m1_pearson", lambda d: diffed(d).groupBy("pair_id").agg(m.correlation("a", "b").alias("pearson")), sql(f"SELECT pair_id, {num('corr(a, b)')} AS pearson FROM diff GROUP BY 1", **P))
add(
    "m2_spearman",
    lambda d: m._with_ranks(diffed(d)).groupBy("pair_id").agg(m.correlation("ra", "rb").alias("spearman")),
    sql(f"SELECT pair_id, {num('corr(ra, rb)')} AS spearman FROM rdiff GROUP BY 1", **P),
)
add("m3_mae", lambda d: pairs(d).groupBy("pair_id").agg(m.mae().alias("mae")), sql(f"SELECT pair_id, {num('avg(abs(a - b))')} AS mae FROM pairs0 GROUP BY 1", **P))
add("m4_rmse", lambda d: pairs(d).groupBy("pair_id").agg(m.rmse().alias("rmse")), sql(f"SELECT pair_id, {num('sqrt(avg((a - b) * (a - b)))')} AS rmse FROM pairs0 GROUP BY 1", **P))
add(
    "m5_mape",
    lambda d: pairs(d).groupBy("pair_id").agg(m.mape().alias("by_reference"), m.mape(denominator="a").alias("by_index")),
    sql(f"SELECT pair_id, {num('avg(abs((a - b) / b)) * 100')} AS by_reference, {num('avg(abs((a - b) / a)) * 100')} AS by_index FROM pairs0 GROUP BY 1", **P),
)
add(
    "m6_direction_agreement",
    lambda d: diffed(d).groupBy("pair_id").agg(m.direction_agreement().alias("exact"), m.direction_agreement(tolerance=0.05).alias("tolerant")),
    sql(
        f"SELECT pair_id, {num('avg(CASE WHEN sign(a) = sign(b) THEN 1 ELSE 0 END)')} AS exact,"
        f" {num('avg(CASE WHEN (CASE WHEN a > 0.05 THEN 1 WHEN a < -0.05 THEN -1 ELSE 0 END) = (CASE WHEN b > 0.05 THEN 1 WHEN b < -0.05 THEN -1 ELSE 0 END) THEN 1 ELSE 0 END)')} AS tolerant"
        " FROM diff GROUP BY 1",
        **P,
    ),
)
add(
    "m7_theil_u2",
    lambda d: diffed(d).groupBy("pair_id").agg(m.theil_u2().alias("theil_u2")),
    sql(f"SELECT pair_id, {num('sqrt(avg((a - b) * (a - b))) / sqrt(avg(b * b))')} AS theil_u2 FROM diff GROUP BY 1", **P),
)
add(
    "m8_compare_growth",
    lambda d: m.compare_growth(pairs(d)),
    sql(
        f"""
        SELECT pair_id, metric, {num('value')} AS value, n, value IS NOT NULL AND n >= 8 AS reliable,
               CASE WHEN metric = 'pearson' THEN (CASE WHEN abs(value) >= 0.7 THEN 'strong' WHEN abs(value) >= 0.4 THEN 'moderate'
                    WHEN abs(value) >= 0.2 THEN 'weak' ELSE 'negligible' END) || CASE WHEN value >= 0 THEN ' positive' ELSE ' negative' END
                    || ' co-movement in growth rates' END AS interpretation
        FROM (SELECT pair_id, count(*) AS n, unnest(['pearson', 'spearman', 'mae', 'rmse', 'mape', 'direction_agreement', 'theil_u2']) AS metric,
                     unnest([corr(a, b), corr(ra, rb), avg(abs(a - b)), sqrt(avg((a - b) * (a - b))), NULL,
                             avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0.0 END), sqrt(avg((a - b) * (a - b))) / sqrt(avg(b * b))]) AS value
              FROM rdiff GROUP BY 1)""",
        **P,
    ),
)
LEV = """
    SELECT *, (a / lag(a) OVER w - 1) * 100 AS ca, (b / lag(b) OVER w - 1) * 100 AS cb, a / first_value(a) OVER w * 100 AS xa,
           b / first_value(b) OVER w * 100 AS xb FROM rlev WINDOW w AS (PARTITION BY pair_id ORDER BY period)"""
LEVEL_SCORES = f"""
    SELECT pair_id, metric, {num('value')} AS value, n, n >= 6 AS reliable
    FROM (SELECT pair_id, unnest(['pearson_r_on_changes', 'spearman_rho_on_levels', 'direction_agreement', 'mape_rebased', 'rmse_rebased']) AS metric,
                 unnest([count(ca), count(*), count(ca), count(*), count(*)]) AS n,
                 unnest([corr(ca, cb), corr(ra, rb),
                         avg(CASE WHEN ca IS NULL THEN NULL WHEN (CASE WHEN ca > 0.05 THEN 1 WHEN ca < -0.05 THEN -1 ELSE 0 END) = (CASE WHEN cb > 0.05 THEN 1 WHEN cb < -0.05 THEN -1 ELSE 0 END) THEN 1.0 ELSE 0.0 END),
                         avg(abs((xa - xb) / xa)) * 100, sqrt(avg((xa - xb) * (xa - xb)))]) AS value
          FROM lev GROUP BY 1)"""
SQL_LEVELS = sql(LEVEL_SCORES, lev=LEV, **P)
add("m8_compare_levels", lambda d: m.compare_levels(pairs(d)), SQL_LEVELS)


def external_pairs(d):
    """Monthly means of every series beside the loaded official index (combined sector), where two months or more are common."""
    official = ld.accepted(loading.cpi_parsed(d)).filter("sector = 'combined'").groupBy(F.col("ref_month").alias("period")).agg(F.avg("index_value").alias("b"))
    monthly = so.monthly_mean(d.series)
    month = next(c for c in monthly.columns if c not in ("series_id", "value"))
    pairs = monthly.select(F.col("series_id").alias("pair_id"), F.col(month).alias("period"), F.col("value").alias("a")).join(official, "period")
    enough = pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("k")).filter("k >= 2").select("pair_id")
    return pairs.join(enough, "pair_id", "left_semi")


EXTERNAL = """
    SELECT pair_id, period, a, b FROM (SELECT *, count(*) OVER (PARTITION BY pair_id) AS k
        FROM (SELECT series_id AS pair_id, cast(date_trunc('month', index_date) AS date) AS period, avg(value) AS a FROM series GROUP BY 1, 2)
        JOIN (SELECT cast(m AS date) AS period, avg(cast(n AS double)) AS b FROM cpiok WHERE mm % 2 <> 0 GROUP BY 1) USING (period)) WHERE k >= 2"""
add(
    "v14_external_comparison",
    lambda d: m.compare_levels(external_pairs(d)),
    sql(LEVEL_SCORES, lev=LEV, **{**P, "pairs0": EXTERNAL}, **loading.C),
)
add(
    "e2_metric_presets",
    lambda d: m.compare_growth(pairs(d), "level").filter("value IS NOT NULL").select("pair_id", "metric", "value"),
    sql(
        f"""
        SELECT pair_id, metric, {num('value')} AS value FROM (SELECT pair_id, unnest(['pearson', 'spearman', 'mae', 'rmse', 'mape', 'direction_agreement']) AS metric,
               unnest([corr(a, b), corr(ra, rb), avg(abs(a - b)), sqrt(avg((a - b) * (a - b))), avg(abs((a - b) / b)) * 100,
                       avg(CASE WHEN ca IS NULL THEN NULL WHEN sign(ca) = sign(cb) THEN 1.0 ELSE 0.0 END)]) AS value FROM lev GROUP BY 1)""",
        lev=LEV, **P,
    ),
)
add(
    "x18_correlation_reading",
    lambda d: diffed(d).groupBy("pair_id").agg(m.correlation("a", "b").alias("r")).select("pair_id", m.read_correlation(F.col("r"), False).alias("reading")),
    sql(
        "SELECT pair_id, (CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END)"
        " || CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END || ' co-movement in growth rates' AS reading FROM (SELECT pair_id, corr(a, b) AS r FROM diff GROUP BY 1)",
        **P,
    ),
)
add(
    "j13_cpi_overlay",
    lambda d: so.cpi_overlay(
        so.monthly_mean(d.series),
        d.table("lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("ref_month")).agg(
            F.avg("l_extendedprice").alias("index_value")
        ).withColumn("sector", F.lit("combined")),
    ),
    sql(
        f"""
        SELECT series_id, {day('m')} AS month, {num('a / first_value(a) OVER w * 100')} AS series, {num('c / first_value(c) OVER w * 100')} AS cpi
        FROM (SELECT series_id, date_trunc('month', index_date) AS m, avg(value) AS a FROM series GROUP BY 1, 2)
        JOIN (SELECT date_trunc('month', l_shipdate) AS m, avg(l_extendedprice) AS c FROM lineitem GROUP BY 1) USING (m)
        WINDOW w AS (PARTITION BY series_id ORDER BY m)"""
    ),
)
