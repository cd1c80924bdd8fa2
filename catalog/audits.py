"""Row rules and keys of the tables that the cleaning queries do not audit: registers, log, cells, index rows, references;
and the sizes of the exported result sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog import ORACLES, add, index, loading, operations, timeseries  # noqa: F401 - index registers oracles used here
from catalog.views import big, day, num, sql
from pricemesh.operators import governance as g
from pricemesh.operators import index as x
from pricemesh.plans import export
from pricemesh.sources import defaults, loaders, sinks


def spoiled_cells(d):
    """Cell results in which every 50th route and window keeps quotes beside a failure, as a faulty writer would."""
    cells = operations.results(d)
    return cells.withColumn("quotes", F.when((F.dayofmonth("scrape_date") % 9 == 4) & (F.col("outcome") != "ok"), 1).otherwise(F.col("quotes")))


def tables(d):
    """Every remaining table. Elementary rows are audited as published: placeholders stand on imputed cells."""
    runs = operations.c.run_totals(operations.results(d)).withColumn("mode", F.when(F.dayofmonth("scrape_date") % 10 == 3, "cron").otherwise("scheduled"))
    return {
        "airport": defaults.airports(d.spark),
        "route": d.routes,
        "route_weight": d.route_weights,
        "advance_window": d.windows,
        "source": d.sources,
        "request_audit": operations.audit(d),
        "collection_run": runs,
        "collection_cell": spoiled_cells(d),
        "elementary_index": x.compat_view(x.stored_elementary(d.elementary)),
        "route_index": d.route_rows,
        "cpi_reference": loaders.accepted(loading.cpi_parsed(d)),
        "fare_reference": loaders.accepted(loading.reference_parsed(d)),
    }


ROWS = {
    "airport": "(SELECT origin AS iata FROM routes UNION SELECT destination FROM routes UNION SELECT 'MAA')",
    "route": "routes",
    "route_weight": "(SELECT *, DATE '2025-06-01' AS weight_ref_start, DATE '2026-05-31' AS weight_ref_end FROM route_weights)",
    "advance_window": "windows",
    "source": "registry",
    "request_audit": "audit",
    "collection_run": "cycleruns",
    "collection_cell": "cells0",
    "elementary_index": "published",
    "route_index": "route_rows",
    "cpi_reference": "cpirows",
    "fare_reference": "farerefs",
}
VIEWS = dict(
    res=operations.RES, **operations.V, **loading.C, refs=loading.REF,
    cycleruns="""
        SELECT scrape_date, count(*) AS planned_cells, count(*) FILTER (outcome IN ('ok', 'sold_out', 'no_flights')) AS ok_cells,
               count(*) FILTER (outcome NOT IN ('ok', 'sold_out', 'no_flights')) AS failed_cells,
               CASE WHEN day(scrape_date) % 10 = 3 THEN 'cron' ELSE 'scheduled' END AS mode FROM res GROUP BY 1""",
    cells0="SELECT * REPLACE (CASE WHEN day(scrape_date) % 9 = 4 AND outcome <> 'ok' THEN 1 ELSE quotes END AS quotes) FROM res",
    published="""
        SELECT index_date, route_id, window_days, index_value, is_imputed, imputation_note, CASE WHEN is_imputed THEN 1 ELSE n_carriers END AS n_carriers,
               CASE WHEN is_imputed THEN 1 ELSE n_quotes END AS n_quotes FROM elementary WHERE NOT is_dropped""",
    cpirows="SELECT 'transport' AS series_code, m AS ref_month, CASE WHEN mm % 2 = 0 THEN 'urban' ELSE 'combined' END AS sector, CASE WHEN mm % 3 = 0 THEN 2012 ELSE 2024 END AS base_year FROM cpiok",
    farerefs="SELECT route_id, CASE WHEN window_days = 7 THEN m + INTERVAL 1 MONTH ELSE m END AS ref_month, top AS avg_fare FROM refs WHERE window_days IN (1, 7)",
)
KNOWN = "('daily','weekly','monthly')"
RULES = [
    ("airport", "airport_iata_upper", "iata = upper(iata)"),
    ("route", "route_canonical", "origin < destination"),
    ("route_weight", "passengers_not_negative", "passengers >= 0"),
    ("route_weight", "weight_in_unit", "weight >= 0 AND weight <= 1"),
    ("route_weight", "weight_ref_order", "weight_ref_end > weight_ref_start"),
    ("advance_window", "window_in_year", "window_days > 0 AND window_days <= 365"),
    ("advance_window", "weight_in_unit", "weight >= 0 AND weight <= 1"),
    ("source", "kind_known", "kind IN ('airline','ota','gds_api','official')"),
    ("source", "tier_known", "tier BETWEEN 1 AND 4"),
    ("source", "verdict_known", "audit_verdict IN ('scrape_ok','scrape_with_caution','do_not_scrape','licensed_api')"),
    ("source", "source_excluded_needs_reason", "enabled OR exclusion_reason IS NOT NULL"),
    ("request_audit", "outcome_known", "outcome IN ('ok','blocked_by_robots','blocked_by_intent','rate_limited','http_error','timeout','parse_error','no_flights','captcha')"),
    ("request_audit", "audit_no_disallowed_fetch", "robots_allowed OR outcome IN ('blocked_by_robots','blocked_by_intent')"),
    ("request_audit", "audit_intent_consistent", "NOT intent_denied OR outcome = 'blocked_by_intent'"),
    ("request_audit", "delay_not_negative", "delay_applied_s >= 0"),
    ("collection_run", "mode_known", "mode IN ('scheduled','manual','backfill','dry_run')"),
    ("collection_run", "collection_run_counts_sane", "ok_cells + failed_cells <= planned_cells"),
    ("collection_cell", "window_positive", "window_days > 0"),
    ("collection_cell", "outcome_known", "outcome IN ('ok','sold_out','no_flights','refused','failed','missed','skipped','planned')"),
    ("collection_cell", "collection_cell_quotes_need_success", "quotes = 0 OR outcome = 'ok'"),
    ("elementary_index", "value_positive", "index_value > 0"),
    ("elementary_index", "carriers_positive", "n_carriers > 0"),
    ("elementary_index", "quotes_positive", "n_quotes > 0"),
    ("elementary_index", "elem_imputed_has_note", "NOT is_imputed OR imputation_note IS NOT NULL"),
    ("route_index", "frequency_known", f"frequency IN {KNOWN}"),
    ("route_index", "value_positive", "index_value > 0"),
    ("cpi_reference", "sector_known", "sector IN ('rural','urban','combined')"),
    ("fare_reference", "avg_fare_positive", "avg_fare > 0"),
]
add(
    "g1_constraint_audit_of_the_rest",
    lambda d: g.audit_all(tables(d)),
    sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) FILTER (NOT coalesce({p}, true)) AS violations FROM {ROWS[t]}" for t, r, p in RULES
        ),
        **VIEWS,
    ),
)
KEYS = {
    "airport": "iata", "route_weight": "route_id, weight_ref_start", "source": "code", "collection_cell": "scrape_date, source_code, origin, destination, window_days",
    "elementary_index": "route_id, window_days, index_date", "cpi_reference": "series_code, ref_month, sector, base_year", "fare_reference": "route_id, ref_month",
}
add(
    "g2_key_audit_of_the_rest",
    lambda d: g.audit_keys({t: df for t, df in tables(d).items() if t in KEYS}),
    sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS duplicate_keys FROM (SELECT 1 FROM {ROWS[t]} GROUP BY {k} HAVING count(*) > 1)" for t, k in KEYS.items()
        ),
        **VIEWS,
    ),
)


# Every exported set counted from the tables it is made of.
DAILY = sql("SELECT 'headline' AS series_id, index_date, cast(index_value AS double) AS value FROM headline WHERE frequency = 'daily'")
EPISODES = timeseries.flags_sql(
    f"SELECT count(*) FROM (SELECT series_id, episode FROM ({timeseries.episodes_sql(2)}) GROUP BY 1, 2)", DAILY, "3.5"
)
SIZES = {
    "series": "SELECT count(*) FROM headline",
    "routes": "SELECT count(*) FROM route_rows",
    "leadtime": "SELECT count(*) FROM elementary WHERE NOT is_dropped",
    "leadtime_fares": "SELECT count(*) FROM stats",
    "fares_daily": "SELECT count(*) FROM (SELECT DISTINCT route_id, window_days, scrape_date FROM usable)",
    "leadtime_fit": "SELECT count(DISTINCT route_id) FROM usable",
    "anomalies": EPISODES,
    # Five models at two horizons, where the daily series is long enough and not constant.
    "nowcast": "SELECT CASE WHEN count(*) >= 28 AND count(DISTINCT index_value) > 1 THEN 10 ELSE 0 END FROM headline WHERE frequency = 'daily'",
    "compliance": "SELECT count(DISTINCT source) FROM audit JOIN registry ON code = source",
    "sources": "SELECT count(*) FROM registry WHERE NOT starts_with(code, '__')",
    "basket": "SELECT count(*) FROM routes",
    "windows": "SELECT count(*) FROM windows",
    "cpi_dispersion": "SELECT count(DISTINCT date_trunc('month', index_date)) FROM headline WHERE frequency = 'daily'",
    "provenance": "SELECT 1",
    "cleaning_report": "SELECT count(DISTINCT scrape_date) FROM classified",
}
add(
    "k8_json_export",
    loading.exported,
    sql(" UNION ALL ".join(f"SELECT '{name}' AS dataset, cast(({query}) AS bigint) AS row_count" for name, query in SIZES.items())),
)


# The back-test written as JSON, one folder per part, and read back.
PARTS = ("checks", "robustness", "concepts", "benchmark", "span")


def backtest_files(d):
    path = loading.folder(d)
    sets = export.backtest(d)
    sinks.export_json({part: sets[part] for part in PARTS}, path)
    return {part: d.spark.read.schema(sets[part].schema).json(f"{path}/{part}") for part in PARTS}


MEASURES = {
    "robustness": ("scenario", ["n", "first", "last", "min", "max", "mean", "max_gap_vs_baseline", "mean_gap_vs_baseline"]),
    "concepts": ("concept", ["n", "mean", "min", "max"]),
    "benchmark": (None, ["n", "correlation_on_changes", "max_divergence_points", "mean_divergence_points", "index_min", "index_max", "naive_min", "naive_max"]),
}


def report_rows(d):
    """One row per figure of the report: part, what it is about, measure, value."""
    files = backtest_files(d)
    parts = []
    for part, (key, measures) in MEASURES.items():
        about = F.col(key) if key else F.lit("index")
        pairs = [F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").cast("double").alias("value")) for m in measures]
        parts.append(files[part].select(F.lit(part).alias("part"), about.alias("about"), F.inline(F.array(*pairs))))
    return reduce(lambda a, b: a.unionByName(b), parts)


add(
    "k10_backtest_tables",
    lambda d: backtest_files(d)["checks"].select("check", "passed", "severity"),
    " UNION ALL ".join(f'SELECT "check", passed, severity FROM ({ORACLES[k]})' for k in ("v1_base_period", "v2_temporal_consistency", "v4_coverage_reported"))
    + f" UNION ALL SELECT 'contributions_sum_to_headline', bool_and(ok), 'error' FROM ({ORACLES['v3_contribution_gaps']})",
)
_REPORT = {"robustness": "v11_window_weight_robustness", "concepts": "v12_price_concept_robustness", "benchmark": "v13_benchmark_naive"}
add(
    "v15_backtest_payload",
    report_rows,
    " UNION ALL ".join(
        f"SELECT '{part}' AS part, {key or chr(39) + 'index' + chr(39)} AS about, unnest({measures}) AS measure,"
        f" unnest([{', '.join(f'cast({chr(34)}{m}{chr(34)} AS double)' for m in measures)}]) AS value FROM ({ORACLES[_REPORT[part]]})"
        for part, (key, measures) in MEASURES.items()
    ),
)
add(
    "v15_backtest_span",
    lambda d: backtest_files(d)["span"],
    sql(
        f"""
        SELECT {day('min(index_date)')} AS start, {day('max(index_date)')} AS "end", {big('count(*)')} AS n_days, {num('arg_max(coverage_ratio, index_date)')} AS coverage_latest,
               {num('arg_max(observed_pax_share, index_date)')} AS pax_share_latest, count(*) >= 30 AS meets_30_days FROM headline WHERE frequency = 'daily'"""
    ),
)
