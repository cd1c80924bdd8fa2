"""Cleaning: plausibility, identity, split, outliers, report, storage, row audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import add
from catalog.views import GROUP, big, day, num, sql
from pricemesh import schema as S
from pricemesh.operators import cleaning as c
from pricemesh.operators import fares as f
from pricemesh.operators import governance as g
from pricemesh.operators import outliers as o
from pricemesh.sources import sinks

QUOTE_COLS = ["ingest_seq", "origin", "destination", "carrier", "scrape_date", "total_fare"]
SQL_QUOTE = f"ingest_seq, origin, destination, carrier, {day('scrape_date')} AS scrape_date, {num('total_fare')} AS total_fare"


def plausible(d):
    return c.classify_plausibility(d.quotes).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def deduped(d):
    return c.deduplicate(plausible(d))


def kept(d):
    return c.verify_decomposition(deduped(d))


add(
    "x1_advance_window",
    lambda d: c.with_window(d.quotes).groupBy("window_days").agg(F.count(F.lit(1)).alias("quotes")),
    sql(f"SELECT {big('window_days')} AS window_days, count(*) AS quotes FROM classified GROUP BY 1"),
)
add(
    "x16_departure_weekday",
    lambda d: d.quotes.groupBy(F.weekday("departure_date").alias("weekday")).agg(F.count(F.lit(1)).alias("quotes")),
    sql("SELECT isodow(departure_date) - 1 AS weekday, count(*) AS quotes FROM quotes GROUP BY 1"),
)
add(
    "p1_plausibility",
    lambda d: c.classify_plausibility(d.quotes).select(*QUOTE_COLS, "window_days", "reject_reason"),
    sql(f"SELECT {SQL_QUOTE}, window_days, reject_reason FROM classified"),
)
add(
    "p2_component_reconciliation",
    lambda d: c.with_window(d.quotes).select("ingest_seq", c.components_reconcile().alias("reconciles")),
    sql(
        "SELECT ingest_seq, coalesce(base_fare IS NOT NULL AND taxes IS NOT NULL AND abs(base_fare + taxes + coalesce(udf,0)"
        " + coalesce(convenience_fee,0) + coalesce(other_charges,0) - total_fare) <= 1, false) AS reconciles FROM quotes"
    ),
)
add(
    "p3_verify_decomposition",
    lambda d: kept(d).select(
        "ingest_seq", "components_complete", "base_fare", "taxes", "udf", "convenience_fee",
        F.array_join("quality_flags", "|").alias("flags"),
    ),
    sql(
        f"SELECT ingest_seq, components_complete, {num('base_fare')} AS base_fare, {num('taxes')} AS taxes, {num('udf')} AS udf,"
        f" {num('convenience_fee')} AS convenience_fee, split_flag AS flags FROM kept"
    ),
)
add(
    "p4_quote_validation",
    lambda d: c.with_window(d.quotes).select("ingest_seq", c.validation_errors().alias("errors")),
    sql(
        "SELECT ingest_seq, array_to_string(list_filter([CASE WHEN total_fare <= 0 THEN 'non_positive_total' END,"
        " CASE WHEN window_days <= 0 THEN 'window_not_positive' END, CASE WHEN base_fare IS NOT NULL AND NOT"
        " coalesce(taxes IS NOT NULL AND abs(base_fare + taxes + coalesce(udf,0) + coalesce(convenience_fee,0)"
        " + coalesce(other_charges,0) - total_fare) <= 1, false) THEN 'components_did_not_reconcile' END],"
        " lambda e: e IS NOT NULL), '|') AS errors FROM classified"
    ),
)
add(
    "p5_sold_out_set_aside",
    lambda d: kept(d).groupBy("scrape_date", "is_sold_out").agg(F.count(F.lit(1)).alias("quotes")),
    sql(f"SELECT {day('scrape_date')} AS scrape_date, is_sold_out, count(*) AS quotes FROM kept GROUP BY ALL"),
)
add(
    "p6_persistable",
    lambda d: d.cleaned.persistable.select(*QUOTE_COLS, "is_outlier", "is_sold_out"),
    sql(f"SELECT {SQL_QUOTE}, is_outlier, is_sold_out FROM survivors"),
)
add(
    "p7_usable_fares",
    lambda d: d.usable.select("ingest_seq", "route_id", "window_days", "total_fare"),
    sql(f"SELECT ingest_seq, {big('route_id')} AS route_id, window_days, {num('total_fare')} AS total_fare FROM usable"),
)
add(
    "p12_non_stop_only",
    lambda d: d.quotes.filter("stops = 0").groupBy("carrier").agg(
        F.count(F.lit(1)).alias("quotes"), F.sum("total_fare").alias("total")
    ),
    sql(f"SELECT carrier, count(*) AS quotes, {num('sum(total_fare)')} AS total FROM quotes WHERE stops = 0 GROUP BY 1"),
)
add(
    "u1_deduplicate",
    lambda d: deduped(d).select(*QUOTE_COLS, "copies"),
    sql(f"SELECT {SQL_QUOTE}, copies FROM deduped"),
)
add(
    "u2_clean_union_flagged",
    lambda d: d.cleaned.clean.unionByName(d.cleaned.flagged).groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_fare").alias("total")
    ),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS rows, {num('sum(total_fare)')} AS total FROM survivors GROUP BY 1"
    ),
)
add(
    "d1_mad_log_scores",
    lambda d: o.score_histogram(kept(d).filter("NOT is_sold_out"), S.COMPARISON_GROUP, "mad_log").select(
        *S.COMPARISON_GROUP, "total_fare", "cnt", "n", F.col("raw_score").alias("score"), "flag"
    ),
    sql(
        f"SELECT origin, destination, carrier, window_days, {day('scrape_date')} AS scrape_date, {num('total_fare')} AS total_fare,"
        f" count(*) AS cnt, max(n) AS n, {num('max(raw_score)')} AS score, coalesce(abs(max(raw_score)) > 3.5, false) AS flag"
        f" FROM scored GROUP BY {GROUP}, scored.total_fare"
    ),
)
IQR = f"""
    SELECT *, q3 - q1 AS iqr FROM (
        SELECT *, count(*) OVER g AS n, quantile_cont(cast(total_fare AS double), 0.25) OVER g AS q1,
               quantile_cont(cast(total_fare AS double), 0.75) OVER g AS q3, cast(total_fare AS double) AS x
        FROM kept WHERE NOT is_sold_out WINDOW g AS (PARTITION BY {GROUP}))"""
add(
    "d2_tukey_fences",
    lambda d: o.score_histogram(kept(d).filter("NOT is_sold_out"), S.COMPARISON_GROUP, "iqr").select(
        *S.COMPARISON_GROUP, "total_fare", "cnt", "q1", "q3", F.col("raw_score").alias("score"), "flag"
    ),
    sql(
        f"SELECT origin, destination, carrier, window_days, {day('scrape_date')} AS scrape_date, {num('total_fare')} AS total_fare,"
        f" count(*) AS cnt, {num('max(q1)')} AS q1, {num('max(q3)')} AS q3,"
        f" {num('max(CASE WHEN n < 5 OR iqr <= 0 THEN NULL WHEN x < q1 - 3 * iqr THEN (q1 - 3 * iqr - x) / iqr WHEN x > q3 + 3 * iqr THEN (x - q3 - 3 * iqr) / iqr ELSE 0 END)')} AS score,"
        f" bool_or(n >= 5 AND iqr > 0 AND (x < q1 - 3 * iqr OR x > q3 + 3 * iqr)) AS flag"
        f" FROM fenced GROUP BY {GROUP}, fenced.total_fare",
        fenced=IQR,
    ),
)


def by_method(d):
    rows = kept(d).filter("NOT is_sold_out")
    out = None
    for method in o.METHODS:
        part = o.score_histogram(rows, S.COMPARISON_GROUP, method).agg(
            F.lit(method).alias("method"),
            F.sum("cnt").alias("assessed"),
            F.sum(F.when(F.col("flag"), F.col("cnt")).otherwise(0)).alias("flagged"),
        )
        out = part if out is None else out.unionByName(part)
    return out


add(
    "d3_method_dispatch",
    by_method,
    sql(
        "SELECT 'mad_log' AS method, count(*) AS assessed, count(*) FILTER (abs(raw_score) > 3.5) AS flagged FROM scored"
        " UNION ALL SELECT 'iqr', count(*), count(*) FILTER (n >= 5 AND iqr > 0 AND (x < q1 - 3 * iqr OR x > q3 + 3 * iqr)) FROM fenced"
        " UNION ALL SELECT 'none', count(*), 0 FROM kept WHERE NOT is_sold_out",
        fenced=IQR,
    ),
)
add(
    "e4_method_by_name",
    lambda d: c.clean_quotes(d.quotes, "iqr").survivors.filter("is_outlier").select("ingest_seq", "outlier_method"),
    sql("SELECT ingest_seq, 'iqr' AS outlier_method FROM fenced WHERE n >= 5 AND iqr > 0 AND (x < q1 - 3 * iqr OR x > q3 + 3 * iqr)", fenced=IQR),
)
add(
    "x27_outlier_verdict_from_flag",
    lambda d: d.cleaned.survivors.withColumn("v", c.parse_outlier_flag(F.col("quality_flags"))).select(
        "ingest_seq", "v.is_outlier", F.col("v.method").alias("method"), F.col("v.score").alias("score")
    ),
    sql(
        f"SELECT ingest_seq, is_outlier, outlier_method AS method, {num('outlier_score')} AS score FROM survivors"
    ),
)
add(
    "a18_cleaning_report",
    lambda d: d.cleaned.report(),
    sql(
        f"""
        SELECT {day('i.scrape_date')} AS scrape_date, input_quotes, rejected, exact_duplicates, sold_out, outliers,
               components_complete, components_missing, output_quotes, comparison_groups, groups_too_small_to_assess, index_cells,
               {num('(rejected + exact_duplicates + outliers) / input_quotes')} AS discard_rate,
               {num('components_complete / (components_complete + components_missing)')} AS component_completeness
        FROM (SELECT scrape_date, count(*) AS input_quotes, count(reject_reason) AS rejected FROM classified GROUP BY 1) i
        JOIN (SELECT scrape_date, cast(sum(copies - 1) AS bigint) AS exact_duplicates, count(*) FILTER (is_sold_out) AS sold_out,
                     count(*) FILTER (is_outlier) AS outliers, count(*) FILTER (components_complete) AS components_complete,
                     count(*) FILTER (NOT components_complete) AS components_missing,
                     count(*) FILTER (NOT is_outlier AND NOT is_sold_out) AS output_quotes,
                     count(DISTINCT CASE WHEN NOT is_outlier AND NOT is_sold_out THEN (origin, destination, window_days, carrier) END) AS index_cells
              FROM survivors GROUP BY 1) s USING (scrape_date)
        JOIN (SELECT scrape_date, count(*) AS comparison_groups, count(*) FILTER (n < 5) AS groups_too_small_to_assess
              FROM (SELECT DISTINCT {GROUP}, n FROM scored) GROUP BY 1) g USING (scrape_date)"""
    ),
)
add(
    "a18_reject_reasons",
    lambda d: d.cleaned.reasons,
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, reject_reason, count(*) AS quotes FROM classified"
        " WHERE reject_reason IS NOT NULL GROUP BY ALL"
    ),
)
add(
    "i1_clean_quotes",
    lambda d: d.cleaned.index_prices,
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, origin, destination, window_days, carrier, {num('min(total_fare)')} AS price,"
        f" count(*) AS n_quotes FROM survivors WHERE NOT is_outlier AND NOT is_sold_out GROUP BY {GROUP}"
    ),
)
add(
    "k1_insert_absent_raw",
    lambda d: sinks.absent_rows(
        deduped(d).select(*S.QUOTE_IDENTITY, "ingest_seq"),
        deduped(d).filter(F.col("scrape_date") < "2024-01-16").select(*S.QUOTE_IDENTITY),
        S.QUOTE_IDENTITY,
    ).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("new_rows")),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS new_rows FROM deduped WHERE scrape_date >= DATE '2024-01-16' GROUP BY 1"
    ),
)
add(
    "k2_stored_fares",
    lambda d: d.fares.select("ingest_seq", "route_id", "is_outlier", "is_sold_out", "components_complete", "total_fare"),
    sql(
        f"SELECT ingest_seq, {big('route_id')} AS route_id, is_outlier, is_sold_out, components_complete,"
        f" {num('total_fare')} AS total_fare FROM fares"
    ),
)
add(
    "k3_canonical_route",
    lambda d: f.with_route(d.quotes, d.routes).groupBy("route_id").agg(F.count(F.lit(1)).alias("quotes")),
    sql(
        f"SELECT {big('route_id')} AS route_id, count(*) AS quotes FROM quotes q LEFT JOIN routes r"
        " ON r.origin = least(q.origin, q.destination) AND r.destination = greatest(q.origin, q.destination) GROUP BY 1"
    ),
)
add(
    "k3_unknown_routes",
    lambda d: f.unknown_routes(d.quotes, d.routes),
    sql(
        "SELECT least(q.origin, q.destination) AS origin, greatest(q.origin, q.destination) AS destination, count(*) AS quotes"
        " FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM routes r WHERE r.origin = least(q.origin, q.destination)"
        " AND r.destination = greatest(q.origin, q.destination)) GROUP BY 1, 2"
    ),
)


def raw_rows(d):
    return c.with_window(d.quotes)


_FARE_RULES = {
    "stops_not_negative": "stops >= 0",
    "base_fare_not_negative": "base_fare >= 0",
    "taxes_not_negative": "taxes >= 0",
    "udf_not_negative": "udf >= 0",
    "convenience_fee_not_negative": "convenience_fee >= 0",
    "other_charges_not_negative": "other_charges >= 0",
    "total_positive": "total_fare > 0",
    "fare_window_matches": "window_days = date_diff('day', scrape_date, departure_date)",
    "fare_od_differ": "origin <> destination",
    "fare_components_reconcile": "NOT components_complete OR (base_fare IS NOT NULL AND taxes IS NOT NULL AND abs(coalesce(base_fare,0)"
    " + coalesce(taxes,0) + coalesce(udf,0) + coalesce(convenience_fee,0) + coalesce(other_charges,0) - total_fare) <= 1.00)",
    "fare_outlier_has_method": "NOT is_outlier OR outlier_method IS NOT NULL",
    "fare_components_all_or_nothing": "components_complete OR (base_fare IS NULL AND taxes IS NULL AND udf IS NULL"
    " AND convenience_fee IS NULL AND other_charges IS NULL)",
}
add(
    "g1_fare_rules",
    lambda d: g.audit_rules("fare", d.fares),
    sql(
        " UNION ALL ".join(
            f"SELECT 'fare' AS table_name, '{r}' AS rule, count(*) FILTER (NOT coalesce({p}, true)) AS violations FROM fares"
            for r, p in _FARE_RULES.items()
        )
    ),
)
_RAW_RULES = {
    "raw_window_matches_dates": "window_days = date_diff('day', scrape_date, departure_date)",
    "raw_od_differ": "origin <> destination",
}
add(
    "g1_raw_quote_rules",
    lambda d: g.audit_rules("raw_quote", raw_rows(d)),
    sql(
        " UNION ALL ".join(
            f"SELECT 'raw_quote' AS table_name, '{r}' AS rule, count(*) FILTER (NOT coalesce({p}, true)) AS violations FROM classified"
            for r, p in _RAW_RULES.items()
        )
    ),
)
add(
    "g2_duplicate_quote_keys",
    lambda d: g.duplicate_keys(plausible(d), [k for k in S.QUOTE_IDENTITY if k != "fare_brand"]),
    sql(
        f"SELECT source_code, {day('scrape_date')} AS scrape_date, carrier, flight_number, {day('departure_date')} AS departure_date,"
        f" fare_class, {num('total_fare')} AS total_fare, count(*) AS copies FROM classified WHERE reject_reason IS NULL"
        " AND flight_number IS NOT NULL GROUP BY source_code, classified.scrape_date, carrier, flight_number,"
        " classified.departure_date, fare_class, classified.total_fare HAVING count(*) > 1"
    ),
)
_KEYED = {
    "route": ("routes", "origin, destination"),
    "advance_window": ("windows", "window_days"),
    "base_price": ("base", "route_id, window_days, carrier"),
    "headline": ("headline", "index_date, frequency"),
    "route_index": ("route_rows", "index_date, frequency, route_id"),
}
add(
    "g2_key_audit",
    lambda d: g.audit_keys({"route": d.routes, "advance_window": d.windows, "base_price": d.base, "headline": d.headline, "route_index": d.route_rows}),
    sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS duplicate_keys FROM (SELECT 1 FROM {v} GROUP BY {k} HAVING count(*) > 1)" for t, (v, k) in _KEYED.items()
        )
    ),
)
_HEAD_RULES = {
    "frequency_known": "frequency IN ('daily','weekly','monthly')",
    "value_positive": "index_value > 0",
    "cells_positive": "n_cells > 0",
    "coverage_in_unit": "coverage_ratio > 0 AND coverage_ratio <= 1",
    "pax_share_in_unit": "observed_pax_share > 0 AND observed_pax_share <= 1",
}
_BASE_RULES = {"base_positive": "base_price > 0", "observations_positive": "n_observations > 0"}
add(
    "g1_constraint_audit",
    lambda d: g.audit_all({"raw_quote": raw_rows(d), "fare": d.fares, "base_price": d.base, "headline": d.headline}),
    sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{r}' AS rule, count(*) FILTER (NOT coalesce({p}, true)) AS violations FROM {v}"
            for t, v, rules in (("raw_quote", "classified", _RAW_RULES), ("fare", "fares", _FARE_RULES), ("base_price", "base", _BASE_RULES), ("headline", "headline", _HEAD_RULES))
            for r, p in rules.items()
        )
    ),
)
add(
    "g2_reference_audit",
    lambda d: g.audit_references(
        [
            ("fare.route_id", d.fares, "route_id", d.routes, "route_id"),
            ("fare.window_days", d.fares, "window_days", d.windows, "window_days"),
            ("fare.carrier", d.fares, "carrier", d.shares, "carrier"),
            ("quote.window_days", raw_rows(d), "window_days", d.windows, "window_days"),
            ("event.customer", d.events, "user_id", d.table("customer"), "c_custkey"),
        ]
    ),
    sql(
        "SELECT 'fare.route_id' AS link, count(*) AS orphan_rows FROM fares WHERE route_id NOT IN (SELECT route_id FROM routes)"
        " UNION ALL SELECT 'fare.window_days', count(*) FROM fares WHERE window_days NOT IN (SELECT window_days FROM windows)"
        " UNION ALL SELECT 'fare.carrier', count(*) FROM fares WHERE carrier NOT IN (SELECT carrier FROM shares)"
        " UNION ALL SELECT 'quote.window_days', count(*) FROM classified WHERE window_days NOT IN (SELECT window_days FROM windows)"
        " UNION ALL SELECT 'event.customer', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)"
    ),
)
