"""Constraint, key and reference audits over tables, and provenance of published rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# The schema's row rules by table, as SQL predicates that must not be false.
RULES: dict[str, dict[str, str]] = {
    "airport": {"airport_iata_upper": "iata = upper(iata)"},
    "route": {"route_canonical": "origin < destination"},
    "route_weight": {
        "passengers_not_negative": "passengers >= 0",
        "weight_in_unit": "weight >= 0 AND weight <= 1",
        "weight_ref_order": "weight_ref_end > weight_ref_start",
    },
    "advance_window": {
        "window_in_year": "window_days > 0 AND window_days <= 365",
        "weight_in_unit": "weight >= 0 AND weight <= 1",
    },
    "source": {
        "kind_known": "kind IN ('airline','ota','gds_api','official')",
        "tier_known": "tier BETWEEN 1 AND 4",
        "verdict_known": "audit_verdict IN ('scrape_ok','scrape_with_caution','do_not_scrape','licensed_api')",
        "source_excluded_needs_reason": "enabled OR exclusion_reason IS NOT NULL",
    },
    "request_audit": {
        "outcome_known": "outcome IN ('ok','blocked_by_robots','blocked_by_intent','rate_limited','http_error',"
        "'timeout','parse_error','no_flights','captcha')",
        "audit_no_disallowed_fetch": "robots_allowed OR outcome IN ('blocked_by_robots','blocked_by_intent')",
        "audit_intent_consistent": "NOT intent_denied OR outcome = 'blocked_by_intent'",
        "delay_not_negative": "delay_applied_s >= 0",
    },
    "collection_run": {
        "mode_known": "mode IN ('scheduled','manual','backfill','dry_run')",
        "collection_run_counts_sane": "ok_cells + failed_cells <= planned_cells",
    },
    "collection_cell": {
        "window_positive": "window_days > 0",
        "outcome_known": "outcome IN ('ok','sold_out','no_flights','refused','failed','missed','skipped','planned')",
        "collection_cell_quotes_need_success": "quotes = 0 OR outcome = 'ok'",
    },
    "raw_quote": {
        "raw_window_matches_dates": "window_days = datediff(departure_date, scrape_date)",
        "raw_od_differ": "origin <> destination",
    },
    "fare": {
        "stops_not_negative": "stops >= 0",
        "base_fare_not_negative": "base_fare >= 0",
        "taxes_not_negative": "taxes >= 0",
        "udf_not_negative": "udf >= 0",
        "convenience_fee_not_negative": "convenience_fee >= 0",
        "other_charges_not_negative": "other_charges >= 0",
        "total_positive": "total_fare > 0",
        "fare_window_matches": "window_days = datediff(departure_date, scrape_date)",
        "fare_od_differ": "origin <> destination",
        "fare_components_reconcile": "NOT components_complete OR (base_fare IS NOT NULL AND taxes IS NOT NULL AND"
        " abs(coalesce(base_fare,0) + coalesce(taxes,0) + coalesce(udf,0) + coalesce(convenience_fee,0)"
        " + coalesce(other_charges,0) - total_fare) <= 1.00)",
        "fare_outlier_has_method": "NOT is_outlier OR outlier_method IS NOT NULL",
        "fare_components_all_or_nothing": "components_complete OR (base_fare IS NULL AND taxes IS NULL AND udf IS NULL"
        " AND convenience_fee IS NULL AND other_charges IS NULL)",
    },
    "base_price": {"base_positive": "base_price > 0", "observations_positive": "n_observations > 0"},
    "elementary_index": {
        "value_positive": "index_value > 0",
        "carriers_positive": "n_carriers > 0",
        "quotes_positive": "n_quotes > 0",
        "elem_imputed_has_note": "NOT is_imputed OR imputation_note IS NOT NULL",
    },
    "headline": {
        "frequency_known": "frequency IN ('daily','weekly','monthly')",
        "value_positive": "index_value > 0",
        "cells_positive": "n_cells > 0",
        "coverage_in_unit": "coverage_ratio > 0 AND coverage_ratio <= 1",
        "pax_share_in_unit": "observed_pax_share > 0 AND observed_pax_share <= 1",
    },
    "route_index": {"frequency_known": "frequency IN ('daily','weekly','monthly')", "value_positive": "index_value > 0"},
    "cpi_reference": {"sector_known": "sector IN ('rural','urban','combined')"},
    "fare_reference": {"avg_fare_positive": "avg_fare > 0"},
}

KEYS: dict[str, list[str]] = {
    "airport": ["iata"],
    "route": ["origin", "destination"],
    "route_weight": ["route_id", "weight_ref_start"],
    "advance_window": ["window_days"],
    "source": ["code"],
    "collection_cell": ["scrape_date", "source_code", "origin", "destination", "window_days"],
    "base_price": ["route_id", "window_days", "carrier", "price_ref_start"],
    "elementary_index": ["route_id", "window_days", "index_date"],
    "headline": ["index_date", "frequency"],
    "route_index": ["index_date", "frequency", "route_id"],
    "cpi_reference": ["series_code", "ref_month", "sector", "base_year"],
    "fare_reference": ["route_id", "ref_month"],
}
# End of fixed values.


def audit_rules(table: str, rows: DataFrame) -> DataFrame:
    """Violations per rule in one pass; as in SQL, an unknown (null) outcome is no violation."""
    rules = RULES[table]
    counts = rows.agg(*[F.count_if(~F.coalesce(F.expr(p), F.lit(True))).alias(r) for r, p in rules.items()])
    pairs = ", ".join(f"'{r}', `{r}`" for r in rules)
    return counts.selectExpr(f"'{table}' as table_name", f"stack({len(rules)}, {pairs}) as (rule, violations)")


def violations(table: str, rows: DataFrame, rule: str) -> DataFrame:
    return rows.filter(~F.coalesce(F.expr(RULES[table][rule]), F.lit(True)))


def audit_all(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [audit_rules(t, df) for t, df in tables.items()])


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; null keys never clash."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rows.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def orphans(rows: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values that point at no parent row, with the number of rows that hold them."""
    held = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    return held.join(parent.select(F.col(parent_key).alias("value")).distinct(), "value", "left_anti")


def audit_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of clashing keys per table."""
    parts = [
        duplicate_keys(df, KEYS[t]).agg(F.count(F.lit(1)).alias("duplicate_keys")).select(F.lit(t).alias("table_name"), "duplicate_keys")
        for t, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def audit_references(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Rows without a parent, per named link (name, child, column, parent, key)."""
    parts = [
        orphans(child, column, parent, key).agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("orphan_rows")).select(
            F.lit(name).alias("link"), "orphan_rows"
        )
        for name, child, column, parent, key in links
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def provenance(fares: DataFrame, headline: DataFrame, seed_source: str = "seed") -> DataFrame:
    """Seeded and live row counts, the span of the daily index, latest coverage and share."""
    rows = fares.agg(
        F.count_if(F.col("source_code") == seed_source).alias("seeded_fare_rows"),
        F.count_if(F.col("source_code") != seed_source).alias("live_fare_rows"),
    )
    span = headline.filter("frequency = 'daily'").agg(
        F.min("index_date").alias("first_index_date"),
        F.max("index_date").alias("last_index_date"),
        F.max_by("coverage_ratio", "index_date").cast("double").alias("latest_coverage"),
        F.max_by("observed_pax_share", "index_date").cast("double").alias("latest_pax_share"),
    )
    out = rows.withColumn("_s", span.select(F.struct("*")).scalar())
    return out.select("seeded_fare_rows", "live_fare_rows", "_s.*").withColumn("seeded", F.col("seeded_fare_rows") > 0)


def attach_provenance(rows: DataFrame, prov: DataFrame, price_reference: str, weight_reference: str) -> DataFrame:
    """Carry basis, reference periods and coverage on every published row."""
    one = rows.withColumn("_p", prov.select(F.struct("seeded", "latest_coverage", "latest_pax_share")).scalar())
    return one.select(
        *rows.columns,
        F.col("_p.seeded").alias("is_seeded"),
        F.lit(price_reference).alias("price_reference"),
        F.lit(weight_reference).alias("weight_reference"),
        F.col("_p.latest_coverage").alias("basket_coverage"),
        F.col("_p.latest_pax_share").alias("observed_share"),
    )


def collection_health(fares: DataFrame, runs: DataFrame, headline: DataFrame, seed_source: str = "seed") -> DataFrame:
    """Live, synthetic or empty; days of real data; the latest run and whether it was real."""
    real = F.col("source_code") != seed_source
    days = fares.agg(
        F.count_distinct(F.when(real, F.col("scrape_date"))).alias("days_of_real_data"),
        F.max(F.when(real, F.col("scrape_date"))).alias("last_real_scrape"),
    )
    real_days = fares.filter(real).select("scrape_date").distinct().withColumn("is_real", F.lit(True))
    last = (
        runs.join(real_days, "scrape_date", "left")
        .agg(F.max_by(F.struct("scrape_date", "planned_cells", "ok_cells", "failed_cells", "is_real"), "scrape_date").alias("r"))
        .select("r")
    )
    share = headline.filter("frequency = 'daily' AND observed_pax_share IS NOT NULL").agg(
        F.max_by("observed_pax_share", "index_date").cast("double").alias("s")
    )
    out = days.withColumn("r", last.scalar()).withColumn("observed_pax_share", share.scalar())
    status = (
        F.when(F.col("days_of_real_data") > 0, "live").when(F.col("r").isNull(), "no_data").otherwise("synthetic")
    )
    return out.select(
        status.alias("status"), "days_of_real_data", "last_real_scrape",
        F.col("r.scrape_date").alias("last_run_date"), F.col("r.planned_cells").alias("planned_cells"),
        F.col("r.ok_cells").alias("ok_cells"), F.col("r.failed_cells").alias("failed_cells"),
        F.coalesce("r.is_real", F.lit(False)).alias("last_run_is_real"), "observed_pax_share",
    )
