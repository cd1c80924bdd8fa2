"""Composed outputs: the published result sets and the back-test."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricemesh.operators import anomalies, collection, elasticity, governance, leadtime, nowcast, serving, validation
from pricemesh.operators import fares as fare_ops
from pricemesh.operators import index as index_ops
from pricemesh.operators import series as series_ops
from pricemesh.plans.domain import PRICE_REF_END, PRICE_REF_START, Domain
from pricemesh.sources import defaults


def headline_series(d: Domain) -> DataFrame:
    return d.headline.filter("frequency = 'daily'").select(
        F.lit("headline").alias("series_id"), "index_date", F.col("index_value").cast("double").alias("value")
    )


def result_sets(d: Domain) -> dict[str, DataFrame]:
    """The published result sets by name."""
    series = headline_series(d)
    stats = leadtime.leadtime_stats(d.usable, d.routes)
    fits = elasticity.parameters(
        elasticity.fit_routes(leadtime.with_code(d.usable, d.routes), ["route_code"]), ["route_code"]
    )
    audit = collection.with_outcome(d.requests)
    return {
        "series": d.headline,
        "routes": d.route_rows.join(d.routes.select("route_id", "route_code", "origin", "destination"), "route_id"),
        "leadtime": serving.cells(index_ops.stored_elementary(d.elementary), d.routes),
        "leadtime_fares": stats,
        "fares_daily": leadtime.leadtime_by_day(d.usable, d.routes),
        "leadtime_fit": fits,
        "anomalies": anomalies.detect_and_group(series),
        "nowcast": nowcast.scoreboard(nowcast.evaluate(series, min_train=14)),
        "compliance": collection.compliance_summary(audit, d.sources),
        "sources": collection.public_sources(d.sources),
        "basket": serving.basket(d.routes, defaults.airports(d.spark), d.route_weights, defaults.WEIGHT_REF_START),
        "windows": d.windows.filter("in_basket"),
        "cpi_dispersion": series_ops.dispersion(series),
        "provenance": governance.provenance(d.fares, d.headline),
        "cleaning_report": d.cleaned.report(),
    }


def backtest(d: Domain) -> dict[str, DataFrame]:
    """Identity checks, robustness, benchmark and coverage of one build."""
    daily = d.headline.filter("frequency = 'daily'")
    monthly = d.headline.filter("frequency = 'monthly'")
    checks = validation.roll_up(
        [
            validation.base_period(daily, PRICE_REF_START, PRICE_REF_END),
            validation.temporal(daily, monthly, "monthly"),
            validation.contributions(daily, d.route_rows.filter("frequency = 'daily'")),
            validation.coverage_reported(daily),
        ]
    )
    robustness = validation.window_weight_robustness(d.elementary, d.route_weights, defaults.scenarios(d.spark))
    concepts = validation.price_concept_robustness(fare_ops.prices_by_concept(d.fares), d.base, d.weights)
    bench = validation.benchmark_naive(daily, fare_ops.naive_mean(d.fares))
    span = daily.agg(
        F.min("index_date").alias("start"), F.max("index_date").alias("end"), F.count(F.lit(1)).alias("n_days"),
        F.max_by("coverage_ratio", "index_date").alias("coverage_latest"),
        F.max_by("observed_pax_share", "index_date").alias("pax_share_latest"),
    ).withColumn("meets_30_days", F.col("n_days") >= 30)
    as_rows = lambda part, df: df.select(F.lit(part).alias("part"), F.to_json(F.struct("*")).alias("content"))
    payload = as_rows("checks", checks)
    for part, df in (("robustness", robustness), ("concepts", concepts), ("benchmark", bench), ("span", span)):
        payload = payload.unionByName(as_rows(part, df))
    return {
        "checks": checks, "robustness": robustness, "concepts": concepts, "benchmark": bench, "span": span,
        "summary": validation.summarise(checks), "payload": payload,
    }
