"""Plans, gaps, cycle results and the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SUCCESS = ["ok", "sold_out", "no_flights"]
PLAN_KEY = ["origin", "destination", "window_days"]


def enabled_sources(sources: DataFrame, max_tier: int = 2) -> DataFrame:
    """Sources that may be collected: enabled and tier one or two; a missing tier counts as four."""
    return sources.filter(F.col("enabled") & (F.coalesce("tier", F.lit(4)) <= max_tier))


def narrow(routes: DataFrame, codes: list[str] | None) -> DataFrame:
    if not codes:
        return routes
    return routes.filter(F.upper("route_code").isin([c.upper() for c in codes]))


def expected_cells(
    sources: DataFrame, routes: DataFrame, windows: DataFrame, days: DataFrame,
    codes: list[str] | None = None, only_windows: list[int] | None = None,
) -> DataFrame:
    """Every (day, source, route, window) a cycle should collect.

    Sources and windows are registers of a few rows; they ride along as arrays and are
    exploded, so the plan is built without a cross join.
    """
    w = windows.filter(F.col("window_days").isin(only_windows)) if only_windows else windows
    ws = w.agg(F.array_sort(F.collect_set("window_days")).alias("x")).scalar()
    codes_in = sources.agg(F.array_sort(F.collect_set("code")).alias("x")).scalar()
    dates = days.select("scrape_date").distinct().agg(F.array_sort(F.collect_set("scrape_date")).alias("x")).scalar()
    plan = narrow(routes, codes).select("route_code", "origin", "destination")
    plan = plan.withColumn("_w", ws).withColumn("_s", codes_in).withColumn("_d", dates)
    plan = plan.select("route_code", "origin", "destination", "_s", "_d", F.explode("_w").alias("window_days"))
    plan = plan.select("route_code", "origin", "destination", "window_days", "_d", F.explode("_s").alias("source_code"))
    plan = plan.select("route_code", "origin", "destination", "window_days", "source_code", F.explode("_d").alias("scrape_date"))
    return plan.withColumn("departure_date", F.date_add("scrape_date", F.col("window_days")))


def valid_requests(plan: DataFrame) -> DataFrame:
    """Requests that make sense: two different ends and a departure after the observation."""
    return plan.filter((F.col("origin") != F.col("destination")) & (F.col("departure_date") > F.col("scrape_date")))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_distinct("source_code").alias("sources"),
        F.count_distinct("route_code").alias("routes"),
        F.array_sort(F.collect_set("window_days")).alias("windows"),
    )


def collected_keys(fares: DataFrame) -> DataFrame:
    """Cells that already hold fares: day, unordered pair, window; the source does not matter."""
    return fares.select(
        "scrape_date", F.least("origin", "destination").alias("_o"), F.greatest("origin", "destination").alias("_d"),
        F.col("window_days").alias("_w"),
    ).distinct()


def _on_cell(plan: DataFrame, fares: DataFrame, how: str) -> DataFrame:
    c = collected_keys(fares).withColumnRenamed("scrape_date", "_day")
    on = (
        (F.col("scrape_date") == F.col("_day"))
        & (F.least("origin", "destination") == F.col("_o"))
        & (F.greatest("origin", "destination") == F.col("_d"))
        & (F.col("window_days") == F.col("_w"))
    )
    return plan.join(c, on, how)


def missing_cells(plan: DataFrame, fares: DataFrame) -> DataFrame:
    return _on_cell(plan, fares, "left_anti")


def already_collected(plan: DataFrame, fares: DataFrame) -> DataFrame:
    return _on_cell(plan, fares, "left_semi")


def assess(plan: DataFrame, fares: DataFrame, today) -> DataFrame:
    """Per day: planned, collected, missing, and what can be done about the missing ones."""
    age = F.datediff(F.lit(today).cast("date"), "scrape_date")
    planned = plan.groupBy("scrape_date").agg(F.count(F.lit(1)).alias("planned"))
    missing = missing_cells(plan, fares).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("missing"))
    out = planned.join(missing, "scrape_date", "left").withColumn("missing", F.coalesce("missing", F.lit(0)))
    action = (
        F.when(age < 0, "refuse")
        .when(F.col("missing") == 0, "nothing_to_do")
        .when(age == 0, "recoverable")
        .otherwise("record_gap")
    )
    return out.select(
        "scrape_date", "planned", (F.col("planned") - F.col("missing")).alias("already_collected"), "missing",
        age.alias("age_days"), action.alias("action"),
    )


def gap_rows(plan: DataFrame, fares: DataFrame, today) -> DataFrame:
    """Cells of past days that can no longer be observed, as rows of the cell log."""
    lost = missing_cells(plan, fares).filter(F.col("scrape_date") < F.lit(today).cast("date"))
    note = F.concat(
        F.lit("collection cycle for "), F.col("scrape_date").cast("string"), F.lit(" did not complete; observed "),
        F.datediff(F.lit(today).cast("date"), "scrape_date").cast("string"), F.lit(" day(s) later"),
    )
    return lost.select(
        "scrape_date", "source_code", "origin", "destination", "window_days", "departure_date",
        F.lit(0).alias("attempts"), F.lit("missed").alias("outcome"), F.lit(0).alias("quotes"),
        note.alias("error_detail"),
    )


def gap_runs(gaps: DataFrame) -> DataFrame:
    """One backfill run row per day with recorded gaps."""
    return gaps.groupBy("scrape_date").agg(
        F.lit("backfill").alias("mode"),
        F.count(F.lit(1)).alias("planned_cells"),
        F.lit(0).alias("ok_cells"),
        F.count(F.lit(1)).alias("failed_cells"),
        F.min("error_detail").alias("notes"),
    )


def gap_report(cells: DataFrame, runs: DataFrame, start, end) -> DataFrame:
    """Recorded gaps per day in a range: cell log joined to its run."""
    hit = cells.filter(F.col("outcome") == "missed").join(
        runs.filter(F.col("scrape_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("scrape_date", "notes"),
        "scrape_date",
    )
    return hit.groupBy("scrape_date").agg(F.count(F.lit(1)).alias("missed_cells"), F.min("notes").alias("reason"))


def outcomes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("scrape_date", "outcome").agg(F.count(F.lit(1)).alias("cells"))


def run_totals(cells: DataFrame) -> DataFrame:
    """Closing totals of each cycle; sold-out and no-flight answers count as success."""
    good = F.col("outcome").isin(SUCCESS)
    return cells.groupBy("scrape_date").agg(
        F.count(F.lit(1)).alias("planned_cells"),
        F.count_if(good).alias("ok_cells"),
        F.count_if(~good).alias("failed_cells"),
        F.sum(F.when(F.col("outcome") == "ok", F.col("quotes")).otherwise(0)).alias("quotes_written"),
    )


def cell_results(plan: DataFrame, fares: DataFrame) -> DataFrame:
    """Cell log of executed cycles: quotes stored per planned cell, source included."""
    got = fares.groupBy(
        "scrape_date", "source_code", F.least("origin", "destination").alias("origin"),
        F.greatest("origin", "destination").alias("destination"), "window_days",
    ).agg(F.count_if(~F.col("is_sold_out")).alias("quotes"), F.count_if("is_sold_out").alias("sold_out"))
    out = plan.withColumns({"origin": F.least("origin", "destination"), "destination": F.greatest("origin", "destination")})
    out = out.join(got, ["scrape_date", "source_code", "origin", "destination", "window_days"], "left")
    outcome = F.when(F.col("quotes") > 0, "ok").when(F.col("sold_out") > 0, "sold_out").otherwise("failed")
    return out.select(
        "scrape_date", "source_code", "origin", "destination", "window_days", "departure_date",
        outcome.alias("outcome"), F.coalesce("quotes", F.lit(0)).alias("quotes"),
    )


def request_outcome(status: Column) -> Column:
    """Outcome of a sent request from its HTTP status."""
    return (
        F.when(status.isNull(), "timeout").when(status == 429, "rate_limited").when(status >= 400, "http_error").otherwise("ok")
    )


def with_outcome(requests: DataFrame) -> DataFrame:
    return requests.withColumn(
        "outcome",
        F.when(F.col("intent_denied"), "blocked_by_intent")
        .when(~F.col("robots_allowed"), "blocked_by_robots")
        .otherwise(request_outcome(F.col("http_status"))),
    )


def compliance_summary(audit: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence per source; delays cover sent requests, their minimum only positive ones."""
    sent = F.col("robots_allowed")
    delay = F.col("delay_applied_s")
    return (
        audit.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(sent).alias("requests_sent"),
            F.count_if(~sent).alias("robots_blocked"),
            F.count_if("intent_denied").alias("intent_blocked"),
            F.sum(F.when(sent, delay)).alias("_total"),
            F.min(F.when(sent & (delay > 0), delay)).alias("min_delay_s"),
            F.max(F.when(sent, delay)).alias("max_delay_s"),
            F.count_if(F.col("outcome") == "ok").alias("ok"),
            F.count_if(F.col("outcome").isin("http_error", "timeout", "rate_limited")).alias("errors"),
            F.min("requested_at").alias("first_request"),
            F.max("requested_at").alias("last_request"),
        )
        .join(sources.select(F.col("code").alias("source"), "tier", "audit_verdict"), "source")
        .withColumn("avg_delay_s", F.round(F.col("_total") / F.nullif(F.col("requests_sent"), F.lit(0)), 2))
        .withColumn("min_delay_s", F.round("min_delay_s", 2))
        .withColumn("max_delay_s", F.round("max_delay_s", 2))
        .drop("_total")
    )


def request_intervals(audit: DataFrame, min_delay: float) -> DataFrame:
    """Interval between consecutive sent requests of an origin, the first one zero.

    A busy origin may hold a third of the log, so rows are ordered only within one (origin,
    second). The predecessor of a second's first request comes from two small edge tables: the
    last request of each second, ordered within its hour, and of each hour, ordered per origin.
    """
    sent = audit.filter("robots_allowed").select(
        "request_id", "source", "requested_at",
        F.substring(F.col("requested_at").cast("string"), 1, 13).alias("_hour"),
        F.substring(F.col("requested_at").cast("string"), 15, 5).alias("_second"),
    )
    last = F.max("requested_at").alias("_last")
    seconds = sent.groupBy("source", "_hour", "_second").agg(last)
    hours = seconds.groupBy("source", "_hour").agg(F.max("_last").alias("_last"))
    in_hour = Window.partitionBy("source", "_hour").orderBy("_second")
    before_hour = hours.select(
        "source", "_hour", F.lag("_last").over(Window.partitionBy("source").orderBy("_hour")).alias("_before_hour")
    )
    before = (
        seconds.withColumn("_before_second", F.lag("_last").over(in_hour))
        .join(before_hour, ["source", "_hour"])
        .select("source", "_hour", "_second", F.coalesce("_before_second", "_before_hour").alias("_before"))
    )
    within = Window.partitionBy("source", "_hour", "_second").orderBy("requested_at", "request_id")
    rows = sent.withColumn("_prev", F.lag("requested_at").over(within)).join(before, ["source", "_hour", "_second"])
    rows = rows.withColumn("_prev", F.coalesce("_prev", "_before"))
    gap = F.expr("cast(cast(requested_at - _prev as interval second) as decimal(18,6))").cast("double")
    return rows.select(
        "request_id", "source", "requested_at",
        F.coalesce(gap, F.lit(0.0)).alias("interval_s"),
        F.col("_prev").isNull().alias("is_first"),
    ).withColumn("below_floor", ~F.col("is_first") & (F.col("interval_s") < min_delay))


def interval_floor(min_delay: Column, crawl_delay: Column) -> Column:
    """The pause a source asked for, never below our own."""
    return F.greatest(min_delay, crawl_delay)


def intervals_by_floor(audit: DataFrame, delays: DataFrame) -> DataFrame:
    """Intervals judged by each source's own floor; delays: source, min_delay, crawl_delay (null: none asked for)."""
    floors = delays.select("source", interval_floor(F.col("min_delay"), F.col("crawl_delay")).alias("floor_s"))
    rows = request_intervals(audit, 0.0).drop("below_floor").join(floors, "source", "left")
    return rows.withColumn("below_floor", ~F.col("is_first") & F.coalesce(F.col("interval_s") < F.col("floor_s"), F.lit(False)))


def cells_with_run(gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """Every missed cell beside the run row of its day; a cell whose day has no run row keeps nulls."""
    run = runs.select("scrape_date", *[F.col(c).alias(f"run_{c}") for c in runs.columns if c != "scrape_date"])
    return gaps.join(run, "scrape_date", "left")


def excluded_and_pending(sources: DataFrame) -> DataFrame:
    """Disabled sources, split into excluded on principle (tier three up) and not built yet."""
    rows = sources.filter(~F.col("enabled") & ~F.col("code").isin("seed", "__robots__"))
    return rows.select(
        "code", "kind", "tier", "audit_verdict", "exclusion_reason",
        F.when(F.col("tier") >= 3, "excluded").otherwise("pending").alias("status"),
    )


def public_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(~F.startswith("code", F.lit("__")))


def newest_requests(audit: DataFrame, limit: int = 200, source: str | None = None) -> DataFrame:
    """The latest part of the request log, as a top-k report."""
    if not 1 <= limit <= 2000:
        raise ValueError("limit must lie in 1..2000")
    rows = audit.filter(F.col("source") == source) if source else audit
    return rows.orderBy(F.desc("requested_at"), F.desc("request_id")).limit(limit)
