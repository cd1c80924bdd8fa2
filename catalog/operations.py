"""Plans, gaps, request log, robots rules, provenance and streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import add
from catalog.views import big, day, num, sql, text_list
from pricemesh import staging
from pricemesh.operators import collection as c
from pricemesh.operators import governance as g
from pricemesh.operators import robots as r
from pricemesh.operators import serving as q
from pricemesh.plans.domain import quotes_from_events
from pricemesh.sources import defaults, sinks
from pricemesh.streaming import closing, ingest

TODAY = "2024-01-30"


def audit(d):
    return c.with_outcome(d.requests)


def quote_sources(d):
    return d.quotes.select(F.col("source_code").alias("code")).distinct()


def plan(d):
    return c.expected_cells(quote_sources(d), d.routes, d.windows, d.days)


PLAN = """
    SELECT route_code, origin, destination, window_days, source_code, scrape_date, cast(scrape_date + cast(window_days AS integer) AS date) AS departure_date
    FROM routes CROSS JOIN windows CROSS JOIN (SELECT DISTINCT source_code FROM quotes) CROSS JOIN days"""
HAVE = """
    SELECT DISTINCT scrape_date, least(origin, destination) AS o, greatest(origin, destination) AS d, window_days FROM fares"""
MISS = """
    SELECT * FROM plan p WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.scrape_date = p.scrape_date AND h.o = p.origin
        AND h.d = p.destination AND h.window_days = p.window_days)"""
V = dict(plan=PLAN, have=HAVE, miss=MISS)
PLAN_COLS = f"route_code, {big('window_days')} AS window_days, source_code, {day('scrape_date')} AS scrape_date"

add(
    "i8_expected_cells",
    lambda d: plan(d).select("route_code", "window_days", "source_code", "scrape_date", "departure_date"),
    sql(f"SELECT {PLAN_COLS}, {day('departure_date')} AS departure_date FROM plan", **V),
)
add(
    "x35_departure_dates",
    lambda d: plan(d).groupBy("departure_date").agg(F.count(F.lit(1)).alias("cells")),
    sql(f"SELECT {day('departure_date')} AS departure_date, count(*) AS cells FROM plan GROUP BY 1", **V),
)
add(
    "p13_plan_narrowing",
    lambda d: c.expected_cells(quote_sources(d), d.routes, d.windows, d.days, ["blr-del", "BOM-DEL"], [7, 30]).groupBy("route_code", "window_days").agg(
        F.count(F.lit(1)).alias("cells")
    ),
    sql(
        f"SELECT route_code, {big('window_days')} AS window_days, count(*) AS cells FROM plan WHERE route_code IN ('BLR-DEL', 'BOM-DEL')"
        " AND plan.window_days IN (7, 30) GROUP BY ALL",
        **V,
    ),
)
add(
    "p17_valid_requests",
    lambda d: c.valid_requests(d.quotes).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("valid")),
    sql(f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS valid FROM quotes WHERE origin <> destination AND departure_date > quotes.scrape_date GROUP BY 1"),
)
add(
    "a27_plan_summary",
    lambda d: c.plan_summary(plan(d)),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS cells, count(DISTINCT source_code) AS sources, count(DISTINCT route_code) AS routes,"
        f" {text_list('list_sort(list(DISTINCT window_days))')} AS windows FROM plan GROUP BY 1",
        **V,
    ),
)
add("j5_missing_cells", lambda d: c.missing_cells(plan(d), d.fares).select("route_code", "window_days", "source_code", "scrape_date"), sql(f"SELECT {PLAN_COLS} FROM miss", **V))
add("u4_planned_minus_collected", lambda d: c.missing_cells(plan(d), d.fares).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("missing")), sql(
    f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS missing FROM miss GROUP BY 1", **V))
add(
    "j6_already_collected",
    lambda d: c.already_collected(plan(d), d.fares).groupBy("route_code", "window_days").agg(F.count(F.lit(1)).alias("cells")),
    sql(
        f"SELECT route_code, {big('p.window_days')} AS window_days, count(*) AS cells FROM plan p JOIN have h ON h.scrape_date = p.scrape_date"
        " AND h.o = p.origin AND h.d = p.destination AND h.window_days = p.window_days GROUP BY ALL",
        **V,
    ),
)
ASSESS = """
    SELECT scrape_date, count(*) AS planned, count(*) FILTER (m) AS missing, date_diff('day', scrape_date, DATE '2024-01-30') AS age
    FROM (SELECT p.*, NOT EXISTS (SELECT 1 FROM have h WHERE h.scrape_date = p.scrape_date AND h.o = p.origin AND h.d = p.destination
          AND h.window_days = p.window_days) AS m FROM plan p) GROUP BY 1"""
add(
    "i10_backfill_assessment",
    lambda d: c.assess(plan(d), d.fares, TODAY),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, planned, planned - missing AS already_collected, missing, age AS age_days,"
        " CASE WHEN age < 0 THEN 'refuse' WHEN missing = 0 THEN 'nothing_to_do' WHEN age = 0 THEN 'recoverable' ELSE 'record_gap' END AS action FROM assess",
        assess=ASSESS, **V,
    ),
)
add(
    "k11_gap_rows",
    lambda d: c.gap_rows(plan(d), d.fares, TODAY).groupBy("scrape_date", "outcome", "error_detail").agg(F.count(F.lit(1)).alias("cells")),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, 'missed' AS outcome, 'collection cycle for ' || {day('scrape_date')} || ' did not complete; observed '"
        " || date_diff('day', scrape_raw, DATE '2024-01-30') || ' day(s) later' AS error_detail, count(*) AS cells"
        " FROM (SELECT *, miss.scrape_date AS scrape_raw FROM miss) WHERE scrape_raw < DATE '2024-01-30' GROUP BY ALL",
        **V,
    ),
)


def gaps(d):
    return c.gap_rows(plan(d), d.fares, TODAY)


GAPS = f"""
    SELECT {day('scrape_date')} AS scrape_date, count(*) AS missed_cells, min('collection cycle for ' || {day('scrape_date')} || ' did not complete; observed '
           || date_diff('day', scrape_raw, DATE '2024-01-30') || ' day(s) later') AS reason
    FROM (SELECT *, miss.scrape_date AS scrape_raw FROM miss) WHERE scrape_raw BETWEEN DATE '2024-01-05' AND DATE '2024-01-29' GROUP BY 1"""
add("a23_gap_report", lambda d: c.gap_report(gaps(d), c.gap_runs(gaps(d)), "2024-01-05", "2024-01-29"), sql(GAPS, **V))


def results(d):
    return c.cell_results(plan(d), d.fares)


RES = """
    SELECT p.scrape_date, p.source_code, p.window_days, p.origin, p.destination, coalesce(quotes, 0) AS quotes,
           CASE WHEN quotes > 0 THEN 'ok' WHEN sold > 0 THEN 'sold_out' ELSE 'failed' END AS outcome
    FROM plan p LEFT JOIN (SELECT scrape_date, source_code, least(origin, destination) AS o, greatest(origin, destination) AS d, window_days,
                                  count(*) FILTER (NOT is_sold_out) AS quotes, count(*) FILTER (is_sold_out) AS sold FROM fares GROUP BY ALL) f
         ON f.scrape_date = p.scrape_date AND f.source_code = p.source_code AND f.o = p.origin AND f.d = p.destination AND f.window_days = p.window_days"""
add(
    "j10_cells_with_run",
    lambda d: c.cells_with_run(gaps(d), c.run_totals(results(d))).groupBy("scrape_date", "run_planned_cells", "run_ok_cells", "run_quotes_written").agg(
        F.count(F.lit(1)).alias("missed_cells")
    ),
    sql(
        f"""
        SELECT {day('g.d')} AS scrape_date, planned AS run_planned_cells, ok AS run_ok_cells, {big('written')} AS run_quotes_written, missed_cells
        FROM (SELECT miss.scrape_date AS d, count(*) AS missed_cells FROM miss WHERE miss.scrape_date < DATE '2024-01-30' GROUP BY 1) g
        LEFT JOIN (SELECT scrape_date, count(*) AS planned, count(*) FILTER (outcome IN ('ok', 'sold_out', 'no_flights')) AS ok, sum(quotes) AS written FROM res GROUP BY 1) r
             ON r.scrape_date = g.d""",
        res=RES, **V,
    ),
)
add("a22_outcome_histogram", lambda d: c.outcomes(results(d)), sql(
    f"SELECT {day('scrape_date')} AS scrape_date, outcome, count(*) AS cells FROM res GROUP BY ALL", res=RES, **V))
add(
    "k12_run_totals",
    lambda d: c.run_totals(results(d)),
    sql(
        f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS planned_cells, count(*) FILTER (outcome IN ('ok', 'sold_out', 'no_flights')) AS ok_cells,"
        f" count(*) FILTER (outcome NOT IN ('ok', 'sold_out', 'no_flights')) AS failed_cells, {big('sum(quotes)')} AS quotes_written FROM res GROUP BY 1",
        res=RES, **V,
    ),
)

# Request log.
add("x28_request_outcome", lambda d: audit(d).select("request_id", "outcome"), sql("SELECT request_id, outcome FROM audit"))
SQL_COMPLIANCE = sql(
    f"""
    SELECT source, {big('tier')} AS tier, audit_verdict, count(*) AS requests, count(*) FILTER (robots_allowed) AS requests_sent,
           count(*) FILTER (NOT robots_allowed) AS robots_blocked, count(*) FILTER (intent_denied) AS intent_blocked,
           {num('round(cast(sum(delay_applied_s) FILTER (robots_allowed) AS double) / count(*) FILTER (robots_allowed), 2)')} AS avg_delay_s,
           {num('round(min(delay_applied_s) FILTER (robots_allowed AND delay_applied_s > 0), 2)')} AS min_delay_s,
           {num('round(max(delay_applied_s) FILTER (robots_allowed), 2)')} AS max_delay_s, count(*) FILTER (outcome = 'ok') AS ok,
           count(*) FILTER (outcome IN ('http_error', 'timeout', 'rate_limited')) AS errors,
           cast(min(requested_at) AS varchar) AS first_request, cast(max(requested_at) AS varchar) AS last_request
    FROM audit JOIN registry ON code = source GROUP BY 1, 2, 3"""
)
add("a17_compliance_summary", lambda d: c.compliance_summary(audit(d), d.sources), SQL_COMPLIANCE)
def compliance_answer(d):
    """All public sources: those that were asked with their figures, disabled ones as excluded or pending."""
    used = c.compliance_summary(audit(d), d.sources).select(F.col("source").alias("code"), "requests", "requests_sent", "robots_blocked", "ok", "errors")
    off = c.excluded_and_pending(d.sources).select("code", "status", "exclusion_reason")
    rows = c.public_sources(d.sources).select("code", "tier").join(used, "code", "left").join(off, "code", "left")
    return rows.withColumn("status", F.coalesce("status", F.when(F.col("code") == "seed", "synthetic").otherwise("active")))


add(
    "q10_compliance",
    compliance_answer,
    sql(
        f"""
        SELECT code, {big('tier')} AS tier, count(source) FILTER (source IS NOT NULL) + CASE WHEN count(source) = 0 THEN NULL ELSE 0 END AS requests,
               CASE WHEN count(source) > 0 THEN count(*) FILTER (robots_allowed) END AS requests_sent,
               CASE WHEN count(source) > 0 THEN count(*) FILTER (NOT robots_allowed) END AS robots_blocked,
               CASE WHEN count(source) > 0 THEN count(*) FILTER (outcome = 'ok') END AS ok,
               CASE WHEN count(source) > 0 THEN count(*) FILTER (outcome IN ('http_error', 'timeout', 'rate_limited')) END AS errors,
               CASE WHEN code = 'seed' THEN 'synthetic' WHEN enabled THEN 'active' WHEN tier >= 3 THEN 'excluded' ELSE 'pending' END AS status,
               CASE WHEN NOT enabled AND code <> 'seed' THEN exclusion_reason END AS exclusion_reason
        FROM registry LEFT JOIN audit ON source = code WHERE code NOT LIKE '\\_\\_%' ESCAPE '\\' GROUP BY ALL"""
    ),
)
DELAYS = [("click", 6.0, 5.0), ("error", 6.0, 8.0), ("purchase", 6.0, None), ("signup", 3.0, 12.5), ("view", 9.0, 2.0)]


def delays(d):
    return d.spark.createDataFrame(DELAYS, "source string, min_delay double, crawl_delay double")


FLOOR = "CASE source " + " ".join(f"WHEN '{s}' THEN {max(x for x in (a, b) if x is not None)}" for s, a, b in DELAYS) + " END"
add(
    "w12_intervals_by_source_floor",
    lambda d: c.intervals_by_floor(audit(d), delays(d)).select("request_id", "floor_s", "below_floor"),
    sql(
        f"""
        SELECT request_id, {num(FLOOR)} AS floor_s, coalesce((epoch_us(requested_at) - epoch_us(p)) / 1000000.0 < {FLOOR}, false) AS below_floor
        FROM (SELECT *, lag(requested_at) OVER (PARTITION BY source ORDER BY requested_at, request_id) AS p FROM audit WHERE robots_allowed)"""
    ),
)
add(
    "j9_audit_with_source",
    lambda d: audit(d).join(d.sources.withColumnRenamed("code", "source"), "source").groupBy("source", "kind", "tier").agg(F.count(F.lit(1)).alias("requests")),
    sql(f"SELECT source, kind, {big('tier')} AS tier, count(*) AS requests FROM audit JOIN registry ON code = source GROUP BY ALL"),
)
add(
    "w12_request_intervals",
    lambda d: c.request_intervals(audit(d), 6.0).select("request_id", "interval_s", "is_first", "below_floor"),
    sql(
        f"""
        SELECT request_id, {num('coalesce(epoch_us(requested_at) - epoch_us(p), 0) / 1000000.0')} AS interval_s, p IS NULL AS is_first,
               coalesce((epoch_us(requested_at) - epoch_us(p)) / 1000000.0 < 6.0, false) AS below_floor
        FROM (SELECT *, lag(requested_at) OVER (PARTITION BY source ORDER BY requested_at, request_id) AS p FROM audit WHERE robots_allowed)"""
    ),
)
add(
    "o1_newest_requests",
    lambda d: c.newest_requests(audit(d), 200).select("request_id", "source", "outcome"),
    sql("SELECT request_id, source, outcome FROM audit ORDER BY requested_at DESC, request_id DESC LIMIT 200"),
)
add(
    "q11_request_log_of_source",
    lambda d: c.newest_requests(audit(d), 50, "view").select("request_id", "requested_at", "http_status", "outcome"),
    sql(
        f"SELECT request_id, cast(requested_at AS varchar) AS requested_at, {big('http_status')} AS http_status, outcome FROM audit WHERE source = 'view'"
        " ORDER BY audit.requested_at DESC, request_id DESC LIMIT 50"
    ),
)
add(
    "p9_public_sources_in_log",
    lambda d: audit(d).join(c.public_sources(d.sources).select(F.col("code").alias("source")), "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("requests")),
    sql("SELECT source, count(*) AS requests FROM audit WHERE source IN (SELECT code FROM registry WHERE code NOT LIKE '\\_\\_%' ESCAPE '\\') GROUP BY 1"),
)
add(
    "p10_excluded_and_pending",
    lambda d: c.excluded_and_pending(d.sources).join(d.requests.groupBy(F.col("source").alias("code")).agg(F.count(F.lit(1)).alias("requests")), "code"),
    sql(
        f"SELECT code, kind, {big('tier')} AS tier, audit_verdict, exclusion_reason, CASE WHEN tier >= 3 THEN 'excluded' ELSE 'pending' END AS status, requests"
        " FROM registry JOIN (SELECT source AS code, count(*) AS requests FROM audit GROUP BY 1) USING (code) WHERE NOT enabled AND code NOT IN ('seed', '__robots__')"
    ),
)
add(
    "p11_enabled_sources",
    lambda d: d.requests.join(c.enabled_sources(d.sources).select(F.col("code").alias("source"), "tier"), "source").groupBy("source", "tier").agg(F.count(F.lit(1)).alias("requests")),
    sql(f"SELECT source, {big('tier')} AS tier, count(*) AS requests FROM audit JOIN registry ON code = source WHERE enabled AND coalesce(tier, 4) <= 2 GROUP BY ALL"),
)
add(
    "g3_log_rules",
    lambda d: g.audit_rules("request_audit", audit(d).withColumn("robots_allowed", F.col("robots_allowed") | (F.col("request_id") % 57 == 0))
                            .withColumn("outcome", F.when(F.col("request_id") % 38 == 0, "ok").otherwise(F.col("outcome")))),
    sql(
        """
        SELECT 'request_audit' AS table_name, 'outcome_known' AS rule, 0 AS violations
        UNION ALL SELECT 'request_audit', 'audit_no_disallowed_fetch', count(*) FILTER (NOT (robots_allowed OR outcome IN ('blocked_by_robots', 'blocked_by_intent'))) FROM broken
        UNION ALL SELECT 'request_audit', 'audit_intent_consistent', count(*) FILTER (NOT (NOT intent_denied OR outcome = 'blocked_by_intent')) FROM broken
        UNION ALL SELECT 'request_audit', 'delay_not_negative', count(*) FILTER (delay_applied_s < 0) FROM broken""",
        broken="""SELECT request_id, robots_allowed OR request_id % 57 = 0 AS robots_allowed, intent_denied, delay_applied_s,
                         CASE WHEN request_id % 38 = 0 THEN 'ok' ELSE outcome END AS outcome FROM audit""",
    ),
)
add(
    "k13_registered_log_rows",
    lambda d: sinks.require_registered(audit(d), d.sources).groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("row_count")),
    sql("SELECT source, outcome, count(*) AS row_count FROM audit GROUP BY ALL"),
)


def log_append(d):
    """The log of every day appended in two halves; a second table gets it in one."""
    out = folder(d)
    rows = audit(d)
    for k in (0, 1):
        sinks.append_requests(d.spark, rows.filter(F.col("request_id") % 2 == k), d.sources, f"{out}/log")
    return d.spark.read.parquet(f"{out}/log").groupBy("log_date", "source", "outcome").agg(F.count(F.lit(1)).alias("row_count"), F.sum("delay_applied_s").alias("delay"))


add(
    "k13_request_log_append",
    log_append,
    sql(f"SELECT {day('requested_at')} AS log_date, source, outcome, count(*) AS row_count, {num('sum(delay_applied_s)')} AS delay FROM audit GROUP BY ALL"),
)

# Provenance and health.
add(
    "a24_provenance",
    lambda d: g.provenance(d.fares, d.headline),
    sql(
        f"SELECT s AS seeded_fare_rows, l AS live_fare_rows, {day('mn')} AS first_index_date, {day('mx')} AS last_index_date, {num('cov')} AS latest_coverage,"
        f" {num('px')} AS latest_pax_share, s > 0 AS seeded FROM (SELECT count(*) FILTER (source_code = 'seed') AS s, count(*) FILTER (source_code <> 'seed') AS l FROM fares),"
        " (SELECT min(index_date) AS mn, max(index_date) AS mx, arg_max(coverage_ratio, index_date) AS cov, arg_max(observed_pax_share, index_date) AS px FROM headline WHERE frequency = 'daily')"
    ),
)
add(
    "g4_attached_provenance",
    lambda d: g.attach_provenance(
        d.headline.select("index_date", "frequency", "index_value"), g.provenance(d.fares, d.headline), "2024-01-01 to 2024-01-14", "2025-06-01 to 2026-05-31"
    ),
    sql(
        f"SELECT {day('index_date')} AS index_date, frequency, {num('index_value')} AS index_value, s > 0 AS is_seeded, '2024-01-01 to 2024-01-14' AS price_reference,"
        f" '2025-06-01 to 2026-05-31' AS weight_reference, {num('cov')} AS basket_coverage, {num('px')} AS observed_share"
        " FROM headline, (SELECT count(*) FILTER (source_code = 'seed') AS s FROM fares),"
        " (SELECT arg_max(coverage_ratio, index_date) AS cov, arg_max(observed_pax_share, index_date) AS px FROM headline WHERE frequency = 'daily')"
    ),
)
SQL_HEALTH = sql(
    f"""
    SELECT CASE WHEN days > 0 THEN 'live' ELSE 'synthetic' END AS status, days AS days_of_real_data, {day('last')} AS last_real_scrape,
           {day('rd')} AS last_run_date, planned AS planned_cells, ok AS ok_cells, planned - ok AS failed_cells,
           EXISTS (SELECT 1 FROM fares WHERE source_code <> 'seed' AND fares.scrape_date = rd) AS last_run_is_real, {num('px')} AS observed_pax_share
    FROM (SELECT count(DISTINCT scrape_date) AS days, max(scrape_date) AS last FROM fares WHERE source_code <> 'seed'),
         (SELECT scrape_date AS rd, count(*) AS planned, count(*) FILTER (outcome IN ('ok', 'sold_out', 'no_flights')) AS ok FROM res GROUP BY 1 ORDER BY 1 DESC LIMIT 1),
         (SELECT arg_max(observed_pax_share, index_date) AS px FROM headline WHERE frequency = 'daily')""",
    res=RES, **V,
)
add("a25_collection_health", lambda d: g.collection_health(d.fares, c.run_totals(results(d)), d.headline), SQL_HEALTH)
add("q12_collection_health", lambda d: g.collection_health(d.fares, c.run_totals(results(d)), d.headline), SQL_HEALTH)
add(
    "j17_seeded_exists",
    lambda d: d.fares.agg(F.bool_or(F.col("source_code") == "seed").alias("seeded")),
    sql("SELECT EXISTS (SELECT 1 FROM fares WHERE source_code = 'seed') AS seeded"),
)
add(
    "j18_real_run_days",
    lambda d: d.days.join(d.fares.filter("source_code <> 'seed'").select("scrape_date").distinct(), "scrape_date", "left_semi"),
    sql(f"SELECT DISTINCT {day('scrape_date')} AS scrape_date FROM fares WHERE source_code <> 'seed'"),
)
add(
    "u5_reachable_airports",
    lambda d: q.reachable(d.fares.select("origin", "destination").distinct()),
    sql(
        f"SELECT iata, {text_list('list_sort(list(DISTINCT p))')} AS partners FROM (SELECT origin AS iata, destination AS p FROM fares UNION SELECT destination, origin FROM fares) GROUP BY 1"
    ),
)
add(
    "u5_endpoints",
    lambda d: q.endpoints(d.fares),
    sql("SELECT origin AS iata FROM fares UNION SELECT destination FROM fares"),
)
LISTING = """SELECT r.route_code, r.origin, r.destination, passengers, weight, n FROM routes r JOIN route_weights USING (route_id)
    LEFT JOIN (SELECT route_id, count(*) AS n FROM fares GROUP BY 1) f USING (route_id)"""
add(
    "j8_basket_listing",
    lambda d: q.basket(d.routes, defaults.airports(d.spark), d.route_weights, defaults.WEIGHT_REF_START)
    .join(d.fares.groupBy("route_id").agg(F.count(F.lit(1)).alias("n")), "route_id", "left")
    .select("route_code", "passengers", "weight", "n"),
    sql(f"SELECT route_code, {big('passengers')} AS passengers, {num('weight')} AS weight, n FROM listing", listing=LISTING),
)
add(
    "q9_observed_basket_weight",
    lambda d: q.basket_total(d.route_weights.join(d.fares.select("route_id").distinct(), "route_id", "left_semi")),
    sql(f"SELECT {num('sum(weight)')} AS total_weight FROM route_weights WHERE route_id IN (SELECT route_id FROM fares)"),
)


def basket_answer(d):
    """Weighted basket, booking windows, and every route that fares are known for, in one list."""
    basket = q.basket(d.routes, defaults.airports(d.spark), d.route_weights, defaults.WEIGHT_REF_START)
    known = d.fares.select("route_id").distinct().join(d.routes, "route_id")
    return (
        basket.select(F.lit("basket").alias("part"), F.col("route_code").alias("name"), F.col("weight").cast("double").alias("weight"))
        .unionByName(d.windows.filter("in_basket").select(F.lit("window").alias("part"), F.col("window_days").cast("string").alias("name"), F.col("weight").cast("double").alias("weight")))
        .unionByName(known.select(F.lit("known_route").alias("part"), F.col("route_code").alias("name"), F.lit(None).cast("double").alias("weight")))
    )


add(
    "q9_basket_windows_routes",
    basket_answer,
    sql(
        f"SELECT 'basket' AS part, route_code AS name, {num('weight')} AS weight FROM routes JOIN route_weights USING (route_id)"
        f" UNION ALL SELECT 'window', cast(window_days AS varchar), {num('weight')} FROM windows"
        " UNION ALL SELECT DISTINCT 'known_route', route_code, cast(NULL AS double) FROM fares"
    ),
)

# Robots rules over the page table: one stored file per host.
BODIES = {
    0: "User-agent: *\nAllow: /\nDisallow: /fr/  # french pages\nDisallow: /*?utm_source=\nDisallow: /de/*.html$\n\nUser-agent: pricebot\nCrawl-delay: 5\nDisallow: /es/\nAllow: /es/1\n",
    1: "# no rules yet\nDisallow: /en/\nUser-agent: pricebot/2\nUser-agent: other\nDisallow: /en/2*\nAllow: /en/2*\nDisallow:\nCrawl-delay: 2.5\nSitemap: https://x/s.xml\nUser-agent: *\nDisallow: /\n",
    2: "User-agent: *\nDisallow: /fr/8\nAllow: /fr/82\nUser-agent: *\nDisallow: /\n",
}
AGENT = "PriceBot/2.1 (+https://example.org)"
INTENT = ["/es/9", "/private"]


def snapshots(d):
    host = r.url_host(F.col("url"))
    rows = d.table("pages").select(host.alias("host")).distinct()
    pick = F.length("host") % 3
    status = F.when(F.length("host") % 11 == 0, 503).when(F.length("host") % 11 == 1, 404).when(F.length("host") % 11 == 2, 403).otherwise(200)
    body = F.when(pick == 0, BODIES[0]).when(pick == 1, BODIES[1]).otherwise(BODIES[2])
    return rows.select(F.col("host").alias("snapshot_id"), "host", status.alias("http_status"), body.alias("body"))


def urls(d):
    return d.table("pages").select("page_id", "url")


HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
PAGES = rf"""
    SELECT page_id, url, {HOST} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS p,
           regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS qs FROM pages"""
JUDGED = """
    SELECT *, CASE WHEN starts_with(p, '/es/9') THEN 'intent_denied:/es/9' WHEN status IN (503, 403) THEN 'robots:disallow_all' WHEN status = 404 THEN 'robots:allow_all'
                   WHEN k = 0 THEN CASE WHEN starts_with(path, '/es/1') THEN 'robots:allow:/es/1' WHEN starts_with(path, '/es/') THEN 'robots:disallow:/es/' ELSE 'robots:no_matching_rule' END
                   WHEN k = 1 THEN CASE WHEN starts_with(path, '/en/2') THEN 'robots:allow:/en/2*' ELSE 'robots:no_matching_rule' END
                   ELSE CASE WHEN starts_with(path, '/fr/82') THEN 'robots:allow:/fr/82' WHEN starts_with(path, '/fr/8') THEN 'robots:disallow:/fr/8' ELSE 'robots:no_matching_rule' END END AS rule
    FROM (SELECT *, p || CASE WHEN qs = '?' THEN '' ELSE qs END AS path, length(host) % 3 AS k,
                 CASE length(host) % 11 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 403 ELSE 200 END AS status FROM pageparts)"""
R = dict(pageparts=PAGES, judged=JUDGED)


def judged(d):
    return r.judge(urls(d), r.policies(snapshots(d), AGENT), INTENT)


add(
    "x33_url_verdicts",
    lambda d: judged(d).select("page_id", "host", "path", "allowed", "rule", "intent_denied"),
    sql(
        "SELECT page_id, host, path, rule IN ('robots:allow_all', 'robots:no_matching_rule') OR rule LIKE 'robots:allow:%' AS allowed, rule,"
        " rule LIKE 'intent%' AS intent_denied FROM judged",
        **R,
    ),
)
add(
    "j16_rule_match_counts",
    lambda d: judged(d).groupBy("rule").agg(F.count(F.lit(1)).alias("urls")),
    sql("SELECT rule, count(*) AS urls FROM judged GROUP BY 1", **R),
)
add(
    "a20_winning_rule",
    lambda d: judged(d).filter(F.col("rule").rlike("^robots:(allow|disallow):")).select("page_id", "rule"),
    sql("SELECT page_id, rule FROM judged WHERE rule LIKE 'robots:allow:%' OR rule LIKE 'robots:disallow:%'", **R),
)
add("x30_rule_table", lambda d: r.rules(r.directives(snapshots(d))).groupBy("group_no", "allow", "pattern").agg(F.count(F.lit(1)).alias("hosts")), sql(
    """
    SELECT cast(g AS bigint) AS group_no, a AS allow, pt AS pattern, count(*) AS hosts FROM (SELECT DISTINCT host, length(host) % 3 AS k FROM pageparts)
    JOIN (VALUES (0, 1, true, '/'), (0, 1, false, '/fr/'), (0, 1, false, '/*?utm_source='), (0, 1, false, '/de/*.html$'), (0, 2, false, '/es/'), (0, 2, true, '/es/1'),
                 (1, 1, false, '/en/2*'), (1, 1, true, '/en/2*'), (1, 2, false, '/'), (2, 1, false, '/fr/8'), (2, 1, true, '/fr/82'), (2, 2, false, '/')) t(k, g, a, pt) USING (k)
    GROUP BY ALL""",
    **R,
))
add("x31_pattern_regex", lambda d: r.rules(r.directives(snapshots(d))).select("pattern", "regex").distinct(), sql(
    r"""
    SELECT DISTINCT pt AS pattern, rx AS regex FROM (SELECT DISTINCT length(host) % 3 AS k FROM pageparts)
    JOIN (VALUES (0, '/', '^/'), (0, '/fr/', '^/fr/'), (0, '/*?utm_source=', '^/.*\?utm_source='), (0, '/de/*.html$', '^/de/.*\.html$'), (0, '/es/', '^/es/'), (0, '/es/1', '^/es/1'),
                 (1, '/en/2*', '^/en/2.*'), (1, '/', '^/'), (2, '/fr/8', '^/fr/8'), (2, '/fr/82', '^/fr/82'), (2, '/', '^/')) t(k, pt, rx) USING (k)""",
    **R,
))
add(
    "x32_agent_group",
    lambda d: r.chosen_group(r.directives(snapshots(d)), AGENT),
    sql("SELECT DISTINCT host AS snapshot_id, cast(CASE length(host) % 3 WHEN 0 THEN 2 ELSE 1 END AS bigint) AS group_no FROM pageparts", **R),
)
add(
    "x34_landing_recheck",
    lambda d: r.recheck_landing(
        urls(d).select(F.col("page_id"), F.concat(F.lit("https://start.example.com/"), F.col("page_id").cast("string")).alias("url"), F.col("url").alias("final_url")),
        r.policies(snapshots(d), AGENT), INTENT,
    ).select("page_id", "rule"),
    sql("SELECT page_id, rule FROM judged WHERE NOT (rule IN ('robots:allow_all', 'robots:no_matching_rule') OR rule LIKE 'robots:allow:%')", **R),
)
add(
    "g5_snapshot_inventory",
    lambda d: r.snapshot_inventory(snapshots(d)).select("host", "http_status", "body_bytes"),
    sql(
        "SELECT DISTINCT host, cast(CASE length(host) % 11 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN 403 ELSE 200 END AS bigint) AS http_status,"
        f" cast(CASE length(host) % 3 WHEN 0 THEN {len(BODIES[0])} WHEN 1 THEN {len(BODIES[1])} ELSE {len(BODIES[2])} END AS bigint) AS body_bytes FROM pageparts",
        **R,
    ),
)
add(
    "s8_robots_bodies_scan",
    lambda d: r.directives(snapshots(d)).groupBy("field").agg(F.count(F.lit(1)).alias("lines")),
    sql(
        """
        SELECT f AS field, cast(sum(c) AS bigint) AS lines FROM (SELECT DISTINCT host, length(host) % 3 AS k FROM pageparts)
        JOIN (VALUES (0, 'user-agent', 2), (0, 'allow', 2), (0, 'disallow', 4), (0, 'crawl-delay', 1), (1, 'user-agent', 3), (1, 'disallow', 4), (1, 'allow', 1),
                     (1, 'crawl-delay', 1), (1, 'sitemap', 1), (2, 'user-agent', 2), (2, 'disallow', 2), (2, 'allow', 1)) t(k, f, c) USING (k) GROUP BY 1""",
        **R,
    ),
)


# Streaming: the event file replayed as a stream must equal the batch result.
def folder(d) -> str:
    return staging.folder(d.spark, "stream")


def event_stream(d):
    return d.spark.readStream.schema(d.events.schema).parquet(f"{d.path}/events*.parquet")


def raw_stream(d, events):
    return events.select(
        F.col("event_id").alias("raw_id"), F.col("event_type").alias("source"), F.lit("BLR").alias("origin"), F.lit("DEL").alias("destination"),
        F.col("ts").cast("date").alias("scrape_date"), F.date_add(F.col("ts").cast("date"), 7).alias("departure_date"),
        F.col("ts").cast("timestamp").alias("scraped_at"), F.col("props").alias("payload"),
    )


PARTS = 4


def arriving(d, source):
    """Puts the events into the folder `source` in PARTS steps and yields after each: every day is spread over the
    steps, the last of which also brings one whole day that none of the others had, so days come late and in pieces.
    A step is one micro-batch, however many files it has: a batch cleans all its days anew, so one per file would cost
    the square of the input."""
    first = F.date_add(F.lit(d.events.agg(F.min(F.col("ts").cast("date"))).first()[0]), 4)
    late = F.col("ts").cast("date") == first
    part = F.when(late, PARTS - 1).otherwise(F.pmod(F.col("event_id") * 7, F.lit(PARTS)))
    for k in (2, 0, 1, 3):
        d.events.filter(part == k).write.mode("append").parquet(source)
        yield d.spark.readStream.schema(d.events.schema).parquet(source)


def run_raw(d):
    """Ingest the stream as it arrives, then all of it again; the second run must add nothing."""
    out = folder(d)
    for stream in arriving(d, f"{out}/events"):
        ingest.ingest_raw(d.spark, raw_stream(d, stream), f"{out}/raw", f"{out}/checkpoint").awaitTermination()
    ingest.ingest_raw(d.spark, raw_stream(d, event_stream(d)), f"{out}/raw", f"{out}/checkpoint-again").awaitTermination()
    return d.spark.read.parquet(f"{out}/raw").groupBy("scrape_date", "source").agg(F.count(F.lit(1)).alias("payloads"))


add("r1_idempotent_raw_ingest", run_raw, f"SELECT {day('ts')} AS scrape_date, event_type AS source, count(DISTINCT props) AS payloads FROM events GROUP BY 1, 2")
_STREAMED: dict[int, tuple] = {}


def streamed(d):
    """Tables of the incremental index after all steps have arrived, and the first one again; run once per domain."""
    if id(d) not in _STREAMED or _STREAMED[id(d)][0] is not d:
        out = folder(d)
        tables = {t: f"{out}/{t}" for t in ("quotes", "late", "fares", "prices", *ingest.INDEX_TABLES)}
        state = d.routes, d.base, d.weights, d.shares
        for stream in arriving(d, f"{out}/events"):
            ingest.ingest_quotes(d.spark, quotes_from_events(stream), tables, *state, f"{out}/checkpoint").awaitTermination()
        again = d.spark.readStream.schema(d.events.schema).parquet(f"{out}/events")
        ingest.ingest_quotes(d.spark, quotes_from_events(again), tables, *state, f"{out}/checkpoint-again").awaitTermination()
        _STREAMED[id(d)] = (d, tables)
    return {name: sinks.read_table(d.spark, path) for name, path in _STREAMED[id(d)][1].items()}


def late_filings(d):
    """Quotes filed for another day, as the ingest puts them into the gap table."""
    out = folder(d)
    tables = {t: f"{out}/{t}" for t in ("quotes", "late", "fares", "prices", *ingest.INDEX_TABLES)}
    quotes = quotes_from_events(event_stream(d)).withColumn(
        "observed_on", F.date_add("scrape_date", F.when(F.col("ingest_seq") % 9 == 0, 2).otherwise(0))
    )
    ingest.ingest_quotes(d.spark, quotes, tables, d.routes, d.base, d.weights, d.shares, f"{out}/checkpoint").awaitTermination()
    return d.spark.read.parquet(tables["late"]).groupBy("scrape_date", "age_days", "outcome").agg(F.count(F.lit(1)).alias("quotes"))


add(
    "r2_late_observations",
    late_filings,
    sql(f"SELECT {day('scrape_date')} AS scrape_date, 2 AS age_days, 'missed' AS outcome, count(*) AS quotes FROM quotes WHERE ingest_seq % 9 = 0 GROUP BY 1"),
)
def closed_gaps(d):
    """Cells that closed days lacked, told while the stream runs and once more under a new checkpoint."""
    out = folder(d)
    tables = {t: f"{out}/{t}" for t in ("gaps", "closed")}
    known = quote_sources(d), d.routes, d.windows
    for again in ("", "-again"):
        quotes = quotes_from_events(event_stream(d)).filter(GAPPY)
        closing.record_gaps(d.spark, quotes, *known, tables, f"{out}/checkpoint{again}", "2 days").awaitTermination()
    return d.spark.read.parquet(tables["gaps"]).groupBy("scrape_date", "outcome").agg(F.count(F.lit(1)).alias("cells"))


#: Leaves out what most days have, so that there are gaps, and every seventh day as a whole.
GAPPY = "ingest_seq % 50 = 0 AND dayofmonth(scrape_date) % 7 <> 3"
add(
    "r2_gaps_of_closed_days",
    closed_gaps,
    sql(
        f"""
        SELECT * FROM (WITH kept AS (SELECT * FROM quotes WHERE ingest_seq % 50 = 0 AND dayofmonth(scrape_date) % 7 <> 3),
        ends AS (SELECT min(scrape_date) AS a, max(scrape_date) - 3 AS z FROM kept),
        closed AS (SELECT max(scrape_date) AS z FROM kept, ends WHERE scrape_date <= ends.z),
        span AS (SELECT cast(unnest(generate_series(cast(ends.a AS timestamp), cast(closed.z AS timestamp), INTERVAL 1 DAY)) AS date) AS scrape_date FROM ends, closed)
        SELECT {day('s.scrape_date')} AS scrape_date, 'missed' AS outcome, count(*) AS cells
        FROM span s CROSS JOIN routes CROSS JOIN windows CROSS JOIN (SELECT DISTINCT source_code FROM quotes)
        WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.scrape_date = s.scrape_date AND least(k.origin, k.destination) = routes.origin
                          AND greatest(k.origin, k.destination) = routes.destination AND date_diff('day', k.scrape_date, k.departure_date) = windows.window_days)
        GROUP BY 1) AS told"""
    ),
)
add(
    "r3_incremental_daily_index",
    lambda d: streamed(d)["headline"].select("index_date", "frequency", "index_value", "n_cells", "coverage_ratio"),
    sql(f"SELECT {day('index_date')} AS index_date, frequency, {num('index_value')} AS index_value, {big('n_cells')} AS n_cells, {num('coverage_ratio')} AS coverage_ratio FROM headline"),
)
add(
    "r3_incremental_elementary",
    lambda d: streamed(d)["elementary"].select(
        "index_date", "route_id", "window_days", "index_value", "carriers_used", "n_carriers", "n_quotes", "is_imputed", "is_dropped"
    ),
    sql(
        f"SELECT {day('index_date')} AS index_date, {big('route_id')} AS route_id, {big('window_days')} AS window_days, {num('index_value')} AS index_value,"
        f" {text_list('carriers_used')} AS carriers_used, {big('n_carriers')} AS n_carriers, {big('n_quotes')} AS n_quotes, is_imputed, is_dropped FROM elementary"
    ),
)
add(
    "r3_incremental_routes",
    lambda d: streamed(d)["routes"].select("index_date", "frequency", "route_id", "index_value", "weight", "contribution"),
    sql(
        f"SELECT {day('index_date')} AS index_date, frequency, {big('route_id')} AS route_id, {num('index_value')} AS index_value, {num('weight')} AS weight,"
        f" {num('contribution')} AS contribution FROM route_rows"
    ),
)
