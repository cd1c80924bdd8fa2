"""SQL views for the oracles: the domain tables and pipeline stages restated for DuckDB."""

from __future__ import annotations

import re

from pricemesh.sources import defaults


def num(x: str) -> str:
    """Nearest 1e-4, ties upward, as double."""
    return f"floor(cast({x} as double) * 10000 + 0.500001) / 10000"


def day(x: str) -> str:
    return f"strftime(cast({x} as date), '%Y-%m-%d')"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def text_list(x: str) -> str:
    return f"array_to_string({x}, '|')"


def _values(rows, names: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        return f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def _ends(side: int) -> str:
    from pricemesh.plans.domain import ENDS

    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[side]}'" for k, v in ENDS.items()) + " END"


GROUP = "origin, destination, carrier, window_days, scrape_date"

VIEWS: dict[str, str] = {
    "arrivals": """
        SELECT event_id, cast(ts as date) AS scrape_date, user_id, event_type, value,
               unnest(CASE WHEN event_id % 10 = 3 THEN [0, 1] ELSE [0] END) AS arrival
        FROM events""",
    "quotes": f"""
        SELECT source_code, origin, CASE WHEN event_id % 97 = 0 THEN origin ELSE destination END AS destination, carrier,
               scrape_date, cast(scrape_date + cast(w AS integer) AS date) AS departure_date,
               cast(cast(round(value * 100, 2) AS decimal(12,2)) * CASE WHEN event_id % 211 = 0 THEN 10 ELSE 1 END
                    AS decimal(12,2)) AS total_fare,
               CASE WHEN event_id % 13 <> 0 THEN carrier || cast(user_id AS varchar) END AS flight_number,
               CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS stops,
               'ECONOMY' AS fare_class,
               CASE WHEN event_id % 3 = 0 THEN 'SAVER' WHEN event_id % 3 = 1 THEN 'FLEX' END AS fare_brand,
               CASE WHEN event_id % 7 <> 0 THEN cast(cast(round(value * 82, 2) AS decimal(12,2))
                    + CASE WHEN event_id % 11 = 0 THEN 900 ELSE 0 END AS decimal(12,2)) END AS base_fare,
               CASE WHEN event_id % 7 <> 0 THEN cast(round(value * 10, 2) AS decimal(12,2)) END AS taxes,
               cast(round(value * 5, 2) AS decimal(12,2)) AS udf,
               cast(round(value * 3, 2) AS decimal(12,2)) AS convenience_fee,
               cast(NULL AS decimal(12,2)) AS other_charges,
               event_id % 25 = 0 AS is_sold_out,
               event_id * 2 + arrival AS ingest_seq
        FROM (SELECT *, CASE WHEN event_id % 10 = 9 THEN 'seed' WHEN event_id % 2 = 0 THEN 'qpweb' ELSE 'sgweb' END AS source_code,
                     CASE WHEN user_id % 4 = 3 THEN {_ends(1)} ELSE {_ends(0)} END AS origin,
                     CASE WHEN user_id % 4 = 3 THEN {_ends(0)} ELSE {_ends(1)} END AS destination,
                     CASE WHEN user_id % 2 = 0 THEN 'QP' ELSE 'SG' END AS carrier,
                     CASE WHEN event_id % 101 = 0 THEN 0 ELSE ([1, 7, 15, 30, 45])[user_id % 5 + 1] END AS w
              FROM arrivals)""",
    "classified": """
        SELECT *, CASE WHEN origin = destination THEN 'origin_equals_destination'
                       WHEN total_fare IS NULL OR total_fare <= 0 THEN 'non_positive_total'
                       WHEN window_days NOT BETWEEN 1 AND 365 THEN 'window_out_of_range'
                       WHEN total_fare < 500 THEN 'implausible_below_minimum'
                       WHEN total_fare > 200000 THEN 'implausible_above_maximum' END AS reject_reason
        FROM (SELECT *, date_diff('day', scrape_date, departure_date) AS window_days FROM quotes)""",
    "ranked": """
        SELECT *, row_number() OVER k AS rn, count(*) OVER (PARTITION BY source_code, scrape_date, carrier,
                  flight_number, departure_date, fare_class, fare_brand, total_fare) AS copies
        FROM classified WHERE reject_reason IS NULL
        WINDOW k AS (PARTITION BY source_code, scrape_date, carrier, flight_number, departure_date, fare_class,
                     fare_brand, total_fare ORDER BY ingest_seq)""",
    "deduped": "SELECT * FROM ranked WHERE rn = 1",
    "kept": """
        SELECT * REPLACE (CASE WHEN ok THEN base_fare END AS base_fare, CASE WHEN ok THEN taxes END AS taxes,
                          CASE WHEN ok THEN udf END AS udf, CASE WHEN ok THEN convenience_fee END AS convenience_fee,
                          CASE WHEN ok THEN other_charges END AS other_charges),
               ok AS components_complete,
               CASE WHEN base_fare IS NULL AND taxes IS NULL THEN 'no_component_split'
                    WHEN ok THEN '' ELSE 'components_did_not_reconcile' END AS split_flag
        FROM (SELECT *, coalesce(base_fare IS NOT NULL AND taxes IS NOT NULL
                     AND abs(base_fare + taxes + coalesce(udf, 0) + coalesce(convenience_fee, 0)
                             + coalesce(other_charges, 0) - total_fare) <= 1.00, false) AS ok
              FROM deduped)""",
    "centred": f"""
        SELECT *, ln(cast(total_fare AS double)) AS x, count(*) OVER g AS n,
               median(ln(cast(total_fare AS double))) OVER g AS med
        FROM kept WHERE NOT is_sold_out WINDOW g AS (PARTITION BY {GROUP})""",
    "spread": f"""
        SELECT *, median(abs(x - med)) OVER (PARTITION BY {GROUP}) AS mad FROM centred""",
    "scored": """
        SELECT *, CASE WHEN n >= 5 AND mad > 0 THEN 0.6745 * (x - med) / mad END AS raw_score FROM spread""",
    "survivors": """
        SELECT k.*, coalesce(abs(s.raw_score) > 3.5, false) AS is_outlier,
               CASE WHEN abs(s.raw_score) > 3.5 THEN 'mad_log' END AS outlier_method,
               CASE WHEN abs(s.raw_score) > 3.5 THEN round(s.raw_score, 4) END AS outlier_score
        FROM kept k LEFT JOIN scored s USING (ingest_seq)""",
    "routes": _values([(i, o, d, f"{o}-{d}") for i, o, d, _, _ in defaults.ROUTES], "route_id, origin, destination, route_code"),
    "route_weights": _values([(i, p, float(w)) for i, _, _, p, w in defaults.ROUTES], "route_id, passengers, weight"),
    "windows": _values([(d, label, 0.2) for d, label in defaults.WINDOWS], "window_days, label, weight"),
    "shares": _values([(c, float(s)) for c, s in defaults.CARRIER_SHARE], "carrier, share"),
    "scenarios": _values(
        [(i, n, defaults.WINDOWS[j][0], w) for i, (n, ws) in enumerate(defaults.SCENARIOS.items()) for j, w in enumerate(ws)],
        "scenario_no, scenario, window_days, window_weight",
    ),
    "cells": """
        SELECT r.route_id, w.window_days, cast(r.weight AS double) AS route_weight,
               cast(r.weight AS double) * cast(w.weight AS double) AS cell_weight
        FROM route_weights r CROSS JOIN windows w""",
    "fares": """
        SELECT * EXCLUDE (lane, srn) FROM (
            SELECT *, row_number() OVER (PARTITION BY source_code, scrape_date, carrier, flight_number, departure_date,
                      fare_class, total_fare ORDER BY lane, ingest_seq) AS srn
            FROM (SELECT s.*, r.route_id, r.route_code,
                         CASE WHEN is_sold_out THEN 2 WHEN is_outlier THEN 1 ELSE 0 END AS lane
                  FROM survivors s JOIN routes r ON r.origin = least(s.origin, s.destination)
                       AND r.destination = greatest(s.origin, s.destination)))
        WHERE flight_number IS NULL OR srn = 1""",
    "usable": "SELECT * FROM fares WHERE NOT is_outlier AND NOT is_sold_out",
    "prices": """
        SELECT scrape_date, route_id, window_days, carrier, min(total_fare) AS price, count(*) AS n_quotes
        FROM usable GROUP BY ALL""",
    "days": "SELECT DISTINCT scrape_date FROM fares",
    "base": """
        SELECT route_id, window_days, carrier,
               cast(round(exp(avg(ln(cast(price AS double)))), 4) AS decimal(12,4)) AS base_price, count(*) AS n_observations
        FROM prices WHERE scrape_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14'
        GROUP BY ALL HAVING count(*) >= 5""",
    "jevons": """
        SELECT scrape_date, route_id, window_days,
               100 * exp(avg(ln(cast(price AS double) / cast(base_price AS double)))) AS index_value,
               list_sort(list(carrier) FILTER (WHERE base_price IS NOT NULL)) AS carriers_used,
               count(base_price) AS n_carriers, sum(n_quotes) AS n_quotes
        FROM prices LEFT JOIN base USING (route_id, window_days, carrier)
        GROUP BY ALL HAVING count(base_price) > 0""",
    "spine": "SELECT route_id, window_days, scrape_date FROM cells CROSS JOIN days",
    "runs": """
        SELECT *, sum(brk) OVER h AS run
        FROM (SELECT s.*, j.* EXCLUDE (scrape_date, route_id, window_days), j.index_value IS NOT NULL AS seen,
                     CASE WHEN j.index_value IS NOT NULL
                          OR coalesce(date_diff('day', lag(s.scrape_date) OVER h0, s.scrape_date) > 1, false)
                          THEN 1 ELSE 0 END AS brk,
                     last_value(cast(round(j.index_value, 4) AS decimal(12,4)) IGNORE NULLS) OVER
                         (PARTITION BY s.route_id, s.window_days ORDER BY s.scrape_date
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
              FROM spine s LEFT JOIN jevons j USING (scrape_date, route_id, window_days)
              WINDOW h0 AS (PARTITION BY s.route_id, s.window_days ORDER BY s.scrape_date))
        WINDOW h AS (PARTITION BY route_id, window_days ORDER BY scrape_date)""",
    "streaks": """
        SELECT *, sum(CASE WHEN seen THEN 0 ELSE 1 END) OVER (PARTITION BY route_id, window_days, run ORDER BY scrape_date) AS k
        FROM runs""",
    "elementary": """
        SELECT scrape_date AS index_date, route_id, window_days,
               CASE WHEN seen THEN index_value WHEN prior IS NOT NULL AND (k - 1) % 3 < 2 THEN cast(prior AS double) END AS index_value,
               coalesce(carriers_used, []) AS carriers_used, coalesce(n_carriers, 0) AS n_carriers,
               coalesce(n_quotes, 0) AS n_quotes,
               NOT seen AND prior IS NOT NULL AND (k - 1) % 3 < 2 AS is_imputed,
               NOT seen AND NOT (prior IS NOT NULL AND (k - 1) % 3 < 2) AS is_dropped,
               CASE WHEN NOT seen AND prior IS NOT NULL AND (k - 1) % 3 < 2
                    THEN 'carried forward; consecutive imputed days before this one: ' || cast((k - 1) % 3 AS integer) END AS imputation_note,
               CASE WHEN NOT seen AND prior IS NOT NULL AND (k - 1) % 3 >= 2
                    THEN 'no observations and carry-forward limit reached (streak 2 >= 2)'
                    WHEN NOT seen AND prior IS NULL THEN 'no observations and no prior value' END AS drop_reason
        FROM streaks""",
    "weighted": """
        SELECT e.*, c.cell_weight, c.route_weight FROM elementary e JOIN cells c USING (route_id, window_days)
        WHERE index_value IS NOT NULL""",
    "pax": """
        SELECT index_date, coalesce(sum(route_weight * share) / nullif(sum(route_weight), 0), 0) AS observed_pax_share
        FROM (SELECT index_date, route_id, max(route_weight) AS route_weight, sum(share) AS share
              FROM (SELECT DISTINCT index_date, route_id, route_weight, unnest(carriers_used) AS carrier
                    FROM weighted WHERE NOT is_imputed)
              JOIN shares USING (carrier) GROUP BY ALL)
        GROUP BY ALL""",
    "daily": """
        SELECT index_date, 'daily' AS frequency, sum(cell_weight * index_value) / sum(cell_weight) AS index_value,
               count(*) AS n_cells, sum(cell_weight) / (SELECT sum(cell_weight) FROM cells) AS coverage_ratio,
               coalesce(max(observed_pax_share), 0) AS observed_pax_share,
               max(imputed) AS imputed_cells, max(dropped) AS dropped_cells
        FROM weighted LEFT JOIN pax USING (index_date)
        JOIN (SELECT index_date, count(*) FILTER (is_imputed) AS imputed, count(*) FILTER (is_dropped) AS dropped
              FROM elementary GROUP BY ALL) USING (index_date)
        GROUP BY index_date""",
    "all_freq": """
        SELECT * FROM daily
        UNION ALL BY NAME
        SELECT date_trunc(u, index_date)::date AS index_date, f AS frequency, avg(index_value) AS index_value,
               max(n_cells) AS n_cells, avg(coverage_ratio) AS coverage_ratio, avg(observed_pax_share) AS observed_pax_share,
               sum(imputed_cells) AS imputed_cells, sum(dropped_cells) AS dropped_cells
        FROM daily CROSS JOIN (VALUES ('week', 'weekly'), ('month', 'monthly')) AS p(u, f)
        GROUP BY 1, 2""",
    "headline": """
        SELECT * REPLACE (cast(round(index_value, 4) AS decimal(12,4)) AS index_value,
                          cast(round(coverage_ratio, 4) AS decimal(6,4)) AS coverage_ratio,
                          cast(round(observed_pax_share, 4) AS decimal(6,4)) AS observed_pax_share)
        FROM all_freq""",
    "route_daily": """
        SELECT index_date, route_id, 'daily' AS frequency, sum(cell_weight * index_value) / sum(cell_weight) AS index_value,
               sum(cell_weight) AS weight,
               sum(cell_weight * index_value) / sum(sum(cell_weight)) OVER (PARTITION BY index_date) AS contribution
        FROM weighted GROUP BY index_date, route_id""",
    "route_rows": """
        SELECT * FROM route_daily
        UNION ALL BY NAME
        SELECT date_trunc(u, index_date)::date AS index_date, route_id, f AS frequency, avg(index_value) AS index_value,
               0.0 AS weight, 0.0 AS contribution
        FROM route_daily CROSS JOIN (VALUES ('week', 'weekly'), ('month', 'monthly')) AS p(u, f)
        GROUP BY 1, 2, 3""",
    "stats": """
        SELECT route_code, window_days, count(*) AS n,
               cast((2 * cast(sum(total_fare * 100) AS bigint) + count(*)) // (2 * count(*)) AS double) / 100 AS mean_fare,
               min(total_fare) AS min_fare, quantile_cont(cast(total_fare AS double), 0.5) AS median_fare
        FROM usable GROUP BY ALL""",
    "stats_day": """
        SELECT route_code, window_days, scrape_date, count(*) AS n,
               cast((2 * cast(sum(total_fare * 100) AS bigint) + count(*)) // (2 * count(*)) AS double) / 100 AS mean_fare,
               min(total_fare) AS min_fare, quantile_cont(cast(total_fare AS double), 0.5) AS median_fare
        FROM usable GROUP BY ALL""",
    "audit": """
        SELECT *, CASE WHEN intent_denied THEN 'blocked_by_intent' WHEN NOT robots_allowed THEN 'blocked_by_robots'
                       WHEN http_status IS NULL THEN 'timeout' WHEN http_status = 429 THEN 'rate_limited'
                       WHEN http_status >= 400 THEN 'http_error' ELSE 'ok' END AS outcome
        FROM (SELECT event_id AS request_id, event_type AS source, ts AS requested_at,
                     'https://' || event_type || '.example.com/flights/' || user_id AS url,
                     event_id % 31 <> 0 AND event_id % 19 <> 0 AS robots_allowed,
                     CASE WHEN event_id % 31 = 0 THEN 'intent_denied:/api' WHEN event_id % 19 = 0
                          THEN 'robots:disallow:/flights' ELSE 'robots:allow:/' END AS robots_rule,
                     event_id % 31 = 0 AS intent_denied,
                     CASE WHEN event_id % 31 <> 0 AND event_id % 19 <> 0 THEN cast(round(value, 3) AS decimal(8,3)) ELSE 0 END AS delay_applied_s,
                     CASE WHEN event_id % 31 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL
                          WHEN event_id % 29 = 0 THEN 429 WHEN event_id % 37 = 0 THEN 503
                          WHEN event_id % 41 = 0 THEN 404 ELSE 200 END AS http_status,
                     user_id * 100 AS bytes_returned, event_id % 900 AS duration_ms
              FROM events)""",
    "series": f"""
        SELECT series_id, index_date, {num('value')} AS value FROM (
            SELECT event_type AS series_id, cast(ts AS date) AS index_date, avg(value) AS value FROM events GROUP BY ALL
            UNION ALL
            SELECT o_orderpriority, cast(o_orderdate AS date), avg(o_totalprice) FROM orders GROUP BY ALL)""",
    "weekly": f"""
        SELECT series_id, index_date, {num('value')} AS value FROM (
            SELECT o_orderpriority AS series_id, cast(date_trunc('week', o_orderdate) AS date) AS index_date,
                   avg(o_totalprice) AS value FROM orders GROUP BY ALL)""",
    "traffic": """
        SELECT cast(year(o_orderdate) AS varchar) AS "Year", cast(month(o_orderdate) AS varchar) AS "Month",
               'C' || (c_nationkey % 6) AS city1, 'C' || (s_nationkey % 6) AS city2,
               cast(sum(l_quantity) AS bigint) AS pax
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY ALL""",
    "pairs": """
        SELECT least(city1, city2) AS origin, greatest(city1, city2) AS destination,
               sum(pax + CASE WHEN "Month" = '2' THEN 0 ELSE pax END) AS passengers
        FROM traffic WHERE city1 <> city2 AND cast("Year" AS integer) * 100 + cast("Month" AS integer) BETWEEN 199601 AND 200012
        GROUP BY ALL""",
    "large": """
        SELECT cast(o_orderdate AS date) AS scrape_date, 'R' || cn.n_regionkey AS origin, 'R' || sn.n_regionkey AS destination,
               l_returnflag AS carrier, ([1, 3, 7, 15, 30, 45, 60])[l_linenumber] AS window_days,
               cast(l_extendedprice AS decimal(12,2)) AS total_fare
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation sn ON s_nationkey = sn.n_nationkey""",
}


def _registry() -> None:
    from pricemesh.plans.domain import SOURCE_REGISTRY

    VIEWS["registry"] = _values(
        SOURCE_REGISTRY, "code, display_name, kind, tier, enabled, exclusion_reason, audit_verdict"
    )


_registry()




def sql(body: str, **extra: str) -> str:
    """Prefix a query with the views it names, directly or through other views."""
    known = {**VIEWS, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for v in known:
            if v not in order and re.search(rf"(?i)\b(from|join)\s+{v}\b", text):
                visit(known[v])
                if v not in order:
                    order.append(v)

    visit(body)
    ctes = ",\n".join(f"{v} AS ({known[v]})" for v in order)
    return f"WITH {ctes}\n{body}" if ctes else body
