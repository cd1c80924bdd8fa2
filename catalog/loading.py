"""Loaders, parsers, payloads, weights and idempotent writes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from catalog import add
from catalog.views import big, day, num, sql
from pricemesh import staging
from pricemesh import schema as S
from pricemesh.functions import parse as ps
from pricemesh.operators import payload as pl
from pricemesh.operators import weights as w
from pricemesh.plans import export
from pricemesh.sources import loaders as ld
from pricemesh.sources import sinks

CONFIG = Path(__file__).resolve().parent.parent / "config"
START, END = 199601, 200012


def folder(d) -> str:
    return staging.folder(d.spark, "files")


# Traffic and weights.
def traffic_file(d):
    """The derived traffic release written as CSV and read back by the loader."""
    path = folder(d)
    sinks.export_csv(d.traffic, path)
    return ld.traffic_csv(d.spark, path)


def totals(d):
    return w.pair_totals(d.traffic, START, END)


def basket(d):
    """Every pair of the first five cities."""
    return totals(d).filter("origin < 'C4' AND destination < 'C5'").select("origin", "destination")


add(
    "s1_traffic_scan",
    lambda d: w.pair_totals(traffic_file(d), START, END),
    sql(f"SELECT origin, destination, {big('passengers')} AS passengers FROM pairs"),
)
add("a19_city_pair_totals", totals, sql(f"SELECT origin, destination, {big('passengers')} AS passengers FROM pairs"))
BASKET = "SELECT * FROM pairs WHERE origin < 'C4' AND destination < 'C5'"
WEIGHTS = """
    SELECT *, share + CASE WHEN rn = 1 THEN 1 - sum(share) OVER () ELSE 0 END AS weight FROM (
        SELECT origin, destination, passengers, row_number() OVER (ORDER BY passengers DESC, origin, destination) AS rn,
               cast((2 * cast(passengers AS hugeint) * 10000000 + sum(passengers) OVER ()) // (2 * sum(passengers) OVER ()) AS decimal(20,7)) / 10000000 AS share FROM basket)"""
W = dict(basket=BASKET, wts=WEIGHTS)
add(
    "i7_route_weights",
    lambda d: w.route_weights(totals(d), basket(d)).select("route_code", "passengers", (F.col("weight") * 1000).alias("weight_milli")),
    sql(f"SELECT origin || '-' || destination AS route_code, {big('passengers')} AS passengers, {num('weight * 1000')} AS weight_milli FROM wts", **W),
)
add(
    "i7_weights_sum_to_one",
    lambda d: w.route_weights(totals(d), basket(d)).agg((F.sum("weight") == 1).alias("exact")),
    sql("SELECT true AS exact FROM basket LIMIT 1", **W),
)
add(
    "a21_basket_coverage",
    lambda d: w.coverage(totals(d), basket(d)),
    sql(
        f"SELECT {big('b')} AS basket_passengers, {big('a')} AS all_passengers, {num('b / a')} AS coverage FROM (SELECT sum(passengers) AS b FROM basket), (SELECT sum(passengers) AS a FROM pairs)",
        **W,
    ),
)
add(
    "o5_top_omitted_pairs",
    lambda d: w.top_omitted(totals(d), basket(d)),
    sql(
        f"SELECT origin, destination, {big('passengers')} AS passengers FROM pairs WHERE (origin, destination) NOT IN (SELECT origin, destination FROM basket)"
        " ORDER BY pairs.passengers DESC, origin, destination LIMIT 3",
        **W,
    ),
)


def weights_csv(d):
    path = folder(d)
    sinks.export_csv(w.route_weights(totals(d), basket(d)), path)
    return ld.read_text_csv(d.spark, path).selectExpr("route_code", "cast(passengers as bigint) passengers", "cast(weight as decimal(12,10)) * 1000 weight_milli")


add("k9_weights_csv", weights_csv, sql(f"SELECT origin || '-' || destination AS route_code, {big('passengers')} AS passengers, {num('weight * 1000')} AS weight_milli FROM wts", **W))

# Official monthly index.
CPI = """
    SELECT date_trunc('month', l_shipdate) AS m, month(l_shipdate) AS mm, year(l_shipdate) AS yy, count(*) AS n FROM lineitem GROUP BY ALL"""


def cpi_rows(d):
    """A released file in mixed date shapes, grouped digits, gaps and bad rows."""
    base = d.table("lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    mm, yy = F.month("m"), F.year("m").cast("string")
    shape = (
        F.when(mm % 6 == 0, F.date_format("m", "yyyy-MM"))
        .when(mm % 6 == 1, F.concat(yy, F.lit("-"), mm.cast("string")))
        .when(mm % 6 == 2, F.concat(F.date_format("m", "MMM"), F.lit("-"), yy))
        .when(mm % 6 == 3, F.concat(F.upper(F.date_format("m", "MMMM")), F.lit(" "), yy))
        .when(mm % 6 == 4, F.concat(mm.cast("string"), F.lit("/"), yy))
        .otherwise(F.concat(F.lit("bad "), yy))
    )
    value = F.when(mm == 7, "-1").when(mm == 8, "n/a").otherwise(F.concat(F.lit(" "), F.format_number("n", 1)))
    return base.select(
        shape.alias("Period"), value.alias("Index"), F.when(mm % 2 == 0, "Urban").otherwise("").alias("Sector"),
        F.when(mm % 3 == 0, "2012").otherwise("").alias("Base_Year"),
    )


def cpi_parsed(d):
    path = folder(d)
    sinks.export_csv(cpi_rows(d), path)
    return ld.parse_cpi(ld.read_text_csv(d.spark, path))


CPI_OK = "SELECT * FROM cpi WHERE mm % 6 <> 5 AND mm NOT IN (7, 8)"
C = dict(cpi=CPI, cpiok=CPI_OK)
add(
    "s2_cpi_csv_load",
    lambda d: ld.accepted(cpi_parsed(d)).select("ref_month", "sector", "index_value", "base_year", "description"),
    sql(
        f"SELECT {day('m')} AS ref_month, CASE WHEN mm % 2 = 0 THEN 'urban' ELSE 'combined' END AS sector, cast(n AS double) AS index_value,"
        " cast(CASE WHEN mm % 3 = 0 THEN 2012 ELSE 2024 END AS bigint) AS base_year, 'CPI Division 07 Transport' AS description FROM cpiok",
        **C,
    ),
)
add(
    "s2_cpi_rejects",
    lambda d: ld.rejected(cpi_parsed(d)).groupBy("reject").agg(F.count(F.lit(1)).alias("row_count")),
    sql(
        "SELECT CASE WHEN mm % 6 = 5 THEN 'unreadable month' WHEN mm = 8 THEN 'unreadable value' ELSE 'non-positive value' END AS reject, count(*) AS row_count"
        " FROM cpi WHERE mm % 6 = 5 OR mm IN (7, 8) GROUP BY 1",
        **C,
    ),
)


def cpi_upsert(d):
    """Load, then load a revision of the first half: revised rows win, the others stay."""
    path = folder(d)
    rows = ld.accepted(cpi_parsed(d))
    keys = ["series_code", "ref_month", "sector", "base_year"]
    sinks.upsert(d.spark, rows, path, keys, ["base_year"])
    sinks.upsert(d.spark, rows.filter("base_year = 2012").withColumn("index_value", F.col("index_value") + 1), path, keys, ["base_year"])
    return d.spark.read.parquet(path).select("ref_month", "sector", "index_value", "base_year")


add(
    "k6_cpi_upsert",
    cpi_upsert,
    sql(
        f"SELECT {day('m')} AS ref_month, CASE WHEN mm % 2 = 0 THEN 'urban' ELSE 'combined' END AS sector, cast(n + CASE WHEN mm % 3 = 0 THEN 1 ELSE 0 END AS double) AS index_value,"
        " cast(CASE WHEN mm % 3 = 0 THEN 2012 ELSE 2024 END AS bigint) AS base_year FROM cpiok",
        **C,
    ),
)
add(
    "x3_month_parser",
    lambda d: d.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("m")).select(
        "o_orderkey",
        ps.month_start(
            F.when(F.col("o_orderkey") % 5 == 0, F.date_format("m", "yyyy-MM-dd"))
            .when(F.col("o_orderkey") % 5 == 1, F.date_format("m", "MMM/yyyy"))
            .when(F.col("o_orderkey") % 5 == 2, F.date_format("m", "M-yyyy"))
            .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit(" "), F.date_format("m", "MMMM yyyy")))
            .otherwise(F.date_format("m", "yyyy/MM/dd/01"))
        ).alias("ref_month"),
    ),
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE {day("date_trunc('month', o_orderdate)")} END AS ref_month FROM orders",
)

# Reference fares.
REF = """
    SELECT route_code, route_id, cast(date_trunc('month', scrape_date) AS date) AS m, window_days, max(total_fare) AS top FROM usable GROUP BY ALL"""


def reference_rows(d):
    top = d.usable.join(d.routes.select("route_id", "route_code"), "route_id").groupBy(
        "route_code", F.trunc("scrape_date", "month").alias("m"), "window_days"
    ).agg(F.max("total_fare").alias("top"))
    code = F.split("route_code", "-")
    route = (
        F.when(F.col("window_days") == 1, F.col("route_code"))
        .when(F.col("window_days") == 7, F.concat(F.lit(" "), F.lower(F.get(code, F.lit(1))), F.lit("_"), F.lower(F.get(code, F.lit(0)))))
        .when(F.col("window_days") == 15, F.lit("XXX-YYY"))
        .otherwise(F.lit("DELBOM"))
    )
    # Windows 1 and 7 land on the same route, so their months are kept apart.
    month = F.when(F.col("window_days") == 7, F.date_format(F.add_months("m", 1), "MMM-yyyy")).otherwise(F.date_format("m", "yyyy-MM"))
    return top.select(
        route.alias("City_Pair"), month.alias("Date"), F.concat(F.lit("₹"), F.format_number(F.col("top").cast("double"), 2)).alias("Average_Fare"),
        F.lit("").alias("fare_basis"),
    )


def reference_parsed(d):
    path = folder(d)
    sinks.export_csv(reference_rows(d), path)
    return ld.parse_reference_fares(ld.read_text_csv(d.spark, path), d.routes, "monitored fare", "https://example.org/fares")


add(
    "s3_reference_fares_load",
    lambda d: ld.accepted(reference_parsed(d)),
    sql(
        f"SELECT {big('route_id')} AS route_id, route_code, {day('CASE WHEN window_days = 7 THEN m + INTERVAL 1 MONTH ELSE m END')} AS ref_month, {num('top')} AS avg_fare,"
        " 'monitored fare' AS fare_basis, 'https://example.org/fares' AS source_url FROM refs WHERE window_days IN (1, 7)",
        refs=REF,
    ),
)
add(
    "s3_unknown_routes",
    lambda d: reference_parsed(d).filter("reject IS NOT NULL").groupBy("reject").agg(F.count(F.lit(1)).alias("row_count")),
    sql(
        "SELECT CASE WHEN window_days = 15 THEN 'unknown route' ELSE 'unreadable route' END AS reject, count(*) AS row_count FROM refs WHERE window_days NOT IN (1, 7) GROUP BY 1",
        refs=REF,
    ),
)
add(
    "j12_monthly_with_reference",
    lambda d: d.headline.filter("frequency = 'monthly'").join(
        ld.accepted(reference_parsed(d)).groupBy(F.col("ref_month").alias("index_date")).agg(F.avg("avg_fare").alias("reference_fare")), "index_date"
    ).select("index_date", "index_value", "reference_fare"),
    sql(
        f"""
        SELECT {day('index_date')} AS index_date, {num('index_value')} AS index_value, {num('reference_fare')} AS reference_fare
        FROM headline JOIN (SELECT CASE WHEN window_days = 7 THEN m + INTERVAL 1 MONTH ELSE m END AS index_date, avg(cast(top AS double)) AS reference_fare
                            FROM refs WHERE window_days IN (1, 7) GROUP BY 1) USING (index_date) WHERE frequency = 'monthly'""",
        refs=REF,
    ),
)
add(
    "a26_reference_fare_mean",
    lambda d: ld.accepted(reference_parsed(d)).groupBy("ref_month").agg(F.avg("avg_fare").alias("avg_fare")),
    sql(
        f"SELECT {day('CASE WHEN window_days = 7 THEN m + INTERVAL 1 MONTH ELSE m END')} AS ref_month, {num('avg(cast(top AS double))')} AS avg_fare FROM refs WHERE window_days IN (1, 7) GROUP BY 1",
        refs=REF,
    ),
)
add(
    "x2_canonical_route",
    lambda d: d.quotes.select(
        "ingest_seq",
        ps.route_pair(
            F.when(F.col("ingest_seq") % 4 == 0, F.concat("origin", F.lit("-"), "destination"))
            .when(F.col("ingest_seq") % 4 == 1, F.concat(F.lit(" "), F.lower("destination"), F.lit(" _ "), "origin"))
            .when(F.col("ingest_seq") % 4 == 2, F.concat("origin", "destination"))
            .otherwise(F.concat_ws("-", "origin", "destination", F.lit("BLR")))
        ).alias("p"),
    ).select("ingest_seq", F.concat_ws("-", "p.origin", "p.destination").alias("pair")),
    sql("SELECT ingest_seq, CASE WHEN ingest_seq % 4 < 2 THEN least(origin, destination) || '-' || greatest(origin, destination) ELSE '' END AS pair FROM quotes"),
)
add(
    "x4_money_parser",
    lambda d: d.table("orders").select(
        "o_orderkey",
        ps.money(
            F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("₹ "), F.format_number("o_totalprice", 2)))
            .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Rs. "), F.format_number("o_totalprice", 2)))
            .when(F.col("o_orderkey") % 4 == 2, F.concat(F.format_number("o_totalprice", 2), F.lit(" rs")))
            .otherwise(F.lit("-"))
        ).alias("amount"),
    ),
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN {num('round(o_totalprice, 2)')} END AS amount FROM orders",
)

# Payloads.
def documents(d):
    """One nested availability document per event, in the spellings of two profiles."""
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    money = lambda k: F.round(v * k, 2).cast("decimal(12,2)")
    clock = F.format_string("%02d:%02d", uid % 24, eid % 60)
    first = F.struct(
        uid.cast("string").alias("flightNumber"), clock.alias("departureTime"), F.lit(0).alias("stops"), F.lit("SAVER").alias("fareType"),
        (money(82) + F.when(eid % 11 == 0, 900).otherwise(0)).alias("baseFare"), F.when(eid % 2 == 1, money(10)).alias("taxAmount"),
        money(5).alias("udf"), money(3).alias("convenienceFee"), F.concat(F.lit("₹ "), F.format_number(v * 100, 2)).alias("totalAmount"),
    )
    second = F.struct(
        F.struct((uid + 1000).alias("number")).alias("flightNumber"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T06:20:00")).alias("std"),
        F.when(eid % 3 == 0, "1").otherwise("0").alias("numberOfStops"), (money(100) + 10).alias("grandTotal"),
    )
    text = F.concat(
        F.lit('{"trips":[{"journeys":['), F.to_json(first), F.lit(","), F.to_json(second), F.lit(","), F.to_json(first),
        F.lit(']}],"meta":{"k":'), F.get_json_object("props", "$.k"), F.lit(',"note":"{not a node}"}}'),
    )
    return d.events.select(
        eid.alias("raw_id"), F.when(uid % 2 == 0, "qp").otherwise("sg").alias("source"), F.when(uid % 2 == 0, "QP").otherwise("SG").alias("carrier"),
        F.lit("BLR").alias("origin"), F.lit("DEL").alias("destination"), F.col("ts").cast("date").alias("scrape_date"),
        F.col("ts").cast("date").alias("departure_date"), text.alias("payload"),
    )


_RAW: dict = {}


def raw_table(d):
    """The raw payload table of this folder, written once per session."""
    if d.path not in _RAW or _RAW[d.path][0] is not d:
        path = folder(d)
        # The store holds documents in many files, so parsing them is spread from the start.
        n = int(d.spark.conf.get("spark.sql.shuffle.partitions"))
        documents(d).repartition(n, "raw_id").write.parquet(path)
        _RAW[d.path] = (d, path)
    return ld.raw_payloads(d.spark, _RAW[d.path][1])


TWO = """
    SELECT event_id, user_id, cast(ts AS date) AS d, CASE WHEN user_id % 2 = 0 THEN 'QP' ELSE 'SG' END AS carrier, CASE WHEN user_id % 2 = 0 THEN 'qp' ELSE 'sg' END AS source,
           cast(round(value * 100, 2) AS decimal(12,2)) AS total, cast(round(value * 82, 2) AS decimal(12,2)) + CASE WHEN event_id % 11 = 0 THEN 900 ELSE 0 END AS base,
           cast(round(value * 10, 2) AS decimal(12,2)) AS tax, cast(round(value * 5, 2) AS decimal(12,2)) AS udf, cast(round(value * 3, 2) AS decimal(12,2)) AS conv FROM events"""
PQ = """
    SELECT event_id AS raw_id, source, carrier || user_id AS flight_number, cast(d AS timestamp) + to_hours(user_id % 24) + to_minutes(event_id % 60) AS dep, 'SAVER' AS brand,
           total, CASE WHEN event_id % 2 = 1 OR total - base - udf - conv >= 0 THEN base END AS base,
           CASE WHEN event_id % 2 = 1 THEN tax WHEN total - base - udf - conv >= 0 THEN total - base - udf - conv END AS taxes, udf FROM two
    UNION ALL
    SELECT event_id, source, carrier || (user_id + 1000), cast(d AS timestamp) + INTERVAL 6 HOUR + INTERVAL 20 MINUTE, NULL, total + 10, NULL, NULL, NULL FROM two WHERE event_id % 3 <> 0"""
Q = dict(two=TWO, pq=PQ)
add(
    "x11_payload_to_quotes",
    lambda d: pl.quotes(raw_table(d)).select(
        "raw_id", "source_code", "flight_number", "departure_at", "fare_brand", "total_fare", "base_fare", "taxes", "udf",
        F.array_join("quality_flags", "|").alias("flags"),
    ),
    sql(
        f"SELECT raw_id, source AS source_code, flight_number, cast(dep AS varchar) AS departure_at, brand AS fare_brand, {num('total')} AS total_fare, {num('base')} AS base_fare,"
        f" {num('taxes')} AS taxes, {num('udf')} AS udf, CASE WHEN base IS NULL THEN 'no_component_split' ELSE '' END AS flags FROM pq",
        **Q,
    ),
)


def wrapped(d):
    """The same documents inside 0 to 13 more levels, objects and arrays in turn."""
    k = (F.col("raw_id") % 14).cast("int")
    pair = lambda left, right: F.concat(F.repeat(F.lit(left), F.floor(k / 2).cast("int")), F.when(k % 2 == 1, right).otherwise(""))
    before, after = pair('{"w":[', '{"w":'), F.concat(F.when(k % 2 == 1, "}").otherwise(""), F.repeat(F.lit("]}"), F.floor(k / 2).cast("int")))
    return raw_table(d).withColumn("payload", F.concat(before, "payload", after))


add(
    "x11_depth_overflow",
    lambda d: pl.quotes(wrapped(d)).groupBy((F.col("raw_id") % 14).alias("levels")).agg(F.count(F.lit(1)).alias("quotes"), F.sum("total_fare").alias("total_fare")),
    sql(f"SELECT raw_id % 14 AS levels, count(*) AS quotes, {num('sum(total)')} AS total_fare FROM pq GROUP BY 1", **Q),
)


def nodes(d):
    found = pl.objects(raw_table(d)).withColumn("total", pl.by_profile(F.col("source"), "total"))
    return found.filter("total IS NOT NULL")


add(
    "x5_first_money_alias",
    lambda d: nodes(d).groupBy("raw_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("total").alias("total")),
    sql(f"SELECT event_id AS raw_id, cast(3 AS bigint) AS nodes, {num('3 * total + 10')} AS total FROM two", **Q),
)
add(
    "e6_alias_tables",
    lambda d: nodes(d).groupBy("source").agg(F.count(F.lit(1)).alias("nodes"), F.sum(pl.by_profile(F.col("source"), "convenience")).alias("convenience")),
    sql(f"SELECT source, 3 * count(*) AS nodes, {num('2 * sum(conv)')} AS convenience FROM two GROUP BY 1", **Q),
)
add(
    "x6_flight_number",
    lambda d: nodes(d).select("raw_id", pl.flight_number(F.col("carrier")).alias("flight_number")).distinct(),
    sql("SELECT event_id AS raw_id, carrier || user_id AS flight_number FROM two UNION SELECT event_id, carrier || (user_id + 1000) FROM two", **Q),
)
add(
    "x7_departure_timestamp",
    lambda d: nodes(d).select("raw_id", pl.departure_at(F.col("departure_date")).alias("departure_at")).distinct(),
    sql(
        "SELECT event_id AS raw_id, cast(cast(d AS timestamp) + to_hours(user_id % 24) + to_minutes(event_id % 60) AS varchar) AS departure_at FROM two"
        " UNION SELECT event_id, cast(cast(d AS timestamp) + INTERVAL 6 HOUR + INTERVAL 20 MINUTE AS varchar) FROM two",
        **Q,
    ),
)
add(
    "x8_brand_and_stops",
    lambda d: nodes(d).groupBy(pl.brand().alias("brand"), pl.stops().alias("stops")).agg(F.count(F.lit(1)).alias("nodes")),
    sql("SELECT 'SAVER' AS brand, cast(0 AS bigint) AS stops, 2 * count(*) AS nodes FROM two UNION ALL SELECT NULL, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END, count(*) FROM two GROUP BY 2", **Q),
)
add(
    "x9_residual_taxes",
    lambda d: pl.quotes(raw_table(d)).groupBy(F.col("base_fare").isNotNull().alias("has_split")).agg(F.count(F.lit(1)).alias("quotes"), F.sum("taxes").alias("taxes")),
    sql(f"SELECT base IS NOT NULL AS has_split, count(*) AS quotes, {num('sum(taxes)')} AS taxes FROM pq GROUP BY 1", **Q),
)
add(
    "x12_observed_keys",
    lambda d: pl.observed_keys(raw_table(d)).groupBy(F.array_join("keys", ",").alias("keys")).agg(F.count(F.lit(1)).alias("documents")),
    sql(
        "SELECT array_to_string(list_sort(list_concat(['trips', 'journeys', 'meta', 'k', 'note', 'flightNumber', 'departureTime', 'stops', 'fareType', 'baseFare', 'udf',"
        " 'convenienceFee', 'totalAmount', 'number', 'std', 'numberOfStops', 'grandTotal'], CASE WHEN event_id % 2 = 1 THEN ['taxAmount'] ELSE [] END)), ',') AS keys,"
        " count(*) AS documents FROM two GROUP BY 1",
        **Q,
    ),
)
add(
    "x14_payload_hash",
    lambda d: d.events.select("event_id", pl.payload_hash(F.col("props")).alias("sha256")),
    "SELECT event_id, sha256(replace(props, ' ', '')) AS sha256 FROM events",
)


add("s7_raw_payload_scan", lambda d: raw_table(d).groupBy("source", "scrape_date").agg(F.count(F.lit(1)).alias("documents")), sql(
    f"SELECT source, {day('d')} AS scrape_date, count(*) AS documents FROM two GROUP BY ALL", **Q))
add(
    "x10_page_state_markers",
    lambda d: d.table("documents").select(
        "doc_id", F.concat("text", F.when(F.col("doc_id") % 5 == 0, " Sorry, SOLD OUT today").when(F.col("doc_id") % 7 == 0, " No Flights Found").otherwise("")).alias("t")
    ).select("doc_id", ps.looks_sold_out(F.col("t")).alias("sold_out"), ps.looks_no_service(F.col("t")).alias("no_service")),
    "SELECT doc_id, "
    + ", ".join(
        "(" + " OR ".join(f"contains(lower(t), '{m.replace(chr(39), chr(39) * 2)}')" for m in ms) + f") AS {n}"
        for n, ms in (("sold_out", ps.SOLD_OUT_MARKERS), ("no_service", ps.NO_SERVICE_MARKERS))
    )
    + " FROM (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' Sorry, SOLD OUT today' WHEN doc_id % 7 = 0 THEN ' No Flights Found' ELSE '' END AS t FROM documents)",
)
add(
    "x13_landing_fare",
    lambda d: d.table("pages").select(
        "page_id", ps.landing_fare(F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<p>Fares starting at ₹ "), F.format_number(F.col("page_id") + 4000, 0), F.lit("</p>"))).otherwise(F.col("html"))).alias("fare")
    ),
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN cast(page_id + 4000 AS double) END AS fare FROM pages",
)

# Reference registers.
add(
    "s4_basket_config",
    lambda d: ld.basket_config(d.spark, str(CONFIG / "basket.json"))["routes"].join(d.fares.groupBy("route_id").agg(F.count(F.lit(1)).alias("fares")), "route_id").select("route_code", "fares"),
    sql("SELECT route_code, count(*) AS fares FROM fares GROUP BY 1"),
)
add(
    "s4_source_config",
    lambda d: d.requests.join(
        ld.source_config(d.spark, str(CONFIG / "sources.json")).select(F.col("code").alias("source"), "tier", "min_delay_seconds"), "source"
    ).groupBy("source", "tier", "min_delay_seconds").agg(F.count(F.lit(1)).alias("requests")),
    sql(
        f"SELECT source, {big('t')} AS tier, {num('md')} AS min_delay_seconds, count(*) AS requests FROM audit JOIN (VALUES ('view', 1, 8.0), ('click', 2, 6.0), ('purchase', 3, 6.0)) s(code, t, md)"
        " ON code = source GROUP BY ALL"
    ),
)


def share_document(d):
    n = d.events.agg(F.count_if(F.col("user_id") % 2 == 0).alias("even"), F.count(F.lit(1)).alias("n"))
    doc = F.create_map(
        F.lit("Akasa Air"), F.round(F.col("even") / F.col("n"), 6), F.lit("SpiceJet"), F.round(1 - F.col("even") / F.col("n"), 6), F.lit("Unlisted Air"), F.lit(0.25)
    )
    return n.select(F.to_json(F.struct(doc.alias("carrier_share"))).alias("payload"))


add(
    "s5_carrier_share_json",
    lambda d: ld.carrier_shares(share_document(d)),
    f"SELECT unnest(['QP', 'SG']) AS carrier, unnest([{num('s')}, {num('1 - s')}]) AS share FROM (SELECT avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS s FROM events)",
)


# Idempotent writes.
def base_upsert(d):
    path = folder(d)
    keys = [*S.CARRIER_CELL, "price_ref_start"]
    sinks.upsert(d.spark, d.base, path, keys, ["price_ref_start"])
    sinks.upsert(d.spark, d.base.filter("carrier = 'QP'").withColumn("base_price", (F.col("base_price") * 2).cast("decimal(12,4)")), path, keys, ["price_ref_start"])
    return d.spark.read.parquet(path).select(*S.CARRIER_CELL, "base_price")


add(
    "k4_base_price_upsert",
    base_upsert,
    sql(f"SELECT {big('route_id')} AS route_id, {big('window_days')} AS window_days, carrier, {num("base_price * CASE WHEN carrier = 'QP' THEN 2 ELSE 1 END")} AS base_price FROM base"),
)


def headline_upsert(d):
    """Write all frequencies, then rewrite the daily rows twice: the table must not grow."""
    path = folder(d)
    keys = ["index_date", "frequency"]
    sinks.upsert(d.spark, d.headline, path, keys, ["frequency"])
    for _ in range(2):
        sinks.upsert(d.spark, d.headline.filter("frequency = 'daily'"), path, keys, ["frequency"])
    return d.spark.read.parquet(path).groupBy("frequency").agg(F.count(F.lit(1)).alias("row_count"), F.sum("index_value").alias("total"))


add("k5_headline_upsert", headline_upsert, sql(f"SELECT frequency, count(*) AS row_count, {num('sum(index_value)')} AS total FROM headline GROUP BY 1"))


def weight_history(d):
    """A second reference period is added beside the first, not over it."""
    path = folder(d)
    fresh = w.route_weights(totals(d), basket(d)).select("route_code", "passengers", F.lit("1996-01-01").cast("date").alias("weight_ref_start"))
    keys = ["route_code", "weight_ref_start"]
    sinks.upsert(d.spark, fresh, path, keys, ["weight_ref_start"])
    sinks.upsert(d.spark, fresh.withColumn("weight_ref_start", F.lit("1997-01-01").cast("date")), path, keys, ["weight_ref_start"])
    sinks.upsert(d.spark, fresh, path, keys, ["weight_ref_start"])
    return d.spark.read.parquet(path).groupBy("weight_ref_start").agg(F.count(F.lit(1)).alias("routes"), F.sum("passengers").alias("passengers"))


def fare_reference_upsert(d):
    """Load the reference fares, then a revision of one month of routes with a higher fare."""
    path = folder(d)
    rows = ld.accepted(reference_parsed(d))
    keys = ["route_id", "ref_month"]
    sinks.upsert(d.spark, rows, path, keys, ["ref_month"])
    sinks.upsert(d.spark, rows.filter("route_id % 2 = 0").withColumn("avg_fare", F.col("avg_fare") + 100), path, keys, ["ref_month"])
    return d.spark.read.parquet(path).select("route_id", "ref_month", "avg_fare")


add(
    "k6_fare_reference_upsert",
    fare_reference_upsert,
    sql(
        f"SELECT {big('route_id')} AS route_id, {day('CASE WHEN window_days = 7 THEN m + INTERVAL 1 MONTH ELSE m END')} AS ref_month,"
        f" {num('top + CASE WHEN route_id % 2 = 0 THEN 100 ELSE 0 END')} AS avg_fare FROM refs WHERE window_days IN (1, 7)",
        refs=REF,
    ),
)


def window_history(d):
    """Windows that quotes were seen for, stamped with two reference periods: the later load keeps the earlier one."""
    path = folder(d)
    seen = d.usable.groupBy("window_days").agg(F.count(F.lit(1)).alias("quotes"))
    rows = d.windows.join(seen, "window_days").select("window_days", "label", "weight", "quotes")
    keys = ["window_days", "weight_ref_start"]
    for start in ("2024-01-01", "2025-01-01", "2024-01-01"):
        sinks.upsert(d.spark, rows.withColumn("weight_ref_start", F.lit(start).cast("date")), path, keys, ["weight_ref_start"])
    return d.spark.read.parquet(path).select("window_days", "weight_ref_start", "weight", "quotes")


add(
    "k7_window_history_upsert",
    window_history,
    sql(
        f"SELECT {big('window_days')} AS window_days, p AS weight_ref_start, {num('weight')} AS weight, quotes FROM windows"
        " JOIN (SELECT window_days, count(*) AS quotes FROM usable GROUP BY 1) USING (window_days), (SELECT unnest(['2024-01-01', '2025-01-01']) AS p)"
    ),
)
add(
    "k7_weight_history_upsert",
    weight_history,
    sql(f"SELECT unnest(['1996-01-01', '1997-01-01']) AS weight_ref_start, count(*) AS routes, {big('sum(passengers)')} AS passengers FROM basket", **W),
)


def fare_replay(d):
    """Insert the stored fares twice: the second run adds nothing."""
    path = folder(d)
    for _ in range(2):
        sinks.insert_absent(d.spark, d.fares, path, S.FARE_IDENTITY, ["scrape_date"], "ingest_seq", where=F.col("flight_number").isNotNull())
    return d.spark.read.parquet(path).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("row_count"))


add("k2_fare_replay", fare_replay, sql(f"SELECT {day('scrape_date')} AS scrape_date, count(*) AS row_count FROM fares GROUP BY 1"))


def exported(d):
    path = folder(d)
    sets = export.result_sets(d)
    sinks.export_json(sets, path)
    out = None
    for name in sets:
        part = d.spark.read.text(f"{path}/{name}").agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("row_count"))
        out = part if out is None else out.unionByName(part)
    return out
