"""The default basket and reference tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricemesh.sources.inline import inline_table

# Basket routes with the traffic behind their weights, booking windows,
# window-weight scenarios, national carrier shares.
ROUTES = [
    (1, "BLR", "DEL", 4879073, "0.2072001"),
    (2, "BOM", "DEL", 3751418, "0.1593118"),
    (3, "DEL", "HYD", 3095780, "0.1314687"),
    (4, "CCU", "DEL", 2866361, "0.1217260"),
    (5, "BLR", "BOM", 2310386, "0.0981153"),
    (6, "BLR", "HYD", 2251473, "0.0956135"),
    (7, "DEL", "MAA", 2221545, "0.0943425"),
    (8, "BLR", "CCU", 2171615, "0.0922221"),
]
WINDOWS = [(1, "T+1"), (7, "T+7"), (15, "T+15"), (30, "T+30"), (45, "T+45")]
WINDOW_WEIGHT = "0.20"
WINDOW_BASIS = "equal-weight (assumption)"
SCENARIOS = {
    "equal": [0.20, 0.20, 0.20, 0.20, 0.20],
    "near_heavy": [0.35, 0.25, 0.20, 0.12, 0.08],
    "advance_heavy": [0.08, 0.12, 0.20, 0.30, 0.30],
}
CARRIER_SHARE = [
    ("6E", "0.638924"), ("AI", "0.151647"), ("IX", "0.114967"), ("QP", "0.052578"), ("SG", "0.030334"),
]
CARRIER_NAMES = {
    "IndiGo": "6E", "Air India": "AI", "Air India Express": "IX", "Akasa Air": "QP", "SpiceJet": "SG",
}
AIRPORTS = [
    ("BLR", "Bengaluru"), ("BOM", "Mumbai"), ("CCU", "Kolkata"),
    ("DEL", "Delhi"), ("HYD", "Hyderabad"), ("MAA", "Chennai"),
]
# End of fixed values.
WEIGHT_REF_START = "2025-06-01"
WEIGHT_REF_END = "2026-05-31"


def routes(spark: SparkSession) -> DataFrame:
    rows = [(i, o, d, f"{o}-{d}", True) for i, o, d, _, _ in ROUTES]
    return inline_table(spark, rows, "route_id INT, origin STRING, destination STRING, route_code STRING, in_basket BOOLEAN"
    )


def route_weights(spark: SparkSession) -> DataFrame:
    rows = [(i, WEIGHT_REF_START, WEIGHT_REF_END, p, w) for i, _, _, p, w in ROUTES]
    df = inline_table(spark, rows, "route_id INT, weight_ref_start STRING, weight_ref_end STRING, passengers BIGINT, weight STRING"
    )
    return df.selectExpr(
        "route_id", "to_date(weight_ref_start) weight_ref_start", "to_date(weight_ref_end) weight_ref_end",
        "passengers", "cast(weight as decimal(12,10)) weight",
    )


def windows(spark: SparkSession) -> DataFrame:
    rows = [(d, label, WINDOW_WEIGHT, WINDOW_BASIS, True) for d, label in WINDOWS]
    df = inline_table(spark, rows, "window_days INT, label STRING, weight STRING, weight_basis STRING, in_basket BOOLEAN"
    )
    return df.withColumn("weight", df["weight"].cast("decimal(12,10)"))


def scenarios(spark: SparkSession) -> DataFrame:
    rows = [
        (i, name, WINDOWS[j][0], w)
        for i, (name, weights) in enumerate(SCENARIOS.items())
        for j, w in enumerate(weights)
    ]
    return inline_table(spark, rows, "scenario_no INT, scenario STRING, window_days INT, window_weight DOUBLE")


def carrier_share(spark: SparkSession) -> DataFrame:
    df = inline_table(spark, CARRIER_SHARE, "carrier STRING, share STRING")
    return df.withColumn("share", df["share"].cast("decimal(10,6)"))


def airports(spark: SparkSession) -> DataFrame:
    return inline_table(spark, AIRPORTS, "iata STRING, city_name STRING")
