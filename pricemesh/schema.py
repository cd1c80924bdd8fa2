"""Table schemas and the fixed constants of the methodology."""

from __future__ import annotations

# Methodology constants every published figure depends on.
MIN_PLAUSIBLE_FARE = 500
MAX_PLAUSIBLE_FARE = 200000
MAX_WINDOW_DAYS = 365
RECONCILE_TOLERANCE = 1
MIN_GROUP_FOR_DISPERSION = 5
MAD_SCALE = 0.6745
MAD_THRESHOLD = 3.5
IQR_K = 3.0
MAX_CARRY_FORWARD = 2
MIN_BASE_OBSERVATIONS = 10
INDEX_BASE = 100.0
CLEANER_VERSION = "clean-v1"

REJECT_SAME_OD = "origin_equals_destination"
REJECT_NON_POSITIVE = "non_positive_total"
REJECT_WINDOW = "window_out_of_range"
REJECT_BELOW = "implausible_below_minimum"
REJECT_ABOVE = "implausible_above_maximum"
# End of fixed values.

COMPONENTS = ["base_fare", "taxes", "udf", "convenience_fee", "other_charges"]

QUOTE = """
    source_code STRING, origin STRING, destination STRING, carrier STRING,
    scrape_date DATE, departure_date DATE, total_fare DECIMAL(12,2),
    flight_number STRING, departure_at TIMESTAMP_NTZ, arrival_at TIMESTAMP_NTZ, stops INT,
    fare_class STRING, fare_brand STRING,
    base_fare DECIMAL(12,2), taxes DECIMAL(12,2), udf DECIMAL(12,2),
    convenience_fee DECIMAL(12,2), other_charges DECIMAL(12,2),
    currency STRING, is_sold_out BOOLEAN, quality_flags ARRAY<STRING>, ingest_seq BIGINT
"""

# Identity of an observation. The route is deliberately not part of it.
QUOTE_IDENTITY = [
    "source_code", "scrape_date", "carrier", "flight_number",
    "departure_date", "fare_class", "fare_brand", "total_fare",
]

# Identity of a stored fare; rows without a flight number are never merged.
FARE_IDENTITY = [
    "source_code", "scrape_date", "carrier", "flight_number",
    "departure_date", "fare_class", "total_fare",
]

# The group a quote is judged within: one day, one carrier, one cell.
COMPARISON_GROUP = ["origin", "destination", "carrier", "window_days", "scrape_date"]

CELL = ["route_id", "window_days"]
CARRIER_CELL = ["route_id", "window_days", "carrier"]
