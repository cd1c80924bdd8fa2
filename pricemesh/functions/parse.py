"""Tolerant parsers for text that arrives in several shapes; unreadable input becomes null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Month names and page-state markers.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SOLD_OUT_MARKERS = [
    "sold out", "no seats available", "fully booked", "no fares available", "seats are not available",
    "no seats left",
]
NO_SERVICE_MARKERS = [
    "no flights found", "we don't fly", "we do not operate", "no flights available on", "try another date",
    "no flights on this route", "no results found",
]
LANDING_FARE = "(?i)(?:starting|lowest|from)[^₹]{0,40}₹\\s?([\\d,]{3,9})"
# End of fixed values.


def money(text: Column, scale: str = "decimal(18,2)") -> Column:
    """Amount in rupees: currency marks, spaces and grouping are dropped, the decimal point kept."""
    bare = F.regexp_replace(text, "(?i)(₹|rs\\.?)", "")
    bare = F.regexp_replace(bare, "[\\s,]", "")
    return bare.try_cast(scale)


def month_start(text: Column) -> Column:
    """First of the month from yyyy-m[-d], Mon[th]-yyyy or m-yyyy (space and slash allowed)."""
    s = F.trim(text)
    iso = F.regexp_extract(s, r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$", 1)
    iso_m = F.regexp_extract(s, r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$", 2)
    name = F.lower(F.substring(F.regexp_extract(s, r"^([A-Za-z]{3,9})[-\s/](\d{4})$", 1), 1, 3))
    name_y = F.regexp_extract(s, r"^([A-Za-z]{3,9})[-\s/](\d{4})$", 2)
    num_m = F.regexp_extract(s, r"^(\d{1,2})[-/](\d{4})$", 1)
    num_y = F.regexp_extract(s, r"^(\d{1,2})[-/](\d{4})$", 2)
    names = F.array(*[F.lit(m) for m in MONTHS])
    at = F.array_position(names, name)

    def first_of(year: Column, month: Column) -> Column:
        y, m = year.try_cast("int"), month.try_cast("int")
        return F.when(y.isNotNull() & m.between(1, 12), F.make_date(y, m, F.lit(1)))

    return F.coalesce(first_of(iso, iso_m), F.when(at > 0, first_of(name_y, at)), first_of(num_y, num_m))


def route_pair(text: Column) -> Column:
    """Unordered pair of three-letter codes as struct(origin, destination); null if malformed."""
    parts = F.transform(F.split(F.replace(text, F.lit("_"), F.lit("-")), "-"), lambda p: F.upper(F.trim(p)))
    parts = F.filter(parts, lambda p: p != "")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = (F.size(parts) == 2) & (F.length(a) == 3) & (F.length(b) == 3)
    return F.when(ok, F.struct(F.least(a, b).alias("origin"), F.greatest(a, b).alias("destination")))


def has_marker(text: Column, markers: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda x, y: x | y, [F.contains(low, F.lit(m)) for m in markers])


def looks_sold_out(text: Column) -> Column:
    return has_marker(text, SOLD_OUT_MARKERS)


def looks_no_service(text: Column) -> Column:
    return has_marker(text, NO_SERVICE_MARKERS)


def landing_fare(html: Column) -> Column:
    """Indicative lowest fare of a route landing page; null when the page names none."""
    return money(F.regexp_extract(html, LANDING_FARE, 1))
