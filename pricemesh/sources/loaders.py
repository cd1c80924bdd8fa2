"""Readers of the reference's file formats. All columns are read as text and parsed tolerantly."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricemesh.functions.common import must
from pricemesh.functions.parse import month_start, route_pair
from pricemesh.sources.defaults import CARRIER_NAMES
from pricemesh.sources.inline import inline_table

# Accepted header spellings and defaults.
MONTH_HEADERS = ["month", "period", "date"]
INDEX_HEADERS = ["index_value", "index", "value"]
ROUTE_HEADERS = ["route", "sector", "city_pair"]
FARE_HEADERS = ["avg_fare", "average_fare", "fare", "value"]
CPI_SERIES = "CPI_DIV07_TRANSPORT"
CPI_DESCRIPTION = "CPI Division 07 Transport"
CPI_BASE_YEAR = 2024
# End of fixed values.


class BadHeader(ValueError):
    """A required column is absent under every accepted name."""


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text; a byte-order mark on the first name is dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def resolve(columns: list[str], names: list[str], required: bool = True) -> str | None:
    """First accepted name present, compared without case and surrounding space."""
    lower = {c.strip().lower(): c for c in columns}
    for name in names:
        if name in lower:
            return lower[name]
    if required:
        raise BadHeader(f"need one of {names}; found {columns}")
    return None


def _optional(rows: DataFrame, name: str) -> Column:
    found = resolve(rows.columns, [name], required=False)
    return F.nullif(F.col(f"`{found}`"), F.lit("")) if found else F.lit(None).cast("string")


def traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_text_csv(spark, path).select("Year", "Month", "City1", "City2", "PaxToCity2", "PaxFromCity2")


def parse_cpi(rows: DataFrame, series_code: str = CPI_SERIES) -> DataFrame:
    """Typed rows of an official monthly index with `reject`: null for a usable row."""
    month, value = resolve(rows.columns, MONTH_HEADERS), resolve(rows.columns, INDEX_HEADERS)
    number = F.regexp_replace(F.trim(F.col(f"`{value}`")), ",", "").try_cast("double")
    sector = F.lower(F.trim(_optional(rows, "sector")))
    return rows.select(
        F.lit(series_code).alias("series_code"),
        month_start(F.col(f"`{month}`")).alias("ref_month"),
        F.when(sector.isin("rural", "urban", "combined"), sector).otherwise("combined").alias("sector"),
        number.alias("index_value"),
        F.coalesce(_optional(rows, "base_year").try_cast("int"), F.lit(CPI_BASE_YEAR)).alias("base_year"),
        F.coalesce(F.trim(_optional(rows, "description")), F.lit(CPI_DESCRIPTION)).alias("description"),
    ).withColumn(
        "reject",
        F.when(F.col("ref_month").isNull(), "unreadable month")
        .when(F.col("index_value").isNull() | F.isnan("index_value"), "unreadable value")
        .when(F.col("index_value") <= 0, "non-positive value"),
    )


def parse_reference_fares(
    rows: DataFrame, routes: DataFrame, default_basis: str | None = None, default_source: str | None = None
) -> DataFrame:
    """Typed reference fares with `reject`; a usable row without basis or source fails the job."""
    route, month, fare = (resolve(rows.columns, h) for h in (ROUTE_HEADERS, MONTH_HEADERS, FARE_HEADERS))
    amount = F.regexp_replace(F.trim(F.col(f"`{fare}`")), "[,₹]", "").try_cast("double")
    parsed = rows.select(
        route_pair(F.col(f"`{route}`")).alias("pair"),
        month_start(F.col(f"`{month}`")).alias("ref_month"),
        amount.alias("avg_fare"),
        F.coalesce(F.trim(_optional(rows, "fare_basis")), F.lit(default_basis)).alias("fare_basis"),
        F.coalesce(F.trim(_optional(rows, "source_url")), F.lit(default_source)).alias("source_url"),
    )
    known = routes.select("route_id", F.struct("origin", "destination").alias("pair"))
    out = parsed.join(known, "pair", "left").withColumn("route_code", F.concat_ws("-", "pair.origin", "pair.destination"))
    reject = (
        F.when(F.col("pair").isNull(), "unreadable route")
        .when(F.col("ref_month").isNull(), "unreadable month")
        .when(F.col("avg_fare").isNull() | F.isnan("avg_fare"), "unreadable fare")
        .when(F.col("avg_fare") <= 0, "non-positive fare")
        .when(F.col("route_id").isNull(), "unknown route")
    )
    stated = F.col("fare_basis").isNotNull() & F.col("source_url").isNotNull()
    checked = must(
        out.withColumn("reject", reject),
        F.col("reject").isNotNull() | stated,
        F.lit("fare_basis and source_url are mandatory"),
    )
    return checked.select("route_id", "route_code", "ref_month", "avg_fare", "fare_basis", "source_url", "reject")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject").isNull()).drop("reject")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject").isNotNull())


def unknown_routes(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject") == "unknown route").select("route_code").distinct()


def carrier_shares(documents: DataFrame, names: dict[str, str] = CARRIER_NAMES) -> DataFrame:
    """(carrier, share) from JSON text with a `carrier_share` object; unmapped names drop out."""
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    shares = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json("payload"), "$.carrier_share", "variant")), "map<string,double>")
    rows = documents.select(F.explode(shares).alias("name", "share"))
    return rows.select(F.element_at(mapping, F.col("name")).alias("carrier"), F.col("share").cast("decimal(10,6)").alias("share")).filter(
        F.col("carrier").isNotNull()
    )


def carrier_share_file(spark: SparkSession, path: str) -> DataFrame:
    return carrier_shares(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


def _config(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("YAML configuration needs PyYAML; JSON is read without it") from exc
        return yaml.safe_load(text)
    return json.loads(text)


def basket_config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Routes, weights, windows and weight scenarios from a basket configuration file.

    Configuration is a register of some hundred rows at most, read on the driver.
    """
    cfg = _config(path)
    ref = cfg["weight_reference"]
    ends = [tuple(sorted((r["origin"], r["destination"]))) for r in cfg["routes"]]
    routes = [(i, a, b, f"{a}-{b}", True) for i, (a, b) in enumerate(ends, start=1)]
    weights = [
        (i, str(ref["start"]), str(ref["end"]), int(r["passengers"]), str(r["weight"]))
        for i, r in enumerate(cfg["routes"], start=1)
    ]
    windows = [(w["days"], w["label"], str(w["weight"]), w["weight_basis"], True) for w in cfg["advance_windows"]]
    scenarios = [
        (n, name, w["days"], float(v))
        for n, (name, values) in enumerate(cfg.get("window_weight_scenarios", {}).items())
        for w, v in zip(cfg["advance_windows"], values)
    ]
    rw = inline_table(spark, weights, "route_id INT, s STRING, e STRING, passengers BIGINT, weight STRING")
    win = inline_table(
        spark, windows, "window_days INT, label STRING, weight STRING, weight_basis STRING, in_basket BOOLEAN"
    )
    return {
        "routes": inline_table(
            spark, routes, "route_id INT, origin STRING, destination STRING, route_code STRING, in_basket BOOLEAN"
        ),
        "route_weights": rw.selectExpr(
            "route_id", "to_date(s) weight_ref_start", "to_date(e) weight_ref_end", "passengers",
            "cast(weight as decimal(12,10)) weight",
        ),
        "windows": win.withColumn("weight", win["weight"].cast("decimal(12,10)")),
        "scenarios": inline_table(
            spark, scenarios, "scenario_no INT, scenario STRING, window_days INT, window_weight DOUBLE"
        ),
    }


def source_config(spark: SparkSession, path: str) -> DataFrame:
    """Source register with defaults filled in and the robots pseudo-source appended."""
    cfg = _config(path)
    base = cfg.get("defaults", {})
    rows = [
        (
            s["code"], s["display_name"], s["base_url"], s["kind"], s.get("tier"), bool(s.get("enabled")),
            s.get("exclusion_reason"), s["audit_verdict"],
            float(s.get("min_delay_seconds", base.get("min_delay_seconds", 6.0))),
            float(s.get("jitter_seconds", base.get("jitter_seconds", 2.0))),
            list(s.get("intent_denied_paths", [])),
        )
        for s in cfg["sources"]
    ]
    rows.append(
        ("__robots__", "robots.txt fetches", "-", "official", 1, False, "internal pseudo-source for robots.txt retrieval",
         "scrape_ok", 6.0, 2.0, [])
    )
    return inline_table(
        spark, rows,
        "code STRING, display_name STRING, base_url STRING, kind STRING, tier INT, enabled BOOLEAN,"
        " exclusion_reason STRING, audit_verdict STRING, min_delay_seconds DOUBLE, jitter_seconds DOUBLE,"
        " intent_denied_paths ARRAY<STRING>",
    )


def robots_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Stored robots files, one row per file, whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("snapshot_id"),
        F.regexp_replace(F.regexp_replace("_metadata.file_name", r"\.txt$", ""), "^[a-z0-9]+_", "").alias("host"),
        F.lit(200).alias("http_status"),
        F.col("value").alias("body"),
    )


def raw_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Raw payload table; documents stay text until parsed."""
    return spark.read.parquet(path)
