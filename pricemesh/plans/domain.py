"""Domain views over the driver's tables: quotes, request log, series, traffic."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemesh import staging
from pricemesh.functions.common import fixed4
from pricemesh.operators import fares as fare_ops
from pricemesh.operators import index as index_ops
from pricemesh.operators.cleaning import CleaningResult, clean_quotes
from pricemesh.sources import defaults
from pricemesh.sources.inline import inline_table

PRICE_REF_START = "2024-01-01"
PRICE_REF_END = "2024-01-14"
MIN_BASE_OBS = 5

ENDS = {
    "click": ("BLR", "DEL"),
    "error": ("BOM", "DEL"),
    "purchase": ("DEL", "HYD"),
    "signup": ("CCU", "DEL"),
    "view": ("BLR", "BOM"),
}


def _end(side: int):
    out = None
    for name, ends in ENDS.items():
        hit = F.col("event_type") == name
        out = F.when(hit, ends[side]) if out is None else out.when(hit, ends[side])
    return out


def quotes_from_events(events: DataFrame) -> DataFrame:
    """Fare quotes carried by the event stream; every tenth event arrives twice."""
    e = events.select(
        "event_id", F.col("ts").cast("date").alias("scrape_date"), "user_id", "event_type", "value",
        F.explode(F.when(F.col("event_id") % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias(
            "arrival"
        ),
    )
    eid, uid, value = F.col("event_id"), F.col("user_id"), F.col("value")
    swapped = uid % 4 == 3
    origin = F.when(swapped, _end(1)).otherwise(_end(0))
    dest = F.when(eid % 97 == 0, origin).when(swapped, _end(0)).otherwise(_end(1))
    window = F.element_at(F.array(*[F.lit(w) for w, _ in defaults.WINDOWS]), (uid % 5 + 1).cast("int"))
    window = F.when(eid % 101 == 0, 0).otherwise(window)
    carrier = F.when(uid % 2 == 0, "QP").otherwise("SG")
    shift = F.when(eid % 211 == 0, 10).otherwise(1)
    no_split = eid % 7 == 0

    def money(factor):
        return F.round(value * factor, 2).cast("decimal(12,2)")

    base = F.when(no_split, None).otherwise(money(82) + F.when(eid % 11 == 0, 900).otherwise(0)).cast("decimal(12,2)")
    return e.select(
        F.when(eid % 10 == 9, "seed").when(eid % 2 == 0, "qpweb").otherwise("sgweb").alias("source_code"),
        origin.alias("origin"),
        dest.alias("destination"),
        carrier.alias("carrier"),
        "scrape_date",
        F.date_add("scrape_date", window).alias("departure_date"),
        (money(100) * shift).cast("decimal(12,2)").alias("total_fare"),
        F.when(eid % 13 != 0, F.concat(carrier, uid.cast("string"))).alias("flight_number"),
        F.lit(None).cast("timestamp_ntz").alias("departure_at"),
        F.lit(None).cast("timestamp_ntz").alias("arrival_at"),
        F.when(eid % 17 == 0, 1).otherwise(0).alias("stops"),
        F.lit("ECONOMY").alias("fare_class"),
        F.when(eid % 3 == 0, "SAVER").when(eid % 3 == 1, "FLEX").alias("fare_brand"),
        base.alias("base_fare"),
        F.when(no_split, None).otherwise(money(10)).alias("taxes"),
        money(5).alias("udf"),
        money(3).alias("convenience_fee"),
        F.lit(None).cast("decimal(12,2)").alias("other_charges"),
        F.lit("INR").alias("currency"),
        (eid % 25 == 0).alias("is_sold_out"),
        F.array().cast("array<string>").alias("quality_flags"),
        (eid * 2 + F.col("arrival")).alias("ingest_seq"),
    )


def quotes_from_lineitem(lineitem, orders, customer, supplier, nation) -> DataFrame:
    """A long quote table: region pairs as routes, seven windows, three carriers, ~2,400 days."""
    c = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select(
        "c_custkey", F.col("n_regionkey").alias("c_region")
    )
    s = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        "s_suppkey", F.col("n_regionkey").alias("s_region")
    )
    window = F.element_at(F.array(*[F.lit(w) for w in (1, 3, 7, 15, 30, 45, 60)]), F.col("l_linenumber"))
    return (
        lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_extendedprice")
        .join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("o_orderdate").cast("date").alias("scrape_date"),
            F.concat(F.lit("R"), "c_region").alias("origin"),
            F.concat(F.lit("R"), "s_region").alias("destination"),
            F.col("l_returnflag").alias("carrier"),
            window.alias("window_days"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("total_fare"),
        )
    )


SOURCE_REGISTRY = [
    ("click", "Click feed", "ota", 2, True, None, "licensed_api"),
    ("error", "Error feed", "airline", 1, False, "adapter not built", "scrape_with_caution"),
    ("purchase", "Purchase feed", "airline", 3, False, "active bot management", "do_not_scrape"),
    ("signup", "Signup feed", "ota", 4, False, "search path disallowed", "do_not_scrape"),
    ("view", "View feed", "airline", 1, True, None, "scrape_ok"),
    ("seed", "Synthetic rows", "official", 1, False, "synthetic demo rows", "scrape_ok"),
    ("__robots__", "robots.txt fetches", "official", 1, False, "internal pseudo-source", "scrape_ok"),
]


def source_registry(spark: SparkSession) -> DataFrame:
    return inline_table(spark, SOURCE_REGISTRY,
        "code STRING, display_name STRING, kind STRING, tier INT, enabled BOOLEAN, exclusion_reason STRING,"
        " audit_verdict STRING",
    )


def request_log(events: DataFrame) -> DataFrame:
    """One logged request per event; status, refusals and delays follow from the event."""
    eid = F.col("event_id")
    intent = eid % 31 == 0
    allowed = ~intent & (eid % 19 != 0)
    status = (
        F.when(~allowed, None)
        .when(eid % 23 == 0, None)
        .when(eid % 29 == 0, 429)
        .when(eid % 37 == 0, 503)
        .when(eid % 41 == 0, 404)
        .otherwise(200)
    )
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("source"),
        F.col("ts").alias("requested_at"),
        F.concat(F.lit("https://"), "event_type", F.lit(".example.com/flights/"), F.col("user_id").cast("string")).alias(
            "url"
        ),
        F.lit("GET").alias("method"),
        allowed.alias("robots_allowed"),
        F.when(intent, "intent_denied:/api").when(~allowed, "robots:disallow:/flights").otherwise("robots:allow:/").alias(
            "robots_rule"
        ),
        intent.alias("intent_denied"),
        F.when(allowed, F.round(F.col("value"), 3)).otherwise(0).cast("decimal(8,3)").alias("delay_applied_s"),
        status.cast("int").alias("http_status"),
        (F.col("user_id") * 100).cast("int").alias("bytes_returned"),
        (F.col("event_id") % 900).cast("int").alias("duration_ms"),
    )


def daily_series(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Daily means: one series per event type and one per order priority."""
    a = events.groupBy(F.col("event_type").alias("series_id"), F.col("ts").cast("date").alias("index_date")).agg(
        F.avg("value").alias("value")
    )
    b = orders.groupBy(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("index_date")
    ).agg(F.avg("o_totalprice").alias("value"))
    return a.unionByName(b).withColumn("value", fixed4(F.col("value")))


def weekly_series(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy(
            F.col("o_orderpriority").alias("series_id"), F.trunc(F.col("o_orderdate").cast("date"), "week").alias("index_date")
        )
        .agg(fixed4(F.avg("o_totalprice")).alias("value"))
    )


def traffic(lineitem, orders, customer, supplier) -> DataFrame:
    """City-pair traffic rows in the layout of an official monthly release, all columns text."""
    city = lambda key: F.concat(F.lit("C"), (key % 6).cast("string"))
    qty = F.sum("l_quantity").cast("bigint").cast("string")
    return (
        lineitem.select("l_orderkey", "l_suppkey", "l_quantity")
        .join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(
            F.year("o_orderdate").cast("string").alias("Year"),
            F.month("o_orderdate").cast("string").alias("Month"),
            city(F.col("c_nationkey")).alias("City1"),
            city(F.col("s_nationkey")).alias("City2"),
        )
        .agg(F.coalesce(qty, F.lit("")).alias("PaxToCity2"))
        .withColumn("PaxFromCity2", F.when(F.col("Month") == "2", "n/a").otherwise(F.col("PaxToCity2")))
    )


_KNOWN: dict[tuple[str, str], tuple[frozenset, Domain]] = {}


def _state(spark: SparkSession, path: str) -> frozenset:
    """Names, sizes and change times of the tables in a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return frozenset((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found)


@dataclass
class Domain:
    """Views of one scale-factor folder.

    With `staged`, the tables a pipeline stores between its steps (fares, prices, elementary
    cells, index rows) are written once to the shared checkpoint folder and read back, which
    also cuts their lineage. Without it every view is one lazy plan over the input tables.
    """

    spark: SparkSession
    path: str
    staged: bool = False

    @classmethod
    def of(cls, spark: SparkSession, path: str) -> Domain:
        """The staged views of a folder, shared by all queries of a session until a file of the folder changes."""
        key = (spark.sparkContext.applicationId, path)
        state = _state(spark, path)
        if key not in _KNOWN or _KNOWN[key][0] != state:
            _KNOWN[key] = (state, cls(spark, path, staged=True))
        return _KNOWN[key][1]

    @cached_property
    def _folder(self) -> str:
        return staging.folder(self.spark, "stage")

    def stage(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        if not self.staged:
            return df
        out = f"{self._folder}/{name}"
        if partition_by:
            df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(out)
        else:
            df.write.parquet(out)
        return self.spark.read.parquet(out)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def quotes(self) -> DataFrame:
        return quotes_from_events(self.events)

    @cached_property
    def quotes_large(self) -> DataFrame:
        return quotes_from_lineitem(*(self.table(t) for t in ("lineitem", "orders", "customer", "supplier", "nation")))

    @cached_property
    def routes(self) -> DataFrame:
        return defaults.routes(self.spark)

    @cached_property
    def route_weights(self) -> DataFrame:
        return defaults.route_weights(self.spark)

    @cached_property
    def windows(self) -> DataFrame:
        return defaults.windows(self.spark)

    @cached_property
    def shares(self) -> DataFrame:
        return defaults.carrier_share(self.spark)

    @cached_property
    def weights(self) -> DataFrame:
        return index_ops.cell_weights(self.route_weights, self.windows)

    @cached_property
    def cleaned(self) -> CleaningResult:
        return clean_quotes(self.quotes)

    @cached_property
    def fares(self) -> DataFrame:
        kept = fare_ops.require_known_routes(self.cleaned.persistable, self.routes)
        return self.stage("fares", fare_ops.stored_fares(kept), "scrape_date")

    @cached_property
    def usable(self) -> DataFrame:
        return fare_ops.usable(self.fares)

    @cached_property
    def price_table(self) -> DataFrame:
        return self.stage("price_table", fare_ops.price_table(self.fares))

    @cached_property
    def prices(self) -> DataFrame:
        return fare_ops.daily_prices(self.price_table)

    @cached_property
    def days(self) -> DataFrame:
        return fare_ops.scrape_dates(self.price_table)

    @cached_property
    def base(self) -> DataFrame:
        return fare_ops.base_prices(self.prices, PRICE_REF_START, PRICE_REF_END, MIN_BASE_OBS)

    @cached_property
    def elementary(self) -> DataFrame:
        rows = index_ops.build_elementary(self.prices, self.base, self.weights, self.days)
        return self.stage("elementary", rows)

    @cached_property
    def daily(self) -> DataFrame:
        return index_ops.daily_headline(self.elementary, self.weights, self.shares)

    @cached_property
    def headline(self) -> DataFrame:
        return self.stage("headline", index_ops.stored_index(index_ops.all_frequencies(self.daily)))

    @cached_property
    def route_rows(self) -> DataFrame:
        rows = index_ops.all_route_frequencies(index_ops.route_index(self.elementary, self.weights))
        return self.stage("route_rows", rows)

    @cached_property
    def requests(self) -> DataFrame:
        return request_log(self.events)

    @cached_property
    def sources(self) -> DataFrame:
        return source_registry(self.spark)

    @cached_property
    def series(self) -> DataFrame:
        return daily_series(self.events, self.table("orders"))

    @cached_property
    def weekly(self) -> DataFrame:
        return weekly_series(self.table("orders"))

    @cached_property
    def traffic(self) -> DataFrame:
        return traffic(*(self.table(t) for t in ("lineitem", "orders", "customer", "supplier")))
