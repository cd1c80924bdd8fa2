"""Streaming forms of the three ingest rules: no duplicates, late filings set apart, days that stay true.

A day may arrive in any number of micro-batches and in any order. What is stored therefore never depends on batch
borders: quotes are merged into their day, and every touched day is cleaned again from all of its quotes.
"""

from __future__ import annotations

import functools
import operator
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemesh import schema as S
from pricemesh.functions.common import same_keys
from pricemesh.operators import cleaning, fares as fare_ops, index as index_ops
from pricemesh.operators.payload import payload_hash
from pricemesh.sources import sinks

RAW_KEY = ["source", "origin", "destination", "departure_date", "scrape_date", "payload_sha256"]
#: Copies of a quote for the store: equal in all that plausibility looks at, so one stands for all of them.
QUOTE_KEY = [*S.QUOTE_IDENTITY, "origin", "destination"]


def hashed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("payload_sha256", payload_hash(F.col("payload")))


def stored_raw(raw: DataFrame) -> DataFrame:
    """Batch form: the first arrival of each payload per request identity."""
    return cleaning.first_arrivals(hashed(raw), RAW_KEY, F.col("raw_id")).drop("copies")


def ingest_raw(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str):
    """Replay-safe raw ingest: what the target holds already is not added again, however old it is."""

    def write(batch: DataFrame, _: int) -> None:
        sinks.insert_absent(batch.sparkSession, hashed(batch), target, RAW_KEY, ["scrape_date"], "raw_id")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(quotes: DataFrame, observed_on: str = "observed_on") -> tuple[DataFrame, DataFrame]:
    """Observations belong to the day they were made; a quote filed for another day is a gap."""
    on_time = F.col(observed_on).eqNullSafe(F.col("scrape_date"))
    late = quotes.filter(~on_time).select(
        "source_code", "scrape_date", observed_on, "origin", "destination", "departure_date", "ingest_seq",
        F.datediff(observed_on, "scrape_date").alias("age_days"), F.lit("missed").alias("outcome"),
    )
    return quotes.filter(on_time).drop(observed_on), late


def store_quotes(spark: SparkSession, quotes: DataFrame, path: str) -> list:
    """Merge quotes into their days: of equal ones the first in arrival order stays, whichever batch brought it.
    Returns the days of the quotes, empty where there are none.

    Of stored quotes only keys and arrival numbers are read, in one hash aggregate with those that come. Quotes the table
    lacks are added to their day; a day is written again only where a quote arrived before the equal one stored.
    """
    beside, work = sinks.staged(spark, quotes, path, ["scrape_date"])
    stored = sinks.read_table(spark, path, beside)
    days = [r[0] for r in beside.select("scrape_date").distinct().collect()]  # partition names of a batch, not rows
    if not days:
        sinks.remove(spark, work)
        return days
    new, order = sinks.numbered(beside), beside.schema["ingest_seq"].dataType
    marks = new.select(*QUOTE_KEY, F.col("ingest_seq").alias("_seq"), F.lit(None).cast(order).alias("_held"), "_row")
    if stored is not None:
        stored = stored.filter(F.col("scrape_date").isin(days))
        held = [F.lit(None).cast(order).alias("_seq"), F.col("ingest_seq").alias("_held"), F.lit(None).cast("bigint").alias("_row")]
        marks = marks.unionByName(stored.select(*QUOTE_KEY, *held))
    marks = marks.groupBy(*QUOTE_KEY).agg(F.min_by("_row", "_seq").alias("_first"), F.min("_seq").alias("_seq"), F.min("_held").alias("_held"))
    wanted = marks.filter(F.col("_first").isNotNull() & (F.col("_held").isNull() | (F.col("_seq") < F.col("_held"))))
    wanted, named = sinks.staged(spark, wanted.drop("_seq"), path, ["scrape_date"])
    # Names of days again; those without a quote to write are not touched.
    adds = {r[0]: r[1] for r in wanted.groupBy("scrape_date").agg(F.count("_held") > 0).collect()}
    same = same_keys("q", "f", QUOTE_KEY) & (F.col("q._row") == F.col("f._first"))
    fresh = new.alias("q").join(wanted.alias("f"), same).select(*[f"q.{c}" for c in beside.columns])
    again = [day for day, replaced in adds.items() if replaced]
    if again:
        old = stored.filter(F.col("scrape_date").isin(again)).alias("s")
        gone = wanted.filter(F.col("_held").isNotNull()).alias("f")
        kept = old.join(gone, same_keys("s", "f", QUOTE_KEY), "left_anti")
        sinks.replace_partitions(spark, kept.unionByName(fresh.filter(F.col("scrape_date").isin(again))), path, ["scrape_date"])
        fresh = fresh.filter(~F.coalesce(F.col("scrape_date").isin(again), F.lit(False)))
    if len(again) < len(adds) or stored is None:
        fresh.hint("rebalance", "scrape_date").write.mode("append").partitionBy("scrape_date").parquet(path)
    sinks.remove(spark, named)
    sinks.remove(spark, work)
    return days


#: Tables that build_days keeps: the published ones, and the state from which a day is continued.
INDEX_TABLES = ["elementary", "headline", "routes", "snapshots", "daily", "daily_routes"]


def snapshot_before(spark: SparkSession, path: str, day) -> DataFrame | None:
    """Carry state of all cells at the end of the last processed day before `day`: one partition."""
    earlier = [v for v in sinks.partition_values(spark, path, "index_date") if v < str(day)]
    if not earlier:
        return None
    return sinks.read_partitions(spark, path, "index_date", earlier[-1:])


def _first_of_periods(start) -> dict[str, object]:
    """First day of the period of every frequency that `start` belongs to."""
    return {"daily": start, "weekly": start - timedelta(days=start.weekday()), "monthly": start.replace(day=1)}


def _publish(spark: SparkSession, rows: DataFrame, path: str, start) -> None:
    """Swap in the published rows of all periods that `start` or a later day belongs to; periods left without rows go."""
    first = _first_of_periods(start)
    wanted = functools.reduce(
        operator.or_, [(F.col("frequency") == f) & (F.col("index_date") >= F.lit(day)) for f, day in first.items()]
    )
    beside, work = sinks.staged(spark, rows.filter(wanted), path, ["frequency", "index_date"])
    sinks.overwrite(beside, path, ["frequency", "index_date"])
    for f, day in first.items():
        kept = set(sinks.partition_values(spark, f"{work}/frequency={f}", "index_date"))
        for value in sinks.partition_values(spark, f"{path}/frequency={f}", "index_date"):
            if value >= str(day) and value not in kept:
                sinks.remove(spark, f"{path}/frequency={f}/index_date={value}")
    sinks.remove(spark, work)


def _at_once(spark: SparkSession, *writes) -> None:
    """Run writes to different tables side by side: each is small, so most of its time is waiting. Fails as the first does."""
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]:
            done.result()


def build_days(
    spark: SparkSession, days: list, tables: dict[str, str], base: DataFrame, weights: DataFrame, shares: DataFrame | None
) -> None:
    """Rebuild the index from the earliest of `days` on: what is carried forward from a day changes the days after it.

    The state is a snapshot per day: last observed value and days missing of every cell. Prices and cells are read from
    the earliest touched day on, the snapshot of the day before it and, for periods under way, the exact daily rows since
    their month began (one row per day and route). Cost follows the days from there on, not the history; rows before
    that day, and periods that end before it, are neither read nor written.
    """
    start = min(days)
    later = [v for v in sinks.partition_values(spark, tables["prices"], "scrape_date") if v >= str(start)]
    table = sinks.read_partitions(spark, tables["prices"], "scrape_date", later)
    state = snapshot_before(spark, tables["snapshots"], start)
    built = index_ops.continue_elementary(fare_ops.daily_prices(table), base, weights, fare_ops.scrape_dates(table), state)
    cells, work = sinks.staged(spark, built, f"{tables['elementary']}_work", ["index_date"])
    snapshots = cells.select("index_date", *S.CELL, *index_ops.CARRY_STATE)
    cells = cells.drop(*index_ops.CARRY_STATE)
    # A week may begin in the month before, so daily rows are read from the earlier of the two.
    since = F.col("index_date") >= F.lit(min(_first_of_periods(start).values()))

    def replace(name: str, rows: DataFrame) -> None:
        sinks.replace_from(spark, rows, tables[name], "index_date", str(start), later)

    def publish(exact: str, published: str, daily: DataFrame, frequencies, finish=lambda rows: rows) -> None:
        sinks.replace_from(spark, daily, tables[exact], "index_date", str(start))
        current = spark.read.schema(daily.schema).parquet(tables[exact]).filter(since)
        _publish(spark, finish(frequencies(current)), tables[published], start)

    _at_once(
        spark,
        functools.partial(replace, "snapshots", snapshots),
        functools.partial(replace, "elementary", cells),
        functools.partial(publish, "daily", "headline", index_ops.daily_headline(cells, weights, shares), index_ops.all_frequencies, index_ops.stored_index),
        functools.partial(publish, "daily_routes", "routes", index_ops.route_index(cells, weights), index_ops.all_route_frequencies),
    )
    sinks.remove(spark, work)


def ingest_quotes(
    spark: SparkSession, stream: DataFrame, tables: dict[str, str], routes: DataFrame, base: DataFrame,
    weights: DataFrame, shares: DataFrame | None, checkpoint: str,
):
    """Store every micro-batch of quotes and bring the index up to date with it.

    tables names the folders quotes, late, fares, prices and those of INDEX_TABLES. Quotes with a column
    observed_on other than their day go to the gap table `late` and are not indexed. The touched days are cleaned anew
    from all their stored quotes, because outlier groups and duplicates span batches. Replaying a batch changes nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        if "observed_on" in batch.columns:
            batch, late = split_late(batch)
            sinks.insert_absent(session, late, tables["late"], ["ingest_seq"], ["scrape_date"], "ingest_seq")
        days = store_quotes(session, batch, tables["quotes"])
        if not days:
            return
        quotes = session.read.schema(batch.schema).parquet(tables["quotes"]).filter(F.col("scrape_date").isin(days))
        kept = fare_ops.stored_fares(fare_ops.require_known_routes(cleaning.clean_quotes(quotes).persistable, routes))
        sinks.overwrite(kept, tables["fares"], ["scrape_date"])
        today = session.read.schema(kept.schema).parquet(tables["fares"]).filter(F.col("scrape_date").isin(days))
        sinks.overwrite(fare_ops.price_table(today), tables["prices"], ["scrape_date"])
        build_days(session, days, tables, base, weights, shares)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
