"""Closed days: what a streamed day lacked, told once, when the day is over.

Cells that quotes fill are kept per day in Spark's streaming state until the watermark passes the day's end; the day then
leaves the state once, with all its cells. A day bounds its state by the cells of the plan. Quotes that come later (a
micro-batch may still bring some while the watermark moves) are no longer counted here, but still reach their day through
ingest.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemesh.operators import collection
from pricemesh.sources import sinks

CELL = "array<struct<origin:string,destination:string,window_days:int>>"


def closed_days(quotes: DataFrame, delay: str = "1 day") -> DataFrame:
    """(scrape_date, cells) of a stream of quotes: each day once, when no quote may come for it within `delay` any more.

    cells are the (origin, destination, window_days) that any quote of the day filled, ends in order.
    """
    window = F.datediff("departure_date", "scrape_date") if "window_days" not in quotes.columns else F.col("window_days")
    cell = F.struct(
        F.least("origin", "destination").alias("origin"), F.greatest("origin", "destination").alias("destination"),
        window.cast("int").alias("window_days"),
    )
    seen = quotes.select(F.col("scrape_date").cast("timestamp").alias("_at"), cell.alias("cell")).withWatermark("_at", delay)
    days = seen.groupBy(F.window("_at", "1 day")).agg(F.collect_set("cell").alias("cells"))
    return days.select(F.col("window.start").cast("date").alias("scrape_date"), F.col("cells").cast(CELL).alias("cells"))


def record_gaps(
    spark: SparkSession, quotes: DataFrame, sources: DataFrame, routes: DataFrame, windows: DataFrame,
    tables: dict[str, str], checkpoint: str, delay: str = "1 day",
):
    """Write every planned cell that its day lacked to tables["gaps"], and a row per closed day to tables["closed"].

    A calendar day without any quote between two closed ones lacks its whole plan. Gaps are written before the day is
    marked, and marked days are never told again, so a replay, or the whole stream under a new checkpoint, adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        days = [r[0] for r in batch.select("scrape_date").collect()]  # days, not rows
        told = sinks.partition_values(session, tables["closed"], "scrape_date")
        first = date.fromisoformat(told[-1]) + timedelta(days=1) if told else min(days, default=None)
        if not days or first > max(days):
            return
        span = [(first + timedelta(days=k),) for k in range((max(days) - first).days + 1)]
        plan = collection.expected_cells(sources, routes, windows, session.createDataFrame(span, "scrape_date date"))
        filled = batch.select("scrape_date", F.inline("cells"))
        lost = collection.missing_cells(plan, filled)
        gaps = lost.select("scrape_date", "source_code", "origin", "destination", "window_days", "departure_date", F.lit("missed").alias("outcome"))
        sinks.replace_partitions(session, gaps, tables["gaps"], ["scrape_date"])
        counts = collection.plan_summary(plan).select("scrape_date", "cells")
        missing = session.read.schema(gaps.schema).parquet(tables["gaps"]).groupBy("scrape_date").agg(F.count(F.lit(1)).alias("missing"))
        closed = counts.join(missing, "scrape_date", "left").select("scrape_date", "cells", F.coalesce("missing", F.lit(0)).alias("missing"))
        sinks.replace_partitions(session, closed, tables["closed"], ["scrape_date"])

    stream = closed_days(quotes, delay).writeStream.outputMode("append").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
