"""Incremental index: a day is continued from the snapshot of the day before it."""

import random
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricemesh.operators import fares as fare_ops, index as index_ops
from pricemesh.sources import sinks
from pricemesh.streaming import ingest

FIRST = date(2026, 6, 24)
PRICES = "scrape_date date, route_id int, window_days int, carrier string, price decimal(12,2), n_quotes bigint"


def price_rows(seed=1, days=24):
    """Prices with missing cells, runs of missing days, days on which nothing was collected, and late carriers."""
    rng = random.Random(seed)
    rows = []
    for k in range(days):
        if k in (7, 8, 15):
            continue
        for route in (1, 2, 3):
            for window in (7, 30):
                if route == 3 and 3 <= k <= 13:
                    continue
                for carrier in ("AA", "BB"):
                    if rng.random() < 0.55:
                        rows.append((FIRST + timedelta(days=k), route, window, carrier, round(rng.uniform(3000, 9000), 2), rng.randrange(1, 5)))
    return rows


@pytest.fixture()
def parts(spark):
    from decimal import Decimal

    rows = [(d, r, w, c, Decimal(str(p)), n) for d, r, w, c, p, n in price_rows()]
    prices = spark.createDataFrame(rows, PRICES)
    base = spark.createDataFrame(
        [(r, w, c, Decimal("5000.0000")) for r in (1, 2, 3) for w in (7, 30) for c in ("AA", "BB")],
        "route_id int, window_days int, carrier string, base_price decimal(12,4)",
    )
    weights = spark.createDataFrame(
        [(r, w, Decimal("0.3333"), 0.1 * r + 0.01 * w) for r in (1, 2, 3) for w in (7, 30)],
        "route_id int, window_days int, route_weight decimal(8,4), cell_weight double",
    )
    shares = spark.createDataFrame([("AA", 0.6), ("BB", 0.3)], "carrier string, share double")
    return prices, base, weights, shares


def batch(parts):
    prices, base, weights, shares = parts
    cells = index_ops.build_elementary(fare_ops.daily_prices(prices), base, weights, fare_ops.scrape_dates(prices))
    head = index_ops.stored_index(index_ops.all_frequencies(index_ops.daily_headline(cells, weights, shares)))
    return cells, head, index_ops.all_route_frequencies(index_ops.route_index(cells, weights))


def rounded(df, names):
    return sorted(
        str([round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)]) for r in df.collect()
    )


def same(stored, want):
    names = sorted(want.columns)
    assert rounded(stored, names) == rounded(want, names)


def arrive(spark, prices, days, tables):
    sinks.replace_partitions(spark, prices.filter(F.col("scrape_date").isin(days)), tables["prices"], ["scrape_date"])


def test_days_in_any_order_equal_the_batch_build(spark, parts, tmp_path):
    prices, base, weights, shares = parts
    tables = {t: str(tmp_path / t) for t in ("prices", *ingest.INDEX_TABLES)}
    days = sorted({r[0] for r in price_rows()})
    order = days[:]
    random.Random(1).shuffle(order)
    groups = [order[i : i + 6] for i in range(0, len(order), 6)]
    for group in groups:
        arrive(spark, prices, group, tables)
        ingest.build_days(spark, group, tables, base, weights, shares)
    cells, head, routes = batch(parts)
    same(spark.read.parquet(tables["elementary"]), cells)
    same(spark.read.parquet(tables["headline"]), head)
    same(spark.read.parquet(tables["routes"]), routes)


def spoil(folder, day, column):
    """Make the files of all partitions before a day unreadable."""
    hit = 0
    for part in Path(folder).rglob(f"{column}=*"):
        if part.name.split("=")[1] < str(day):
            for file in part.glob("*.parquet"):
                file.write_bytes(b"not a table any more")
                hit += 1
            for crc in part.glob(".*.crc"):
                crc.unlink()
    return hit


def test_a_touched_day_reads_nothing_older_than_its_snapshot(spark, parts, tmp_path):
    prices, base, weights, shares = parts
    tables = {t: str(tmp_path / t) for t in ("prices", *ingest.INDEX_TABLES)}
    days = sorted({r[0] for r in price_rows()})
    arrive(spark, prices, days, tables)
    ingest.build_days(spark, days[:-4], tables, base, weights, shares)
    touched = days[-4]
    before = [d for d in days if d < touched][-1]
    assert spoil(tables["prices"], touched, "scrape_date") > 5 and spoil(tables["elementary"], touched, "index_date") > 5
    assert spoil(tables["snapshots"], before, "index_date") > 5
    month = touched.replace(day=1)
    assert spoil(tables["daily"], min(month, touched - timedelta(days=touched.weekday())), "index_date") > 0
    ingest.build_days(spark, [touched], tables, base, weights, shares)
    cells, head, routes = batch(parts)
    later = F.col("index_date") >= F.lit(touched)
    same(spark.read.schema(cells.schema).parquet(tables["elementary"]).filter(later), cells.filter(later))
    same(spark.read.parquet(tables["headline"]), head)
    same(spark.read.parquet(tables["routes"]), routes)
    files = ingest.snapshot_before(spark, tables["snapshots"], touched).inputFiles()
    assert files and all(f"index_date={before}/" in f for f in files)


def test_periods_left_without_rows_go(spark, parts, tmp_path):
    """A day whose only usable cells vanish must not keep the row it had."""
    prices, base, weights, shares = parts
    tables = {t: str(tmp_path / t) for t in ("prices", *ingest.INDEX_TABLES)}
    day = date(2026, 7, 6)
    one = prices.limit(1).withColumns({"scrape_date": F.lit(day), "route_id": F.lit(1), "window_days": F.lit(7)})
    arrive(spark, one, [day], tables)
    ingest.build_days(spark, [day], tables, base, weights, shares)
    assert spark.read.parquet(tables["headline"]).count() == 3
    arrive(spark, one.withColumn("price", F.lit(None).cast("decimal(12,2)")), [day], tables)
    ingest.build_days(spark, [day], tables, base, weights, shares)
    assert sinks.partition_values(spark, tables["daily"], "index_date") == []
    assert all(sinks.partition_values(spark, f"{tables['headline']}/frequency={f}", "index_date") == [] for f in ("daily", "weekly", "monthly"))


def test_a_step_of_many_files_is_one_micro_batch(spark, tmp_path):
    """Days are cleaned anew in every batch, so the number of batches must not follow the number of files."""
    from types import SimpleNamespace

    from catalog import operations

    made = "timestamp'2026-06-24' + make_dt_interval(cast(id % 9 AS int)) AS ts"
    spark.range(0, 360, 1, 6).selectExpr("id AS event_id", made).write.parquet(str(tmp_path / "all"))
    events = spark.read.parquet(str(tmp_path / "all"))
    source, batches, seen = str(tmp_path / "events"), [], []

    def write(batch, number):
        batches.append(number)
        seen.extend(r[0] for r in batch.select("event_id").collect())

    for stream in operations.arriving(SimpleNamespace(spark=spark, events=events.repartition(6)), source):
        run = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "checkpoint"))
        run.trigger(availableNow=True).start().awaitTermination()
    assert len(list(Path(source).glob("*.parquet"))) > operations.PARTS
    assert len(batches) == operations.PARTS and sorted(seen) == list(range(360))


QUOTES = (
    "source_code string, scrape_date date, carrier string, flight_number string, departure_date date, fare_class string,"
    " fare_brand string, total_fare decimal(12,2), origin string, destination string, base_fare int, ingest_seq bigint"
)


def quote_rows(n=240):
    """Quotes on few days, with many copies of which some come without flight number or brand; ingest_seq names each."""
    from decimal import Decimal

    rng = random.Random(7)
    return [
        (
            "web", FIRST + timedelta(days=rng.randrange(3)), "AA", rng.choice(["AA1", "AA2", None]), FIRST + timedelta(days=30), "ECONOMY",
            rng.choice(["FLEX", None]), Decimal(rng.choice(["5000.00", "6000.00", "7000.00"])), "BOM", rng.choice(["DEL", "BLR"]), k * 10, k,
        )
        for k in range(n)
    ]


def test_stored_quotes_are_the_first_arrivals_of_all_batches_in_any_order(spark, tmp_path):
    path, rows = str(tmp_path / "quotes"), quote_rows()
    wanted = {}
    for r in rows:
        wanted.setdefault(r[:10], r)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    for k in (0, 60, 120, 180, 60):
        part = shuffled[k : k + 60]
        assert set(ingest.store_quotes(spark, spark.createDataFrame(part, QUOTES), path)) == {r[1] for r in part}
    names = [c.split(" ")[0] for c in QUOTES.split(", ")]
    stored = [tuple(r) for r in spark.read.parquet(path).select(*names).collect()]
    assert sorted(stored, key=lambda r: r[-1]) == sorted(wanted.values(), key=lambda r: r[-1])
    assert ingest.store_quotes(spark, spark.createDataFrame([], QUOTES), path) == []


def test_storing_quotes_rewrites_only_days_with_an_earlier_arrival(spark, tmp_path):
    """A day that only gains quotes, or gets those it has, keeps its files as they are."""
    path = str(tmp_path / "quotes")

    def files(day):
        return {f.name: f.stat().st_mtime_ns for f in Path(path, f"scrape_date={day}").glob("*.parquet")}

    from decimal import Decimal

    like = quote_rows(1)[0]

    def quote(day, fare, seq):
        return (like[0], FIRST + timedelta(days=day), *like[2:7], fare, *like[8:11], seq)

    low, high = Decimal("5000.00"), Decimal("6000.00")
    ingest.store_quotes(spark, spark.createDataFrame([quote(0, low, 10), quote(1, low, 11)], QUOTES), path)
    first = [files(FIRST + timedelta(days=k)) for k in (0, 1)]
    ingest.store_quotes(spark, spark.createDataFrame([quote(0, low, 10), quote(0, low, 20), quote(1, low, 11)], QUOTES), path)
    assert [files(FIRST + timedelta(days=k)) for k in (0, 1)] == first
    ingest.store_quotes(spark, spark.createDataFrame([quote(0, high, 21), quote(1, low, 3), quote(1, high, 22)], QUOTES), path)
    now = [files(FIRST + timedelta(days=k)) for k in (0, 1)]
    assert first[0].items() < now[0].items() and not first[1].keys() & now[1].keys()
    stored = sorted((r.scrape_date, r.total_fare, r.ingest_seq) for r in spark.read.parquet(path).collect())
    assert stored == [(FIRST, low, 10), (FIRST, high, 21), (FIRST + timedelta(days=1), low, 3), (FIRST + timedelta(days=1), high, 22)]


def test_gaps_of_closed_days_are_told_once(spark, tmp_path):
    """Files out of order, a day without quotes, a late quote for a closed day, and the whole stream once more."""
    from pricemesh.streaming import closing

    schema = "scrape_date date, departure_date date, origin string, destination string"
    day = lambda k: FIRST + timedelta(days=k)
    quote = lambda k, w, a="DEL", b="BOM": (day(k), day(k + w), a, b)
    files = [[quote(1, 7), quote(0, 7)], [quote(1, 30, "BOM", "DEL")], [quote(4, 7)], [quote(4, 7)], [quote(0, 30)], [quote(9, 7), quote(9, 30)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        parts = sorted((tmp_path / "in").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime)
        __import__("os").utime(parts[-1], (1_700_000_000 + k, 1_700_000_000 + k))
    sources = spark.createDataFrame([("s1",)], "code string")
    routes = spark.createDataFrame([("BOM-DEL", "BOM", "DEL")], "route_code string, origin string, destination string")
    windows = spark.createDataFrame([(7,), (30,)], "window_days int")
    tables = {t: str(tmp_path / t) for t in ("gaps", "closed")}
    for run in ("a", "b"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        closing.record_gaps(spark, stream, sources, routes, windows, tables, str(tmp_path / f"cp{run}"), "1 day").awaitTermination()
        gaps = sorted((r.scrape_date, r.window_days) for r in spark.read.parquet(tables["gaps"]).collect())
        # Day 0 closed before its late quote came; days 2 and 3 had no quote at all; day 9 is still open.
        want = [(day(0), 30), (day(2), 7), (day(2), 30), (day(3), 7), (day(3), 30), (day(4), 30)]
        assert gaps == want
    closed = {r.scrape_date: (r.cells, r.missing) for r in spark.read.parquet(tables["closed"]).collect()}
    assert closed == {day(0): (2, 1), day(1): (2, 0), day(2): (2, 2), day(3): (2, 2), day(4): (2, 1)}
