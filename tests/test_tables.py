"""Writes, audits, gaps, log statistics and streaming ingest."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricemesh.operators import collection as c
from pricemesh.operators import fares, weights
from pricemesh.operators import governance as g
from pricemesh.sources import defaults, loaders, sinks
from pricemesh.streaming import ingest

D = dt.date


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, part string, v double")


def test_upsert_replaces_and_keeps(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert(spark, table(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)]), path, ["k"], ["part"])
    sinks.upsert(spark, table(spark, [(2, "a", 20.0), (4, "a", 4.0)]), path, ["k"], ["part"])
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert got == {1: 1.0, 2: 20.0, 3: 3.0, 4: 4.0}


def test_insert_absent_is_idempotent_and_null_safe(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "x", 2), (1, "a", None, 3), (1, "a", None, 4)], "k int, part string, f string, seq long")
    for _ in range(2):
        sinks.insert_absent(spark, rows, path, ["k", "part", "f"], ["part"], "seq", where=F.col("f").isNotNull())
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == [1, 3, 4]
    p2 = str(tmp_path / "u")
    for _ in range(2):
        sinks.insert_absent(spark, rows, p2, ["k", "part", "f"], ["part"], "seq")
    assert sorted(r.seq for r in spark.read.parquet(p2).collect()) == [1, 3]


def audit_rows(spark):
    t = dt.datetime(2026, 9, 4, 10)
    rows = [
        (1, "s", t, True, False, 0.0, 200), (2, "s", t + dt.timedelta(seconds=8.4), True, False, 8.4, 200),
        (3, "s", t + dt.timedelta(seconds=17.5), True, False, 9.1, 429), (4, "s", t + dt.timedelta(seconds=18), False, False, 0.0, None),
    ]
    return c.with_outcome(
        spark.createDataFrame(rows, "request_id long, source string, requested_at timestamp_ntz, robots_allowed boolean, intent_denied boolean, delay_applied_s double, http_status int")
    )


def test_compliance_summary_and_intervals(spark):
    src = spark.createDataFrame([("s", 1, "scrape_ok")], "code string, tier int, audit_verdict string")
    r = c.compliance_summary(audit_rows(spark), src).first()
    assert (r.requests, r.requests_sent, r.robots_blocked, r.ok, r.errors) == (4, 3, 1, 2, 1)
    assert (r.min_delay_s, r.max_delay_s, r.avg_delay_s) == (8.4, 9.1, pytest.approx(5.83))
    iv = {x.request_id: (round(x.interval_s, 3), x.below_floor) for x in c.request_intervals(audit_rows(spark), 9.0).collect()}
    assert iv == {1: (0.0, False), 2: (8.4, True), 3: (9.1, False)}


def test_intervals_cross_hours(spark):
    t = dt.datetime(2026, 9, 4, 10, 59, 58)
    rows = [(i, "s", t + dt.timedelta(seconds=4 * i), True) for i in range(5)]
    rows.append((9, "s", t + dt.timedelta(hours=30), True))
    df = spark.createDataFrame(rows, "request_id long, source string, requested_at timestamp_ntz, robots_allowed boolean")
    iv = {x.request_id: x.interval_s for x in c.request_intervals(df, 6.0).collect()}
    assert iv == {0: 0.0, 1: 4.0, 2: 4.0, 3: 4.0, 4: 4.0, 9: 30 * 3600 - 16.0}


def test_log_rules_guard_appends(spark, tmp_path):
    src = spark.createDataFrame([("s",)], "code string")
    rows = audit_rows(spark).withColumn("url", F.lit("https://x"))
    sinks.append_requests(spark, rows, src, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    with pytest.raises(Exception, match="fetch rule"):
        sinks.append_requests(spark, rows.withColumn("outcome", F.lit("ok")), src, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="not registered"):
        sinks.append_requests(spark, rows.withColumn("source", F.lit("nobody")), src, str(tmp_path / "bad2"))


def test_plan_gaps_and_assessment(spark):
    sources = spark.createDataFrame([("s1",), ("s2",)], "code string")
    days = spark.createDataFrame([(D(2026, 9, 4),), (D(2026, 9, 5),), (D(2026, 9, 7),)], "scrape_date date")
    plan = c.expected_cells(sources, defaults.routes(spark), defaults.windows(spark), days)
    assert plan.count() == 2 * 8 * 5 * 3
    fares = spark.createDataFrame([(D(2026, 9, 4), "DEL", "BLR", 7), (D(2026, 9, 5), "BLR", "DEL", 1)], "scrape_date date, origin string, destination string, window_days int")
    got = {x.scrape_date.day: (x.planned, x.missing, x.action) for x in c.assess(plan, fares, "2026-09-05").collect()}
    assert got == {4: (80, 78, "record_gap"), 5: (80, 78, "recoverable"), 7: (80, 80, "refuse")}
    gaps = c.gap_rows(plan, fares, "2026-09-05")
    assert gaps.count() == 78 and {x.outcome for x in gaps.collect()} == {"missed"}
    assert c.gap_report(gaps, c.gap_runs(gaps), "2026-09-01", "2026-09-30").first().missed_cells == 78
    assert c.narrow(defaults.routes(spark), ["blr-del"]).count() == 1


def test_constraint_audit_finds_each_violation(spark):
    rows = spark.createDataFrame(
        [("2026-09-01", "daily", 100.0, 5, 1.0, 0.5), ("2026-09-02", "hourly", -1.0, 0, 1.2, 0.0), ("2026-09-03", "daily", 100.0, 5, 0.9, None)],
        "index_date string, frequency string, index_value double, n_cells int, coverage_ratio double, observed_pax_share double",
    )
    got = {r.rule: r.violations for r in g.audit_rules("headline", rows).collect()}
    assert got == {"frequency_known": 1, "value_positive": 1, "cells_positive": 1, "coverage_in_unit": 1, "pax_share_in_unit": 1}
    assert g.violations("headline", rows, "value_positive").count() == 1
    dup = g.duplicate_keys(rows.unionByName(rows.limit(1)), ["index_date", "frequency"]).collect()
    assert len(dup) == 1 and dup[0].copies == 2


def test_every_rule_is_valid_sql_over_its_table(spark):
    for table_name, rules in g.RULES.items():
        assert rules and all(p.strip() for p in rules.values()), table_name


def test_late_observations_are_gaps(spark):
    q = spark.createDataFrame(
        [("s", D(2026, 9, 4), D(2026, 9, 4), "A", "B", D(2026, 9, 11), 1), ("s", D(2026, 9, 4), D(2026, 9, 6), "A", "B", D(2026, 9, 11), 2)],
        "source_code string, scrape_date date, observed_on date, origin string, destination string, departure_date date, ingest_seq long",
    )
    on_time, late = ingest.split_late(q)
    assert on_time.count() == 1 and late.first().age_days == 2 and late.first().outcome == "missed"


def test_stream_replay_adds_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "raw")
    rows = [(i, "s", "A", "B", D(2026, 9, 4), D(2026, 9, 11), dt.datetime(2026, 9, 4, 10, i), '{"a": %d, "b": 1}' % (i % 3)) for i in range(9)]
    schema = "raw_id long, source string, origin string, destination string, scrape_date date, departure_date date, scraped_at timestamp, payload string"
    spark.createDataFrame(rows, schema).write.parquet(src)
    for n in range(2):
        stream = spark.readStream.schema(schema).parquet(src)
        ingest.ingest_raw(spark, stream, out, str(tmp_path / f"cp{n}")).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    batch = ingest.stored_raw(spark.read.parquet(src))
    assert sorted(r.raw_id for r in batch.collect()) == [0, 1, 2]


def test_old_days_are_stored_too(spark, tmp_path):
    """A batch that brings a day long before the newest one loses nothing."""
    schema = "raw_id long, source string, origin string, destination string, scrape_date date, departure_date date, scraped_at timestamp, payload string"
    src, out = str(tmp_path / "in"), str(tmp_path / "raw")
    for day in (20, 2, 11):
        rows = [(day * 10 + i, "s", "A", "B", D(2026, 9, day), D(2026, 10, 1), dt.datetime(2026, 9, day, 10), '{"a": %d}' % i) for i in range(4)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        ingest.ingest_raw(spark, stream, out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 12


def test_hard_checks_hold_whatever_is_read(spark):
    """Each check fails although only a count, or a column it does not touch, is asked for."""
    routes = defaults.routes(spark)
    rows = spark.createDataFrame([("DEL", "BLR", 5.0), ("DEL", "XXX", 7.0)], "origin string, destination string, fare double")
    log = spark.createDataFrame([(1, "s"), (2, "nobody")], "request_id long, source string")
    refs = spark.createDataFrame([("DEL-BLR", "2026-01", "100", "", None)], "route string, month string, fare string, fare_basis string, source_url string")
    traffic = spark.createDataFrame([("BLR", "DEL", 100)], "origin string, destination string, passengers long")
    checks = [
        (fares.require_known_routes(rows, routes).agg(F.sum("fare")), "not in the basket"),
        (fares.require_known_routes(rows, routes).agg(F.count(F.lit(1))), "not in the basket"),
        (sinks.require_registered(log, spark.createDataFrame([("s",)], "code string")).agg(F.max("request_id")), "not registered"),
        (loaders.parse_reference_fares(refs, routes).agg(F.avg("avg_fare")), "mandatory"),
        (weights.basket_traffic(traffic, routes).agg(F.count(F.lit(1))), "no traffic found"),
    ]
    for df, message in checks:
        with pytest.raises(Exception, match=message):
            df.collect()
    assert fares.require_known_routes(rows.limit(1), routes).agg(F.sum("fare")).first()[0] == 5.0


def test_upserts_leave_no_work_files(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in (1.0, 2.0):
        sinks.upsert(spark, table(spark, [(1, "a", v)]), path, ["k"], ["part"])
        sinks.replace_partitions(spark, table(spark, [(2, "b", v)]), path, ["part"])
    assert not any((tmp_path / "t_staging").iterdir())
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, 2.0), (2, 2.0)]
