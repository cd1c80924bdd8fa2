"""Plausibility, identity, split and outlier rules on literal quotes."""

import datetime as dt
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricemesh import schema as S
from pricemesh.operators import cleaning as c
from pricemesh.operators import fares as f
from pricemesh.sources import defaults

DAY = dt.date(2026, 9, 4)


def quote(i, total, **over):
    row = dict(
        source_code="s1", origin="DEL", destination="BOM", carrier="QP", scrape_date=DAY, departure_date=None,
        total_fare=None if total is None else Decimal(str(total)), flight_number=f"QP{i}", departure_at=None, arrival_at=None,
        stops=0, fare_class="ECONOMY", fare_brand=None, base_fare=None, taxes=None, udf=None, convenience_fee=None,
        other_charges=None, currency="INR", is_sold_out=False, quality_flags=[], ingest_seq=i,
    )
    row.update(over)
    row["departure_date"] = row["departure_date"] or row["scrape_date"] + dt.timedelta(days=7)
    return row


def table(spark, rows):
    return spark.createDataFrame([tuple(r[n.strip()] for n in COLS) for r in rows], S.QUOTE)


COLS = [p.strip().split()[0] for p in " ".join(S.QUOTE.split()).replace("DECIMAL(12,2)", "DECIMAL").split(",")]


def totals(spark, values, **over):
    return table(spark, [quote(i, v, **over) for i, v in enumerate(values)])


def flagged(spark, values, method="mad_log"):
    r = c.clean_quotes(totals(spark, values), method)
    return sorted(float(x.total_fare) for x in r.survivors.filter("is_outlier").collect())


def test_surge_is_never_an_outlier(spark):
    base = [4800, 5100, 5400, 5900, 6200, 7100]
    rows = [quote(i, v) for i, v in enumerate(base)]
    rows += [quote(100 + i, v * 3, scrape_date=DAY + dt.timedelta(days=1)) for i, v in enumerate(base)]
    r = c.clean_quotes(table(spark, rows))
    assert r.survivors.filter("is_outlier").count() == 0 and r.groups.count() == 2


@pytest.mark.parametrize("values", [[3200, 3900, 4800, 6100, 7900, 9400, 11200], [5000] * 8, [4800, 5100, 60000]])
def test_nothing_flagged(spark, values):
    assert flagged(spark, values) == []


def test_decimal_shift_is_flagged_and_kept(spark):
    values = [4800, 5100, 5400, 5900, 6200, 60000]
    assert flagged(spark, values) == [60000.0]
    r = c.clean_quotes(totals(spark, values))
    assert r.persistable.count() == 6
    hit = r.flagged.first()
    logs = [__import__("math").log(v) for v in values]
    med = statistics.median(logs)
    z = 0.6745 * (logs[-1] - med) / statistics.median([abs(v - med) for v in logs])
    assert hit.outlier_score == pytest.approx(round(z, 4)) and hit.quality_flags[-1].startswith("outlier:mad_log:")
    assert flagged(spark, values, "iqr") == [60000.0] and flagged(spark, values, "none") == []


def test_masking(spark):
    r = c.clean_quotes(totals(spark, [4800, 5100, 5400, 5900, 6200, 199000, 198000]))
    assert r.survivors.filter("is_outlier AND abs(outlier_score) > 10").count() == 2


def test_bounds_and_order_of_reasons(spark):
    rows = [quote(i, v) for i, v in enumerate([0, -100, 1, 499, 200001, 500, 5000, 50000, 200000])]
    rows.append(quote(20, 0, destination="DEL"))
    rows.append(quote(21, 5000, departure_date=DAY))
    rows.append(quote(22, 5000, departure_date=DAY + dt.timedelta(days=366)))
    got = {r.ingest_seq: r.reject_reason for r in c.classify_plausibility(table(spark, rows)).collect()}
    assert [got[i] for i in range(9)] == [
        S.REJECT_NON_POSITIVE, S.REJECT_NON_POSITIVE, S.REJECT_BELOW, S.REJECT_BELOW, S.REJECT_ABOVE, None, None, None, None,
    ]
    assert (got[20], got[21], got[22]) == (S.REJECT_SAME_OD, S.REJECT_WINDOW, S.REJECT_WINDOW)


def test_duplicates(spark):
    same = [quote(i, 5000, flight_number="QP1") for i in range(3)]
    rows = same + [quote(9, 5200, flight_number="QP1"), quote(10, 5000, flight_number="QP1", fare_brand="FLEX")]
    rows += [quote(11, 5000, flight_number="QP1", source_code="s2")]
    rows += [quote(12, 5000, flight_number="QP1", origin="BLR", destination="DEL")]
    out = {r.ingest_seq: r.copies for r in c.deduplicate(table(spark, rows)).collect()}
    assert out == {0: 4, 9: 1, 10: 1, 11: 1}


def test_hot_key_of_copies_collapses(spark):
    rows = spark.range(30000).selectExpr("id % 3 as k", "id as ingest_seq", "'x' as v")
    one = c.first_arrivals(rows.filter("k = 0"), ["k"], F.col("ingest_seq")).first()
    assert (one.ingest_seq, one.copies) == (0, 10000)


@pytest.mark.parametrize(
    "parts,kept,flag",
    [
        ((4200, 520, 180, 100), True, None),
        ((4200, 900, 180, 100), False, "components_did_not_reconcile"),
        ((4200, 520, 180, 99.5), True, None),
        ((None, None, 180, 100), False, "no_component_split"),
    ],
)
def test_split_is_all_or_nothing(spark, parts, kept, flag):
    d = lambda v: None if v is None else Decimal(str(v))
    q = quote(1, 5000, base_fare=d(parts[0]), taxes=d(parts[1]), udf=d(parts[2]), convenience_fee=d(parts[3]))
    r = c.verify_decomposition(table(spark, [q])).first()
    assert r.components_complete is kept and r.quality_flags == ([flag] if flag else [])
    assert all((r[x] is not None) == kept for x in ("base_fare", "taxes", "udf", "convenience_fee"))


def test_sold_out_is_no_price(spark):
    r = c.clean_quotes(table(spark, [quote(1, 9999), quote(2, 5000, is_sold_out=True)]))
    assert float(r.index_prices.first().price) == 9999 and r.flagged.count() == 1


def test_report(spark):
    rows = [quote(i, v) for i, v in enumerate([4800, 5100, 5400, 5900, 6200, 7100])]
    rows += [quote(20, 4800, flight_number="QP0"), quote(21, 12), quote(22, 60000)]
    r = c.clean_quotes(table(spark, rows)).report().first()
    assert (r.input_quotes, r.exact_duplicates, r.rejected, r.outliers, r.output_quotes, r.index_cells) == (9, 1, 1, 1, 6, 1)
    assert r.discard_rate == pytest.approx(3 / 9)


def test_detectors_against_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    groups = {f"F{g}": [round(rng.lognormvariate(8.5, 0.3)) * (10 if rng.random() < 0.05 else 1) for _ in range(rng.choice([3, 5, 8, 40]))] for g in range(25)}
    rows, i = [], 0
    for g, values in groups.items():
        for v in values:
            rows.append(quote(i, v, carrier=g)); i += 1
    r = c.clean_quotes(table(spark, rows)).survivors.collect()
    expect = {}
    i = 0
    for values in groups.values():
        logs = [math.log(v) for v in values]
        med = statistics.median(logs)
        mad = statistics.median([abs(x - med) for x in logs])
        for v, x in zip(values, logs):
            z = 0.6745 * (x - med) / mad if len(values) >= 5 and mad > 0 else 0.0
            expect[i] = 500 <= v <= 200000 and abs(z) > 3.5
            i += 1
    assert {x.ingest_seq: x.is_outlier for x in r} == {k: v for k, v in expect.items() if k in {x.ingest_seq for x in r}}


def test_storage_identity_and_unknown_route(spark):
    rows = [quote(1, 5000, flight_number="QP1", fare_brand="A"), quote(2, 5000, flight_number="QP1", fare_brand="B")]
    rows += [quote(3, 5000, flight_number=None, fare_brand="A"), quote(4, 5000, flight_number=None, fare_brand="B")]
    kept = c.clean_quotes(table(spark, rows)).persistable
    routes = defaults.routes(spark)
    stored = f.stored_fares(f.require_known_routes(kept, routes))
    assert sorted(r.ingest_seq for r in stored.collect()) == [1, 3, 4]
    bad = c.clean_quotes(table(spark, [quote(1, 5000, origin="XXX")])).persistable
    assert f.unknown_routes(bad, routes).count() == 1
    with pytest.raises(Exception, match="route not in the basket"):
        f.require_known_routes(bad, routes).collect()


def test_quantiles_of_a_hot_group_use_many_tasks(spark):
    """One group holds nine tenths of all distinct prices; its ranks come from many buckets and stay exact."""
    import numpy as np

    from pricemesh.functions import stats

    rng = np.random.default_rng(4)
    prices = {"hot": np.round(rng.uniform(500, 9000, 9000), 2), "cold": np.round(rng.uniform(500, 9000, 1000), 2), None: np.array([7.0, 9.5])}
    rows = [(g, float(v)) for g, vs in prices.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in stats.grouped_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for g, vs in prices.items():
        assert got[g].n == len(vs) and [got[g].q1, got[g].q2, got[g].q9] == pytest.approx(np.quantile(vs, [0.25, 0.5, 0.9]).tolist())
    chosen = stats.chosen_rows(stats.histogram(df, ["g"], "v"), ["g"], "v", {"q2": 0.5}).filter("g = 'hot'")
    # Only the bucket of the median is ordered: as many rows as fit into its width.
    assert 0 < chosen.count() <= 2 * stats.BUCKET * 100 and {float(r.v) // stats.BUCKET for r in chosen.collect()} <= {
        float(np.quantile(vs, 0.5, method=m)) // stats.BUCKET for vs in [[float(r.v) for r in df.filter("g = 'hot'").collect()]] for m in ("lower", "higher")
    }
    for bounded in (False, True):
        again = {r.g: r.q2 for r in stats.grouped_quantiles(df, ["g"], "v", {"q2": 0.5}, bounded).collect()}
        assert again == {g: r.q2 for g, r in got.items()}


def test_first_arrivals_by_number_equal_those_by_row(spark, tmp_path):
    from pricemesh.sources import sinks

    rows = [(k % 5 if k % 11 else None, k // 3 % 7, f"v{k}") for k in range(200)] * 2 + [(9, 1, "same")] * 4
    spark.createDataFrame(rows, "k int, seq long, v string").repartition(6).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    by_number = c.first_arrivals(sinks.numbered(stored), ["k"], F.col("seq"), number="_row")
    want = {r.k: (r.seq, r.copies) for r in c.first_arrivals(stored, ["k"], F.col("seq")).collect()}
    got = by_number.collect()
    assert len(got) == len(want) and {r.k: (r.seq, r.copies) for r in got} == want and by_number.columns == ["k", "seq", "v", "copies"]
    assert "SortAggregate" not in by_number._jdf.queryExecution().executedPlan().toString()
