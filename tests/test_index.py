"""Elementary cells, carry-forward and the headline against hand-worked figures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricemesh.operators import fares, index as x, validation as v
from pricemesh.sources import defaults

# The worked example, two routes x two windows x two carriers.
ROUTE_W = [(1, "0.565330"), (2, "0.434670")]
BASE = {(1, 7): (5200, 4900), (1, 30): (4100, 3800), (2, 7): (4800, 4500), (2, 30): (3700, 3500)}
DAY = {
    1: {(1, 7): (5980, 5390), (1, 30): (4305, 3914), (2, 7): (5760, 5040), (2, 30): (3811, 3605)},
    2: {(1, 7): (6240, 5880), (1, 30): (4182, 3990), (2, 7): (6000, 5310), (2, 30): (3774, 3640)},
}
CELLS_DAY_1 = {(1, 7): 112.4722, (1, 30): 103.9952, (2, 7): 115.9310, (2, 30): 103.0000}
HEADLINE = {1: 108.7691, 2: 111.9522}
# End of fixed values.


def prices_of(spark, days):
    rows = [
        (dt.date(2026, 9, n), r, w, c, float(p), 2)
        for n in days for (r, w), pair in DAY[n].items() for c, p in zip(("QP", "SG"), pair)
    ]
    df = spark.createDataFrame(rows, "scrape_date date, route_id int, window_days int, carrier string, price double, n_quotes long")
    return df.withColumn("price", F.col("price").cast("decimal(12,2)"))


def base_of(spark):
    rows = [(r, w, c, float(p)) for (r, w), pair in BASE.items() for c, p in zip(("QP", "SG"), pair)]
    df = spark.createDataFrame(rows, "route_id int, window_days int, carrier string, base_price double")
    return df.withColumn("base_price", F.col("base_price").cast("decimal(12,4)"))


def weights_of(spark):
    rw = spark.createDataFrame(ROUTE_W, "route_id int, weight string").withColumn("weight", F.col("weight").cast("decimal(12,10)"))
    win = spark.createDataFrame([(7, 0.5), (30, 0.5)], "window_days int, weight double")
    return rw, x.cell_weights(rw, win)


def test_worked_example(spark):
    _, weights = weights_of(spark)
    prices = prices_of(spark, [1, 2])
    elem = x.build_elementary(prices, base_of(spark), weights, fares.scrape_dates(prices))
    day1 = {(r.route_id, r.window_days): r.index_value for r in elem.filter("index_date = '2026-09-01'").collect()}
    assert {k: round(v, 4) for k, v in day1.items()} == CELLS_DAY_1
    daily = x.daily_headline(elem, weights, None)
    got = {r.index_date.day: r for r in daily.collect()}
    assert {k: round(r.index_value, 4) for k, r in got.items()} == HEADLINE
    assert all(r.n_cells == 4 and r.coverage_ratio == pytest.approx(1) and r.observed_pax_share is None for r in got.values())
    monthly = {r.frequency: r.index_value for r in x.all_frequencies(daily).collect() if r.frequency != "daily"}
    assert round(monthly["monthly"], 4) == 110.3607
    routes = x.route_index(elem, weights)
    gap = v.contribution_gaps(daily, routes).agg(F.max("gap")).first()[0]
    assert gap < 1e-9


def test_unmatched_carrier_drops_from_the_mean_but_counts_as_quote(spark):
    _, weights = weights_of(spark)
    base = base_of(spark).filter("NOT (route_id = 1 AND window_days = 7 AND carrier = 'SG')")
    cell = x.jevons_cells(prices_of(spark, [1]), base).filter("route_id = 1 AND window_days = 7").first()
    assert (cell.n_carriers, cell.carriers_used, cell.n_quotes) == (1, ["QP"], 4)
    assert cell.index_value == pytest.approx(115.0)
    assert x.jevons_cells(prices_of(spark, [1]), base.filter("carrier = 'XX'")).count() == 0


def outcomes(spark, pattern, policy="reference", start=dt.date(2026, 9, 1), skip=()):
    """Run carry-forward over one cell; pattern letters are O (observed) and M (missing)."""
    days = [start + dt.timedelta(days=i) for i in range(len(pattern))]
    keep = [i for i in range(len(pattern)) if i not in skip]
    obs = [(days[i], 1, 7, 100.0 + i) for i in keep if pattern[i] == "O"]
    observed = spark.createDataFrame(obs, "scrape_date date, route_id int, window_days int, index_value double").select(
        "*", F.array(F.lit("QP")).alias("carriers_used"), F.lit(1).alias("n_carriers"), F.lit(1).alias("n_quotes")
    )
    spine = spark.createDataFrame([(1, 7, days[i]) for i in keep], "route_id int, window_days int, scrape_date date")
    rows = x.carry_forward(observed, spine, policy=policy).orderBy("index_date").collect()
    return "".join("I" if r.is_imputed else "D" if r.is_dropped else "O" for r in rows), rows


def test_carry_forward_is_periodic(spark):
    got, rows = outcomes(spark, "OMMMMMMMM")
    assert got == "OIIDIIDII"
    assert rows[2].imputation_note.endswith(": 1") and "limit reached" in rows[3].drop_reason
    assert {r.index_value for r in rows if r.is_imputed} == {100.0}
    assert outcomes(spark, "OMMMMMMMM", "documented")[0] == "OIIDDDDDD"
    assert outcomes(spark, "MMOMO")[0] == "DDOIO"


def test_unprocessed_day_restarts_the_run(spark):
    assert outcomes(spark, "OMMMMM", skip={3})[0] == "OIIII"


def sequential(pattern, max_carry=2):
    """Day-by-day restatement: a dropped day leaves nothing stored, so the streak restarts."""
    out, stored, seen = [], {}, False
    for i, p in enumerate(pattern):
        if p == "O":
            out.append("O"); stored[i] = False; seen = True
            continue
        streak, j = 0, i - 1
        while stored.get(j) is True:
            streak += 1; j -= 1
        if seen and streak < max_carry:
            out.append("I"); stored[i] = True
        else:
            out.append("D")
    return "".join(out)


def test_carry_forward_matches_the_sequential_rule(spark):
    rng = random.Random(7)
    patterns = ["".join(rng.choice("OMMM") for _ in range(14)) for _ in range(40)]
    start = dt.date(2026, 1, 1)
    days = [start + dt.timedelta(days=i) for i in range(14)]
    obs = [(days[i], n, 7, 1.0 + i) for n, p in enumerate(patterns) for i, c in enumerate(p) if c == "O"]
    observed = spark.createDataFrame(obs, "scrape_date date, route_id int, window_days int, index_value double").select(
        "*", F.array(F.lit("QP")).alias("carriers_used"), F.lit(1).alias("n_carriers"), F.lit(1).alias("n_quotes")
    )
    spine = spark.createDataFrame([(n, 7, d) for n in range(40) for d in days], "route_id int, window_days int, scrape_date date")
    got = {}
    for r in x.carry_forward(observed, spine).orderBy("route_id", "index_date").collect():
        got[r.route_id] = got.get(r.route_id, "") + ("I" if r.is_imputed else "D" if r.is_dropped else "O")
    assert got == {n: sequential(p) for n, p in enumerate(patterns)}


def test_pax_share(spark):
    rw, weights = weights_of(spark)
    shares = spark.createDataFrame([("6E", 0.6389), ("QP", 0.0526), ("SG", 0.0303)], "carrier string, share double")

    def elem(rows):
        return spark.createDataFrame(
            rows, "index_date date, route_id int, window_days int, index_value double, carriers_used array<string>, is_imputed boolean, is_dropped boolean"
        )

    d = dt.date(2026, 9, 1)
    both = elem([(d, 1, 7, 100.0, ["QP", "SG"], False, False), (d, 2, 7, 100.0, ["SG", "QP"], False, False)])
    one_imputed = elem([(d, 1, 7, 100.0, ["QP", "SG"], False, False), (d, 2, 7, 100.0, [], True, False)])
    only_qp = elem([(d, 1, 7, 100.0, ["QP"], False, False)])
    nothing = elem([(d, 1, 7, 100.0, [], True, False)])
    share = lambda e: round(x.observed_pax_share(e, weights, shares).first()[1], 4)
    assert [share(e) for e in (both, only_qp, one_imputed, nothing)] == [0.0829, 0.0526, 0.0829, 0.0]


def test_base_price_needs_enough_days(spark):
    rows = [(dt.date(2026, 7, n), 1, 7, "QP", float(p)) for n, p in enumerate([4000, 5000, 6000], start=1)]
    prices = spark.createDataFrame(rows, "scrape_date date, route_id int, window_days int, carrier string, price double")
    b = fares.base_prices(prices, "2026-07-01", "2026-07-28", 3).first()
    assert float(b.base_price) == pytest.approx((4000 * 5000 * 6000) ** (1 / 3), abs=1e-4)
    assert fares.base_prices(prices, "2026-07-01", "2026-07-28", 4).count() == 0


def test_window_weight_robustness(spark):
    rows = [(dt.date(2026, 9, n), 1, w, val) for n in range(1, 6) for w, val in ((7, 120.0), (30, 100.0))]
    elem = spark.createDataFrame(rows, "index_date date, route_id int, window_days int, index_value double")
    rw = spark.createDataFrame([(1, 1.0)], "route_id int, weight double")
    sc = spark.createDataFrame(
        [(0, "equal", 7, 0.5), (0, "equal", 30, 0.5), (1, "near_heavy", 7, 0.9), (1, "near_heavy", 30, 0.1)],
        "scenario_no int, scenario string, window_days int, window_weight double",
    )
    got = {r.scenario: r for r in v.window_weight_robustness(elem, rw, sc).collect()}
    assert got["equal"].mean == pytest.approx(110) and got["equal"].max_gap_vs_baseline == 0
    assert got["near_heavy"].mean == pytest.approx(118) and got["near_heavy"].max_gap_vs_baseline == pytest.approx(8)


def test_naive_benchmark(spark):
    idx = [100, 106, 103, 112, 118, 115, 121]
    nv = [5000, 5200, 5100, 5400, 5600, 5500, 5700]
    d0 = dt.date(2026, 9, 1)
    daily = spark.createDataFrame([(d0 + dt.timedelta(days=i), float(a)) for i, a in enumerate(idx)], "index_date date, index_value double")
    naive = spark.createDataFrame([(d0 + dt.timedelta(days=i), float(a)) for i, a in enumerate(nv)], "scrape_date date, mean_fare double")
    r = v.benchmark_naive(daily, naive).first()
    gaps = [abs(a - b / 50) for a, b in zip(idx, nv)]
    assert r.n == 7 and r.max_divergence_points == pytest.approx(max(gaps)) and 0.9 < r.correlation_on_changes <= 1


def test_default_weights_sum_to_one(spark):
    assert float(defaults.route_weights(spark).agg(F.sum("weight")).first()[0]) == 1.0


def test_rebuilds_are_compared_by_checksums(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), 100.0 + i % 7) for i in range(200)]
    schema = "index_date date, index_value double"
    first, again = spark.createDataFrame(days, schema), spark.createDataFrame(days[::-1], schema).repartition(5)
    assert v.changed_rows(first, again) is None
    assert v.reproducible(first, again).first().passed
    plan = v.reproducible(first, again)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # equal sums: no row is joined
    # A changed value, a lost and an added day, and two values that changed places are found and named.
    other = dict(days)
    other[dt.date(2024, 3, 5)] += 0.0001
    lost = other.pop(dt.date(2024, 5, 9))
    other[dt.date(2025, 1, 1)] = 7.0
    x1, x2 = dt.date(2024, 2, 1), dt.date(2024, 2, 2)
    other[x1], other[x2] = other[x2], other[x1]
    second = spark.createDataFrame(list(other.items()), schema)
    expected = {d: (dict(days).get(d), other.get(d)) for d in {*other, *dict(days)} if dict(days).get(d) != other.get(d)}
    assert len(expected) == 5 and expected[dt.date(2024, 5, 9)] == (lost, None)
    for kept in (None, v.checksums(v._comparable(first), F.trunc("index_date", "month"))):
        found = {r.index_date: (r.first_value, r.second_value) for r in v.changed_rows(first, second, kept).collect()}
        assert found == expected
    assert not v.reproducible(first, second).first().passed
    assert v.reproducible(first.limit(0), second.limit(0)).first().passed
