"""Tolerant parsers, loaders, payloads and robots rules on literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from pricemesh.functions import parse as ps
from pricemesh.operators import payload as pl
from pricemesh.operators import robots as r
from pricemesh.operators import weights as w
from pricemesh.sources import defaults, loaders as ld


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [x.v for x in df.select("i", build(F.col("s")).alias("v")).orderBy("i").collect()]


def test_months(spark):
    july = ["2026-07", "2026-7", "2026-07-23", "Jul-2026", "July 2026", "JULY/2026", "07/2026", "7-2026"]
    assert {str(v) for v in column(spark, july, ps.month_start)} == {"2026-07-01"}
    assert str(column(spark, ["Dec-2024"], ps.month_start)[0]) == "2024-12-01"
    bad = ["", "nonsense", "2026", "Smarch-2026", "13-2026-xx", "2026/07/01/02", "2026-13", None]
    assert column(spark, bad, ps.month_start) == [None] * len(bad)


def test_routes(spark):
    good = column(spark, ["BOM-DEL", "DEL-BOM", " del-bom ", "del_bom"], ps.route_pair)
    assert {tuple(v) for v in good} == {("BOM", "DEL")}
    assert column(spark, ["DELBOM", "DEL-BOM-BLR", "D-B", ""], ps.route_pair) == [None] * 4


def test_money(spark):
    got = column(spark, ["₹ 5,000", "4,200", "800", "Rs. 1,23,456", "5200.50", "-", "", "abc", None], ps.money)
    # A decimal point is kept: "5200.50" is five thousand two hundred, not half a million.
    assert [None if v is None else float(v) for v in got] == [5000, 4200, 800, 123456, 5200.5, None, None, None, None]


def test_page_states(spark):
    assert column(spark, ["Sorry, SOLD OUT", "all good", None], ps.looks_sold_out) == [True, False, False]
    assert column(spark, ["We don't fly there", "ok"], ps.looks_no_service) == [True, False]
    assert [None if v is None else float(v) for v in column(spark, ["Fares starting from ₹ 4,250 only", "none"], ps.landing_fare)] == [4250.0, None]


def test_cpi_csv(spark, tmp_path):
    p = tmp_path / "cpi.csv"
    p.write_text("﻿Month,Index,SECTOR\n2026-07,118.4,combined\nAug-2026,\"1,119.1\",rural\n2026-09,-3,urban\nbad,1,urban\n2026-10,x,urban\n2026-11,5,other\n", encoding="utf-8")
    parsed = ld.parse_cpi(ld.read_text_csv(spark, str(p)))
    ok = [(str(x.ref_month), x.sector, x.index_value, x.base_year) for x in ld.accepted(parsed).orderBy("ref_month").collect()]
    assert ok == [("2026-07-01", "combined", 118.4, 2024), ("2026-08-01", "rural", 1119.1, 2024), ("2026-11-01", "combined", 5.0, 2024)]
    assert sorted(x.reject for x in ld.rejected(parsed).collect()) == ["non-positive value", "unreadable month", "unreadable value"]
    q = tmp_path / "noheader.csv"
    q.write_text("a,b\n1,2\n")
    with pytest.raises(ld.BadHeader):
        ld.parse_cpi(ld.read_text_csv(spark, str(q)))


def test_reference_fares(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("sector,date,fare\nDEL-BOM,2026-07,\"₹5,100\"\nBOM-XXX,2026-07,5000\nDEL,2026-07,1\nBLR-DEL,2026-07,0\n", encoding="utf-8")
    rows = ld.read_text_csv(spark, str(p))
    parsed = ld.parse_reference_fares(rows, defaults.routes(spark), "basis", "url")
    assert [(x.route_code, x.avg_fare) for x in ld.accepted(parsed).collect()] == [("BOM-DEL", 5100.0)]
    assert [x.route_code for x in ld.unknown_routes(parsed).collect()] == ["BOM-XXX"]
    with pytest.raises(Exception, match="mandatory"):
        ld.parse_reference_fares(rows, defaults.routes(spark)).collect()


def test_configuration_files(spark):
    from pathlib import Path

    folder = Path(__file__).resolve().parent.parent / "config"
    cfg = ld.basket_config(spark, str(folder / "basket.json"))
    assert cfg["routes"].count() == 8 and cfg["windows"].count() == 5 and cfg["scenarios"].count() == 15
    assert {x.code for x in ld.source_config(spark, str(folder / "sources.json")).collect()} >= {"view", "__robots__"}


# Published weights of the eight routes.
WEIGHTS = [".2072001", ".1593118", ".1314687", ".1217260", ".0981153", ".0956135", ".0943425", ".0922221"]


def test_route_weights(spark):
    totals = spark.createDataFrame([(o, d, p) for _, o, d, p, _ in defaults.ROUTES] + [("AAA", "BBB", 999)], "origin string, destination string, passengers long")
    basket = defaults.routes(spark)
    got = w.route_weights(totals, basket).orderBy(F.desc("passengers")).collect()
    assert [float(x.weight) for x in got] == [float(v) for v in WEIGHTS] and sum(x.weight for x in got) == 1
    assert w.top_omitted(totals, basket).first().origin == "AAA"
    with pytest.raises(Exception, match="no traffic found"):
        w.route_weights(totals.filter("passengers < 4000000"), basket).collect()


DOC = {"trips": [{"journeys": [{"flightNumber": "1512", "departureTime": "2026-09-11T06:20:00", "stops": 0, "fareType": "SAVER",
                                "baseFare": 4200, "taxAmount": 520, "udf": 180, "convenienceFee": 100, "totalAmount": 5000}]}]}


def payload_quotes(spark, *docs):
    rows = [(i, "qp", "QP", "DEL", "BOM", "2026-09-04", "2026-09-11", json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "raw_id int, source string, carrier string, origin string, destination string, s string, d string, payload string")
    df = df.selectExpr("raw_id", "source", "carrier", "origin", "destination", "to_date(s) scrape_date", "to_date(d) departure_date", "payload")
    return df, {x.raw_id: x for x in pl.quotes(df).collect()}


def with_fields(**over):
    j = dict(DOC["trips"][0]["journeys"][0])
    j.update(over)
    return {"trips": [{"journeys": [{k: v for k, v in j.items() if v != "absent"}]}]}


def test_payload_fields(spark):
    df, q = payload_quotes(
        spark, DOC, with_fields(taxAmount="absent"), with_fields(baseFare=9000, taxAmount="absent"), with_fields(stops=1),
        with_fields(totalAmount="₹ 5,000", baseFare="4,200", taxAmount="520"), {"weird": {"unexpected": "shape"}},
        with_fields(totalAmount=True), with_fields(flightNumber={"number": "QP 88"}, departureTime="9:05"), with_fields(flightNumber=1512),
    )
    assert (q[0].flight_number, float(q[0].total_fare), str(q[0].departure_at), q[0].fare_brand) == ("QP1512", 5000.0, "2026-09-11 06:20:00", "SAVER")
    assert float(q[1].taxes) == 520.0 and q[2].base_fare is None and q[2].quality_flags == ["no_component_split"]
    assert 3 not in q and 5 not in q and 6 not in q
    assert (float(q[4].total_fare), float(q[4].base_fare)) == (5000.0, 4200.0)
    assert (q[7].flight_number, str(q[7].departure_at)) == ("QP88", "2026-09-11 09:05:00") and q[8].flight_number == "QP1512"
    keys = {x.raw_id: x.keys for x in pl.observed_keys(df.filter("raw_id = 5")).collect()}
    assert keys[5] == ["unexpected", "weird"]


def test_payload_order_and_depth(spark):
    two = {"z": {"totalAmount": 700, "flightNumber": "1", "fareType": "FIRST"}, "a": {"totalAmount": 800, "flightNumber": "1", "fareType": "SECOND"}}
    text_only = {"note": "{\"totalAmount\": 5}", "list": ["[1]", {"totalAmount": 900, "flightNumber": "3"}]}
    df, q = payload_quotes(spark, two, text_only)
    assert q[0].fare_brand == "FIRST" and float(q[1].total_fare) == 900


def test_payloads_are_read_to_any_depth(spark):
    docs = [DOC]
    for k in range(400):
        docs.append({"k": docs[-1]} if k % 2 else [docs[-1]])
    _, q = payload_quotes(spark, *docs)
    assert len(q) == len(docs) and {float(x.total_fare) for x in q.values()} == {5000.0}


def test_silent_payloads_are_listed(spark):
    df, _ = payload_quotes(spark, DOC, {"odd": {"shape": 1}})
    bad = df.limit(1).selectExpr("9 raw_id", "source", "carrier", "origin", "destination", "scrape_date", "departure_date", "'{broken' payload")
    df = df.union(bad)
    assert {r.raw_id: r["keys"] for r in pl.without_quotes(df).collect()} == {1: ["odd", "shape"], 9: None}
    assert [r.raw_id for r in pl.unreadable(df).collect()] == [9]
    hashes = df.select(pl.payload_hash("payload").alias("h")).collect()
    assert len({r.h for r in hashes}) == 3


BODY = "User-agent: *\nAllow: /\nDisallow: /cgi-bin/\nDisallow: /flights/search*\nDisallow: /m/flights/search*\nDisallow: /hotels/info*\nDisallow: /users/\n"


def judged(spark, body, paths, agent="anybot", status=200, intent=()):
    snap = spark.createDataFrame([("h", "x.com", status, body)], "snapshot_id string, host string, http_status int, body string")
    urls = spark.createDataFrame([(p, f"https://x.com{p}") for p in paths], "p string, url string")
    return {x.p: (x.allowed, x.rule) for x in r.judge(urls, r.policies(snap, agent), list(intent)).collect()}


def test_robots_matching(spark):
    denied = ["/flights/search", "/flights/search?from=DEL&to=BOM", "/flights/searchresults", "/m/flights/search", "/hotels/info", "/hotels/info/mumbai", "/users/"]
    got = judged(spark, BODY, denied + ["/flights", "/", "/about"])
    assert [p for p, v in got.items() if not v[0]] and {p for p, v in got.items() if not v[0]} == set(denied)
    assert got["/users/"][1] == "robots:disallow:/users/" and got["/about"][1] == "robots:allow:/"


def test_robots_groups_and_anchors(spark):
    body = "Disallow: /early\nUser-agent: alpha\nUser-agent: alphabot\nDisallow: /a$\nAllow: /eq\nDisallow: /eq\n\nUser-agent: *\nDisallow: /\nUser-agent: *\nAllow: /\n"
    got = judged(spark, body, ["/a", "/ab", "/eq", "/early", "/x.y"], "AlphaBot/1.0")
    assert {k: v[0] for k, v in got.items()} == {"/a": False, "/ab": True, "/eq": True, "/early": True, "/x.y": True}
    assert judged(spark, body, ["/a"], "other")["/a"] == (False, "robots:disallow:/")
    assert judged(spark, "User-agent: *\nDisallow: /x.y\n", ["/x.y", "/xzy"])["/xzy"][0]


def slow_winner(rules, path):
    import re

    best = None
    for allow, pattern in rules:
        body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
        if re.match("".join(".*" if c == "*" else re.escape(c) for c in body) + end, path):
            best = max(best or (0, False, ""), (len(pattern), allow, pattern))
    return (True, "robots:no_matching_rule") if best is None else (best[1], f"robots:{'allow' if best[1] else 'disallow'}:{best[2]}")


def test_rules_by_prefix_equal_all_rules_in_turn(spark):
    import random

    rng = random.Random(3)
    piece = lambda n: "".join(rng.choice("/ab*.$") for _ in range(n))
    rules = [(rng.random() < 0.5, "/" + piece(rng.randrange(6))) for _ in range(150)] + [(False, "*b"), (True, "*"), (False, "$"), (True, "/a$b")]
    body = "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {p}\n" for a, p in rules)
    paths = ["/" + "".join(rng.choice("/ab.") for _ in range(rng.randrange(7))) for _ in range(200)]
    got = judged(spark, body, sorted(set(paths)))
    assert got == {p: slow_winner(rules, p) for p in set(paths)}


def test_a_host_with_a_hundred_thousand_rules(spark):
    body = "User-agent: *\n" + "".join(f"Disallow: /item/{k}/\n" for k in range(100_000)) + "Allow: /item/77/open*\n"
    got = judged(spark, body, ["/item/99999/x", "/item/100000/x", "/item/77/", "/item/77/open/1", "/other"])
    assert got["/item/99999/x"] == (False, "robots:disallow:/item/99999/") and got["/item/77/open/1"][0] and not got["/item/77/"][0]
    assert got["/item/100000/x"] == got["/other"] == (True, "robots:no_matching_rule")


@pytest.mark.parametrize("status,allowed", [(200, True), (401, False), (403, False), (404, True), (429, True), (500, False), (None, False)])
def test_robots_status_policy(spark, status, allowed):
    assert judged(spark, "", ["/p"], status=status)["/p"][0] is allowed


def test_intent_comes_first(spark):
    got = judged(spark, "User-agent: *\nAllow: /\n", ["/api/v1", "/ok"], intent=["/api"])
    assert got["/api/v1"] == (False, "intent_denied:/api") and got["/ok"][0]


def test_deeply_nested_members_are_written():
    value = {"a": [pl.Number("1.50"), None, "x\"y", {}, []], "b": True}
    assert pl._text_of(value) == '{"a":[1.50,null,"x\\"y",{},[]],"b":true}'
    for _ in range(20_000):
        value = {"in": [value]}
    text = pl._text_of(value)
    assert text.startswith('{"in":[{"in":[') and text.count("in") == 20_000


@pytest.mark.parametrize("text", [
    "{}", "[]", ' {"a" : [1, -2.50, 1e5, true, false, null, "x\\u00e9\\n"], "b":{"c":[]}, "a":2} ', "[[[]],{}]", '{"a":NaN,"b":-Infinity,"c":Infinity}',
    "", " ", "{", "[1", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', '{a:1}', "[1 2]", "{} x", "[01]", "[1.]", "[tru]", '["a\nb"]', "[}", '{"a":1]', "7", '"x"', "nul",
])
def test_the_deep_reader_reads_what_json_reads(text):
    def whole(read):
        try:
            return read(text)
        except ValueError:
            return "no JSON"

    want = whole(lambda t: json.loads(t, parse_int=pl.Number, parse_float=pl.Number, parse_constant=pl.Number))
    assert whole(pl._read_deep) == want


def deep(levels, core, space=""):
    return "".join(f'{{{space}"in":{space}[' for _ in range(levels // 2)) + core + "]}" * (levels // 2)


def test_documents_of_any_depth(spark):
    core = json.dumps(DOC["trips"][0]["journeys"][0])
    turned = json.dumps(dict(reversed(DOC["trips"][0]["journeys"][0].items())))
    levels = [10, 900, 3000, 5000, 9000, 20_000, 200_000]
    texts = [deep(k, core) for k in levels] + [deep(k, turned, " ") for k in levels] + [deep(200_000, core)[:-1], deep(5000, '{"odd":1}')]
    rows = [(i, "qp", "QP", "DEL", "BOM", "2026-09-04", "2026-09-11", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "raw_id int, source string, carrier string, origin string, destination string, s string, d string, payload string")
    df = df.selectExpr("raw_id", "source", "carrier", "origin", "destination", "to_date(s) scrape_date", "to_date(d) departure_date", "payload")
    got = {r.raw_id: float(r.total_fare) for r in pl.quotes(df).collect()}
    assert got == {i: 5000.0 for i in range(2 * len(levels))}
    assert [r.raw_id for r in pl.unreadable(df).collect()] == [2 * len(levels)]
    silent = {r.raw_id: r["keys"] for r in pl.without_quotes(df).collect()}
    assert silent == {2 * len(levels): None, 2 * len(levels) + 1: ["in", "odd"]}
    hashes = {r.raw_id: r.h for r in df.select("raw_id", pl.payload_hash("payload").alias("h")).collect()}
    for i in range(len(levels)):
        assert hashes[i] == hashes[i + len(levels)]
    assert len(set(hashes.values())) == len(levels) + 2


def test_lone_surrogates_are_replaced(spark):
    df, q = payload_quotes(spark, with_fields(fareType="X\ud800Y"))
    assert q[0].fare_brand == "X\ufffdY"
