import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricemesh.llm import quality_model as Q
from tests.llm import cases


def brute_model(texts):
    """Interpolated modified Kneser-Ney over the same classes, by dictionaries."""
    tables = [Counter()]
    for t in texts:
        tables[0].update(Q.grams([t])[0].tolist())
    for order in range(Q.ORDER - 1, 0, -1):
        tables.append(Counter(g & (1 << 6 * order) - 1 for g in tables[-1]))
    levels = []
    for table in tables[::-1]:
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cut = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 for k in (1, 2, 3)]
        cut = [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), cut)]
        total, taken = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[g >> 6] += c
            taken[g >> 6] += cut[min(c, 3) - 1]
        levels.append(({g: (c - cut[min(c, 3) - 1]) / total[g >> 6] for g, c in table.items()}, {k: taken[k] / total[k] for k in total}))

    def p(gram):
        value = 1 / 64
        for order, (own, back) in enumerate(levels, 1):
            g = gram & (1 << 6 * order) - 1
            value = own.get(g, 0) + back.get(g >> 6, 1.0) * value
        return value

    return p


@pytest.fixture(scope="module")
def texts():
    return [cases.prose(k, 60) + ". The End, 12!" for k in range(30)] + ["", "a", "Été\nçà"]


def test_probabilities_equal_brute_force_and_sum_to_one(spark, texts):
    counts = Q.count(spark.createDataFrame([(t,) for t in texts], "text string"))
    seen = sorted({g for t in texts for g in Q.grams([t])[0].tolist()})
    wanted = seen[::7] + [seen[3] >> 6 << 6 | w for w in range(64)] + [63 << 18 | 5 << 12 | w for w in range(64)]
    got = {r.gram: math.exp(r.log_p) for r in Q.probabilities(spark.createDataFrame([(g,) for g in set(wanted)], "gram bigint"), counts).collect()}
    p = brute_model(texts)
    assert got == pytest.approx({g: p(g) for g in set(wanted)})
    assert sum(got[seen[3] >> 6 << 6 | w] for w in range(64)) == pytest.approx(1)
    assert sum(got[63 << 18 | 5 << 12 | w] for w in range(64)) == pytest.approx(1)


def test_scores_equal_brute_force(spark, texts):
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(99, None, None)], "doc_id bigint, text string, lang string")
    counts = Q.count(docs.where("text is not null"))
    table = Q.probabilities(Q.count(docs.where("text is not null")).select("gram"), counts)
    p = brute_model(texts)
    for r in Q.score(docs, table).collect():
        grams = Q.grams([texts[r.doc_id]])[0] if r.doc_id != 99 else []
        assert r.nll == (pytest.approx(-np.mean([math.log(p(int(g))) for g in grams]), rel=1e-5) if len(grams) else None)


def corpus(spark):
    good = [(k, cases.prose(k, 30 + k % 90), "en") for k in range(800)]
    bad = [(1000 + k, " ".join(f"{w.upper()}%%%" for w in cases.prose(k, 50).split()), "en") for k in range(40)]
    rest = [(2000, None, "en"), (2001, "", "xx"), (2002, cases.prose(9, 20000), "en"), (2003, "?!", None), (None, cases.prose(8, 70), "en"), (5, good[5][1], "en")]
    return spark.createDataFrame(good + bad + rest, "doc_id bigint, text string, lang string")


def test_junk_goes_and_clean_text_stays(spark):
    docs = corpus(spark)
    trusted = docs.where("doc_id < 600").select("doc_id")
    got = Q.judge(docs, trusted).collect()
    assert len(got) == docs.count()
    for r in got:
        clean = r.doc_id is None or r.doc_id < 1000 or r.doc_id in (2002, 2003)
        assert r.kept == clean, r
    left = Q.keep_good(docs.withColumns({"nll": F.lit(1), "row_hash": F.lit(2), "_row_hash": F.lit("x")}), trusted)
    assert left.count() == sum(r.kept for r in got)


def test_without_trusted_text_only_empty_texts_go(spark):
    docs = cases.docs(spark)
    got = Q.judge(docs, docs.select("doc_id").limit(0)).collect()
    assert sorted(str(r.doc_id) for r in got if not r.kept) == ["40", "41"]
    assert Q.judge(cases.empty(spark), docs.select("doc_id")).count() == 0


def test_classes_with_few_trusted_texts_are_judged(spark):
    good = [(k, cases.prose(k, 60), "en") for k in range(600)] + [(900 + k, cases.prose(900 + k, 60), "de") for k in range(4)]
    junk = "%$#@ " * 30
    docs = spark.createDataFrame(good + [(2000, junk, "de"), (2001, junk, "xx"), (2002, junk[:40], "en"), (2003, junk[:40], None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in Q.judge(docs, docs.where("doc_id < 2000").select("doc_id")).collect()}
    assert not any(got[k].kept for k in (2000, 2001, 2002, 2003)) and all(r.most is not None for r in got.values())


def test_limit_is_a_quantile_of_trusted_texts(spark):
    rows = [(k, "en", 400, 1.7 + k / 1000) for k in range(200)]
    trusted = spark.createDataFrame(rows, "doc_id bigint, lang string, length bigint, nll double")
    for q in (0.5, 0.9, 0.995):
        known, _ = Q.limits(trusted, q)
        (r,) = known.where("size = 4").collect()
        passing = sum(x[3] <= r.center + r.most * 20 / 400 for x in rows) / len(rows)
        assert passing == pytest.approx(q, abs=0.011)


def test_limits_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["en", "en", "en", "de", "fr"]), rng.choice([9, 20, 300, 2000]), 1.5 + rng.random()) for k in range(90)]
    rows += [(100, "es", 40, 1.9)]
    trusted = spark.createDataFrame(rows, "doc_id bigint, lang string, length bigint, nll double")
    mean = sum(r[3] for r in rows) / len(rows)
    centers = {}
    for lang in ("en", "de", "fr", "es"):
        own = [r[3] for r in rows if r[1] == lang]
        centers[lang] = round((sum(own) + 30 * mean) / (len(own) + 30), 6)
    size = {9: 0, 20: 1, 40: 2, 300: 4, 2000: 5}
    bins = [(lang, size[n], math.floor((nll - centers[lang]) * math.sqrt(n) * 100)) for _, lang, n, nll in rows]
    sd = math.sqrt(sum(((b + 0.5) / 100) ** 2 for *_, b in bins) / (len(bins) - 1))

    def wide(b):
        t = (b + 1) / 100 / sd / math.sqrt(3)
        return 0.5 + (t / (1 + t * t) + math.atan(t)) / math.pi

    def mixed(b, own, prior):
        return (sum(x <= b for x in own) + 30 * prior) / (len(own) + 30)

    def first(share):
        seen = sorted({x for *_, x in bins} | set(range(20000)))
        return (next(b for b in seen if share(b) >= 0.995 - 1e-9) + 1) / 100

    known, (center, most, shortest) = Q.limits(trusted)
    got = {(r.lang, r["size"]): (r.center, r.most) for r in known.collect()}
    assert len(got) == 4 * 6 and shortest == 9
    assert (center, most) == (pytest.approx(mean), pytest.approx(first(lambda b: mixed(b, [x for *_, x in bins], wide(b)))))
    for (lang, k), (at, limit) in got.items():
        here = [x for g, n, x in bins if g == lang and n == k]
        rest = [x for g, n, x in bins if g == lang and n != k]
        others = [x for g, _, x in bins if g != lang]
        want = first(lambda b: mixed(b, here, mixed(b, rest, mixed(b, others, wide(b)))))
        assert (at, limit) == (pytest.approx(centers[lang]), pytest.approx(want)), (lang, k)
    assert Q.limits(trusted.limit(1))[1] is None and Q.limits(trusted.limit(1))[0].count() == 0


def test_no_more_than_the_quantile_of_short_texts_passes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "ab cd", "en") for k in range(5000)], "doc_id bigint, text string, lang string")
    nll = (1 + F.pmod(F.hash("doc_id"), F.lit(10007)) / 5000).alias("nll")
    told = [F.lit(0).cast("bigint").alias("row_hash"), "lang", F.length("text").cast("bigint").alias("length")]
    monkeypatch.setattr(Q, "score", lambda docs, *_: docs.select("doc_id", *told, nll))
    got = Q.judge(docs, docs.select("doc_id"), quantile=0.9)
    assert got.agg(F.avg(F.col("kept").cast("double"))).first()[0] == pytest.approx(0.9, abs=0.03)


def test_documents_meet_the_sharded_table_in_a_join(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(k // 2, t, "en") for k, t in enumerate(texts * 4)] + [(None, None, None)], "doc_id bigint, text string, lang string")
    table = Q.probabilities(Q.count(docs.where("text is not null")), Q.count(docs.where("text like '%alpha%'")))
    whole = Q.staging.written(table, "table")

    def refuse(*_):
        raise AssertionError("the table is collected")

    monkeypatch.setattr(type(whole), "toPandas", refuse)
    monkeypatch.setattr(type(whole), "collect", refuse)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refuse)
    found = [Q.staging.written(Q.score(docs.repartition(parts), whole, groups=g), "scores") for parts, g in ((1, 1), (5, 3))]
    monkeypatch.undo()
    one, other = (sorted(map(str, f.collect())) for f in found)
    assert one == other and len(one) == len(texts) * 4 + 1
    log_p = {r.gram: r.log_p for r in whole.collect()}
    want = {t: -np.mean([log_p[g] for g in Q.grams([t])[0].tolist()]) for t in texts if t}
    got = sorted(r.nll for r in found[1].collect() if r.nll is not None)
    assert got == pytest.approx(sorted(x for x in want.values() for _ in range(4)), rel=1e-5)


def test_packed_counts_are_those_of_every_document(spark, texts):
    awkward = ["a" * 70_000, "", "\u4e2d\U0001f600" * 3, *texts]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(awkward)], "doc_id bigint, text string, lang string").repartition(3)
    found, told = defaultdict(Counter), {}
    parts = Q.document_counts(docs, groups=2).collect()
    for r in parts:
        if r.docs is not None:
            assert r.block not in told
            told[r.block] = [d.doc_id for d in r.docs]
    for r in parts:
        for gram, row, n in zip(*(x.tolist() for x in Q._unpacked(bytes(r.counts)))):
            assert gram % Q.SHARDS == r.cell % Q.SHARDS
            found[told[r.block][row]][gram] += n
    assert sorted(k for ids in told.values() for k in ids) == list(range(len(awkward)))
    for k, t in enumerate(awkward):
        assert found[k] == Counter(Q.grams([t])[0].tolist())
