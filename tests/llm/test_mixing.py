from pyspark.sql import functions as F

from pricemesh.llm import mixing
from tests.llm import cases


def shares(spark, leaves, budget, weights, **more):
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    return {(r.domain, r.lang, r.source): r.target for r in mixing.plan(frame, budget, weights, **more).collect()}


def test_shortages_go_to_siblings_first(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 5000), ("code", "en", "d", 5000)]
    got = shares(spark, leaves, 2000, {"domain": {"web": 1, "code": 1}}, max_epochs=1)
    # Each domain has 1,000, each language of web 500; a lacks 150, which its sibling b takes, not de or code.
    assert got == {("web", "en", "a"): 100, ("web", "en", "b"): 400, ("web", "de", "c"): 500, ("code", "en", "d"): 1000}


def test_then_to_ancestors(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 50), ("web", "de", "c", 300), ("code", "en", "d", 5000)]
    got = shares(spark, leaves, 2000, {}, max_epochs=1)
    assert got == {("web", "en", "a"): 100, ("web", "en", "b"): 50, ("web", "de", "c"): 300, ("code", "en", "d"): 1550}


def test_zero_weights_and_too_large_budgets(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 50), ("code", "en", "d", 10)]
    got = shares(spark, leaves, 10_000, {"source": {"b": 0}}, max_epochs=2)
    assert got == {("web", "en", "a"): 200, ("web", "en", "b"): 0, ("code", "en", "d"): 20}


def test_mix_fills_budget_by_whole_documents(spark):
    docs = cases.docs(spark)
    domain = F.when(F.col("source") == "src1", "b").otherwise("a")
    for percent in (10, 60, 250):
        got = mixing.mix(docs, domain, percent, {"domain": {"a": 1, "b": 3}}, max_epochs=3).collect()
        tokens = {i: len((t or "").split()) for i, t, *_ in cases.rows()}
        assert all(r.n_tokens == tokens[r.doc_id] and 1 <= r.copies <= 3 for r in got)
        spent = sum(r.n_tokens * r.copies for r in got)
        assert spent <= sum(len((t or "").split()) for _, t, *_ in cases.rows()) * percent // 100
        again = mixing.mix(docs.repartition(5), domain, percent, {"domain": {"a": 1, "b": 3}}, max_epochs=3).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))


def test_prefix_is_the_longest_that_fits(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 7 + 1), "en", "s") for k in range(500)], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id for r in mixing.mix(docs, F.lit("a"), 37, {}, seed=5).collect()}
    keys = docs.withColumn("full_epochs", F.lit(0)).select("doc_id", mixing._key(5).alias("key")).collect()
    left, want = sum(k % 7 + 1 for k in range(500)) * 37 // 100, set()
    for r in sorted(keys, key=lambda r: r.key):
        left -= r.doc_id % 7 + 1
        if left < 0:
            break
        want.add(r.doc_id)
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    assert mixing.mix(cases.empty(spark), F.lit("a"), 50, {}).count() == 0
    clash = cases.docs(spark).withColumns({"domain": F.lit(1), "_lang": F.lit(2), "copies": F.lit("x")})
    assert mixing.mix(clash, F.lit("a"), 300, {}).count() > 0


def test_tokens_are_counted_without_holding_them(spark, capsys):
    awkward = [None, "", " \n\t\x0b\x0c\r ", "a", "  a\tb\r\n\x0bc  ", "\u00a0a\u2003b c", "\U0001f600 \u4e2d\u0085x\x00 y\x1fz", "$1 \\1 x", "w " * 50_000 + "\n" * 50_000]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(awkward)], "doc_id bigint, text string, lang string, source string")
    mixed = mixing.mix(docs, F.lit("a"), 300, {}, max_epochs=3)
    got = {r.doc_id: r.n_tokens for r in mixed.collect()}
    assert got == {k: len((t or "").encode().split()) for k, t in enumerate(awkward)}
    mixed.explain(True)
    assert "regexp_extract_all" not in capsys.readouterr().out.lower()
