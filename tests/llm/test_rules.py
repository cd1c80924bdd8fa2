import re
from collections import Counter

from pyspark.sql import functions as F

from pricemesh.llm import rules
from tests.llm import cases


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_counts_equal_brute_force(spark):
    extra = [(80, "a b c d a b c x y " * 20 + "#$%\n same \n same \n", "en", "s", 0), (81, "né " * 60 + "a\x0bb\x0cc\td", "fr", "s", 0)]
    docs = cases.docs(spark).union(spark.createDataFrame(extra, cases.SCHEMA))
    for r in rules.judge(docs).collect():
        assert brute(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_thresholds_decide(spark):
    good = "the house and the garden of a friend are in the town that we like " * 3
    texts = [" ".join(f"{w}{k}" if len(w) > 5 else w for k, w in enumerate(good.split() + ["and"] * k)) for k in (12, 14)]
    docs = spark.createDataFrame([(0, texts[0]), (1, texts[1].upper()), (2, " ".join(w + "###" for w in texts[1].split()))], "doc_id int, text string")
    free = (rules.Rule("symbol_ratio", None, 0.1), rules.Rule("upper_ratio", None, 0.5), rules.Rule("n_words", 1, None))
    got = {r.doc_id: r.failed_rules for r in rules.judge(docs, thresholds=free).collect()}
    assert got == {0: [], 1: ["upper_ratio"], 2: ["symbol_ratio"]}
    assert all(r.failed_rules == [] for r in rules.judge(docs, thresholds=()).collect())


def test_empty_table_and_clashing_columns(spark):
    assert rules.judge(cases.empty(spark)).count() == 0
    clash = cases.docs(spark).withColumns({"n_words": F.lit("x"), "kept": F.lit(7), "_words": F.lit(1)})
    assert rules.judge(clash).count() == len(cases.rows())


def test_no_user_functions(spark):
    plan = rules.judge(cases.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
