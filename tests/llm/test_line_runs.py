import random

import pytest
from pyspark.sql import functions as F

from pricemesh.llm import line_runs
from tests.llm import cases


def brute(rows, least):
    """Cut lines per document: every run of `least` words or more that an earlier run equals."""
    first, cut = {}, {}
    for key, text in rows:
        lines = [(n, x.strip()) for n, x in enumerate((text or "").split("\n")) if x.split()]
        cut[key] = set()
        for a in range(len(lines)):
            words = 0
            for b in range(a, len(lines)):
                words += len(lines[b][1].split())
                if words >= least:
                    run = tuple(x for _, x in lines[a : b + 1])
                    if first.setdefault(run, (key, a)) != (key, a):
                        cut[key].update(range(lines[a][0], lines[b][0] + 1))
        for (x, _), (y, _) in zip(lines, lines[1:]):
            if {x, y} <= cut[key]:
                cut[key].update(range(x, y))  # blank lines between cut lines
    return cut


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [cases.prose(k, rng.choice([1, 2, 3, 5, 8, 13])) for k in range(12)] + ["", "  "]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randrange(14)))) for k in range(40)]
    rows += [(100 + k, "\n".join(pool[:9])) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text")).repartition(4)
    want = brute(rows, 12)
    for r in line_runs.deduplicate(docs, least=12).collect():
        text = dict(rows)[r.doc_id]
        left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[r.doc_id])
        assert (r.text, r.n_lines_cut) == (left, len(want[r.doc_id]))
        assert r.n_chars == len(left)


def test_passages_go_and_clean_texts_stay(spark):
    texts = {i: t for i, t, *_ in cases.rows()}
    got = {r.doc_id: r for r in line_runs.deduplicate(cases.docs(spark)).collect()}
    passage = "\n".join(texts[30].split("\n")[1:4])
    assert passage in got[30].text and passage not in got[31].text and passage not in got[32].text
    assert got[31].text == "\n".join(texts[31].split("\n")[::4])
    assert got[20].text == texts[20] and got[21].text == "" and got[50].text == texts[50]
    assert all(got[k].text == texts[k] and got[k].n_lines_cut == 0 for k in (*range(12), 40, 41, 42, 43, 60))


def test_repeated_rows_empty_tables_and_clashing_columns(spark):
    text = cases.prose(1, 80)
    docs = spark.createDataFrame([(1, text)] * 3 + [(None, text), (2, text + "\nend")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), len(r.text)) for r in line_runs.deduplicate(docs).collect())
    assert got == [("1", len(text))] * 3 + [("2", 3), ("None", 0)]
    clash = cases.docs(spark).withColumns({"_cuts": F.lit(1), "_doc": F.lit(2), "n_lines_cut": F.lit("x"), "_text": F.lit(3)})
    assert line_runs.deduplicate(clash).count() == len(cases.rows())
    assert line_runs.deduplicate(cases.empty(spark)).count() == 0
