import re

import pytest
from pyspark.sql import functions as F

from pricemesh.llm import decontaminate
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(text, items):
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for k in range(max(1, len(w) - 12) if w else 0):
            gram = w[k : k + 13]
            for i in range(len(doc) - len(gram) + 1):
                if doc[i : i + len(gram)] == gram:
                    hit.update(range(i, i + len(gram)))
                    found.add("" if name is None else str(name))
    return len(doc), len(hit), sorted(found)


@pytest.fixture
def items():
    texts = {i: t for i, t, *_ in cases.rows() if t}
    return [
        (1, " ".join(texts[5].split()[3:25])), (2, "ONE! two"), (3, None), (4, ""), (None, texts[7][:60]), (10, " ".join(texts[50].split()[20000:20030])),
        (11, " ".join(texts[20].split()[290:300] + ["new"] * 5)), (2, texts[3]), (12, "alpha1 alpha1"), (13, texts[30].split("\n")[1]),
    ]


@pytest.mark.parametrize("chars", [decontaminate.BLOCK_CHARS, 150])
def test_matches_equal_brute_force(spark, monkeypatch, items, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    docs = cases.docs(spark)
    got = decontaminate.matches(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert len(got) == len(cases.rows())
    want = sorted((str(i), *brute(t, items)) for i, t, *_ in cases.rows())
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want


def test_near_matches_take_any_order(spark):
    docs = spark.createDataFrame([(1, "x quartz stone fjord y"), (2, "quartz " + "z " * 90 + "fjord stone")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "fjord quartz stone")], "item_id int, text string")
    got = {r.doc_id: [n.item_id for n in r.near] for r in decontaminate.matches(docs, bench).collect()}
    assert got == {1: ["9"], 2: []}


def test_contaminated_documents_go(spark, items):
    docs, bench = cases.docs(spark), spark.createDataFrame(items, "item_id int, text string")
    left = decontaminate.decontaminate(docs.withColumn("_bad_id", F.lit(1)), bench)
    bad = [i for i, t, *_ in cases.rows() if 0 < brute(t, items)[1] and 20 * brute(t, items)[1] >= brute(t, items)[0]]
    assert bad and left.count() == len(cases.rows()) - len(bad)
    assert "_bad_id" in left.columns


def test_empty_tables(spark, items):
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert decontaminate.matches(cases.empty(spark), bench).count() == 0
    none = decontaminate.matches(cases.docs(spark), bench.limit(0)).collect()
    assert len(none) == len(cases.rows()) and all(r.n_hit == 0 and r["items"] == [] for r in none)


@pytest.mark.parametrize("chars", [decontaminate.BLOCK_CHARS, 150])
def test_rows_that_share_a_name_keep_all_their_words(spark, monkeypatch, chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
    text = " ".join(f"w{i}" for i in range(200))
    part = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    # Per name the later row of the benchmark stands earlier in the document.
    items = [(7, part(100, 113)), (7, part(10, 23)), (None, part(150, 163)), (None, part(40, 53))]
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (got,) = decontaminate.matches(docs, spark.createDataFrame(items, "item_id int, text string").coalesce(1)).collect()
    assert (got.n_words, got.n_hit, got["items"]) == brute(text, items)
    assert [(p.start, p.stop, p.item_id) for p in got.phrases] == [(10, 23, "7"), (40, 53, ""), (100, 113, "7"), (150, 163, "")]


@pytest.mark.parametrize("batch", [0, 200_000])
def test_more_documents_than_a_segment_holds(spark, batch):
    """Short documents by the hundred thousand in one Arrow batch: document numbers must not wrap."""
    bad = {5: "a phrase of the benchmark", 70_005: "x a phrase of the benchmark y", 139_999: "another one"}
    docs = spark.range(140_000).select(F.col("id").alias("doc_id"), F.lit("w q").alias("text"))
    for i, t in bad.items():
        docs = docs.withColumn("text", F.when(F.col("doc_id") == i, t).otherwise(F.col("text")))
    bench = spark.createDataFrame([(1, "A phrase of the benchmark"), (2, "another one"), (1, "A phrase of the benchmark")], "item_id int, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = decontaminate.matches(docs.coalesce(1), bench).where("n_hit > 0").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found} == {5: (5, ["1"]), 70_005: (5, ["1"]), 139_999: (2, ["2"])}


def test_a_text_longer_than_a_segment_beside_short_ones(spark, monkeypatch):
    """Positions of a long text go beyond 24 bits of what a shared segment may use."""
    phrase = " ".join(f"k{i}" for i in range(13))
    long = "a " * 4_300_000 + phrase + " a" * 5
    rows = [(1, "short " + phrase), (2, long), (3, "a a a"), (4, phrase)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(9, phrase), (8, "a b"), (9, phrase)], "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], [(p.start, p.stop) for p in r.phrases]) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {
        1: (14, 13, ["9"], [(1, 14)]), 2: (4_300_018, 13, ["9"], [(4_300_000, 4_300_013)]), 3: (3, 0, [], []), 4: (13, 13, ["9"], [(0, 13)])
    }


@pytest.mark.parametrize("vocabulary", [decontaminate.VOCABULARY, 30])
def test_long_and_repeated_items_over_many_blocks(spark, monkeypatch, vocabulary):
    """Pieces of long items and blocks that share an index, or not, find what the whole items hold."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 300)
    monkeypatch.setattr(decontaminate, "VOCABULARY", vocabulary)
    built = []
    build = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda *a: built.append(1) or build(*a))
    texts = {i: t for i, t, *_ in cases.rows() if t}
    items = [(1, " ".join(texts[20].split()[:200])), (1, " ".join(texts[20].split()[:200])), (2, " ".join(texts[50].split()[400:640])), (3, texts[43])]
    got = decontaminate.matches(cases.docs(spark), spark.createDataFrame(items, "item_id int, text string")).collect()
    want = sorted((str(i), *brute(t, items)) for i, t, *_ in cases.rows())
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got) == want
    assert len(built) == 1 if vocabulary > 30 else len(built) > 1


def test_pieces_of_long_items_keep_every_phrase(spark):
    size = decontaminate.PIECE_WORDS
    text = " ".join(f"w{i}" for i in range(2 * size + 5))
    pieces = decontaminate._pieces(spark.createDataFrame([(1, text), (2, "x"), (3, None)], "item_id int, text string"), 13).collect()
    grams = {tuple(w[k : k + 13]) for p in pieces if p.item_id == 1 for w in [p.text.split()] for k in range(len(w) - 12)}
    assert grams == {tuple(f"w{j}" for j in range(k, k + 13)) for k in range(2 * size + 5 - 12)}
    assert sorted((p.item_id, p.text) for p in pieces if p.item_id != 1) == [(2, "x"), (3, None)]
