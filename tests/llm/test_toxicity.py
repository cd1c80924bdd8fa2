import random

import pytest
from pyspark.sql import functions as F

from pricemesh.llm import toxicity
from tests.llm import cases

LEXICON = toxicity.Lexicon({"moron": 2.0, "trash": 1.0, "tra": 0.5}, ("trash can",), (-4.0, 3.0))


@pytest.mark.parametrize("text", ["M0R0N", "mоrоn", "ｍｏｒｏｎ", "mo​ron", "m\xadoron", "m0r0n!", "$ay m0ron", "Moronic"])
def test_disguises_are_folded(text):
    assert toxicity.Matcher(LEXICON).rate(f"you {text} here")


@pytest.mark.parametrize("text", ["", "oxymoron", "a trash can here", "Trash-Can!", "clean words"])
def test_exceptions_and_inner_matches_are_not_hits(text):
    assert toxicity.Matcher(LEXICON).rate(text) == 0


def test_longest_entry_and_length(spark):
    matcher = toxicity.Matcher(LEXICON)
    assert matcher.rate("trash") == 100.0 and matcher.rate("trait x") == 25.0
    assert matcher.rate("trash can trash") == pytest.approx(100 / 3)


def corpus():
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(400):
        words = cases.prose(k, 60 + rng.randrange(60)).split()
        if k % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vileterm", "vileterms"]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 5 == 0)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "n4stYw0rd " * 9), (None, "clean")], "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    train = known.where(~toxicity.held_out(F.col("doc_id")))
    lexicon = toxicity.train(docs.withColumn("toxic", F.lit("clash")), train)
    assert set(lexicon.weights) == {"nastyword", "vileterm"}
    got = {r.doc_id: r for r in toxicity.score(docs.withColumns({"score": F.lit("x"), "hits": F.lit(1)}), lexicon).collect()}
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(got[k].predicted == toxic for k, toxic in labels)
    assert got[900].score == got[901].score < 0.5 and got[902].predicted == 1 and got[None].predicted == 0


def test_no_labels_no_lexicon(spark):
    docs = cases.docs(spark)
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    lexicon = toxicity.train(docs, none)
    assert lexicon.weights == {} and {r.predicted for r in toxicity.score(docs, lexicon).collect()} == {0}
    assert toxicity.score(cases.empty(spark), lexicon).count() == 0


def test_fold_is_the_contracts(spark):
    import zlib

    ids = spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)
