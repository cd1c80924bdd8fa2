import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pricemesh.llm import spelling
from tests.llm import cases


def slow_vocabulary(rows, every=None, letters=5, least=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if every and h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def edited(word):
    """All words one edit away over the letters that occur."""
    letters = "abcdefghijklmnopqrstuvwxyzàéÿÀ×"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    out |= {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def slow_groups(words):
    near = {w: [x for x in edited(w) if x in words] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    root = {}
    for w in words:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {(w, n, len(near[w]), form[w], words.get(form[w]), root[w]) for w, n in words.items()}


def some_words(seed, n, letters="aeinrst"):
    rng = random.Random(seed)
    words = {}
    for _ in range(n):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 9)))
        words[w] = rng.randrange(3, 60)
        for x in rng.sample(sorted(edited(w)), 3):
            if len(x) >= 5:
                words[x] = rng.randrange(3, 200)
    return words


def test_vocabulary_equals_brute_force(spark):
    extra = [(70, "Straße ÀÉÎ×÷ÿ naïve naïve NAÏVE naïve中naïve KKelvin"), (None, "Kelvin kelvin KELVIN kelvin")]
    rows = [(r[0], r[1]) for r in cases.rows()] + extra
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for every in (None, 2, 97):
        got = {r.word: r.n for r in spelling.vocabulary(docs, typo_every=every).collect()}
        assert got == slow_vocabulary(rows, every)


@pytest.mark.parametrize("leaf,block", [(spelling.LEAF, spelling.BLOCK), (8, 200)])
def test_groups_equal_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = some_words(1, 400) | {"x" * 5000: 9, "x" * 5001: 30, "x" * 4095: 5, "x" * 4096: 4, "ÿÿÀ×àé": 3, "ÿÿÀ×àe": 7, "aaaaa": 3, "aaaab": 6, "aaaac": 6}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(4)
    got = {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.group(frame).collect()}
    long = {w for w in words if len(w) > 4000}
    assert {x for x in got if x[0] not in long} == slow_groups({w: n for w, n in words.items() if w not in long})
    assert {(x[0], x[2], x[3], x[5]) for x in got if x[0] in long} == {
        ("x" * 5000, 1, "x" * 5001, "x" * 5001), ("x" * 5001, 1, None, "x" * 5001), ("x" * 4095, 1, None, "x" * 4095), ("x" * 4096, 1, None, "x" * 4096)
    }


def test_deep_descent_finds_what_flat_comparison_finds(monkeypatch):
    words = sorted(w.encode("latin-1") for w in some_words(2, 800, "aeilnorst") if len(w) == 7)
    counts = np.minimum(spelling._counts(words, spelling._FINE, 27), 255).astype(np.uint8)
    kind = np.full(len(words), spelling.HOME)
    found = []
    for leaf in (4, 1 << 30):
        monkeypatch.setattr(spelling, "LEAF", leaf)
        a, b = spelling.near_in_shard(words, kind, counts, spelling._bits(counts))
        found.append(set(zip(a.tolist(), b.tolist())))
    assert found[0] == found[1] and len(found[0]) > 100


def test_awkward_tables(spark):
    assert spelling.group(spelling.vocabulary(cases.empty(spark))).count() == 0
    one = spark.createDataFrame([("lonely", 4)], "word string, n bigint")
    assert [tuple(r) for r in spelling.group(one).select("word", "n", "n_near", "form", "form_n", "root").collect()] == [("lonely", 4, 0, None, None, "lonely")]
    clash = cases.docs(spark).selectExpr("*", "1 AS word", "'x' AS n", "2 AS shard", "3 AS _text", "4 AS _key")
    assert spelling.vocabulary(clash).count() == spelling.vocabulary(cases.docs(spark)).count()
