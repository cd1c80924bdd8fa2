import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pricemesh.llm import packing
from tests.llm import cases

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_ids_equal_the_plain_tokenizer():
    odd = [
        "", " \n\t ", "Hello, World... it's we'll 'twas don't.", "a.b, c,. d),. (e.", "Ärger ÀÉ é é ́x ΣΑΣ ς", "中文 字 　 x y  z\x85q\x1cr",
        "<|endoftext|> x<|startoftext|>y <|endoftext|>, <|endoftext|>.", "1,000.50 3.14, 7.,", "x" * 3000, "각 İstanbul ﬁ ½ ¼.", "tabs\x0bvt\x0cff\r\n.", "word word, word. word., .,",
    ]
    texts = odd + [t or "" for _, t, *_ in cases.rows()]
    encoder = packing.encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [plain_ids(t) for t in texts]
    encoder.held = packing.KNOWN_BYTES + 1
    assert [x.tolist() for x in encoder.encode(pa.array([None, *texts[1:5]]))] == [plain_ids(t) for t in texts[:5]]


def least_bins(lengths, capacity):
    """The fewest bins, by trying all placements."""
    best = len(lengths)

    def go(k, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if k == len(lengths):
            best = len(loads)
            return
        for i in range(len(loads)):
            if loads[i] + lengths[k] <= capacity and loads[i] not in loads[:i]:
                go(k + 1, [*loads[:i], loads[i] + lengths[k], *loads[i + 1 :]])
        go(k + 1, [*loads, lengths[k]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_bound_never_exceeds_the_optimum_and_search_reaches_it():
    rng = random.Random(1)
    reached = 0
    for trial in range(60):
        lengths = [rng.randrange(1, 31) for _ in range(rng.randrange(1, 13))]
        least = least_bins(lengths, 30)
        array = np.array(lengths)
        assert packing.bound(array, 30) <= least
        found = packing.evolve(array, packing.founders(array, None, 30, random.Random(trial)), 30, random.Random(trial), children=60)
        bins = found[0]
        assert np.bincount(bins, array).max() <= 30 and bins.max() + 1 >= least
        reached += bins.max() + 1 == least
    assert reached >= 59


def test_crossing_keeps_every_piece_once_and_helps():
    rng = random.Random(2)
    # Triples that fill a bin exactly: best fit alone does not find them all.
    lengths = []
    for _ in range(60):
        a, b = rng.randrange(260, 480), rng.randrange(260, 480)
        lengths += [a, b, 1000 - a - b] if a + b < 960 else [a, 1000 - a]
    array = np.array(lengths)
    start = packing.founders(array, None, 1000, random.Random(3))
    for _ in range(20):
        child = packing.crossed(start[0], start[1], array, 1000, rng)
        assert len(child) == len(array) and np.bincount(child, array).max() <= 1000 and child.min() >= 0
    before = min(packing.fitness(b, array, 1000) for b in start)
    after = packing.fitness(packing.evolve(array, start, 1000, random.Random(4), children=400)[0], array, 1000)
    assert after < before


def check_places(rows, capacity):
    """Every sequence is filled without gaps from 0 and holds no more than capacity."""
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


@pytest.mark.parametrize("cell", [packing.CELL, 40])
def test_places_over_many_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(packing, "CELL", cell)
    rng = random.Random(5)
    lengths = [rng.choice([4096, 4095, 2100, 2000, rng.randrange(1, 900), rng.randrange(1, 4096)]) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "uid bigint, length bigint")
    got = frame.join(packing.place(frame), "uid").collect()
    assert sorted(r.uid for r in got) == list(range(1500))
    used = check_places(got, 4096)
    least = packing.bound(np.array(lengths), 4096)
    assert used <= least * 1.01 + 2


def test_pack_documents(spark):
    packed = packing.pack(cases.docs(spark), PATH, keep_ids=True)
    rows = packed.collect()
    check_places(rows, packing.CAPACITY)
    want = sorted(((i, tuple([*plain_ids(t or ""), packing.END])) for i, t, *_ in cases.rows()), key=str)
    whole = {}
    for r in sorted(rows, key=lambda r: r.piece):
        assert r.start == r.piece * packing.CAPACITY and r.length == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for r in rows:
        if r.piece == 0 and r.length < packing.CAPACITY:
            whole.setdefault(str(r.doc_id), []).append(tuple(r.ids))
    long = [r for r in rows if r.doc_id == 50]
    assert tuple(x for r in sorted(long, key=lambda r: r.piece) for x in r.ids) == dict(want)[50]
    assert all(r.length == packing.CAPACITY for r in long[:-1]) or len(long) == 1
    assert sorted((k, x) for k, v in whole.items() for x in v) == sorted((str(i), x) for i, x in want if len(x) < packing.CAPACITY)
    joined = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in joined) == sum(len(x) for _, x in want) and max(len(r.ids) for r in joined) <= packing.CAPACITY
    for r in joined:
        assert [r.ids[s:][: len(dict(want)[d])] == list(dict(want)[d]) for s, d in zip(r.starts, r.doc_ids) if d not in (50, 60)].count(False) == 0


def test_awkward_tables(spark):
    assert packing.pack(cases.empty(spark), PATH).count() == 0
    clash = cases.docs(spark).selectExpr("*", "1 AS uid", "'x' AS piece", "2 AS length", "3 AS _text")
    assert packing.pack(clash, PATH).count() == packing.pack(cases.docs(spark), PATH).count()
