import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricemesh.llm import components, simhash
from tests.llm import cases


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_fingerprints_equal_brute_force():
    for text in [*(t for _, t, *_ in cases.rows() if len(t or "") < 5000), "Ärger ÄRGER É", "A\x0bB\x0cC d", "x" * 3]:
        assert simhash.fingerprint((text or "").encode()) & (1 << 64) - 1 == slow_fingerprint(text)


@pytest.mark.parametrize("pairs,block", [(simhash.PAIRS, simhash.BLOCK), (1, 7)])
def test_links_connect_like_all_pairs(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(rng.randrange(9)):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << bit
            values.append(v)
    values = sorted({int(np.uint64(v).astype(np.int64)) for v in values})
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    frame = spark.createDataFrame([(v,) for v in values], "fp bigint")
    edges = simhash.links(frame)
    assert all(near(r.a, r.b) for r in edges.collect())
    root = {r.node: r.root for r in components.labels(edges).collect()}
    want = classes(values, near)
    assert [root.get(v, v) for v in values] == [values[w] for w in want]


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (100, 101)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.labels(chain).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.labels(chain.limit(0)).count() == 0


def test_groups_and_survivors(spark):
    got = simhash.groups(cases.docs(spark)).collect()
    assert len(got) == len(cases.rows())
    component = {r.doc_id: r.component_id for r in got}
    assert component[21] == component[22] == component[23] == 20
    assert component[40] == component[41] == component[42] == 40 and component[43] == 43
    kept = [r.doc_id for r in simhash.deduplicate(cases.docs(spark)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({r.component_id for r in got if r.component_id is not None})
    assert kept.count(None) == 1


def test_empty_table_and_clashing_columns(spark):
    assert simhash.groups(cases.empty(spark)).count() == 0 and simhash.deduplicate(cases.empty(spark)).count() == 0
    clash = cases.docs(spark).withColumns({"fp": F.lit("x"), "_row_hash": F.lit(1), "component_id": F.lit(2)})
    kept = simhash.deduplicate(clash)
    assert kept.columns == clash.columns and kept.count() == simhash.deduplicate(cases.docs(spark)).count()
