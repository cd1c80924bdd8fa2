import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pricemesh.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def chats(seed, n):
    """Conversations with shared openings, copies, prefixes of others, empty texts, nulls, ties and a very long one."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 2, 3, 5, 7])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "go on", "", None, "a b  c\td"])))
    rows += [(2000 + k, t, "user", "same old words") for k in range(40) for t in range(3)]
    rows += [(3000, t, "user", f"line {t}") for t in range(300)] + [(3001, t, "user", f"line {t}") for t in range(150)]
    rows += [(4000, None, "user", "first"), (4000, 0, "user", "second"), (4000, 0, "user", "second"), (None, 0, "user", "nobody")]
    rows += [(5003, 0, "user", "own"), (-7, 0, "user", "x " * 50000), (-7, 1, "user", "y")]
    return rows


def slow_rebuilt(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(x)] for c, x in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    return out


def slow_trie(convs):
    members = defaultdict(list)
    for c, seq in sorted(convs.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        words = len(node[-1][1].encode().split()) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in who if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(turns):
    seqs = prefix_trie.conversations(prefix_trie.turn_keys(turns))
    return prefix_trie.with_shared_openings(seqs, 20, F.crc32(F.col("conv_id").cast("string")) % 4)


def rows_of(nodes):
    return sorted((tuple(r)[:8] for r in nodes.collect()), key=str)


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 60])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = chats(4, 150)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    nodes = prefix_trie.trie(rebuilt(frame))
    assert rows_of(nodes) == slow_trie(slow_rebuilt(rows))
    assert nodes.select("node_id").distinct().count() == nodes.count()


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_contraction_over_many_levels(size):
    """Blocks of a few paths, merged level by level in plain Python, against the trie built at once."""
    rng = random.Random(size)
    convs = {c: tuple(("user", rng.choice("ab")) for _ in range(rng.randrange(6))) for c in range(60)}
    tails = defaultdict(list)
    for c, seq in convs.items():
        tails[seq].append(c)

    def item(seq, who):
        names = [repr(seq[: d + 1]).encode() for d in range(len(seq))]
        hang = {c: [0] * len(seq) + [0] for c in prefix_trie._HANG} | {"n": [0] * len(seq) + [len(who)], "low": [prefix_trie._FAR] * len(seq) + [min(who)]}
        return {"path": names, "words": [1] * len(seq), **hang}

    items, done = [item(s, w) for s, w in tails.items()], []
    for _ in range(1 if size == 1 else 9):
        items.sort(key=lambda x: x["path"])
        parts = [prefix_trie.contract(items[i : i + size], False) for i in range(0, len(items), size)]
        done += [n for p in parts for n in p[0]]
        items = [x for p in parts for x in p[1]]
    items.sort(key=lambda x: x["path"])
    done += prefix_trie.contract(items, True)[0]
    lows = {n[0]: n[3] for n in done}
    got = sorted(((n[3], n[1], lows.get(n[7]), *n[2:3], n[4], n[5], n[6]) for n in done), key=str)
    assert got == sorted((x[:7] for x in slow_trie(convs)), key=str)


def test_long_lists_of_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    rows = [(c, 0, "user", "copy") for c in range(3000)]
    nodes = prefix_trie.trie(rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert rows_of(nodes) == slow_trie(slow_rebuilt(rows))


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(rebuilt(empty)).count() == 0
    nobody = spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)
    assert prefix_trie.trie(rebuilt(nobody)).count() == 0
    rows = chats(5, 10)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS words", "2 AS seq", "3 AS path", "4 AS n", "5 AS tail")
    assert rows_of(prefix_trie.trie(rebuilt(clash))) == slow_trie(slow_rebuilt(rows))
