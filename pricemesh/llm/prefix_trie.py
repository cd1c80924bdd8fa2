"""Prefix trie of conversations: which opening turns are shared, by how many, and what sharing them saves.

A conversation becomes the path of its turns: a running 128-bit hash names every prefix, so equal names mean equal
prefixes. Equal paths are counted first, so a group of copies of any size is one path with a weight. Paths are sorted
and cut into blocks; between sorted neighbours the length of the common prefix is an edge. Union-find takes the edges of
a block in descending depth: paths below the deeper prefix merge first, and every merge of components is a branching
node. Between branchings a component is lifted turn by turn, one node per depth.

Nodes on the first or last path of a block may go on in the next block; all others are finished there. The forest of a
block is contracted to these two paths, every node of which keeps the sums of what hangs below it, and the contracted
paths are sorted and cut into blocks again, until one block is left. Every level is a written table a few thousand times
smaller than the one before.

Null role or text counts as empty, null turns come first; ties of turn are ordered by role and a hash of the text.
Repeated rows are turns of their own. Rows without conv_id belong to no conversation and are left out. An empty table has
no nodes, not even a root. Texts of any length become a hash and a word count; of a conversation, 20 bytes a turn must
fit into a task. Only conv_id, turn, role and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pricemesh import staging
from pricemesh.llm import blocks

#: Paths of a block; turns of a block that is not the last; bytes of a piece of a list of ids.
BLOCK, BLOCK_TURNS, PIECE = 8192, 1 << 18, 1 << 16
ROOT = b"\0" * 16
_FAR = (1 << 63) - 1
#: What hangs on a path: at each depth (from 0) members, smallest member, leaves, saved words and children finished below.
_HANG = ("n", "low", "leaves", "saved", "kids")
PATH = "path array<binary>, words array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _HANG)
NODE = "id binary, depth bigint, n bigint, low bigint, kids bigint, leaves bigint, saved bigint, parent binary, parent_low bigint"


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, words): texts replaced by a hash of role and text, and their words counted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.cut(batches, "text"):
            keys, words = [], []
            for role, text in zip(blocks.raw(batch.column(2)), blocks.raw(batch.column(3))):
                keys.append(xxhash.xxh3_128_digest(len(role).to_bytes(8, "little") + role + text))
                words.append(len(text.split()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(words, pa.int64())], ["conv_id", "turn", "role", "key", "words"])

    kind = turns.schema["turn"].dataType.simpleString()
    columns = [F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("text").cast("string").alias("text")]
    read = turns.where("conv_id IS NOT NULL").select(*columns)
    return read.mapInArrow(run, f"conv_id bigint, turn {kind}, role string, key binary, words bigint")


def conversations(keys: DataFrame) -> DataFrame:
    """(conv_id, seq): the turns of every conversation in order, as an array of (key, words)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "key", "words")))
    turns = F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return keys.groupBy("conv_id").agg(turns.alias("seq"))


def with_shared_openings(seqs: DataFrame, every: int, shared: Column) -> DataFrame:
    """seqs with the first `shared` turns of each conversation taken from conversation conv_id - conv_id mod every.

    A shorter opening is taken whole, a missing one is empty; the conversation's own turns follow from number `shared` on.
    The remainder is never negative. shared is a column over conv_id.
    """
    heads = seqs.where(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("of"), F.col("seq").alias("head"))
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(every))
    joined = seqs.withColumn("of", base).hint("merge").join(heads, "of", "left").withColumn("take", shared.cast("int"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("take")), F.slice("seq", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(head, F.slice("seq", F.col("take") + 1, F.size("seq"))).alias("seq"))


def paths(seqs: DataFrame) -> DataFrame:
    """(conv_id, tail, path, words): names of all prefixes of the turns, the last of them being the path's own (tail)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, named = [], []
            for keys in batch.column(1).to_pylist():
                at, names = ROOT, []
                for key in keys:
                    at = xxhash.xxh3_128_digest(at + key)
                    names.append(at)
                tails.append(at)
                named.append(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails, pa.binary()), pa.array(named, pa.list_(pa.binary())), batch.column(2)], ["conv_id", "tail", "path", "words"]
            )

    split = seqs.select("conv_id", F.col("seq.key").alias("key"), F.col("seq.words").alias("words"))
    return split.mapInArrow(run, "conv_id bigint, tail binary, path array<binary>, words array<bigint>")


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Turns that two paths share: names differ from the first difference on, so the last equal one is found by halves."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle - 1] == b[middle - 1] else (low, middle - 1)
    return low


def _find(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def forest(block: list[list[bytes]]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The trie of sorted paths: per node its depth, a path it lies on and its parent (-1: root), and each path's last node.

    Edges between neighbours are taken in descending depth of their common prefix. A component's top is its shallowest
    node so far; tops are lifted to just below the edge and meet in one node at its depth.
    """
    depth, on, parent, same = [], [], [], []
    up, top = list(range(len(block))), []

    def node(d: int, i: int) -> int:
        depth.append(d)
        on.append(i)
        parent.append(-1)
        same.append(len(same))
        return len(depth) - 1

    def lift(t: int, d: int) -> int:
        while depth[t] > d:
            parent[t] = node(depth[t] - 1, on[t])
            t = parent[t]
        return t

    ends = [node(len(path), i) for i, path in enumerate(block)]
    top = list(ends)
    shared = [_common(block[i - 1], block[i]) for i in range(1, len(block))]
    for i in sorted(range(len(shared)), key=lambda k: -shared[k]):
        a, b, d = _find(up, i), _find(up, i + 1), shared[i]
        one = lift(top[a], d)
        other = top[b]
        if depth[other] > d:
            other = lift(other, d + 1)
            parent[other] = one
        else:  # both components already reach this depth: two nodes become one
            same[other] = one
        up[b] = a
        top[a] = one
    lift(top[_find(up, 0)], 0)
    alive = [k for k in range(len(depth)) if same[k] == k]
    number = {k: n for n, k in enumerate(alive)}
    above = [-1 if parent[k] < 0 else number[_find(same, parent[k])] for k in alive]
    return [depth[k] for k in alive], [on[k] for k in alive], above, [number[_find(same, k)] for k in ends]


def contract(block: list[dict], last: bool) -> tuple[list[tuple], list[dict]]:
    """Finished nodes of a block of sorted paths, and its first and last path with what hangs on them (none if last)."""
    depth, on, parent, ends = forest([x["path"] for x in block])
    count = len(depth)
    sums = {c: [_FAR if c == "low" else 0] * count for c in _HANG}
    for i, item in enumerate(block):
        at = ends[i]
        for d in range(len(item["path"]), -1, -1):
            for c in _HANG:
                value = item[c][d]
                sums[c][at] = min(sums[c][at], value) if c == "low" else sums[c][at] + value
            at = parent[at]
    n, low, leaves, saved, kids = (sums[c] for c in _HANG)
    spine: set[int] = set()
    if not last:
        for end in {ends[0], ends[-1]}:
            while end >= 0 and end not in spine:
                spine.add(end)
                end = parent[end]
    order = sorted(range(count), key=lambda k: -depth[k])
    for k in order:
        if k in spine:
            continue
        leaves[k] += kids[k] == 0
        words = block[on[k]]["words"][depth[k] - 1] if depth[k] else 0
        saved[k] += (n[k] - 1) * words
        p = parent[k]
        if p >= 0:
            n[p], low[p], kids[p] = n[p] + n[k], min(low[p], low[k]), kids[p] + 1
            leaves[p], saved[p] = leaves[p] + leaves[k], saved[p] + saved[k]

    def name(k: int) -> bytes:
        return block[on[k]]["path"][depth[k] - 1] if depth[k] else ROOT

    done = []
    for k in order:
        if k not in spine:
            p = parent[k]
            closed = p >= 0 and p not in spine
            done.append((name(k), depth[k], n[k], low[k], kids[k], leaves[k], saved[k], name(p) if p >= 0 else None, low[p] if closed else None))
    left, seen = [], set()
    for i in [] if last else sorted({0, len(block) - 1}):
        chain, at = [], ends[i]
        while at >= 0:
            chain.append(at)
            at = parent[at]
        chain.reverse()
        item = {"path": block[i]["path"], "words": block[i]["words"]}
        for c in _HANG:
            item[c] = [sums[c][k] if k not in seen else _FAR if c == "low" else 0 for k in chain]
        seen.update(chain)
        left.append(item)
    return done, left


def _level(items: DataFrame, last: bool) -> DataFrame:
    """Finished nodes (kind 0) and contracted paths (kind 1) of all blocks of sorted paths."""
    names = [x.split()[0] for x in PATH.split(", ")]

    def rows(block: list[dict]) -> Iterator[pa.RecordBatch]:
        done, left = contract(block, last)
        for part in range(0, len(done), 1 << 14):
            yield pa.RecordBatch.from_pylist([{"node": dict(zip(fields, x)), "item": None} for x in done[part : part + (1 << 14)]], schema=schema)
        if left:
            yield pa.RecordBatch.from_pylist([{"node": None, "item": x} for x in left], schema=schema)

    fields = [x.split()[0] for x in NODE.split(", ")]
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "array<binary>": pa.list_(pa.binary()), "array<bigint>": pa.list_(pa.int64())}
    kind = lambda text: pa.struct([(a, kinds[b]) for a, b in (x.split() for x in text.split(", "))])
    schema = pa.schema([("node", kind(NODE)), ("item", kind(PATH))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        held = 0
        for batch in batches:
            for item in batch.to_pylist():
                if not last and block and (len(block) >= BLOCK or held + len(item["path"]) > BLOCK_TURNS):
                    yield from rows(block)
                    block, held = [], 0
                block.append(item)
                held += len(item["path"]) + 1
        if block:
            yield from rows(block)

    spec = lambda text: "struct<" + ", ".join(f"{a}:{b}" for a, b in (x.split() for x in text.split(", "))) + ">"
    return items.select(*names).mapInArrow(run, f"node {spec(NODE)}, item {spec(PATH)}")


def _endings(members: DataFrame) -> DataFrame:
    """(tail, ends_sha256): hash of the ascending ids of the conversations that end in tail, comma-joined.

    Ids are sorted by range, so one tail may fill many tasks; each writes its stretch in pieces, and the pieces of a tail
    are hashed in order as a stream.
    """
    ordered = members.repartitionByRange("tail", "conv_id").sortWithinPartitions("tail", "conv_id")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tail", "first", "piece"]
        tails: list[bytes] = []
        firsts: list[int] = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for tail, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word = b"%d" % conv
                if tails and tails[-1] == tail and size < PIECE:
                    texts[-1].append(word)
                    size += len(word) + 1
                else:
                    tails.append(tail)
                    firsts.append(conv)
                    texts.append([word])
                    size = len(word)
            if len(tails) > 1:  # the last piece stays open
                yield pa.RecordBatch.from_arrays([pa.array(tails[:-1], pa.binary()), pa.array(firsts[:-1], pa.int64()), pa.array([b",".join(x) for x in texts[:-1]], pa.binary())], names)
                tails, firsts, texts = tails[-1:], firsts[-1:], texts[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(tails, pa.binary()), pa.array(firsts, pa.int64()), pa.array([b",".join(x) for x in texts], pa.binary())], names)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for tail, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if tail == now:
                    state.update(b"," + piece)
                else:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = tail, hashlib.sha256(piece)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.binary(), pa.string()))], ["tail", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["tail", "ends_sha256"])

    cut = ordered.mapInArrow(pieces, "tail binary, first bigint, piece binary")
    return cut.repartition("tail").sortWithinPartitions("tail", "first").mapInArrow(hashes, "tail binary, ends_sha256 string")


def trie(seqs: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of seqs (conv_id, seq): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and its name node_id with parent_id.

    conv_id is the smallest member; members are the conversations that begin with the node's turns. saved_tokens sums over
    the node's subtree the words of each last text, times members but one. ends_sha256 hashes the ids that end here.
    """
    own = staging.written(paths(seqs), "trie-paths")
    tails = own.groupBy("tail").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    distinct = own.select("conv_id", "path", "words").hint("merge").join(tails, "conv_id")

    def hang(end: Column, before: int = 0) -> Column:
        return F.concat(F.array_repeat(F.lit(before).cast("bigint"), F.size("path")), F.array(end.cast("bigint")))

    none = hang(F.lit(0))
    columns = [hang(F.col("copies")), hang(F.col("conv_id"), _FAR), none, none, none]
    items = staging.written(distinct.select("path", "words", *[c.alias(n) for c, n in zip(columns, _HANG)]), "trie-level")
    nodes = None
    while True:
        count = items.count()
        last = count <= BLOCK
        ranged = items.repartition(1) if last else items.repartitionByRange(-(-count // BLOCK), "path")
        level = staging.written(_level(ranged.sortWithinPartitions("path"), last), "trie-level")
        found = level.where("node IS NOT NULL").select("node.*")
        nodes = found if nodes is None else nodes.unionByName(found)
        if last:
            break
        items = level.where("item IS NOT NULL").select("item.*")
    # Parents on the edge of a block were finished later; their smallest member is looked up by name.
    open_parent = F.col("parent").isNotNull() & F.col("parent_low").isNull()
    late = nodes.where(open_parent).drop("parent_low").hint("merge")
    late = late.join(nodes.select(F.col("id").alias("parent"), F.col("low").alias("parent_low")), "parent")
    whole = nodes.where(~open_parent).unionByName(late.select(*nodes.columns))
    ended = _endings(own.select("tail", "conv_id"))
    whole = whole.hint("merge").join(ended, F.col("id") == F.col("tail"), "left")
    return whole.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.col("id").alias("node_id"), F.col("parent").alias("parent_id"),
    )
