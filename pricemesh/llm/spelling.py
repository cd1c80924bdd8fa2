"""Spelling variants: words one letter apart, each hung below its most frequent neighbour.

A word is described by its frequency vector, the counts of its letters in groups. One inserted, deleted or replaced
letter changes that vector by a surplus of at most one and a deficit of at most one, so near words are found in a trie
whose levels are successive group counts. The upper levels are coarse groups that cover the alphabet: their counts name
a shard, and every word is sent to its own shard and to those that one deleted letter (a deficit of one) or one replaced
letter (a surplus and a deficit of one) lead to; of two shards that a replacement links only one looks into the other,
so every pair is met once. The lower levels are the counts of single letters. Inside a shard, words looking and words
looked at descend together, depth first, spending what is left of the two budgets; small subtries are compared by the
bits of their vectors, and the pairs left are verified letter by letter, all in numpy.

A crowded shard is cut into blocks of words looking and words looked at, every pair of blocks a task of its own, so
tasks stay bounded while all pairs are met. Tasks return one row per word, shard and block: number of near words and the
best of them, never the pairs.

Words are maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. Null texts have no words, a
null doc_id is written as the empty text, repeated rows count as often as they occur, and very long texts and words are
taken whole. An empty table gives no words. Only the columns doc_id and text are read, so others may have any name. Ties
of frequency go to the smaller word in code-point order.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pricemesh import staging
from pricemesh.llm import blocks

LEAST_LETTERS, LEAST_COUNT, FACTOR = 5, 3, 2
#: Letters of the coarse groups, about equally frequent in European languages; all others fall into the last one.
COARSE = ("eq", "ajknz", "ilmx", "obrsv")
#: Pairs compared at once in a subtrie, and rows of a shard beyond which it is cut into blocks.
LEAF, BLOCK = 1 << 14, 1 << 15
#: Words counted in a task before they are handed on, and rows of whole shards searched together.
HELD, BUNCH = 300_000, 1 << 16

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))
_FOLD = bytes(x + 32 if 65 <= x < 91 else x if x in _LETTERS else 32 for x in range(256))
_SHARD = np.full(256, len(COARSE), np.int64)
for _k, _group in enumerate(COARSE):
    _SHARD[list(_group.encode())] = _k
#: Fine groups: the letters a-z, and all others together; the order of levels is that of _LEVELS.
_FINE = np.full(256, 26, np.int64)
_FINE[97:123] = np.arange(26)
_LEVELS = [ord(x) - 97 for x in "etaoinshrdlucmfwygpbvkxqjz"] + [26]
_RARE = [ord(x) - 97 for x in "qxzjwk"]
_COMMON = [x for x in _LEVELS if x not in _RARE]
#: Roles of a row in a shard.
ELSEWHERE, HOME, LOOKS, SEEN = range(4)


def runs(text: str) -> list[bytes]:
    """The lower-cased letter runs of a text, in Latin-1 (other code points separate words)."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def vocabulary(docs: DataFrame, text: str = "text", least_letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n): words of at least least_letters letters that occur at least `least` times in all texts.

    typo_every spoils words on purpose, for trials: where it divides h = crc32("<doc_id>:<word>"), the word loses its
    letter number h % length in that document.
    """

    def table(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if n and len(w) >= least_letters]
        words = [w.decode("latin-1") for w, _ in kept]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        crc = zlib.crc32
        for batch in blocks.cut(batches, "_text"):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not body:
                    continue
                words = runs(body)
                counts.update(words)
                if typo_every:
                    start = crc(f"{key}:".encode())
                    for w in [w for w in set(words) if crc(w if w.isascii() else _utf8(w), start) % typo_every == 0]:
                        at = crc(_utf8(w), start) % len(w)
                        n = words.count(w)
                        counts[w] -= n
                        counts[w[:at] + w[at + 1 :]] += n
            if len(counts) >= HELD:
                yield table(counts)
                counts = Counter()
        yield table(counts)

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key")
    counted = docs.select(key, F.col(f"`{text}`").alias("_text")).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All letters end to end, and the word each belongs to."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), sizes)


def _counts(words: list[bytes], group: np.ndarray, n: int) -> np.ndarray:
    """Per word how many letters fall into each of n groups."""
    letters, of = _joined(words)
    return np.bincount(of * n + group[letters], minlength=n * len(words)).reshape(-1, n)


def _shards(counts: np.ndarray) -> np.ndarray:
    """One number per row of coarse counts: their digits to the base 4096, or a negative hash for words beyond it."""
    place = np.int64(1) << 12 * np.arange(counts.shape[1], dtype=np.int64)
    out = (counts * place).sum(axis=1)
    for i in np.flatnonzero(counts.sum(axis=1) > 4095):
        out[i] = xxhash.xxh64_intdigest(counts[i].astype("<i8").tobytes()) // 2 - (1 << 63)
    return out


def _ways(words: DataFrame) -> DataFrame:
    """(shard, own, word, n): every word in its own shard and as one that looks into those a deletion or replacement leads to."""
    k = len(COARSE) + 1
    one = np.eye(k, dtype=np.int64)
    steps = [0 * one[0], *-one, *[one[g] - one[h] for g in range(k) for h in range(g + 1, k)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.cut(batches, "word"):
            counts = _counts([w.encode("latin-1") for w in batch.column(0).to_pylist()], _SHARD, k)
            for s, step in enumerate(steps):
                moved = counts + step
                at = np.flatnonzero((moved >= 0).all(axis=1))
                taken = pa.array(at)
                columns = [pa.array(_shards(moved[at])), pa.array(np.full(len(at), s == 0)), *[c.take(taken) for c in batch.columns]]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "own", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "shard bigint, own boolean, word string, n bigint")


def _bits(counts: np.ndarray) -> np.ndarray:
    """Frequency vectors as bit sets, count c of a group as c ones (three at most); rare letters share a group."""
    columns = [*counts[:, _COMMON[:20]].T, counts[:, _RARE + _COMMON[20:]].sum(axis=1)]
    out = np.zeros(len(counts), np.uint64)
    for k, column in enumerate(columns):
        for step in range(3):
            out |= (column > step).astype(np.uint64) << np.uint64(3 * k + step)
    return out


class _Side:
    """Words of one length: row numbers, letters, bit sets and, in the order of the trie, counts by level."""

    def __init__(self, rows: np.ndarray, words: list[bytes], counts: np.ndarray, bits: np.ndarray, deep: bool):
        if deep:
            rows = rows[np.lexsort(counts[rows][:, _LEVELS[::-1]].T)]
            self.levels = np.ascontiguousarray(counts[rows][:, _LEVELS].T.astype(np.int64))
        self.rows, self.bits = rows, bits[rows]
        self.letters = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(len(rows), -1)


def _search(look: _Side, there: _Side, surplus: int, deficit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first descent of both tries: (rows of look, rows of there) whose vectors fit the budgets, by small subtries."""
    stack = [(0, 0, len(look.rows), 0, len(there.rows), surplus, deficit)]
    budget = surplus + deficit
    while stack:
        level, a, z, b, y, more, less = stack.pop()
        if (z - a) * (y - b) <= LEAF or level == len(_LEVELS):
            wide = max(1, LEAF // (y - b))
            for part in range(a, z, wide):
                near = np.bitwise_count(look.bits[part : min(part + wide, z), None] ^ there.bits[None, b:y]) <= budget
                i, j = np.nonzero(near)
                if len(i):
                    yield i + part, j + b
            continue
        mine, other = look.levels[level, a:z], there.levels[level, b:y]
        span = range(int(max(mine[0], other[0] - 1)), int(min(mine[-1], other[-1] + 1)) + 1)
        cut = np.searchsorted(mine, [span.start, *[x + 1 for x in span]]) + a
        first = span.start - 1
        edge = np.searchsorted(other, range(first, span.stop + 2)) + b
        for k, x in enumerate(span):
            if cut[k] == cut[k + 1]:
                continue
            for value in (x - 1, x, x + 1):
                left, right = more - (value < x), less - (value > x)
                lo, hi = edge[value - first], edge[value - first + 1]
                if left >= 0 and right >= 0 and lo < hi:
                    stack.append((level + 1, int(cut[k]), int(cut[k + 1]), int(lo), int(hi), left, right))


def _one_apart(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Rows whose words differ by exactly one replaced letter (equal length), or by one letter more in long."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (long != short).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(long[:, :n] == short, axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= n


def near_in_shard(words: list[bytes], kind: np.ndarray, counts: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) row numbers of all near pairs of a shard, where a looks and b is looked at; rows are in order of words.

    kind: ELSEWHERE looks from another shard; HOME looks and is looked at; LOOKS and SEEN are the two roles of a home
    word of a crowded shard. All words looked at have one length. Of two home words the smaller looks.
    """
    home = np.flatnonzero((kind == HOME) | (kind == SEEN))
    found = []
    if len(home):
        size = len(words[home[0]])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for length, surplus, deficit in ((size, 1, 1), (size + 1, 1, 0)):
            rows = np.flatnonzero((sizes == length) & (kind != SEEN))
            if not len(rows):
                continue
            deep = len(rows) * len(home) > LEAF
            look, there = (_Side(x, words, counts, bits, deep) for x in (rows, home))
            for i, j in _search(look, there, surplus, deficit):
                once = (kind[look.rows[i]] == ELSEWHERE) | (look.rows[i] < there.rows[j])
                i, j = i[once], j[once]
                good = _one_apart(look.letters[i], there.letters[j])
                found.append((look.rows[i[good]], there.rows[j[good]]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *[x[0] for x in found]]), np.concatenate([none, *[x[1] for x in found]])


def _best(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row with near words: its number, how many there are and the best (largest n, then smallest row number)."""
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((two, -n[two], one))
    one, two = one[order], two[order]
    start = _edges(one)
    return one[start], np.diff(np.append(start, len(one))), two[start]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where rows that agree in all columns begin."""
    change = np.zeros(len(columns[0]) - 1, bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    return np.flatnonzero(np.append(True, change))


def _searched(table: pa.Table) -> pa.RecordBatch:
    """One row per word and shard of a table of whole shards (shard, i, j, kind, word, n)."""
    shard, i, j, kind, n = (np.asarray(table.column(c)) for c in ("shard", "i", "j", "kind", "n"))
    text = table.column("word").combine_chunks()
    words = [w.encode("latin-1") for w in text.to_pylist()]
    counts = np.minimum(_counts(words, _FINE, 27), 255).astype(np.uint8)
    bits = _bits(counts)
    edges = [*_edges(shard, i, j).tolist(), len(words)]
    out: list[list[np.ndarray]] = [[], [], []]
    for a, z in zip(edges, edges[1:]):
        one, two = near_in_shard(words[a:z], kind[a:z], counts[a:z], bits[a:z])
        if len(one):
            row, count, best = _best(n[a:z], one, two)
            for part, x in zip(out, (row + a, count, best + a)):
                part.append(x)
    row, count, best = (np.concatenate([np.empty(0, np.int64), *x]) for x in out)
    columns = [text.take(pa.array(row)), pa.array(count), text.take(pa.array(best)), pa.array(n[best])]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best", "best_n"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) for every word of words (word, n) that has a near word; words are distinct."""
    ways = _ways(words)
    sizes = ways.groupBy("shard").agg(F.sum(F.col("own").cast("bigint")).alias("owners"), F.count("*").alias("rows"))
    crowded = sizes.where((F.col("owners") > 0) & (F.col("rows") > BLOCK))
    parts = [F.ceil(F.col(c) / BLOCK).cast("int").alias(p) for c, p in (("owners", "columns"), ("rows", "lines"))]
    crowded = staging.written(crowded.select("shard", *parts), "spelling-crowded")
    placed = ways.join(crowded, "shard", "left")
    cut = F.col("lines").isNotNull()

    def part(count: str) -> Column:
        return F.pmod(F.xxhash64("word", F.lit(count)), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1)

    def role(i: Column, j: Column, kind: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), kind.alias("kind"))

    # A word of a crowded shard looks in one row of blocks and, at home, is looked at in one column of them.
    looks = F.transform(every("columns"), lambda j: role(part("lines"), j, F.when(F.col("own"), LOOKS).otherwise(ELSEWHERE)))
    seen = F.transform(every("lines"), lambda i: role(i, part("columns"), F.lit(SEEN)))
    alone = F.array(role(F.lit(0), F.lit(0), F.when(F.col("own"), HOME).otherwise(ELSEWHERE)))
    roles = F.when(~cut, alone).when(F.col("own"), F.concat(looks, seen)).otherwise(looks)
    dealt = placed.select("shard", F.inline(roles), "word", "n").repartition("shard", "i", "j")
    dealt = dealt.sortWithinPartitions("shard", "i", "j", "word")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < BUNCH:
                continue
            table = pa.Table.from_batches(held)
            stop = int(_edges(*[np.asarray(table.column(c)) for c in ("shard", "i", "j")])[-1])
            if stop:
                yield _searched(table.slice(0, stop))
            held = table.slice(stop).to_batches()
        if sum(x.num_rows for x in held):
            yield _searched(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, "word string, n_near bigint, best string, best_n bigint")
    merged = found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    )
    return merged.select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word reached by following forms, found by doubling the steps.

    A form is at least FACTOR times as frequent as its word, so chains are short and end. Every round is a written table.
    """
    now = staging.written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.hint("merge").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        now = staging.written(moved, "spelling-roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for words (word, n): form is the near word of largest n if that is at least
    factor times n, root the last word reached by following forms (the word itself if it has none)."""
    words = staging.written(words.select("word", "n"), "spelling-words")
    near = neighbours(words)
    joined = words.hint("merge").join(near, "word", "left")
    chosen = F.col("best_n") >= factor * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, F.col("best")).alias("form"), F.when(chosen, F.col("best_n")).alias("form_n")
    )
    formed = staging.written(formed, "spelling-forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.hint("merge").join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
