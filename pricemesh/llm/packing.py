"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents become token ids, closed by an end id; only those longer than a sequence are cut, into full pieces and a rest.
Full pieces are sequences of their own. All others are dealt to cells of a few thousand pieces, and every cell is packed
by several islands. An island holds a population of groupings, the first from best-fit over pieces in (perturbed)
descending order. A child takes a share of the best-filled bins of one parent whole, drops from the other parent all bins
that hold a piece taken (no piece twice), and puts the pieces so displaced back by best fit; a mutation empties the
worst-filled bin and a few others first. After every epoch the best groupings migrate to the next island of the cell, as
rows of a written table. An island rests when it reaches a lower bound of its cell (sum of lengths, or the bound that
counts pieces over half a sequence).

The worst-filled bins of all cells, a sixteenth at most, are then dealt whole to fewer cells and packed again with their
old grouping among the parents, so no round is worse than the last; this ends with one cell, and at most its last
sequences stay open.

Null text counts as empty and is one end id. Rows are packed as they are: repeated rows, rows without doc_id and equal
doc_ids are pieces of their own. An empty table gives no pieces. Clashing columns do no harm, only doc_id and text are
read. Very long texts are encoded whole. Equal lengths are interchangeable; which of them goes where follows their
place in the input.
"""

from __future__ import annotations

import json
import os
import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from pricemesh import staging
from pricemesh.llm import blocks

CAPACITY, END = 4096, 1
#: Pieces of a cell; the share of a cell's bins that may be packed again is one in LOOSE.
CELL, LOOSE = 4096, 16
ISLANDS, POPULATION, ELITES, EPOCHS, CHILDREN = 3, 5, 2, 3, 16
#: Bytes of texts' chunks whose ids a worker remembers.
KNOWN_BYTES = 12 << 20
#: Bytes of texts that are encoded together.
BLOCK_BYTES = 8 << 20

#: Marks that may follow a word, and words of ASCII digits or of Latin-1 letters, in UTF-8.
_MARKS = b".,;:!?#$%&*)]}"
_WORD = re.compile(rb"[0-9]+|(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_TOKENIZERS: dict[str, _Encoder] = {}


class _Encoder:
    """Ids of texts, chunk by chunk between ASCII white space, with the ids of chunks seen before remembered.

    White space always separates tokens for the tokenizers this is meant for (white space dropped, words merged alone),
    so the ids of a text are those of its chunks end to end. A chunk of ASCII letters is one word, in lower case, whose
    last token alone carries the end-of-word mark: new ones are encoded as long lists of words by the merges alone, and
    the ids cut where words end. Where a tokenizer does not agree with that on a few words, none of this is used.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        mark = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(1 + max(words.values()), bool)
        self.ends_word[[k for token, k in words.items() if mark and token.endswith(mark)]] = True
        probe = "The QUICK brown fox JumpsOver lazydogs unwordlike qzx"
        want = self.tokenizer.encode(probe, add_special_tokens=False).ids
        found = self.merges.encode(probe.lower(), add_special_tokens=False).ids
        self.plain_words = want == found and int(self.ends_word[found].sum()) == len(probe.split())
        self.forget()

    def forget(self) -> None:
        self.codes: dict[bytes, int] = {}
        self.held = self.count = 0
        self.new_ids: list[np.ndarray] = []
        self.new_sizes: list[np.ndarray] = []
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)
        self._remember([b""], [], np.zeros(1, np.int64))  # what stands before leading white space

    def _remember(self, chunks: list[bytes], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        first = self.count
        self.codes.update(zip(chunks, range(first, first + len(chunks))))
        self.count += len(chunks)
        self.held += sum(map(len, chunks))
        self.new_ids += ids
        self.new_sizes.append(sizes)

    def _settle(self) -> None:
        """Append what was remembered to the arrays that are gathered from, at once."""
        if self.new_sizes:
            self.ids = np.concatenate([self.ids, *self.new_ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(self.new_sizes), dtype=np.int64)])
            self.new_ids, self.new_sizes = [], []

    def _words(self, tokenizer, words: list[bytes]) -> None:
        """Remember words that are one token run each: many are encoded as one text, cut again where words end."""
        lists = [words[i : i + 512] for i in range(0, len(words), 512)]
        for part, e in zip(lists, tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lists], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends_word[ids])
            if len(stops) == len(part):
                self._remember(part, [ids], np.diff(stops, prepend=-1))

    def _learn(self, chunks: list[bytes]) -> None:
        """Remember new chunks. Marks after a word are a token run of their own: word and marks are looked up alone."""
        stems = [c.rstrip(_MARKS) for c in chunks]
        split = [(c, s, c[len(s) :]) for c, s in zip(chunks, stems) if len(s) < len(c) and _WORD.fullmatch(s)]
        fresh = dict.fromkeys(c for c, s in zip(chunks, stems) if len(s) == len(c) or not _WORD.fullmatch(s))
        fresh.update(dict.fromkeys(x for _, s, tail in split for x in (s, tail) if x not in self.codes))
        if self.plain_words:
            cased = [(c, c.lower()) for c in fresh if c.isalpha()]
            self._words(self.merges, [w for w in dict.fromkeys(w for _, w in cased) if w not in self.codes])
            self.codes.update((c, self.codes[w]) for c, w in cased if c != w and w in self.codes)
            self._words(self.tokenizer, [c for c in fresh if c not in self.codes and not c.isdigit() and _WORD.fullmatch(c)])
        others = [c for c in fresh if c not in self.codes]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([c.decode() for c in others], add_special_tokens=False)]
        self._remember(others, found, np.array([len(x) for x in found], np.int64))
        if split:
            parts = np.array([[self.codes[s], self.codes[tail]] for _, s, tail in split]).ravel()
            ids, size = self._gather(parts)
            self._remember([c for c, _, _ in split], [ids], size.reshape(-1, 2).sum(axis=1))

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks with these codes end to end, and how many each has."""
        self._settle()
        first = self.ends[which]
        size = self.ends[which + 1] - first
        stop = np.cumsum(size)
        return self.ids[np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)], size

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Token ids of every text (null: none). Only the distinct chunks of a block are looked up one by one."""
        if self.held > KNOWN_BYTES:
            self.forget()
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        codes = list(map(self.codes.get, distinct))
        if None in codes:
            self._learn([c for c, k in zip(distinct, codes) if k is None])
            codes = [self.codes[c] if k is None else k for c, k in zip(distinct, codes)]
        ids, size = self._gather(np.array(codes, np.int64)[np.asarray(chunks.indices)])
        edges = np.concatenate([[0], np.cumsum(size)])[np.asarray(split.offsets)]
        return [ids[a:z] for a, z in zip(edges, edges[1:])]


def encoder(path: str) -> _Encoder:
    """The encoder of a tokenizer file, one per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Encoder(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """(doc_id, uid, piece, start, length, ids_crc32[, ids]): every document's ids and end id, cut at `capacity`.

    tokenizer is the path of a tokenizer file that every executor can read. uid numbers the pieces of this run.
    """
    schema = docs.select("doc_id").schema
    for name in ("uid", "piece", "start", "length", "ids_crc32"):
        schema = schema.add(name, T.IntegerType() if name == "piece" else T.LongType())
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in blocks.cut(batches, "_text", BLOCK_BYTES):
            of, number, ids = [], [], []
            for i, found in enumerate(encoder(tokenizer).encode(batch.column(1))):
                found = np.append(found, np.uint32(end)).astype("<u4")
                for k in range(-(-len(found) // capacity)):
                    of.append(i)
                    number.append(k)
                    ids.append(found[k * capacity : (k + 1) * capacity])
            place = np.array(number, np.int64)
            columns = [
                batch.column(0).take(pa.array(of, pa.int64())), pa.array(np.arange(uid, uid + len(of))), pa.array(place.astype(np.int32)),
                pa.array(place * capacity), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
            ]
            uid += len(of)
            if keep_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)


def bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing stays below (Martello and Toth's L2)."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    n, s = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)
    huge = n[-1] - n[capacity - a]
    large, large_sum = n[capacity - a] - n[half], s[capacity - a] - s[half]
    small = s[half] - np.where(a > 0, s[a - 1], 0)
    over = small - (large * capacity - large_sum)
    return int((huge + large + np.maximum(0, -(-over // capacity))).max())


def best_fit(lengths: list[int], order: Iterable[int], bins: np.ndarray, load: list[int], capacity: int) -> None:
    """Put the pieces of `order` into the bins they fill best, opening new ones; bins and load are changed in place."""
    free = sorted((capacity - x, b) for b, x in enumerate(load))
    for i in order:
        size = lengths[i]
        k = bisect_left(free, (size, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, len(load)
            load.append(0)
        bins[i] = b
        load[b] += size
        if room > size:
            insort(free, (room - size, b))


def _compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Smaller is better: number of bins, then minus the mean square of their fill."""
    load = np.bincount(bins, lengths)
    return len(load), -float(np.mean((load / capacity) ** 2)) if len(load) else 0.0


def crossed(one: np.ndarray, two: np.ndarray, lengths: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """A child: well-filled bins of one, what of two does not collide with them, displaced pieces by best fit."""
    load = np.bincount(one, lengths)
    ranked = np.argsort(-load, kind="stable")
    rich = ranked[: max(1, int(len(ranked) * rng.uniform(0.3, 0.9)))]
    taken = np.zeros(len(load), bool)
    taken[rich[np.array([rng.random() < 0.7 for _ in rich])]] = True
    inside = taken[one]
    other = np.bincount(two, lengths)
    gone = np.zeros(len(other), bool)
    gone[two[inside]] = True
    left = ~gone
    if left.any():  # mutation: the worst-filled bin left and a few others are emptied as well
        gone[np.flatnonzero(left)[np.argmin(other[left])]] = True
        gone[np.array([rng.randrange(len(other)) for _ in range(1 + len(other) // 50)])] = True
    kept = ~inside & ~gone[two]
    child = np.full(len(lengths), -1, np.int64)
    child[inside], child[kept] = one[inside], two[kept] + len(load)
    placed = child >= 0
    child[placed] = _compact(child[placed])
    loads = np.bincount(child[placed], lengths[placed]).astype(np.int64).tolist()
    loose = np.flatnonzero(~placed)
    order = loose[np.argsort(-lengths[loose], kind="stable")]
    best_fit(lengths.tolist(), order.tolist(), child, loads, capacity)
    return _compact(child)


def founders(lengths: np.ndarray, old: np.ndarray | None, capacity: int, rng: random.Random, size: int = POPULATION) -> list[np.ndarray]:
    """A first population: the old grouping, best fit in descending order, and the same with lengths perturbed."""
    out = [] if old is None else [_compact(old)]
    least = bound(lengths, capacity) if len(lengths) else 0
    while len(out) < size:
        noise = np.array([rng.uniform(-1, 1) for _ in range(len(lengths))]) * 0.15 * min(len(out), 1)
        bins, load = np.zeros(len(lengths), np.int64), []
        best_fit(lengths.tolist(), np.argsort(-lengths * (1 + noise), kind="stable").tolist(), bins, load, capacity)
        out.append(_compact(bins))
        if len(load) <= least:
            break
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: random.Random, children: int = CHILDREN, size: int = POPULATION) -> list[np.ndarray]:
    """The population after `children` crossings, best first; a child replaces the worst if it is better and new."""
    ranked = sorted(((fitness(b, lengths, capacity), k, b) for k, b in enumerate(population)), key=lambda x: x[:2])
    least = bound(lengths, capacity) if len(lengths) else 0
    for k in range(children):
        if ranked[0][0][0] <= least:
            break
        one, two = (min(rng.randrange(len(ranked)), rng.randrange(len(ranked))) for _ in range(2))
        child = crossed(ranked[one][2], ranked[two][2], lengths, capacity, rng)
        score = fitness(child, lengths, capacity)
        if len(ranked) < size or score < ranked[-1][0] and all(score != r[0] for r in ranked):
            ranked = sorted([*ranked, (score, len(population) + k, child)], key=lambda x: x[:2])[:size]
    return [r[2] for r in ranked]


def _epoch(islands: DataFrame, capacity: int, seed: int, epoch: int) -> DataFrame:
    """(cell, island, population): every island after an epoch, its best groupings first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                rng = random.Random(f"{seed}:{row['cell']}:{row['island']}:{epoch}")
                if row["population"] is None:
                    old = np.array(row["old"], np.int64)
                    population = founders(lengths, old if len(set(row["old"])) < len(old) else None, capacity, rng)
                else:
                    population = [np.array(x, np.int32) for x in [*row["population"], *(row["guests"] or [])]]
                population = evolve(lengths, population, capacity, rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["cell"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([population], pa.list_(pa.list_(pa.int32())))],
                    ["cell", "island", "population"],
                )

    columns = ["cell", "island", "lengths", "old", "population", "guests"]
    return islands.select(*columns).mapInArrow(run, "cell bigint, island int, population array<array<int>>")


def _packed_cells(cells: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(cell, uids, lengths, bins): the best grouping that the islands of every cell reach."""
    spread = cells.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    nothing = F.lit(None).cast("array<array<int>>")
    first = spread.withColumns({"population": nothing, "guests": nothing})
    state = staging.written(_epoch(first.repartition("cell", "island"), capacity, seed, 0), "packing-islands")
    for epoch in range(1, EPOCHS):
        elites = state.select("cell", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("population", 1, ELITES).alias("guests"))
        joined = spread.hint("merge").join(state, ["cell", "island"]).hint("merge").join(elites, ["cell", "island"])
        state = staging.written(_epoch(joined, capacity, seed, epoch), "packing-islands")
    best = F.element_at("population", 1)
    key = F.struct(F.array_max(best).alias("bins"), "island", best.alias("grouping"))
    chosen = state.groupBy("cell").agg(F.min(key).alias("best")).select("cell", F.col("best.grouping").alias("bins"))
    return cells.hint("merge").join(chosen, "cell")


def _placed(packed: DataFrame, base: int, capacity: int, again: bool) -> DataFrame:
    """(uid, length, sequence_id, offset, loose): places in every cell; loose ones are to be packed again."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, bins = np.array(row["lengths"], np.int64), np.array(row["bins"], np.int64)
                order = np.argsort(bins, kind="stable")
                stop = np.cumsum(lengths[order])
                load = np.bincount(bins, lengths).astype(np.int64)
                offset = np.empty(len(bins), np.int64)
                offset[order] = stop - lengths[order] - (np.cumsum(load) - load)[bins[order]]
                loose = np.zeros(len(load), bool)
                if again:
                    worst = np.argsort(load, kind="stable")[: -(-len(load) // LOOSE)]
                    loose[worst[load[worst] < capacity]] = True
                columns = [
                    pa.array(row["uids"], pa.int64()), pa.array(lengths), pa.array(np.int64(base + row["cell"] << 20) + bins),
                    pa.array(offset), pa.array(loose[bins]), pa.array(np.full(len(bins), row["cell"], np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "length", "sequence_id", "offset", "loose", "cell"])

    kept = packed.select("cell", "uids", "lengths", "bins")
    return kept.mapInArrow(run, "uid bigint, length bigint, sequence_id bigint, offset bigint, loose boolean, cell bigint")


def place(lengths: DataFrame, capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """(uid, sequence_id, offset) for lengths (uid, length), in as few sequences as the search finds."""
    own = lengths.where(F.col("length") == capacity).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    open_pieces = lengths.where(F.col("length") < capacity)
    rest = open_pieces.select("uid", "length", F.col("uid").alias("old"), F.col("uid").alias("deal"))
    done, base, count = own, 0, open_pieces.count()
    while count:
        cells = max(1, -(-count // CELL))
        dealt = rest.withColumn("cell", F.pmod(F.xxhash64("deal", F.lit(base)), F.lit(cells)))
        members = F.array_sort(F.collect_list(F.struct("uid", "length", "old")))
        grouped = dealt.groupBy("cell").agg(members.alias("m"))
        table = staging.written(grouped.select("cell", F.col("m.uid").alias("uids"), F.col("m.length").alias("lengths"), F.col("m.old").alias("old")), "packing-cells")
        placed = staging.written(_placed(_packed_cells(table, capacity, seed), base, capacity, cells > 1), "packing-places")
        done = done.unionByName(placed.where("NOT loose").select("uid", "sequence_id", "offset"))
        # Bins go on whole, with the others of their cell, so the old grouping is a parent of the new one.
        rest = placed.where("loose").select("uid", "length", F.col("sequence_id").alias("old"), F.col("cell").alias("deal"))
        base, count = base + cells, rest.count() if cells > 1 else 0
    return done


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    cut = staging.written(pieces(docs, tokenizer, text, capacity, end, keep_ids), "packing-pieces")
    return cut.hint("merge").join(place(cut.select("uid", "length"), capacity), "uid").drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the token sequences of pack(..., keep_ids=True), pieces in order of offset."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    rows = packed.groupBy("sequence_id").agg(ordered.alias("m"))
    return rows.select("sequence_id", F.flatten("m.ids").alias("ids"), F.col("m.doc_id").alias("doc_ids"), F.col("m.offset").alias("starts"))
