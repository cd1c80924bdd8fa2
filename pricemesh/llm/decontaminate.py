"""Benchmark decontamination with a distributed positional inverted index.

The index is cut into segments of a few megabytes of text. A segment is one row: for every indexed term the list
of (document, position) at which it stands, sorted, as packed arrays. Segments are built where the text is read,
written once to the shared folder and searched where they lie: postings are never shuffled, so a word that stands
in every document is no hot key. Only words that some benchmark item holds are stored; no other word can take part
in a match.

A phrase is 13 consecutive words of an item (an item of fewer words is one phrase). Its terms are ordered by their
count in the whole corpus; the list of the rarest gives the candidates, and the lists of the others, each moved by
its offset, are intersected with them from rare to frequent. Proximity matches are places where the rarest terms of
an item stand near each other in any order; of equally rare terms the first in byte order counts.

The benchmark is taken in blocks of about BLOCK_CHARS characters, equal rows once, long items in overlapping pieces of
PIECE_WORDS words, so neither the driver nor a task ever holds more of it. Blocks share an index as long as their
distinct words fit into VOCABULARY; the corpus is read once for each index, and every block searches it. Null or
wordless texts match nothing, whatever their length texts are read whole, an empty table of documents gives no rows and
an empty benchmark no matches. Repeated rows are judged one by one; items that share an item_id count once; a null
item_id is written as the empty text. Proximity of an item in pieces is that of its pieces. Clashing columns of docs do
no harm, only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pricemesh import staging
from pricemesh.llm import blocks, rows

WINDOW = 13
BLOCK_CHARS = 2_000_000
#: Distinct benchmark words of one index, and words of a piece of a long item.
VOCABULARY, PIECE_WORDS = 1 << 20, 100_000
#: A segment holds so many bytes and rows. With them 16 bits name a document and 24 a position in it; a text of more
#: bytes is a segment of its own, its only document number 0, and its positions may run on through the unused bits.
SEGMENT_BYTES, SEGMENT_ROWS = 8 << 20, 1 << 16
#: Proximity: this many of an item's rarest terms, each at most so many words from the rarest one.
NEAR_TERMS, NEAR_WORDS = 3, 20

#: Bytes of words stay (A-Z lowered); all other ASCII bytes part words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_DOC, _POS = np.uint64(40), np.uint64(24)
SEGMENT = "doc_ids array<bigint>, row_hashes array<bigint>, n_words binary, terms binary, starts binary, docs binary, positions binary"


class Phrases(NamedTuple):
    """A block of benchmark items in term ids. ids: item of each name; terms, offsets: phrases padded with -1."""

    names: list[str]
    item: np.ndarray
    terms: np.ndarray
    length: np.ndarray
    vocabulary: dict[bytes, int]
    items: list[np.ndarray]


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def phrases(
    items: Iterable[tuple[object, str | None]], window: int = WINDOW, vocabulary: dict[bytes, int] | None = None
) -> Phrases:
    """The phrases of (item_id, text) rows in the term ids of vocabulary, or of their own."""
    vocabulary = {} if vocabulary is None else vocabulary
    names: list[str] = []
    owner, grams, length, whole = [], [], [], []
    for name, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words((text or "").encode())]
        if not ids:
            continue
        names.append("" if name is None else str(name))
        whole.append(np.array(ids, np.int64))
        for k in range(max(1, len(ids) - window + 1)):
            gram = ids[k : k + window]
            owner.append(len(names) - 1)
            length.append(len(gram))
            grams.append(gram + [-1] * (window - len(gram)))
    terms = np.array(grams, np.int64).reshape(-1, window)
    return Phrases(names, np.array(owner, np.int64), terms, np.array(length, np.int64), vocabulary, whole)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], text: str = "text") -> DataFrame:
    """Index segments of docs for the words of `vocabulary`."""
    if len(vocabulary) >= 1 << 24:
        raise ValueError("an index takes fewer than 2^24 distinct words")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    wide = np.uint16 if len(vocabulary) < 1 << 16 else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in blocks.cut(batches, "_text", SEGMENT_BYTES, SEGMENT_ROWS):
            counts, found = [], []
            for x in blocks.raw(batch.column(0)):
                tokens = words(x)
                counts.append(len(tokens))
                found.append(np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens)))
            n_words = np.array(counts, np.int64)
            ids = np.concatenate(found)
            doc = np.repeat(np.arange(len(counts)), n_words)
            position = np.arange(len(ids)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
            known = np.flatnonzero(ids >= 0)
            order = known[np.argsort(ids[known].astype(wide), kind="stable")]
            terms, starts = np.unique(ids[order], return_index=True)
            packed = [
                n_words.astype("<i4"), terms.astype("<i4"), np.append(starts, len(order)).astype("<i4"),
                doc[order].astype("<u2"), position[order].astype("<i4"),
            ]
            named = [pa.array([batch.column(i).to_pylist()], pa.list_(pa.int64())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [*named, *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
                ["doc_ids", "row_hashes", "n_words", "terms", "starts", "docs", "positions"],
            )

    columns = [F.col(f"`{text}`").alias("_text"), "doc_id", rows.row_hash(docs).alias("row_hash")]
    return docs.select(*columns).mapInArrow(run, SEGMENT)


def _unpacked(batch: pa.RecordBatch, i: int) -> dict[str, np.ndarray]:
    kinds = {"n_words": "<i4", "terms": "<i4", "starts": "<i4", "docs": "<u2", "positions": "<i4"}
    names = batch.schema.names
    return {
        k: np.frombuffer(batch.column(names.index(k))[i].as_py(), kind).astype(np.int64)
        for k, kind in kinds.items()
        if k in names
    }


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): occurrences of every indexed term in the whole corpus."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpacked(batch, i)
                yield pa.RecordBatch.from_arrays([pa.array(x["terms"]), pa.array(np.diff(x["starts"]))], ["term", "n"])

    counted = index.select("terms", "starts").mapInArrow(run, "term bigint, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("n"))


def _exact(x: dict[str, np.ndarray], found: Phrases, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase, document and start of every occurrence in a segment. order: offsets of each phrase, rarest first."""
    keys = (
        np.repeat(x["terms"], np.diff(x["starts"])).astype(np.uint64) << _DOC
        | x["docs"].astype(np.uint64) << _POS
        | x["positions"].astype(np.uint64)
    )
    rarest = order[:, 0]
    first = found.terms[np.arange(len(order)), rarest]
    slot = np.searchsorted(x["terms"], first)
    slot[slot == len(x["terms"])] = 0
    there = (x["terms"][slot] == first) if len(x["terms"]) else np.zeros(len(first), bool)
    phrase = np.flatnonzero(there)
    begin = x["starts"][slot[phrase]]
    n = x["starts"][slot[phrase] + 1] - begin
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    phrase = np.repeat(phrase, n)
    doc, start = x["docs"][at], x["positions"][at] - rarest[phrase]
    alive = start >= 0
    phrase, doc, start = phrase[alive], doc[alive], start[alive]
    for k in range(1, order.shape[1]):
        offset = order[phrase, k]
        checked = offset < found.length[phrase]
        term = np.where(checked, found.terms[phrase, offset], 0)
        want = term.astype(np.uint64) << _DOC | doc.astype(np.uint64) << _POS | (start + offset).astype(np.uint64)
        spot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        alive = ~checked | (keys[spot] == want) if len(keys) else ~checked
        phrase, doc, start = phrase[alive], doc[alive], start[alive]
        if not len(phrase):
            break
    return phrase, doc, start


def _near(x: dict[str, np.ndarray], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, document and position of the rarest term wherever all rare terms of an item stand close by."""
    place = x["docs"] << 32 | x["positions"]
    at = {int(t): place[a:b] for t, a, b in zip(x["terms"], x["starts"], x["starts"][1:])}
    present = np.isin(rare, x["terms"]) | (rare < 0)
    item, spots = [], []
    for i in np.flatnonzero(present.all(axis=1) & (rare[:, 1] >= 0)):
        mine = at[int(rare[i, 0])]
        for t in rare[i, 1:]:
            if t >= 0 and len(mine):
                other = at[int(t)]
                k = np.searchsorted(other, mine - NEAR_WORDS)
                mine = mine[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= mine + NEAR_WORDS)]
        item.append(np.full(len(mine), i))
        spots.append(mine)
    items = np.concatenate(item) if item else np.zeros(0, np.int64)
    places = np.concatenate(spots) if spots else np.zeros(0, np.int64)
    return items, places >> 32, places & 0xFFFFFFFF


STRETCH = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("item_id", pa.string())]))
CLOSE = pa.list_(pa.struct([("at", pa.int64()), ("item_id", pa.string())]))
MATCHES = (
    "doc_id bigint, row_hash bigint, n_words bigint, phrases array<struct<start:bigint,stop:bigint,item_id:string>>, "
    "near array<struct<at:bigint,item_id:string>>"
)


def search(index: DataFrame, found: Phrases, counts: dict[int, int]) -> DataFrame:
    """One row per indexed row: its words, the stretches that phrases of an item cover, and proximity matches."""
    weight = np.array([counts.get(t, 0) for t in range(len(found.vocabulary))] + [np.iinfo(np.int64).max], np.int64)
    order = np.argsort(weight[found.terms], axis=1, kind="stable") if len(found.terms) else found.terms
    spelling = np.argsort(np.argsort(np.array(list(found.vocabulary), object))) if found.vocabulary else np.zeros(0, np.int64)
    rare = np.full((len(found.items), NEAR_TERMS), -1, np.int64)
    for i, ids in enumerate(found.items):
        distinct = np.unique(ids)
        best = distinct[np.lexsort((spelling[distinct], weight[distinct]))][:NEAR_TERMS]
        rare[i, : len(best)] = best
    shared = index.sparkSession.sparkContext.broadcast((found._replace(vocabulary={}), order, rare))
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, order, rare = shared.value
        distinct, naming = np.unique(np.array(found.names, object), return_inverse=True)
        for batch in batches:
            for i in range(batch.num_rows):
                x = _unpacked(batch, i)
                phrase, doc, start = _exact(x, found, order) if len(order) else (np.zeros(0, np.int64),) * 3
                named_as = naming[found.item[phrase]]
                stretches: dict[int, list] = {}
                # Rows that share a name interleave: only in order of start per name is a merge a union.
                for k in np.lexsort((start, named_as, doc)):
                    mine = stretches.setdefault(int(doc[k]), [])
                    name, a, b = str(distinct[named_as[k]]), int(start[k]), int(start[k] + found.length[phrase[k]])
                    if mine and mine[-1]["item_id"] == name and a <= mine[-1]["stop"]:
                        mine[-1]["stop"] = max(b, mine[-1]["stop"])
                    else:
                        mine.append({"start": a, "stop": b, "item_id": name})
                close: dict[int, list] = {}
                for it, d, p in zip(*_near(x, rare)):
                    close.setdefault(int(d), []).append({"at": int(p), "item_id": found.names[it]})
                n = range(len(x["n_words"]))
                named = [pa.array(batch.column(k)[i].as_py(), pa.int64()) for k in (0, 1)]
                lists = [pa.array([stretches.get(d, []) for d in n], STRETCH), pa.array([close.get(d, []) for d in n], CLOSE)]
                yield pa.RecordBatch.from_arrays(
                    [*named, pa.array(x["n_words"]), *lists], ["doc_id", "row_hash", "n_words", "phrases", "near"]
                )

    return index.mapInArrow(run, MATCHES)


def _covered(stretches: Column) -> Column:
    """Words inside the union of the stretches, which come in order of their start."""
    start = F.struct(F.lit(0).cast("bigint").alias("stop"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(
        stretches,
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["stop"], s["stop"]).alias("stop"),
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["stop"], s["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (item_id, text); a text of more than PIECE_WORDS words in pieces that overlap by a phrase less a word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, texts = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                split = words((body or "").encode()) if len(body or "") > PIECE_WORDS else []
                for k in range(0, max(1, len(split) - window + 1), PIECE_WORDS):
                    of.append(i)
                    texts.append(b" ".join(split[k : k + PIECE_WORDS + window - 1]).decode() if len(split) > PIECE_WORDS else body)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(texts, pa.string())], ["item_id", "text"])

    distinct = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    return distinct.mapInArrow(run, distinct.schema)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, row_hash, n_words, n_hit, items, phrases, near.

    benchmark has item_id and text. A word is hit if any occurrence of a phrase covers it; items are the sorted
    ids of the items with occurring phrases.
    """
    items = staging.written(_pieces(benchmark, window), "benchmark")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-size // BLOCK_CHARS) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))

    def block(k: int) -> list[tuple[object, str | None]]:
        return [(r.item_id, r.text) for r in items.where(part == k).collect()]

    found, k = [], 0
    while k < parts:
        # As many blocks as share an index: their words are gathered first, their phrases when they are searched.
        vocabulary, last = {}, k
        while last < parts:
            wider = dict(vocabulary)
            for _, body in block(last):
                for w in words((body or "").encode()):
                    wider.setdefault(w, len(wider))
            if last > k and len(wider) > VOCABULARY:
                break
            vocabulary, last = wider, last + 1
        index = staging.written(build_index(docs, vocabulary, text), "postings")
        counts = {r.term: r.n for r in term_counts(index).collect()}  # one row per word of the vocabulary at most
        found += [search(index, phrases(block(i), window, vocabulary), counts) for i in range(k, last)]
        k = last
    total = found[0]
    if parts > 1:
        more = found[1]
        for other in found[2:]:
            more = more.unionByName(other)
        # Rows equal in id and content match alike: a block's answer for one of them holds for all.
        more = more.where((F.size("phrases") > 0) | (F.size("near") > 0)).distinct()
        more = more.groupBy(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).agg(
            F.flatten(F.collect_list("phrases")).alias("_phrases"), F.flatten(F.collect_list("near")).alias("_near")
        )
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))
        none = F.array()
        total = total.join(more, same, "left").select(
            "doc_id", "row_hash", "n_words",
            F.concat("phrases", F.coalesce("_phrases", none)).alias("phrases"),
            F.concat("near", F.coalesce("_near", none)).alias("near"),
        )
    ordered = total.withColumn("phrases", F.array_sort("phrases"))
    items = F.array_sort(F.array_distinct(F.transform("phrases", lambda p: p["item_id"])))
    return ordered.select("doc_id", "row_hash", "n_words", _covered(F.col("phrases")).alias("n_hit"), items.alias("items"), "phrases", "near")


def contaminated() -> Column:
    """At least one word in twenty, and one at all, stands in a phrase of the benchmark."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without its contaminated rows."""
    bad = matches(docs, benchmark, text).where(contaminated()).select("doc_id", "row_hash").distinct()
    return rows.without(docs, staging.written(bad, "contaminated"))
