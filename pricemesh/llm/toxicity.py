"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lowers case, undoes look-alike letters of other scripts, full-width forms and digit or sign substitutions
("m0r0n"), drops invisible characters and parts words at everything else. The lexicon holds word beginnings that stand
in toxic training texts far more often than in others (log-likelihood ratio), each with its log rate ratio as weight;
exception phrases, given and learned, silence the entries they cover. The weighted hits of a text, divided by its
words, pass through a logistic curve fitted on the training rows.

Training reads at most TRAIN_ROWS labelled texts (a bound, picked by hash); everything scored is scored whole. Null
text counts as empty and scores the curve's value at no hits; repeated rows score alike; without training rows of
both kinds the lexicon is empty and every score is the share of toxic training rows (0 without any).
An empty table gives no rows; clashing columns of documents are replaced, and training reads doc_id and text alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pricemesh import staging
from pricemesh.llm import blocks

TRAIN_ROWS = 20_000
#: Lengths of word beginnings that may become entries.
SHORTEST, LONGEST = 4, 9
#: An entry's least log-likelihood ratio, least log rate ratio, and least number of toxic texts that hold it.
EVIDENCE, RATIO, SUPPORT = 24.0, 1.0, 4
#: A learned exception phrase must stand in so many clean texts and be clean in nearly all.
EXCEPTION_TEXTS = 3

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l",
}
#: Digits and signs written for letters.
#: A sign counts as a letter only before one, so that a closing "!" stays what it is.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Everyday phrases in which such a word is harmless.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown", "pond scum", "soap scum")

_HIDDEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def _latin_table() -> bytes:
    out = []
    for code in range(256):
        c = chr(code).lower()
        c = SUBSTITUTES.get(c, c)
        out.append(ord(c) if c.isalnum() and ord(c) < 256 else 32)
    return bytes(out)


_LATIN = _latin_table()
_WIDE = {**{ord(k): v for k, v in LOOKALIKES.items()}, **{0xFF01 + i: chr(0x21 + i) for i in range(94)}, **_HIDDEN}
_LOOSE = re.compile(r"[!@$](?![^\W\d_])")
_OTHER = re.compile(r"[^\x00-\xff]")
_NOT_WORD = re.compile(r"[^\w]|_")


def fold(text: str) -> str:
    """The words of the text, folded, with one space before, between and after them."""
    if "!" in text or "@" in text or "$" in text:
        text = _LOOSE.sub(" ", text)
    if "\xad" in text or _OTHER.search(text):
        text = text.lower().translate(_WIDE)
    if _OTHER.search(text):
        text = _NOT_WORD.sub(" ", "".join(SUBSTITUTES.get(c, c) for c in text.lower()))
    else:
        text = text.encode("latin-1").translate(_LATIN).decode("latin-1")
    return f" {' '.join(text.split())} "


class Lexicon(NamedTuple):
    """Entries are word beginnings with their weights; exceptions are phrases of whole words; curve: offset, slope."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float]


class Matcher:
    """The automaton of a lexicon, and what it finds in a folded text."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(f" {entry}", (len(entry) + 1, weight, False))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the words that entries begin, the longest entry of each; excepted ones left out."""
        if self.empty:
            return []
        found: dict[int, tuple[int, float]] = {}
        silent: list[tuple[int, int]] = []
        for last, (length, weight, excepts) in self.automaton.iter(folded):
            start = last - length + 1
            if excepts:
                silent.append((start, last))
            else:
                found[start] = (last + 1, weight)
        return [
            (start + 1, end, weight)
            for start, (end, weight) in found.items()
            if not any(a <= start and end - 1 <= b for a, b in silent)
        ]

    def rate(self, text: str) -> float:
        """Weighted hits for each hundred words."""
        folded = fold(text)
        words = folded.count(" ") - 1
        return 100.0 * sum(w for _, _, w in self.hits(folded)) / words if words > 0 else 0.0


def feature(rate: float) -> float:
    return math.log1p(rate)


def _counted(docs: DataFrame, features) -> DataFrame:
    """For each feature how often it stands in toxic and in clean texts, and in how many of either, counted per task
    before the shuffle."""
    names = ("toxic", "clean", "toxic_texts", "clean_texts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, texts = (Counter(), Counter()), (Counter(), Counter())
        for batch in blocks.cut(batches, "text"):
            for text, toxic in zip(blocks.texts(batch.column(0)), batch.column(1).to_pylist()):
                found = features(fold(text))
                times[toxic].update(found)
                texts[toxic].update(found.keys())
        known = list(times[0].keys() | times[1].keys())
        counts = [pa.array([c[x] for x in known], pa.int64()) for c in (times[1], times[0], texts[1], texts[0])]
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.string()), *counts], ["feature", *names])

    schema = "feature string, " + ", ".join(f"{n} bigint" for n in names)
    counted = docs.select("text", "toxic").mapInArrow(run, schema)
    return counted.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def _beginnings(folded: str) -> Counter:
    """Beginnings of the distinct words; the empty one counts the words themselves."""
    words = set(folded.split())
    return Counter(w[:n] for w in words for n in (0, *range(SHORTEST, min(LONGEST, len(w)) + 1)))


def _evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> tuple[float, float]:
    """Log-likelihood ratio of the feature being more frequent among the toxic words, and its log rate ratio."""
    ratio = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    expected = (toxic + clean) * all_toxic / (all_toxic + all_clean)
    spread = [(toxic, expected), (clean, toxic + clean - expected)]
    return 2 * sum(k * math.log(k / e) for k, e in spread if k), ratio


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Logistic regression on one feature by Newton's method, slope lightly held back."""
    design = np.column_stack([np.ones_like(x), x])
    beta, hold = np.zeros(2), np.diag([1e-9, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + hold + 1e-9 * np.eye(2), design.T @ (y - p) - hold @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of docs (doc_id, text) whose labels (doc_id, toxic) are given; at most about `rows` of them."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, rows / max(total, 1)))
    # At most about `rows` pairs of numbers, a bound that does not follow the input: small enough to broadcast.
    picked = F.broadcast(known.where(part))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select("text", "toxic")
    texts = staging.written(texts, "toxicity-train")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Lexicon({}, exceptions, (30.0 if share == 1 else -30.0, 0.0))

    # Bounded by the bounded training texts; of nested beginnings the one with the most evidence,
    # and of those the longest, is the entry.
    counted = staging.written(_counted(texts, _beginnings), "toxicity-words")
    words = {r.feature: r for r in counted.where(F.col("feature") == "").collect()}[""]
    dense = F.col("toxic") * F.lit(words.clean) > F.lit(math.e) * F.col("clean") * F.lit(words.toxic)
    likely = [
        (*_evidence(r.toxic, r.clean, words.toxic, words.clean), r.feature)
        for r in counted.where((F.col("toxic_texts") >= SUPPORT) & dense & (F.col("feature") != "")).toLocalIterator()
    ]
    weights: dict[str, float] = {}
    covered: set[str] = set()
    for evidence, ratio, entry in sorted(likely, key=lambda x: (-x[0], -len(x[2]), x[2])):
        heads = {entry[:n] for n in range(SHORTEST, len(entry) + 1)}
        if evidence >= EVIDENCE and ratio >= RATIO and entry not in covered and not heads & weights.keys():
            covered |= heads
            weights[entry] = ratio

    raw = Matcher(Lexicon(weights, exceptions, (0.0, 0.0)))

    def around(folded: str) -> Counter:
        out = set()
        for start, _, _ in raw.hits(folded):
            stop = folded.index(" ", start)
            before = folded[: start - 1].rpartition(" ")[2]
            after = folded[stop + 1 :].partition(" ")[0]
            word = folded[start:stop]
            out |= {word, *([f"{before} {word}"] if before else []), *([f"{word} {after}"] if after else [])}
        return Counter(out)

    harmless = _counted(texts, around).where(
        (F.col("clean_texts") >= EXCEPTION_TEXTS) & (20 * F.col("toxic_texts") <= F.col("clean_texts"))
    )
    learned = tuple(sorted(r.feature for r in harmless.select("feature").collect()))
    matcher = Matcher(Lexicon(weights, exceptions + learned, (0.0, 0.0)))

    def rates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.cut(batches, "text"):
            x = [feature(matcher.rate(t)) for t in blocks.texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], ["x", "toxic"])

    seen = texts.mapInArrow(rates, "x double, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    x = np.repeat([r.x for r in seen], [r["count"] for r in seen])
    y = np.repeat([float(r.toxic) for r in seen], [r["count"] for r in seen])
    return Lexicon(weights, exceptions + learned, _curve(x, y))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (0 or 1) and hits: the matched words' beginnings and how often."""
    keep = [c for c in docs.columns if c not in ("score", "predicted", "hits")]
    columns = [F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_scored"), *[F.col(f"`{c}`") for c in keep]]
    source = docs.select(*columns)
    hits_type = T.ArrayType(T.StructType([T.StructField("entry", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType(
        [*source.schema.fields[1:], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", hits_type)]
    )
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    arrow_hits = pa.list_(pa.struct([("entry", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        offset, slope = shared.value.curve
        for batch in blocks.cut(batches, "_scored"):
            scores, hits = [], []
            for t in blocks.texts(batch.column(0)):
                folded = fold(t)
                words = folded.count(" ") - 1
                found = matcher.hits(folded)
                rate = 100.0 * sum(w for _, _, w in found) / words if words > 0 else 0.0
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, offset + slope * feature(rate))))))
                hits.append([{"entry": k, "n": n} for k, n in sorted(Counter(folded[a:b] for a, b, _ in found).items())])
            extra = [pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(hits, arrow_hits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *extra], [*keep, "score", "predicted", "hits"])

    return source.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold no label of which is learned; rows without id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == 0
