"""Line dedup: repeated runs of lines found with a suffix array over line ids, later copies deleted.

Texts are sequences of lines with at least one word. Suffixes are ranked by distributed prefix doubling: the rank of
the first 2k lines of a suffix is the rank of the pair (rank of its first k, rank of the k after them), ranks being
places in a range-partitioned sort of the distinct pairs. Suffixes whose rank nobody shares have no copy of that length
and leave, so after the first round only repeated lines are carried.

A run counts from MIN_WORDS words on. The suffixes that share the lines a run needs for that many words form one
interval of the suffix array (their common prefix reaches that far); its name is the pair of ranks of the two
power-of-two pieces that cover the run from either end. The first member of an interval, by doc_id and place, is
the copy that stays. Every maximal repeated run is the union of such shortest runs taken forward from each of its lines
and backward from its last one, so together they delete exactly the later copies of all maximal runs.

As every line has a word, no shortest run is longer than MIN_WORDS lines and doubling ends there. Null text counts as
empty. Rows equal in all columns are one document here: they stay alike. Rows without doc_id come last. Blank lines
between deleted lines go with them; texts with nothing deleted stay byte for byte. Clashing columns are replaced.
Texts of any length are read whole, and an empty table has no copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pricemesh import staging
from pricemesh.llm import blocks, rows

MIN_WORDS = 50
_LAST = (1 << 63) - 1
LINES = "doc bigint, row_hash bigint, pos int, line int, key binary, ahead int, behind int"
ROW = ["doc", "row_hash"]


def _shortest(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest run of `least` words that starts, and that ends, at every line; 0 if there is none."""
    total = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(words))
    stop = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(stop <= len(words), stop - at, 0), np.where(start >= 0, at + 1 - start, 0)


def lines(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """One row per line with a word: place among those (pos) and among all lines, content key, shortest runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.cut(batches, "_text"):
            doc, place, number, keys, ahead, behind = [], [], [], [], [], []
            for k, body in enumerate(blocks.raw(batch.column(0))):
                split = [(i, x.strip(), len(x.split())) for i, x in enumerate(body.split(b"\n"))]
                split = [x for x in split if x[2]]
                if not split:
                    continue
                forward, backward = _shortest(np.array([x[2] for x in split]), least)
                doc.append(np.full(len(split), k))
                place.append(np.arange(len(split)))
                number += [x[0] for x in split]
                keys += [xxhash.xxh3_128_digest(x[1]) for x in split]
                ahead.append(forward)
                behind.append(backward)
            if not doc:
                continue
            of = pa.array(np.concatenate(doc))
            small = [pa.array(np.concatenate(x).astype(np.int32)) for x in (place, ahead, behind)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(of), batch.column(2).take(of), small[0], pa.array(number, pa.int32()), pa.array(keys, pa.binary()), small[1], small[2]],
                ["doc", "row_hash", "pos", "line", "key", "ahead", "behind"],
            )

    doc = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("doc")
    return docs.select(F.col(f"`{text}`").alias("_text"), doc, rows.row_hash(docs).alias("row_hash")).mapInArrow(run, LINES)


def ranked(names: DataFrame, by: list[str]) -> DataFrame:
    """names (distinct) with rank: larger for larger names, one task per range of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(place, place + batch.num_rows))], [*by, "rank"])
            place += batch.num_rows

    sorted_names = names.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = ", ".join(f"{n} {t}" for n, t in sorted_names.dtypes) + ", rank bigint"
    return staging.written(sorted_names.mapInArrow(run, schema), "line-ranks")


def _repeated(suffixes: DataFrame, by: list[str]) -> DataFrame:
    return suffixes.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def _same_row(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc") == F.col(f"{b}.doc")) & (F.col(f"{a}.row_hash") == F.col(f"{b}.row_hash"))


def copies(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc, row_hash, start, stop, first, last): places and line numbers that repeat an earlier run of `least` words or more."""
    all_lines = staging.written(lines(docs, text, least), "lines")
    names = ranked(_repeated(all_lines, ["key"]), ["key"])
    tied = all_lines.join(names, "key").drop("key").dropDuplicates([*ROW, "pos"])
    tied = staging.written(tied, "suffixes")
    runs = tied.select(
        *ROW,
        F.explode(
            F.array(
                F.struct(F.col("pos").alias("start"), F.col("ahead").alias("size")),
                F.struct((F.col("pos") - F.col("behind") + 1).alias("start"), F.col("behind").alias("size")),
            )
        ).alias("run"),
    ).select(*ROW, "run.*").where("size > 0").distinct()
    # Runs are no longer than `least` lines, so few rounds are needed; each starts from the last one's written ranks.
    longest = runs.agg(F.max("size")).first()[0] or 0
    suffixes, found, k = tied.select(*ROW, "pos", "rank"), None, 0
    while 1 << k <= longest:
        covers = runs.where((F.col("size") >= 1 << k) & (F.col("size") < 2 << k)).alias("w")
        head = suffixes.select(*ROW, "pos", F.col("rank").alias("head")).alias("h")
        tail = suffixes.select(*ROW, "pos", F.col("rank").alias("tail")).alias("t")
        named = (
            covers.join(head, _same_row("w", "h") & (F.col("w.start") == F.col("h.pos")))
            .join(tail, _same_row("w", "t") & (F.col("w.start") + F.col("w.size") - (1 << k) == F.col("t.pos")))
            .select("w.doc", "w.row_hash", "start", "size", "head", "tail")
        )
        found = named if found is None else found.unionByName(named)
        k += 1
        if 1 << k <= longest:
            suffixes = _doubled(suffixes, 1 << k - 1)
    empty = tied.select(*ROW, *[F.col(c).alias(n) for n, c in zip(("start", "stop", "first", "last"), ("pos", "pos", "line", "line"))]).where("false")
    return empty if found is None else _later(found, tied)


def _doubled(suffixes: DataFrame, length: int) -> DataFrame:
    """Ranks of twice `length` lines for the suffixes that share them with another; the others leave."""
    after = suffixes.select(*ROW, (F.col("pos") - length).alias("pos"), F.col("rank").alias("two"))
    pairs = suffixes.withColumnRenamed("rank", "one").join(after, [*ROW, "pos"])
    names = ranked(_repeated(pairs, ["one", "two"]), ["one", "two"])
    return staging.written(pairs.join(names, ["one", "two"]).select(*ROW, "pos", "rank"), "suffixes")


def _later(found: DataFrame, tied: DataFrame) -> DataFrame:
    """Line numbers of all members but the first of every interval with two or more."""
    found = staging.written(found, "runs")
    interval = ["size", "head", "tail"]
    first = found.groupBy(*interval).agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "row_hash", "start")).alias("keep")
    )
    first = staging.written(first.where("n > 1").select(*interval, "keep"), "first-runs")
    later = found.join(first, interval).where(F.struct("doc", "row_hash", "start") != F.col("keep"))
    at = tied.select(*ROW, "pos", "line")
    begin = at.select(*ROW, F.col("pos").alias("start"), F.col("line").alias("first"))
    end = at.select(*ROW, F.col("pos").alias("stop"), F.col("line").alias("last"))
    spans = later.select(*ROW, "start", (F.col("start") + F.col("size") - 1).alias("stop")).distinct()
    return spans.join(begin, [*ROW, "start"]).join(end, [*ROW, "stop"]).select(*ROW, "start", "stop", "first", "last")


def stretches(spans: DataFrame) -> DataFrame:
    """Disjoint stretches per row of docs, as an array cuts of line numbers (first, last): spans that overlap or follow
    one another are joined, with the blank lines between them."""
    by_row = W.partitionBy(*ROW).orderBy("start", "stop")
    reach = F.max("stop").over(by_row.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    numbered = fresh.withColumn("island", F.sum("fresh").over(by_row.rowsBetween(W.unboundedPreceding, 0)))
    islands = numbered.groupBy(*ROW, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return islands.groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cuts"))


def deduplicate(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs cut out of the text, and n_lines_cut; n_chars follows if it is there."""
    doc, own, of, other, spans, new = rows.fresh(docs, "_doc", "_row_hash", "_of", "_hash", "_cuts", "_text")
    cuts = staging.written(stretches(copies(docs, text, least)), "line-cuts")
    cuts = cuts.select(F.col("doc").alias(of), F.col("row_hash").alias(other), F.col("cuts").alias(spans))
    keep = [c for c in docs.columns if c != "n_lines_cut"]
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias(doc),
        rows.row_hash(docs).alias(own),
    )
    # The cuts grow with docs, so they are never broadcast.
    joined = keyed.hint("merge").join(cuts, (F.col(doc) == F.col(of)) & (F.col(own) == F.col(other)), "left")
    split = F.split(F.col(f"`{text}`"), "\n")
    left = F.filter(split, lambda x, i: ~F.exists(spans, lambda c: (i >= c["first"]) & (i <= c["last"])))
    cut = F.col(spans).isNotNull()
    shortened = joined.withColumns(
        {
            new: F.when(cut, F.array_join(left, "\n")).otherwise(F.col(f"`{text}`")),
            "n_lines_cut": F.when(cut, F.aggregate(spans, F.lit(0), lambda n, c: n + c["last"] - c["first"] + 1)).otherwise(0).cast("bigint"),
        }
    )
    changed = {text: F.col(new)}
    if "n_chars" in keep:
        changed["n_chars"] = F.when(cut, F.length(new)).otherwise(F.col("n_chars"))
    columns = [changed[c].cast(docs.schema[c].dataType).alias(c) if c in changed else F.col(f"`{c}`") for c in keep]
    return shortened.select(*columns, "n_lines_cut")
