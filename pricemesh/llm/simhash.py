"""Near-duplicates by SimHash: fingerprints, links at a small Hamming distance, components.

Links are found through a segment-popcount embedding. A 64-bit fingerprint is cut into 32 segments of two bits;
the vector of their bit counts is the embedding, and Manhattan distance between embeddings never exceeds Hamming
distance. Two fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their halves, so their
16-dimensional half embeddings are at most 1 apart. That is a range join on a unit grid: every fingerprint stands
in its own cell and looks into the cells one step up along each axis (a step down is the other's step up).
Candidates are then compared bit by bit.

Equal fingerprints are collapsed first. A cell pair with many members is cut into blocks; each block pair is
compared with numpy in its own task and yields a spanning forest of its links, never all pairs, so the links that
connect a component stay complete while output grows with members, not with pairs.

Null text counts as empty; texts without words share fingerprint zero. Rows without doc_id, and repeated doc_ids,
are ordinary rows: each gets its own fingerprint, and a component's id is its smallest doc_id (null only where
no row of it has one). Clashing columns of the input are replaced.
Texts of any length are read whole, and an empty table has no groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pricemesh import staging
from pricemesh.llm import blocks, components, rows

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Members of one block; a cell pair with more candidate pairs than PAIRS is compared block by block.
BLOCK = 512
PAIRS = 256

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HALF = 0xFFFFFFFF
_EVEN = 0x55555555


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles (repeats included) with XXH64, ties to zero."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -SHINGLE])).tolist()
        stops = (ends[SHINGLE - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]
    raw = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for part in range(0, len(raw), 1 << 15):
        bits = np.unpackbits(raw[part : part + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(raw), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs and `fp`, the fingerprint as a signed long."""
    names = [c for c in keep if c != "fp"]
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("fp", T.LongType())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.cut(batches, "_text"):
            found = [fingerprint(x) for x in blocks.raw(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.int64())], [*names, "fp"])

    columns = [F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in names]]
    return docs.select(*columns).mapInArrow(run, schema)


def _cells(fps: DataFrame) -> DataFrame:
    """(half, cell, fp, own): the fingerprint's own cell in each half, and the cells one step up."""

    def counts(half: Column) -> Column:
        return half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(_EVEN))

    halves = fps.select(
        "fp",
        F.posexplode(
            F.array(
                counts(F.col("fp").bitwiseAND(F.lit(_HALF))), counts(F.shiftrightunsigned("fp", 32))
            )
        ).alias("half", "cell"),
    )
    upward = F.array_compact(
        F.array(
            *[
                F.when(F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << 2 * i))
                for i in range(16)
            ]
        )
    )
    here = F.array(F.struct(F.col("cell").alias("cell"), F.lit(True).alias("own")))
    above = F.transform(upward, lambda c: F.struct(c.alias("cell"), F.lit(False).alias("own")))
    return halves.select("half", "fp", F.inline(F.concat(here, above)))


def _forest(left: np.ndarray, right: np.ndarray, own: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between left and right; own left members skip themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, x in enumerate(left):
        near = right[np.bitwise_count(right ^ x) <= distance]
        if own[i]:
            near = near[near != x]
        for y in near.tolist():
            a, b = root(int(x)), root(y)
            if a != b:
                parent[a] = b
                links.append((int(x), y))
    return links


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect distinct fingerprints `fp` exactly as all pairs within `distance` bits would.

    distance is 3 at most: beyond it the two halves no longer guarantee a cell one step apart.
    """
    if distance > 3:
        raise ValueError("the two-half grid covers distances up to 3")
    cells = _cells(fps)
    crowd = cells.groupBy("half", "cell").agg(
        F.sum(F.col("own").cast("bigint")).alias("owners"), F.count("*").alias("lookers")
    )
    hot = staging.written(crowd.where(F.col("owners") * F.col("lookers") > PAIRS), "simhash-hot")
    left, right = cells.alias("l"), cells.where("own").select("half", "cell", F.col("fp").alias("b")).alias("r")
    cold = (
        left.join(right, ["half", "cell"])
        .where((F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance) & (~F.col("own") | (F.col("fp") < F.col("b"))))
        .join(hot.select("half", "cell"), ["half", "cell"], "left_anti")
        .select(F.col("fp").alias("a"), "b")
    )

    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK).cast("int")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("fp", F.lit(n)), parts(n)).cast("int")

    crowded = cells.join(hot, ["half", "cell"])
    lookers = crowded.select(
        "half", "cell", block("lookers").alias("i"), F.explode(F.sequence(F.lit(0), parts("owners") - 1)).alias("j"),
        "fp", "own", F.lit(True).alias("looks"),
    )
    owners = crowded.where("own").select(
        "half", "cell", F.explode(F.sequence(F.lit(0), parts("lookers") - 1)).alias("i"), block("owners").alias("j"),
        "fp", "own", F.lit(False).alias("looks"),
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        # Unsigned, as numpy counts the bits of a signed number's absolute value.
        fp, looks = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["looks"].to_numpy(bool)
        found = _forest(fp[looks], fp[~looks], pdf["own"].to_numpy(bool)[looks], distance)
        found = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    dense = lookers.unionByName(owners).groupBy("half", "cell", "i", "j").applyInPandas(compare, "a bigint, b bigint")
    return cold.unionByName(dense)


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_hash (of all its columns), fp, component_id.

    Component ids are the smallest doc_id reachable over links, the row's own included.
    """
    hashed = docs.withColumn("row_hash", rows.row_hash(docs))
    printed = staging.written(fingerprints(hashed, text, ("doc_id", "row_hash")), "simhash-rows")
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = links(distinct.select("fp"))
    linked = components.labels(edges)
    named = linked.join(distinct.withColumnRenamed("fp", "node"), "node")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("root_id"))
    joined = linked.join(smallest, "root").select(F.col("node").alias("fp"), "root_id")
    known = distinct.join(joined, "fp", "left").select("fp", F.coalesce("root_id", "first_id").alias("component_id"))
    # Read back from files, the lookup has an exchange of its own, so rows of a hot fingerprint can be split.
    known = staging.written(known, "simhash-known")
    return printed.join(known, "fp", "left").select("doc_id", "row_hash", "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each component: its smallest doc_id, and of rows sharing that id the smallest hash.

    Components in which no row has a doc_id keep one row for each fingerprint.
    """
    grouped = groups(docs, text)
    anonymous = F.col("component_id").isNull()
    best = grouped.groupBy("component_id", F.when(anonymous, F.col("fp")).alias("lone")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("best")
    )
    own, doc, other = rows.fresh(docs, "_row_hash", "_best_id", "_best_hash")
    chosen = staging.written(best.select(F.col("best.doc_id").alias(doc), F.col("best.row_hash").alias(other)), "simhash-kept")
    hashed = docs.withColumn(own, rows.row_hash(docs))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(other))
    return hashed.hint("merge").join(chosen, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
