"""Telling rows apart by content, for tables whose ids may be missing or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def row_hash(docs: DataFrame) -> Column:
    """64-bit hash of all columns of a row; maps are hashed by their JSON."""
    return F.xxhash64(
        *[
            F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`")
            for f in docs.schema.fields
        ]
    )


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of docs is called so."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def without(docs: DataFrame, unwanted: DataFrame) -> DataFrame:
    """docs minus the rows named by unwanted (doc_id, row_hash); rows equal in all columns go together.

    Always a merge join: how many rows are unwanted grows with docs, so they are never broadcast.
    """
    own, doc, other = fresh(docs, "_row_hash", "_bad_id", "_bad_hash")
    bad = unwanted.select(F.col("doc_id").alias(doc), F.col("row_hash").alias(other))
    hashed = docs.withColumn(own, row_hash(docs))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(other))
    return hashed.hint("merge").join(bad, same, "left_anti").drop(own)
