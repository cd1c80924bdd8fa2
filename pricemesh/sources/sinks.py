"""Idempotent table writes on parquet: insert-if-absent and keyed upsert.

Tables are folders of parquet files. An upsert rewrites only the partitions the new rows
touch, reading the old rows of exactly those partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricemesh.functions.common import must, same_keys
from pricemesh.operators.cleaning import first_arrivals


def read_table(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame | None:
    """The stored table, or null where nothing has been written yet; with the columns of `like`, which a
    table that holds no rows cannot tell by itself."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or len(fs.listStatus(hadoop)) == 0:
        return None
    return (spark.read if like is None else spark.read.schema(like.schema)).parquet(path)


def absent_rows(new: DataFrame, stored: DataFrame | None, keys: list[str], where=None) -> DataFrame:
    """Rows of `new` whose key the target does not hold; rows outside `where` are never matched.

    Null keys match each other, so the anti-join uses null-safe equality.
    """
    if stored is None:
        return new
    keyed = new if where is None else new.filter(where)
    missing = keyed.alias("n").join(
        stored.select(*keys).distinct().alias("s"), same_keys("n", "s", keys), "left_anti"
    )
    return missing if where is None else missing.unionByName(new.filter(~where))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows read from files, with `_row`: a number by file and place in it, the same whenever they are read."""
    return rows.withColumn("_row", F.xxhash64("_metadata.file_path", "_metadata.row_index"))


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of a partition column as its folders name them, in order; empty where nothing has been written yet.

    A listing of one folder level: as many names as partitions (days), no file is opened.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hadoop)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}="))


def read_partitions(spark: SparkSession, path: str, column: str, values: list[str]) -> DataFrame:
    """Rows of the named partitions alone: no other folder is listed, no other file opened, not even for its schema."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/{column}={v}" for v in values])


def staged(spark: SparkSession, new: DataFrame, path: str, partition_by: list[str]) -> tuple[DataFrame, str]:
    """Write the incoming rows beside the table once, and read them back: the rows, and the folder to remove.

    This computes them a single time, cuts their lineage before the table is touched, and
    makes their partition values readable from folder names alone.
    """
    folder = f"{path}_staging/{uuid.uuid4().hex}"
    new.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(folder)
    return spark.read.schema(new.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete the files of staged rows once they are merged."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def touched(stored: DataFrame | None, new: DataFrame, column: str) -> DataFrame | None:
    """Stored rows of the partitions the new rows belong to: a static partition filter.

    The values collected are partition names (days, frequencies), never rows.
    """
    if stored is None:
        return None
    values = [r[0] for r in new.select(column).distinct().collect()]
    return stored.filter(F.col(column).isin(values))


def overwrite(rows: DataFrame, path: str, partition_by: list[str]) -> None:
    (
        rows.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def replace_partitions(spark: SparkSession, new: DataFrame, path: str, partition_by: list[str]) -> None:
    """Swap in whole partitions; new may be computed from the rows it replaces, so it is staged first."""
    beside, work = staged(spark, new, path, partition_by)
    overwrite(beside, path, partition_by)
    remove(spark, work)


def replace_from(
    spark: SparkSession, new: DataFrame, path: str, column: str, start: str, values: list[str] | None = None
) -> None:
    """Swap in all partitions from `start` on: those without new rows go. Older partitions are neither read nor written.

    new is not computed from the table itself. values names its partitions where they are known; else new is staged and
    they are read off the folders.
    """
    work = None
    if values is None:
        new, work = staged(spark, new, path, [column])
        values = partition_values(spark, work, column)
    overwrite(new, path, [column])
    for value in partition_values(spark, path, column):
        if value >= start and value not in values:
            remove(spark, f"{path}/{column}={value}")
    if work:
        remove(spark, work)


def insert_absent(
    spark: SparkSession, new: DataFrame, path: str, keys: list[str], partition_by: list[str], order: str, where=None
) -> None:
    """Append what the target lacks. Replaying the same input adds nothing."""
    beside, work = staged(spark, new, path, partition_by)
    stored = touched(read_table(spark, path, beside), beside, partition_by[0])
    keyed = numbered(beside if where is None else beside.filter(where))
    unique = first_arrivals(keyed, keys, F.col(order), number="_row").drop("copies")
    fresh = absent_rows(unique, stored, keys)
    if where is not None:
        fresh = fresh.unionByName(absent_rows(beside.filter(~where), stored, [order]))
    fresh.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)
    remove(spark, work)


def merged(new: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """New rows win over stored rows of the same key."""
    if stored is None:
        return new
    kept = stored.alias("s").join(new.select(*keys).distinct().alias("n"), same_keys("s", "n", keys), "left_anti")
    return new.unionByName(kept, allowMissingColumns=True)


def upsert(spark: SparkSession, new: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> None:
    """Keyed upsert: the touched partitions are rebuilt beside the table, then swapped in.

    The merged rows are staged too, because the overwrite replaces the files they come from.
    """
    beside, work = staged(spark, new, path, partition_by)
    stored = touched(read_table(spark, path, beside), beside, partition_by[0])
    if stored is None:
        overwrite(beside, path, partition_by)
    else:
        replace_partitions(spark, merged(beside, stored, keys), path, partition_by)
    remove(spark, work)


def require_registered(rows: DataFrame, sources: DataFrame, column: str = "source") -> DataFrame:
    """Fail the job on the first row whose source is not in the register."""
    known = sources.select(F.col("code").alias("_code"))
    out = rows.join(known, F.col(column) == F.col("_code"), "left")
    message = F.concat(F.lit("source not registered: "), F.coalesce(F.col(column), F.lit("null")))
    return must(out, F.col("_code").isNotNull(), message).drop("_code")


def append_requests(spark: SparkSession, rows: DataFrame, sources: DataFrame, path: str) -> None:
    """Append log rows that keep the fetch rules, partitioned by day."""
    broken = (
        (~F.col("robots_allowed") & ~F.col("outcome").isin("blocked_by_robots", "blocked_by_intent"))
        | (F.col("intent_denied") & (F.col("outcome") != "blocked_by_intent"))
        | (F.col("delay_applied_s") < 0)
    )
    checked = must(require_registered(rows, sources), ~F.coalesce(broken, F.lit(False)), F.concat(F.lit("log row breaks a fetch rule: "), "url"))
    day = F.col("requested_at").cast("date")
    checked.withColumn("log_date", day).hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(path)


def export_json(datasets: dict[str, DataFrame], folder: str) -> None:
    """One JSON-lines folder per result set."""
    for name, df in datasets.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
