"""Tables written to the shared folder to cut lineage, removed when the session's JVM ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pricemesh.session import checkpoint_dir


def folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one; Hadoop deletes it when the driver's JVM shuts down."""
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """The rows of df, written once and read back: later plans start from the files, on any executor."""
    spark = df.sparkSession
    path = folder(spark, label)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
