"""Small reference tables as local relations, so the optimizer knows their exact size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def inline_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A DataFrame over literal rows. An RDD-backed one would hide its size from the planner."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)
