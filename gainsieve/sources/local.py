"""Small tables of fitted parameters, made without a Python worker or a parallelized list."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A one-partition frame from driver rows; for parameters (columns, bins, classes), not for data."""
    fields = T.StructType.fromDDL(schema)
    text = json.dumps([dict(zip(fields.names, r)) for r in rows])
    parsed = F.from_json(F.lit(text), T.ArrayType(fields))
    return spark.range(1, numPartitions=1).select(F.inline(parsed))
