"""Fitted models on streams.

Every fitted model of the package (fill, bounds, scalers, linear maps, expressions) is a
stateless projection, so it applies to a stream as it does to a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabwright.session import new_path


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def apply_stream(stream: DataFrame, steps: list[Callable[[DataFrame], DataFrame]], path: str,
                 fmt: str = "parquet", checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run ``steps`` over a stream and append the rows to a table."""
    out = stream
    for step in steps:
        out = step(out)
    writer = out.writeStream.format(fmt).outputMode("append").option(
        "checkpointLocation", checkpoint or new_path(stream.sparkSession, "stream"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
