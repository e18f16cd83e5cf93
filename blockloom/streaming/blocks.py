"""Block operators on streams: codecs and array transforms are per row, so they run on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.params import Transform
from ..operators.transform import array_transform
from ..plans.pipeline import encode


def read_blocks(spark: SparkSession, path: str, schema: StructType, files: int = 16, **options: str) -> DataFrame:
    """A stream of rows from Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.options(**options).parquet(path)


def transform_blocks(rows: DataFrame, kind: Transform) -> DataFrame:
    """block_id, n and data of a stream, with data transformed."""
    return rows.select("block_id", "n", array_transform(F.col("data"), kind).alias("data"))


def encode_blocks(rows: DataFrame, codec: str) -> DataFrame:
    """Encoded blocks of a stream, without state."""
    return encode(rows, codec)


def windowed_stats(events: DataFrame, time: str, value: str, window: str, late: str) -> DataFrame:
    """Count, least, greatest and sum of a value by tumbling window; windows close when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.sum(value).alias("total"))


def write_blocks(encoded: DataFrame, path: str, checkpoint: str):
    """Appends encoded blocks to Parquet, each once; ends when the input so far is done."""
    return encoded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
