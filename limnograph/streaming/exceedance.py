"""Exceedance classes on a stream of new samples: a stateless stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from limnograph.operators.thresholds import band_class, with_points


def stream_parquet(spark: SparkSession, folder: str, schema: T.StructType, *, glob: str = "*.parquet",
                   files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return reader.option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def flag_stream(samples: DataFrame, chars: DataFrame) -> DataFrame:
    """Points and class of every incoming sample; no state, so no watermark."""
    return with_points(samples, chars).withColumn("pcolor", band_class(F.col("ValueCen")))


def write_stream(flagged: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all that has arrived to a table partitioned by park, then stop."""
    writer = flagged.writeStream.format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", checkpoint).partitionBy("Park")
    return writer.trigger(availableNow=True).start()
