"""The strip transform over a stream of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import floor_mask


def floor_stream(spark: SparkSession, path: str, sink: str | None = None) -> DataFrame:
    """doc_id, masked of every file that is at path now, masked as they come, 64 files a micro-batch at most.

    Stateless, so it needs no watermark. The rows go to the sink as Parquet, once each; without one, to a new folder
    in the one that driver and executors share, which goes when the driver ends. No rows pass through the driver.
    """
    schema = spark.read.parquet(path).schema
    # A folder of part files is read as one; a single file by a glob that only it matches.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path if not _is_file(spark, path) else path[:-1] + "[" + path[-1] + "]")
    masked = source.select("doc_id", floor_mask(F.col("text")).alias("masked"))
    sink = sink or _shared_path(spark)
    masked.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(masked.schema).parquet(sink)


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def _shared_path(spark: SparkSession) -> str:
    """A new path in the session's checkpoint folder, or in the warehouse where it names none; removed when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_veilgraph"
    path = f"{shared.rstrip('/')}/floor-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path
