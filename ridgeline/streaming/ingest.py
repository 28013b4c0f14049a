"""Incremental import: new track files in a folder are parsed, hashed and appended, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.sources.trackfiles import track_points

FILES = "path string, modificationTime timestamp, length long, content binary"


def import_batch(files: DataFrame, library: str) -> None:
    """Append the points of files whose content the library does not hold; of equal contents the first path is kept."""
    spark = files.sparkSession
    hashed = files.withColumn("file_hash", F.sha2("content", 256)).groupBy("file_hash").agg(F.min(F.struct("path", "content")).alias("f")).select("file_hash", "f.path", "f.content")
    try:
        hashed = hashed.join(spark.read.parquet(library).select("file_hash").distinct(), "file_hash", "left_anti")
    except Exception as error:  # noqa: BLE001 - a library that does not exist yet holds nothing
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    points = track_points(hashed).join(hashed.select("path", "file_hash"), "path")
    points.write.mode("append").parquet(library)


def watch(spark: SparkSession, folder: str, library: str, checkpoint: str) -> StreamingQuery:
    """A query over all files there are and, when started again, those that came since."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(lambda batch, _: import_batch(batch, library)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
