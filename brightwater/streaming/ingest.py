"""Incremental ingest: files that arrive become chunks of the store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import segments
from ..sources.files import parse_files
from ..sources.scratch import stored


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.withColumn("filename", F.regexp_extract("path", "([^/]+)$", 1))


def ingest(files: DataFrame, store: str, checkpoint: str, chunk_size: int = 800, overlap: int = 120) -> StreamingQuery:
    """Put what has arrived into a store of ``segments``: each batch commits one version with the chunks and lists of its own files, so it can be searched at once.

    The store's log knows each stream by the id that Spark keeps in its checkpoint, and its last batch: a batch that is repeated after a failure changes nothing, while another stream, or a new
    checkpoint, begins a count of its own and only replaces documents of the same names. Streams that commit at the same time are put one after the other. Files that can't be parsed
    are left out. Of files with one name in a batch the last in order of path counts.
    """
    spark = files.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        name = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        parsed = parse_files(batch.groupBy("filename").agg(F.max_by("content", "path").alias("content")))
        fresh = stored(parsed.where("error is null and text <> ''").select("filename", "text"), "arrived")
        segments.change(spark, store, fresh, stream=(name, number), chunk_size=chunk_size, overlap=overlap)
        segments.merge(spark, store)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, store: str) -> DataFrame:
    """The store as it is: chunk_id, filename, text."""
    return segments.read(spark, store)
