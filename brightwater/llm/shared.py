"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import CLEAN_UP, new_folder as new_path


@contextmanager
def shuffles_end(spark: SparkSession):
    """Within, the shuffle files of a write go with it, as nothing reads them again."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at replicated files,
    so a lost executor costs no recomputation, and joins on the result shuffle (and split) both sides."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def stored_by(df: DataFrame, key: str, files: int, name: str) -> DataFrame:
    """As ``stored``, dealt into a number of files by a key, so a join on it leaves the table where it is. No table stays in the session's catalog."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    with shuffles_end(spark):
        df.repartition(files, key).write.option("compression", "zstd").option("path", path).bucketBy(files, key).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog forgets it, the plan keeps its files and buckets
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing will read it again."""
    path = getattr(df, "stored_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def parts(batch: pa.RecordBatch, column: int, rows: int = 256, most: int = 32 << 20):
    """A batch in slices of ``rows`` rows at most and about ``most`` bytes in a text or binary column; one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64).cumsum()
    start = 0
    while start < batch.num_rows:
        before = size[start - 1] if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(size, before + most, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop
