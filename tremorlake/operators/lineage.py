"""Intermediate tables of iterative operators, written to the shared folder so that lost executors cost no rounds."""

from __future__ import annotations

from urllib.parse import urlparse
from uuid import uuid4

from pyspark.sql import DataFrame


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a Parquet table below spark.checkpoint.dir; only where that is unset, below the warehouse.

    A path without a scheme belongs to Hadoop's default file system, as for Spark's own readers and writers.
    """
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not urlparse(folder).scheme:
        folder = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + folder
    path = f"{folder}/{name}-{uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(frame: DataFrame) -> None:
    """Deletes a table that ``written`` made, once a later round has been written whole."""
    spark = frame.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
