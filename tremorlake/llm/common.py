"""Column and DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also inside lambdas."""
    # One parameter: a lambda of two would be handed the index too.
    return F.transform(F.array(value), lambda x: body(x))[0]


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_CLASS + "+"))


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], spread: Column, salts: int = 32, how: str = "inner") -> DataFrame:
    """Inner (or left) join of many ``rows`` with ``keys`` that are unique on ``on``.

    A key that holds a large part of ``rows`` is spread over ``salts`` partitions by the column ``spread``;
    each key row is repeated ``salts`` times, so ``keys`` should be the smaller side.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset, one below the warehouse.

    A path without a scheme belongs to Hadoop's default file system, as it does for Spark's own readers and writers.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    if not urlparse(folder).scheme:
        folder = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + folder
    return folder


def removed(frame: DataFrame) -> None:
    """Deletes the table that ``materialised`` wrote, once a later round has been written whole."""
    spark = frame.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read again: its lineage ends here."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def gapless(frame: DataFrame, group: list[str], order: list[str], to: str, rows_per_chunk: int = 200_000, weight: str | None = None) -> DataFrame:
    """Adds ``to``: a number from 0 without gaps within each ``group``; with ``weight``, the weight of earlier rows.

    A group may hold all rows: each is dealt into chunks by a hash of ``order``, rows are numbered within a
    chunk, and a chunk starts where the earlier ones of its group end. ``order`` should tell rows apart.
    """
    n = frame.count()
    chunks = max(16, -(-n // rows_per_chunk))
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    dealt = frame.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    sizes = dealt.groupBy(*group, "_chunk").agg(F.sum(one).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_chunk").orderBy(*order)
    rank = F.row_number().over(within) - 1 if weight is None else F.sum(one).over(within.rowsBetween(Window.unboundedPreceding, 0)) - one
    return (
        dealt.withColumn("_rank", rank)
        .join(starts, [*group, "_chunk"])
        .withColumn(to, (F.col("_start") + F.col("_rank")).cast("long"))
        .drop("_chunk", "_start", "_rank")
    )
