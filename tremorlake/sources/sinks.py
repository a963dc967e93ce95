"""Sinks of catalogs and result tables, and the registry of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.operators.audit import flattened, merged

#: (source_id, class, product, reader of sources.catalog)
SOURCES = [
    ("gcmt", "catalog", "moment tensors", "read_gcmt_ndk"),
    ("isc", "catalog", "bulletin text", "read_isc_text"),
    ("isc-gem", "catalog", "instrumental catalogue", "read_iscgem_csv"),
    ("usgs-csv", "catalog", "event table", "read_usgs_csv"),
    ("usgs-geojson", "catalog", "event feed", "read_usgs_geojson"),
    ("faults", "geology", "active faults", "read_faults_geojson"),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source_id string, class string, product string, reader string")


def write_catalog(canonical: DataFrame, folder: str) -> None:
    """The nested events as JSON, and flat as CSV."""
    canonical.write.mode("overwrite").json(f"{folder}/json")
    flattened(canonical).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")


def write_results(parts: list[DataFrame], folder: str) -> None:
    """Result tables of different columns as one CSV table."""
    merged(parts).write.mode("overwrite").option("header", True).csv(folder)


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: list[str] | None = None) -> None:
    """Each table below a folder of its name, partitioned by those of ``partition_by`` that it has."""
    for name, table in tables.items():
        by = [c for c in partition_by or [] if c in table.columns]
        table.write.mode("overwrite").partitionBy(*by).parquet(f"{folder}/{name}")


def content_hash(table: DataFrame, without: list[str]) -> DataFrame:
    """Adds content_hash: the first 16 hexadecimal digits of the SHA-256 of the row's columns as JSON, sorted by name."""
    names = sorted(c for c in table.columns if c not in without)
    return table.withColumn("content_hash", F.substring(F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in names])), 256), 1, 16))
