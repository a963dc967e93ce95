"""Structured Streaming wrappers: ingest with late duplicates, event rates in windows, forecasts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.plans import ledger


def landing(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Observations as they arrive in a landing folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, lateness: str = "8 days") -> DataFrame:
    """Each native_event_id once while its copies arrive within ``lateness``; state is dropped after that."""
    return stream.withWatermark("origin_time", lateness).dropDuplicatesWithinWatermark(["native_event_id"])


def event_rates(stream: DataFrame, width: str = "7 days", step: str | None = None, lateness: str = "8 days") -> DataFrame:
    """Events and largest magnitude per tumbling or sliding window."""
    window = F.window("origin_time", width, step) if step else F.window("origin_time", width)
    rows = stream.withWatermark("origin_time", lateness).groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.max("original_magnitude").alias("max_m"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_m")


def sessions(stream: DataFrame, gap: str = "2 minutes", lateness: str = "8 days") -> DataFrame:
    """Runs of events without a longer gap, the streaming form of reconciliation blocks."""
    rows = stream.withWatermark("origin_time", lateness).groupBy(F.session_window("origin_time", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def forecast_each_batch(stream: DataFrame, forecast: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, as_ledger: bool = False):
    """Runs ``forecast`` on every micro-batch and keeps its rows below ``out``.

    Rows go into one folder for each batch, which a replay overwrites; ``as_ledger``: forecast records are appended to
    the ledger at ``out``, which knows replays by their hashes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        made = forecast(batch)
        if as_ledger:
            ledger.append(made, out)
        else:
            made.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
