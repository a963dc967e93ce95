"""Append-only forecast ledger: records with a content hash, integrity checks, scores in a table of their own."""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake.functions.seismo import evidence_level, lcg, p_at_least_one
from tremorlake.operators.metrics import log_likelihood
from tremorlake.operators.rates import expanding_rates, outcomes


def forecasts(events: DataFrame, thresholds: list[float], horizons: dict[str, float], first: int, last: int) -> DataFrame:
    """origin_year, threshold, horizon, cell, rate, p. A threshold's rates are computed once for all horizons."""
    rows = None
    for threshold in thresholds:
        rates = expanding_rates(events, threshold, first, last).withColumn("threshold", F.lit(threshold))
        rows = rates if rows is None else rows.unionByName(rates)
    h = F.array(*[F.struct(F.lit(n).alias("horizon"), F.lit(float(d)).alias("horizon_days")) for n, d in horizons.items()])
    rows = rows.select("origin_year", "threshold", "cell_id", "i_lat", "i_lon", "n_train", "rate", F.inline(h))
    return rows.withColumn("p", p_at_least_one(F.col("rate"), F.col("horizon_days") / 365.25))


def records(cells: DataFrame) -> DataFrame:
    """One record per origin, threshold and horizon: regional sums and the hash of its cells in order of cell_id."""
    line = F.concat_ws(":", "cell_id", "n_train", F.format_string("%.6f", F.round("p", 6)))
    rows = cells.groupBy("origin_year", "threshold", "horizon").agg(
        F.count("*").alias("n_cells"),
        F.round(F.sum("rate"), 6).alias("rate"),
        F.round(1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("p"), F.lit(1e-300))))), 6).alias("p_region"),
        F.array_join(F.array_sort(F.collect_list(line)), ";").alias("_body"),
    )
    return rows.withColumn("forecast_hash", F.substring(F.sha2("_body", 256), 1, 16)).drop("_body")


def with_bounds(cells: DataFrame, spread: float = 2.0) -> DataFrame:
    """Adds p_lower and p_upper from the rate plus and minus ``spread`` square roots of its count, at least 0."""
    exposure = F.when(F.col("n_train") > 0, F.col("n_train") / F.col("rate"))
    half = F.coalesce(spread * F.sqrt(F.col("n_train").cast("double")) / exposure, F.lit(0.0))
    years = F.col("horizon_days") / 365.25
    return cells.withColumns({"p_lower": p_at_least_one(F.greatest(F.col("rate") - half, F.lit(0.0)), years), "p_upper": p_at_least_one(F.col("rate") + half, years)})


def integrity(cells: DataFrame, version: str) -> DataFrame:
    """Per origin, threshold and horizon the cells whose probability is missing, out of range, does not follow its rate
    or lies outside its bounds, and those of another version. ``cells``: forecasts with p_lower, p_upper, version."""
    p = F.col("p")
    off = F.abs(p - p_at_least_one(F.col("rate"), F.col("horizon_days") / 365.25)) > 1e-9
    return cells.groupBy("origin_year", "threshold", "horizon").agg(
        F.count_if(p.isNull()).alias("n_missing"),
        F.count_if((p < 0) | (p > 1)).alias("n_out_of_range"),
        F.count_if(off).alias("n_inconsistent"),
        F.count_if((p < F.col("p_lower")) | (p > F.col("p_upper"))).alias("n_disordered"),
        F.count_if(~F.col("version").eqNullSafe(F.lit(version))).alias("n_other_version"),
    )


def hash_faults(stored: DataFrame, cells: DataFrame) -> DataFrame:
    """origin_year, threshold, horizon, intact: do the cells still give the hash that was stored with the record?"""
    keys = ["origin_year", "threshold", "horizon"]
    now = records(cells).select(*keys, F.col("forecast_hash").alias("_now"))
    return stored.select(*keys, "forecast_hash").join(now, keys, "left").select(*keys, F.col("forecast_hash").eqNullSafe(F.col("_now")).alias("intact"))


def closed(cells: DataFrame, now: str) -> DataFrame:
    """Adds done: the window has ended by ``now``; only such forecasts are scored."""
    end = F.unix_micros(F.make_timestamp("origin_year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) + (F.col("horizon_days") * 86400000000).cast("long")
    return cells.withColumn("done", end <= F.unix_micros(F.lit(now).cast("timestamp")))


def history(records_: DataFrame) -> DataFrame:
    """Adds is_latest to records: the last origin of its threshold and horizon."""
    last = F.max("origin_year").over(Window.partitionBy("threshold", "horizon"))
    return records_.withColumn("is_latest", F.col("origin_year") == last)


def freshness(events: DataFrame, now: str, stale_days: float = 7.0) -> DataFrame:
    """One row: events up to ``now``, days since the last one, events of the last 30 days, status."""
    at = F.lit(now).cast("timestamp")
    age = (F.unix_micros(at) - F.unix_micros("t")) / 86400e6
    row = events.where(F.col("t") <= at).agg(F.count("*").alias("n"), F.min(age).alias("age"), F.count_if(age <= 30).alias("n_30d"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("age") > stale_days, "stale").otherwise("fresh")
    return row.select("n", F.round("age", 6).alias("age_days"), "n_30d", status.alias("status"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per threshold and horizon the forecasts that both ledgers hold: n_evaluated, their Brier scores, the difference.
    ``a`` and ``b``: origin_year, threshold, horizon, cell_id, p; ``a`` has y too."""
    keys = ["origin_year", "threshold", "horizon", "cell_id"]
    met = a.select(*keys, "p", "y").join(b.select(*keys, F.col("p").alias("_p")), keys)
    p, q, y = F.col("p"), F.col("_p"), F.col("y")
    one, two = F.avg((p - y) * (p - y)), F.avg((q - y) * (q - y))
    return met.groupBy("threshold", "horizon").agg(F.countDistinct("origin_year").alias("n_evaluated"), F.round(one, 6).alias("brier_1"), F.round(two, 6).alias("brier_2"), F.round(two - one, 6).alias("difference"))


def brier_intervals(scores: DataFrame, replicates: int = 200, least: int = 5, seed: int = 42) -> DataFrame:
    """threshold, horizon, n_evaluated, brier and its percentiles over resampled origins, where there are ``least``."""
    keys = ["threshold", "horizon"]
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    sums = scores.groupBy(*keys, "origin_year").agg(F.sum(e).alias("e"), F.count("*").alias("n"))
    # A row for each origin and configuration.
    sums = sums.withColumns({"i": F.row_number().over(Window.partitionBy(*keys).orderBy("origin_year")) - 1, "size": F.count("*").over(Window.partitionBy(*keys))})
    sizes = sums.select(*keys, "size").distinct().where(F.col("size") >= least)
    draws = scores.sparkSession.range(replicates).withColumnRenamed("id", "r").join(F.broadcast(sizes)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    drawn = draws.select(*keys, "r", lcg(F.col("r"), F.col("k"), F.col("size"), seed).alias("i")).join(sums.drop("size"), [*keys, "i"])
    per = drawn.groupBy(*keys, "r").agg((F.sum("e") / F.sum("n")).alias("b"))
    at = lambda q: F.round(F.percentile("b", F.lit(q)), 6)
    whole = sums.groupBy(*keys).agg(F.count("*").alias("n_evaluated"), F.round(F.sum("e") / F.sum("n"), 6).alias("brier"))
    return whole.join(per.groupBy(*keys).agg(at(0.025).alias("lower"), at(0.975).alias("upper")), keys, "left")


def scored(cells: DataFrame, events: DataFrame, threshold: float, horizon: str, horizon_days: float, first: int, last: int) -> DataFrame:
    """Cells of one configuration with y, the observed outcome of its closed window."""
    seen = outcomes(events, threshold, horizon_days, first, last)
    mine = cells.where((F.col("threshold") == threshold) & (F.col("horizon") == horizon))
    return mine.join(seen, ["origin_year", "i_lat", "i_lon"], "left").withColumn("y", (F.coalesce("n_future", F.lit(0)) > 0).cast("int"))


def summary(scores: DataFrame) -> DataFrame:
    """Scores per configuration and over all (nulls): forecasts made, those evaluated (``done``), which alone are
    scored, and the evidence level of both numbers."""
    p, y, done = F.col("p"), F.col("y"), F.col("done")
    one = lambda x: F.when(done, x)
    rows = scores.rollup("threshold", "horizon").agg(
        F.countDistinct("origin_year").alias("n_forecasts"),
        F.countDistinct(one(F.col("origin_year"))).alias("n_evaluated"),
        F.round(F.avg(one((p - y) * (p - y))), 6).alias("brier"),
        F.round(F.avg(one(log_likelihood(p, y))), 6).alias("log_likelihood"),
    )
    return rows.where("threshold IS NULL OR horizon IS NOT NULL").withColumn("evidence_level", evidence_level(F.col("n_forecasts"), F.col("n_evaluated")))


KEYS = ["origin_year", "threshold", "horizon"]


def _manifests(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last manifest, and the batch folders that whole manifests name, in order."""
    root = _hadoop_path(spark, f"{path}/manifests")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0, []
    names = sorted(x.getPath().getName() for x in fs.listStatus(root))
    names = [x for x in names if x.isdigit()]
    found = []
    for name in names:
        stream = fs.open(_hadoop_path(spark, f"{path}/manifests/{name}"))
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            found.append(json.loads(text)["batch"])
        except ValueError:
            # Its writer died while it wrote it, so its batch was never committed.
            continue
    return int(names[-1]) if names else 0, found


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _committed(spark: SparkSession, path: str, number: int, batch: str) -> bool:
    """Writes manifest ``number``, if no other writer has done so before."""
    at = _hadoop_path(spark, f"{path}/manifests/{number:010d}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stream = fs.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    stream.write(bytearray(json.dumps({"batch": batch}).encode()))
    stream.close()
    return True


def append(records_: DataFrame, path: str, attempts: int = 10) -> int:
    """Adds the records whose forecast_hash the ledger does not hold yet, and returns how many; none is ever changed.

    A batch is written whole into a folder of its own, then a manifest that names it is created under the next number,
    which only one writer can do. Readers follow manifests, so a batch whose writer died does not exist for them, and
    its replay is added once. A writer that another one forestalled starts again from what is committed now. Records of
    an origin, threshold and horizon that the ledger holds with another hash are an error.
    """
    spark = records_.sparkSession
    for _ in range(attempts):
        last, batches = _manifests(spark, path)
        fresh = records_.dropDuplicates([*KEYS, "forecast_hash"])
        if batches:
            held = _read(spark, path, batches).select(*KEYS, F.col("forecast_hash").alias("_held"))
            met = fresh.join(held, KEYS, "left")
            if not met.where("_held <> forecast_hash").isEmpty():
                raise ValueError("the ledger holds another forecast for an origin, threshold and horizon of these")
            fresh = met.where("_held IS NULL").drop("_held")
        batch = f"batches/{uuid4().hex}"
        fresh.write.partitionBy("origin_year").parquet(f"{path}/{batch}")
        added = spark.read.schema(records_.schema).parquet(f"{path}/{batch}").count()
        if added and _committed(spark, path, last + 1, batch):
            return added
        _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(_hadoop_path(spark, f"{path}/{batch}"), True)
        if not added:
            return 0
    raise RuntimeError(f"other writers forestalled {attempts} attempts")


def _read(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    # Folders have one schema, that of the records; each is a partitioned table of its own.
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{x}") for x in batches])


def read(spark: SparkSession, path: str) -> DataFrame:
    """All committed records, with is_latest."""
    _, batches = _manifests(spark, path)
    if not batches:
        raise FileNotFoundError(f"no committed batch in {path}")
    return history(_read(spark, path, batches))
