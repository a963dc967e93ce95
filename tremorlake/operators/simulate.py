"""Forecasts conditioned on mainshocks, and checks against simulated counts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions.seismo import lcg
from tremorlake.operators import etas, inference
from tremorlake.operators.joins import counted_before, days_between, small
from tremorlake.operators.lineage import written

DAY_US = 86400000000


def conditioned(events: DataFrame, origins: DataFrame, horizon_days: float, models: dict[str, dict[str, float]], target_m: float = 4.0, start: str = "1975-01-01") -> DataFrame:
    """label, origin, p_<model> of each of ``models``, p_poisson, y for ``origins`` (label, origin), which may be many.

    The Poisson forecast has the mean rate since ``start``; it and the outcome are counts up to a time.
    """
    origins = written(origins.withColumn("_row", F.monotonically_increasing_id()), "origins")
    made = etas.expected_after(events, origins.select(F.col("_row").alias("event_id"), F.col("origin").alias("t")), models, horizon_days)
    each = made.groupBy(F.col("event_id").alias("_row")).agg(*[F.max(F.when(F.col("model") == name, 1 - F.exp(-F.col("expected")))).alias(f"p_{name}") for name in models])
    at = F.unix_micros("origin")
    marks = F.array(F.struct(F.lit(0).alias("k"), at.alias("_at")), F.struct(F.lit(1).alias("k"), (at + round(horizon_days * DAY_US)).alias("_at")))
    counts = counted_before(origins.select("_row", F.inline(marks)), events.where(F.col("m") >= target_m).select("t"), "_at", "t")
    n = lambda k: F.max(F.when(F.col("k") == k, F.col("n_before")))
    rows = origins.join(counts.groupBy("_row").agg(n(0).alias("_n"), n(1).alias("_m")), "_row").join(each, "_row")
    days = days_between(F.col("origin"), F.lit(start).cast("timestamp"))
    return rows.select("label", "origin", *[f"p_{name}" for name in models], (1 - F.exp(-F.col("_n") / days * horizon_days)).alias("p_poisson"), (F.col("_m") > F.col("_n")).cast("int").alias("y"))


def fitted_model(events: DataFrame, until: str, mc: float) -> dict[str, float]:
    """Parameters fitted to the events before ``until``, which comes before all origins that they are to forecast."""
    best = etas.fit(events.where(F.col("t") < F.lit(until).cast("timestamp")), mc).first()
    return {"mu_per_year": best["mu_per_year"], "k": best["k"], "alpha": best["alpha"], "c_days": best["c"], "p": best["p"], "mc": mc}


def short_horizons(events: DataFrame, main_m: float, horizons: list[tuple[str, float]], model: dict[str, float], delay_us: int = 3600000000, target_m: float = 4.0, start: str = "1975-01-01") -> DataFrame:
    """horizon, n and Brier scores of both forecasts that begin ``delay_us`` after each mainshock; all horizons of all
    mainshocks are kernel sums, and counts up to a time, of one pass each."""
    rows = written(events.where(F.col("m") >= main_m).select(F.monotonically_increasing_id().alias("event_id"), F.timestamp_micros(F.unix_micros("t") + delay_us).alias("t")), "origins")
    made = etas.expected_after(events, rows, {name: {**model, "horizon_days": days} for name, days in horizons}, 0.0)
    at = F.unix_micros("t")
    marks = F.array(*[F.struct(F.lit(name).alias("model"), F.lit(days).alias("days"), (at + round(days * DAY_US)).alias("_at")) for name, days in [("", 0.0), *horizons]])
    counts = counted_before(rows.select("event_id", "t", F.inline(marks)), events.where(F.col("m") >= target_m).select("t"), "_at", "t")
    before = counts.where("model = ''").select("event_id", F.col("n_before").alias("n"))
    each = made.join(counts.where("model <> ''"), ["event_id", "model"]).join(before, "event_id")
    poisson = 1 - F.exp(-F.col("n") / days_between(F.col("t"), F.lit(start).cast("timestamp")) * F.col("days"))
    y = (F.col("n_before") > F.col("n")).cast("int")
    err = lambda p: F.round(F.avg((p - y) * (p - y)), 6)
    return each.groupBy(F.col("model").alias("horizon")).agg(F.count("*").alias("n"), err(1 - F.exp(-F.col("expected"))).alias("brier_etas"), err(poisson).alias("brier_poisson"))


def checked(totals: DataFrame, observed: DataFrame) -> DataFrame:
    """param_id, observed, mean and interval of simulated totals, and whether the observed one (a one-row table) is inside."""
    at = lambda q: F.percentile("total", F.lit(q))
    per = totals.groupBy("param_id").agg(F.round(F.avg("total"), 6).alias("mean_total"), at(0.025).alias("lo"), at(0.975).alias("hi"))
    return per.join(F.broadcast(observed)).select("param_id", "observed", "mean_total", F.round("lo", 6).alias("lower"), F.round("hi", 6).alias("upper"), F.col("observed").between(F.col("lo"), F.col("hi")).alias("passes"))


def _statistics(cells: DataFrame, by: list[str]) -> DataFrame:
    ranked = cells.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "cell_id")))
    n = F.col("n").cast("double")
    per = ranked.groupBy(*by).agg(F.sum(n).alias("total"), F.count_if(n > 0).cast("double").alias("occupied"), F.max(n).alias("largest"), (F.sum(F.when(F.col("_k") <= 3, n)) / F.nullif(F.sum(n), F.lit(0.0))).alias("top3_share"))
    return per.select(*by, F.inline(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("v")) for s in ("total", "occupied", "largest", "top3_share")])))


def posterior_predictive(cells: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """stat, observed, mean and interval of simulated counts, passes. ``cells``: cell_id, cell (its number), n observed,
    mean; a grid's rows, drawn ``replicates`` times, normal around the mean."""
    u = lambda k: (lcg(F.col("r"), F.col("cell") * 2 + k, 1000003, seed) + 1) / 1000004.0
    z = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * math.pi * u(1))
    drawn = cells.sparkSession.range(replicates).withColumnRenamed("id", "r").join(small(cells.select("cell_id", "cell", "mean")))
    drawn = drawn.select("r", "cell_id", F.greatest(F.round(F.col("mean") + F.sqrt("mean") * z), F.lit(0.0)).alias("n"))
    seen = _statistics(cells.withColumn("_one", F.lit(1)), ["_one"]).select("stat", F.col("v").alias("seen"))
    at = lambda q: F.percentile("v", F.lit(q))
    per = _statistics(drawn, ["r"]).groupBy("stat").agg(F.round(F.avg("v"), 6).alias("mean"), at(0.025).alias("lo"), at(0.975).alias("hi"))
    return per.join(seen, "stat").select("stat", F.round("seen", 6).alias("observed"), "mean", F.round("lo", 6).alias("lower"), F.round("hi", 6).alias("upper"), F.col("seen").between(F.col("lo"), F.col("hi")).alias("passes"))


def rate_bootstrap(events: DataFrame, cells: DataFrame, years: float, h_degrees: float, replicates: int) -> DataFrame:
    """cell_id, lower, upper: percentiles of smoothed rates over replicates in which each event counts as often as it is
    drawn (``inference.weighted_sums``). ``events``: event_id, latitude, longitude; cells are a small dimension."""
    small(cells)
    grid = sorted((r["cell_id"], r["lat_center"], r["lon_center"]) for r in cells.collect())
    lat, lon = (np.array([g[k] for g in grid]) for k in (1, 2))

    def densities(batch: pa.RecordBatch) -> np.ndarray:
        at = [batch.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("latitude", "longitude")]
        d2 = (at[0] - lat) ** 2 + ((at[1] - lon) * math.cos(math.radians(C.MID_LATITUDE))) ** 2
        return np.exp(-d2 / (2 * h_degrees**2)) / (2 * math.pi * h_degrees**2) / years

    sums = inference.weighted_sums(events.select("event_id", "latitude", "longitude"), "event_id", densities, replicates)
    at = lambda q: F.round(F.percentile("s", F.lit(q)), 6)
    each = sums.groupBy("k").agg(at(0.025).alias("lower"), at(0.975).alias("upper"))
    names = cells.sparkSession.createDataFrame([(k, g[0]) for k, g in enumerate(grid)], "k long, cell_id string")
    return each.join(F.broadcast(names), "k").select("cell_id", "lower", "upper")
