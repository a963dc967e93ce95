"""Causal features per (origin, cell): everything is computed from events before the origin."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.geo import cell, cell_id, haversine_km
from tremorlake.operators.joins import counted_before, days_between, grid, neighbours, small
from tremorlake.operators.rates import celled

LOG10_E = math.log10(math.e)


def _since(t: Column, origins: list) -> Column:
    """The first of the sorted ``origins`` after the time ``t``; null where there is none."""
    return F.array_min(F.filter(F.array(*[F.lit(o) for o in origins]), lambda o: o > t))


def features(events: DataFrame, origins: DataFrame, start: str = "1975-01-01") -> DataFrame:
    """The 43 features, rounded, of every origin (column ``origin``) and cell of the 1-degree grid.

    Origins are a small dimension. What counts all history is summed per cell and first origin that sees an event,
    and running sums over origins do the rest; only the events of the last 365 days meet their origins as rows.
    """
    spark = events.sparkSession
    # At most MAX_BROADCAST_ROWS timestamps.
    times = sorted(r["origin"] for r in small(origins.select("origin").distinct()).collect())
    exposure = days_between(F.col("origin"), F.lit(start).cast("timestamp")) / 365.25
    cells = grid(spark)
    frame = cells.select("i_lat", "i_lon").join(F.broadcast(origins.select("origin")))
    ev = celled(events).select("t", "latitude", "longitude", "depth_km", "m", "i_lat", "i_lon", "event_id")
    seen = ev.withColumn("origin", _since(F.col("t"), times)).where("origin IS NOT NULL")
    seen = seen.withColumn("dist", haversine_km(20.5 + F.col("i_lat"), 88.5 + F.col("i_lon"), F.col("latitude"), F.col("longitude")))

    m = F.col("m")
    count = lambda c: F.count_if(c)
    only = lambda c, x: F.when(c, x)
    by = ["origin", "i_lat", "i_lon"]
    upto = Window.partitionBy("i_lat", "i_lon").orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)
    fresh = seen.groupBy(*by).agg(
        F.count("*").alias("n_all"),
        count(m >= 4.5).alias("n_45"),
        count(m >= 5.0).alias("n_50"),
        count(m >= 5.5).alias("n_55"),
        F.max(F.struct("t", (-F.col("event_id")).alias("e"), "dist")).alias("last"),
        F.sum(only(F.col("dist") > 0, 1 / (1 + F.col("dist") / 50))).alias("weighted"),
    )
    # Events near a cell's centre lie in it or in a neighbour (100 km is less than 1.5 cells in either direction).
    near = neighbours(cells, True).join(F.broadcast(cells.select("i_lat", "i_lon", "lat_center", "lon_center")), ["i_lat", "i_lon"])
    close = seen.select("origin", F.col("i_lat").alias("n_lat"), F.col("i_lon").alias("n_lon"), "latitude", "longitude").join(F.broadcast(near), ["n_lat", "n_lon"])
    km = haversine_km(F.col("lat_center"), F.col("lon_center"), F.col("latitude"), F.col("longitude"))
    density = close.groupBy(*by).agg(count(km <= 50).alias("d50"), count(km <= 100).alias("d100"))
    sums = ["n_all", "n_45", "n_50", "n_55", "weighted", "d50", "d100"]
    whole = frame.join(fresh, by, "left").join(density, by, "left")
    whole = whole.select(*by, *[F.sum(c).over(upto).alias(c) for c in sums], F.max("last").over(upto).alias("last"))

    recent = ev.withColumn("origin", F.explode(F.filter(F.array(*[F.lit(o) for o in times]), lambda o: (o > F.col("t")) & (F.unix_micros(o) - F.unix_micros("t") <= 365 * 86400000000))))
    recent = recent.withColumn("age", days_between(F.col("origin"), F.col("t")))
    age, d = F.col("age"), F.col("depth_km")
    within = lambda days: age <= days
    in90, in365 = within(90), within(365) & (m >= 4.45)
    late = recent.groupBy(*by).agg(
        *[count(within(k)).alias(f"n_prev_{k}d") for k in (1, 7, 30, 90, 365)],
        F.max(only(within(30), m)).alias("max_30"),
        F.max(only(in90, m)).alias("max_90"),
        F.avg(only(in90, m)).alias("mean_90"),
        F.var_pop(only(in90, m)).alias("var_90"),
        F.percentile(only(in90, m), F.lit(0.9)).alias("p90_90"),
        count(within(30) & (m >= 4.5)).alias("n45_30"),
        count(within(30) & (m >= 5.0)).alias("n50_30"),
        count(in90 & (m >= 5.5)).alias("n55_90"),
        count(in365).alias("k_365"),
        F.avg(only(in365, m)).alias("mean_365"),
        F.avg(only(in90, d)).alias("depth_mean"),
        F.var_pop(only(in90, d)).alias("depth_var"),
        count(in90 & (d < 25)).alias("shallow"),
        count(in90 & (d >= 25) & (d < 70)).alias("intermediate"),
        count(in90 & (d >= 70)).alias("deep"),
    )
    per = whole.join(late, by, "left").withColumns({"last_age": days_between(F.col("origin"), F.col("last.t")), "last_dist": F.col("last.dist")})
    around = neighbours(cells, False).join(late.select("origin", F.col("i_lat").alias("n_lat"), F.col("i_lon").alias("n_lon"), F.col("n_prev_30d").alias("k")), ["n_lat", "n_lon"])
    activity = around.groupBy(*by).agg(F.sum("k").alias("neighbor_activity"))

    latest = lambda least: F.max(F.when(m >= least, F.struct("t", "latitude", "longitude")))
    ever = origins.select("origin").join(seen.groupBy("origin").agg(latest(5.0).alias("m5"), latest(6.0).alias("m6")), "origin", "left")
    # A row for each origin.
    along = Window.orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)
    ever = ever.select("origin", F.max("m5").over(along).alias("m5"), F.max("m6").over(along).alias("m6"))
    world = recent.groupBy("origin").agg(count(within(30)).alias("g30"), count(within(90) & (m >= 5.0)).alias("main90"))

    def week(e: str, name: str) -> DataFrame:
        """Events from the latest large one on, for a week or until the origin: a difference of two counts."""
        rows = ever.where(F.col(e).isNotNull()).select("origin", F.unix_micros(f"{e}.t").alias("_a"))
        rows = rows.withColumn("_z", F.least(F.col("_a") + 7 * 86400000000, F.unix_micros("origin")))
        start_ = counted_before(rows, ev.select("t"), "_a", "t").withColumnRenamed("n_before", "_n")
        return counted_before(start_, ev.select("t"), "_z", "t").select("origin", (F.col("n_before") - F.col("_n")).alias(name))

    globe = ever.join(world, "origin", "left").join(week("m5", "post5"), "origin", "left").join(week("m6", "post6"), "origin", "left").withColumn("exposure", exposure)

    frame = cells.join(F.broadcast(globe)).join(per, by, "left").join(activity, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda c: zero(c) / F.col("exposure")
    never = F.col("exposure") * 365.25
    since = lambda e: F.coalesce(days_between(F.col("origin"), F.col(f"{e}.t")), never)
    far = lambda e: F.coalesce(haversine_km(F.col("lat_center"), F.col("lon_center"), F.col(f"{e}.latitude"), F.col(f"{e}.longitude")), F.lit(500.0))
    inverse = lambda e: F.coalesce(1 / (days_between(F.col("origin"), F.col(f"{e}.t")) + 1), F.lit(0.0))
    r30, r90 = zero("n_prev_30d") / 30, zero("n_prev_90d") / 90
    # The names of the features.
    named: dict[str, Column] = {
        "hist_rate_all": rate("n_all"),
        "hist_rate_above_45": rate("n_45"),
        "hist_rate_above_50": rate("n_50"),
        "hist_rate_above_55": rate("n_55"),
        **{f"n_prev_{k}d": zero(f"n_prev_{k}d").cast("double") for k in (1, 7, 30, 90, 365)},
        "time_since_last_event_days": F.coalesce("last_age", never),
        "time_since_last_m5_days": since("m5"),
        "time_since_last_m6_days": since("m6"),
        "rolling_rate_30d": r30,
        "rolling_rate_90d": r90,
        "max_mag_recent_30d": zero("max_30"),
        "max_mag_recent_90d": zero("max_90"),
        "mean_mag_recent_90d": zero("mean_90"),
        "mag_var_recent_90d": zero("var_90"),
        "mag_p90_recent_90d": zero("p90_90"),
        "n_above_45_recent_30d": zero("n45_30").cast("double"),
        "n_above_50_recent_30d": zero("n50_30").cast("double"),
        "n_above_55_recent_90d": zero("n55_90").cast("double"),
        "rolling_b_value_365d": F.when((zero("k_365") >= 20) & (F.col("mean_365") > 4.4), LOG10_E / (F.col("mean_365") - 4.4)).otherwise(0.0),
        "local_density_50km": rate("d50"),
        "local_density_100km": rate("d100"),
        "neighbor_activity_8cells": zero("neighbor_activity").cast("double"),
        "dist_to_last_event_km": F.coalesce("last_dist", F.lit(500.0)),
        "dist_to_last_m5_km": far("m5"),
        "dist_to_last_m6_km": far("m6"),
        "spatial_concentration": F.when(zero("g30") > 0, zero("d50") / F.col("g30")).otherwise(0.0),
        "mean_depth_recent_90d": zero("depth_mean"),
        "depth_var_recent_90d": zero("depth_var"),
        "n_shallow_recent_90d": zero("shallow").cast("double"),
        "n_intermediate_recent_90d": zero("intermediate").cast("double"),
        "n_deep_recent_90d": zero("deep").cast("double"),
        "depth_weighted_density": rate("weighted"),
        "rate_acceleration_30d_vs_90d": (r30 - r90) / F.greatest(r90, F.lit(1e-6)),
        "omori_time_since_m5": inverse("m5"),
        "omori_time_since_m6": inverse("m6"),
        "post_m5_activity_7d": zero("post5").cast("double"),
        "post_m6_activity_7d": zero("post6").cast("double"),
        "n_mainshocks_90d": zero("main90").cast("double"),
        "dcfs_cumulative_Pa": F.lit(0.0),
    }
    return frame.select("origin", "cell_id", *[F.round(c, 6).alias(n) for n, c in named.items()])


#: How many features of the list above belong to each kind, in order; ablation groups A to G add one kind each.
KINDS = {"history": 4, "temporal": 10, "magnitude": 9, "spatial": 7, "depth": 6, "clustering": 6, "stress": 1}


def group(rows: DataFrame, letter: str) -> list[str]:
    """Names of the features of an ablation group, ``A`` (history alone) to ``G`` (all)."""
    names = [c for c in rows.columns if c not in ("origin", "cell_id", "n_future", "label")]
    return names[: sum(list(KINDS.values())[: "ABCDEFG".index(letter) + 1])]


def labelled(events: DataFrame, origins: DataFrame, threshold: float, horizon_days: float, start: str = "1975-01-01") -> DataFrame:
    """``features`` with n_future, the events from the origin on for the horizon in the half-open cell, and label."""
    i, j = cell(F.col("latitude"), F.col("longitude"), 1.0, "halfopen")
    past = F.col("t") >= F.col("origin")
    soon = F.unix_micros("t") < F.unix_micros("origin") + round(horizon_days * 86400e6)
    hit = events.where(F.col("m") >= threshold).select("t", cell_id(i, j).alias("cell_id")).where("cell_id IS NOT NULL").join(small(origins.select("origin")), past & soon)
    seen = hit.groupBy("origin", "cell_id").agg(F.count("*").alias("n_future"))
    rows = features(events, origins, start).join(seen, ["origin", "cell_id"], "left")
    return rows.withColumn("n_future", F.coalesce("n_future", F.lit(0))).withColumn("label", (F.col("n_future") > 0).cast("int"))
