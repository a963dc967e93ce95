"""Observations of several agencies reconciled into canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions.geo import haversine_km
from tremorlake.operators.joins import interval_join, touched_cells
from tremorlake.operators.lineage import written
from tremorlake.operators.settling import BLOCK_LINKS, settled_in_time

# Lower is better, anything else ranks last.
QUALITY_RANK = {"reviewed": 0, "historical": 1, "macroseismic": 2, "automatic": 3, "unknown": 4}


def near_duplicate_pairs(obs: DataFrame, window_s: float = 120.0, radius_km: float = 50.0) -> DataFrame:
    """id_a, id_b, dt_s, dist_km of observations of near time and place."""
    cols = ["native_event_id", "origin_time", "latitude", "longitude"]
    a = obs.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = obs.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = interval_join(a, b, "a_origin_time", "b_origin_time", window_s)
    d = haversine_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    return pairs.where("a_native_event_id < b_native_event_id").select(
        F.col("a_native_event_id").alias("id_a"),
        F.col("b_native_event_id").alias("id_b"),
        F.round(F.abs(F.unix_micros("b_origin_time") - F.unix_micros("a_origin_time")) / 1e6, 6).alias("dt_s"),
        F.round(d, 6).alias("dist_km"),
    ).where(F.col("dist_km") <= radius_km)


def match_observations(obs: DataFrame, window_s: float = 120.0, radius_km: float = 50.0, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Adds anchor_id: in order of time, a free observation becomes an anchor and takes later ones in its window.

    An observation is an anchor iff no earlier anchor covers it, and belongs to the earliest anchor that does. Covering
    pairs are joined on buckets of time and cells of space; ``settled_in_time`` tells who is an anchor. Observations of
    one time and place count once there, so that a report that is repeated very often makes no pairs with itself.
    """
    place = ["origin_time", "latitude", "longitude"]
    placed = obs.where(F.col("origin_time").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    points = written(placed.groupBy(*place).agg(F.min("native_event_id").alias("native_event_id")), "points")
    a, b = (points.select(*[F.col(c).alias(f"{side}_{c}") for c in ("native_event_id", *place)]) for side in "ab")
    lat = points.agg(F.coalesce(F.max(F.abs("latitude")), F.lit(0.0))).first()[0]
    # An observation looks ahead only, into the few buckets of four windows and cells of four radii that it touches.
    us, window = (lambda side: F.unix_micros(f"{side}_origin_time")), round(window_s * 1e6)
    bucket = lambda us: F.floor(us / max(1, 4 * window))
    cells = {side: touched_cells(F.col(f"{side}_latitude"), F.col(f"{side}_longitude"), radius_km, lat) for side in "ab"}
    wide = a.withColumn("_c", F.explode(cells["a"][1])).withColumn("_b", F.explode(F.sequence(bucket(us("a")), bucket(us("a") + window))))
    own = b.withColumns({"_c": cells["b"][0], "_b": bucket(us("b"))})
    pairs = wide.join(own, ["_b", "_c"]).where(us("b") - us("a") <= window)
    earlier = F.struct("a_origin_time", "a_native_event_id") < F.struct("b_origin_time", "b_native_event_id")
    near = haversine_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude")) <= radius_km
    links = pairs.where(earlier & near).select(F.col("a_native_event_id").alias("a"), F.col("b_native_event_id").alias("b"), F.unix_micros("a_origin_time").alias("us_a"), F.unix_micros("b_origin_time").alias("us_b"))
    links = written(links, "covering")
    seeds = settled_in_time(links, round(window_s * 1e6), block_links).where("seed").select("a")
    owner = links.join(seeds, "a").groupBy(F.col("b").alias("_p")).agg(F.min(F.struct("us_a", "a")).alias("_o"))
    owned = points.join(owner, points["native_event_id"] == owner["_p"], "left").select(*place, F.coalesce("_o.a", "native_event_id").alias("anchor_id"))
    return obs.join(owned, place, "left").select(*obs.columns, F.coalesce("anchor_id", "native_event_id").alias("anchor_id"))


def canonical_events(matched: DataFrame) -> DataFrame:
    """One row per anchor: best origin by quality, best magnitude by type, and what it was chosen from."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for pair in QUALITY_RANK.items() for x in pair])[F.col("quality_flag")], F.lit(4))
    by_origin = F.struct(rank.alias("q"), F.coalesce("horizontal_uncertainty_km", F.lit(25.0)).alias("h"), (-F.coalesce("n_stations", F.lit(0))).alias("n"), F.coalesce("gap_deg", F.lit(360.0)).alias("g"), F.col("source_catalog").alias("s"), F.col("native_event_id").alias("i"))
    by_magnitude = F.struct(F.when(F.col("magnitude_type").isin(C.MW_FAMILY), 0).otherwise(1).alias("w"), F.coalesce("magnitude_uncertainty", F.lit(0.3)).alias("u"), F.col("source_catalog").alias("s"), F.col("native_event_id").alias("i"))
    where = F.struct("origin_time", "latitude", "longitude", "depth_km", F.col("native_event_id").alias("id"))
    size = F.struct("original_magnitude", "magnitude_type", F.col("native_event_id").alias("id"))
    return matched.groupBy("anchor_id").agg(
        F.min_by(where, by_origin).alias("o"),
        F.min_by(size, by_magnitude).alias("g"),
        F.count("*").alias("n_observations"),
        F.array_join(F.array_sort(F.collect_set("source_catalog")), ",").alias("sources"),
    ).select("anchor_id", F.col("o.origin_time").alias("origin_time"), F.col("o.latitude").alias("latitude"), F.col("o.longitude").alias("longitude"), F.col("o.depth_km").alias("depth_km"), F.col("o.id").alias("origin_from"), F.col("g.original_magnitude").alias("original_magnitude"), F.col("g.magnitude_type").alias("magnitude_type"), F.col("g.id").alias("magnitude_from"), "n_observations", "sources")


def source_overlap(matched: DataFrame) -> DataFrame:
    """Events that both sources of a pair observed; sources are few, their sets are one small array per event."""
    sets = matched.groupBy("anchor_id").agg(F.array_sort(F.collect_set("source_catalog")).alias("s"))
    pairs = sets.select(F.explode("s").alias("source_a"), "s").select("source_a", F.explode("s").alias("source_b")).where("source_a < source_b")
    return pairs.groupBy("source_a", "source_b").agg(F.count("*").alias("n_events"))


def overlap_summary(matched: DataFrame) -> DataFrame:
    """One row: events, those that several sources observed, their share, observations per event and the most of one."""
    per = matched.groupBy("anchor_id").agg(F.count("*").alias("n"), F.size(F.collect_set("source_catalog")).alias("s"))
    multi = F.count_if(F.col("s") > 1)
    return per.agg(F.count("*").alias("n_events"), multi.alias("n_multi"), F.round(multi / F.count("*"), 6).alias("multi_share"), F.round(F.avg("n"), 6).alias("observations_per_event"), F.max("n").alias("most"))


def seen_by(matched: DataFrame, source: str) -> DataFrame:
    """anchor_id of the events that ``source`` observed."""
    return matched.select("anchor_id").distinct().join(matched.where(F.col("source_catalog") == source), "anchor_id", "left_semi")


def numbered(matched: DataFrame) -> DataFrame:
    """canonical_id, anchor_id: events numbered by the time of their anchor, ``ev_000001`` on.

    Anchors are numbered within a day and days are added up, so no task sorts the catalog.
    """
    anchors = matched.where("native_event_id = anchor_id").select("anchor_id", "origin_time", F.floor(F.unix_micros("origin_time") / 86400000000).alias("_day"))
    days = anchors.groupBy("_day").agg(F.count("*").alias("n"))
    # One row per day of the catalog, so one window over all days is small.
    before = days.select("_day", F.coalesce(F.sum("n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_day").orderBy("origin_time", "anchor_id"))
    return anchors.withColumn("_k", rank).join(before, "_day").select(F.format_string("ev_%06d", F.col("_k") + F.col("_before")).alias("canonical_id"), "anchor_id")
