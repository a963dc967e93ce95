"""Joins in time and space that stay equi-joins on buckets, so that no pair outside the window is made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as C

#: Rows of a dimension (grid, origins, parameters) that may be broadcast.
MAX_BROADCAST_ROWS = 100_000


def small(frame: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``frame`` marked for broadcast, after a check that it is a dimension: at most ``most`` rows."""
    if frame.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for a dimension of {frame.columns}")
    return F.broadcast(frame)


def seconds(t: Column) -> Column:
    return F.unix_micros(t) / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86400e6


def interval_join(left: DataFrame, right: DataFrame, t_left: str, t_right: str, window_s: float, forward: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with 0 < right - left <= window (``forward``), or |right - left| <= window.

    Time is cut into buckets of the window's width; a left row meets its own bucket and the next one (or both
    neighbours), so each pair is made in exactly one bucket. Column names must differ, but for those of ``on``, which
    both sides have and pairs agree in.
    """
    width = max(1, round(window_s * 1e6))
    micros = lambda c: F.unix_micros(F.col(c))
    reach = [0, 1] if forward else [-1, 0, 1]
    a = left.withColumn("_b", F.explode(F.array(*[F.floor(micros(t_left) / width) + k for k in reach])))
    b = right.withColumn("_b", F.floor(micros(t_right) / width))
    gap = micros(t_right) - micros(t_left)
    within = (gap > 0) & (gap <= width) if forward else F.abs(gap) <= width
    return a.join(b, ["_b", *on]).where(within).drop("_b")


def near_cells(lat: Column, lon: Column, radius_km: float, max_abs_lat: float, around: bool) -> Column:
    """Cells of at least ``radius_km`` on both axes as an array: the point's own one, or those ``around`` it too.

    Two points within the radius are in the same cell or in neighbours, also across the date line; where the radius
    reaches a pole, all longitudes are one cell.
    """
    reach = radius_km / C.EARTH_RADIUS_KM * (1 + 1e-9)
    high, steps = math.radians(max_abs_lat), (-1, 0, 1) if around else (0,)
    n = 1 if reach + high >= math.pi / 2 else math.floor(2 * math.pi / math.asin(math.sin(reach) / math.cos(high)))
    i, j = F.floor(F.radians(lat) / reach), F.floor((lon + 180) / 360 * n)
    return F.array_distinct(F.array(*[F.struct((i + di).alias("i"), F.pmod(j + dj, F.lit(n)).alias("j")) for di in steps for dj in steps]))


def touched_cells(lat: Column, lon: Column, radius_km: float, max_abs_lat: float, times: int = 4) -> tuple[Column, Column]:
    """The point's own cell, and all that ``radius_km`` around it touches; cells are ``times`` (2 at least) radii wide.

    Most points touch one cell or two of these, where cells as narrow as the radius would take nine.
    """
    r = radius_km / C.EARTH_RADIUS_KM * (1 + 1e-9)
    reach, high = r * times, math.radians(max_abs_lat)
    n = 1 if reach + high >= math.pi / 2 else math.floor(2 * math.pi / math.asin(math.sin(reach) / math.cos(high)))
    aside = 0.0 if n == 1 else math.degrees(math.asin(math.sin(r) / math.cos(high))) * (1 + 1e-9)
    i = lambda up: F.floor((F.radians(lat) + up) / reach).alias("i")
    j = lambda right: F.pmod(F.floor((lon + 180 + right) / 360 * n), F.lit(n)).alias("j")
    return F.struct(i(0.0), j(0.0)), F.array_distinct(F.array(*[F.struct(i(y), j(x)) for y in (-r, r) for x in (-aside, aside)]))


def grid(spark, size: float = 1.0) -> DataFrame:
    """All cells, also those without events: i_lat, i_lon, cell_id, lat_center, lon_center."""
    n_lat, n_lon = round((C.MAX_LAT - C.MIN_LAT) / size), round((C.MAX_LON - C.MIN_LON) / size)
    return spark.range(n_lat * n_lon).select(
        F.floor(F.col("id") / n_lon).cast("int").alias("i_lat"),
        (F.col("id") % n_lon).cast("int").alias("i_lon"),
    ).select(
        "i_lat",
        "i_lon",
        F.format_string("cell_%02d_%02d", "i_lat", "i_lon").alias("cell_id"),
        (C.MIN_LAT + (F.col("i_lat") + 0.5) * size).alias("lat_center"),
        (C.MIN_LON + (F.col("i_lon") + 0.5) * size).alias("lon_center"),
    )


def neighbours(cells: DataFrame, itself: bool) -> DataFrame:
    """(i_lat, i_lon, n_lat, n_lon): the cells around each cell of a full grid."""
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    out = cells.select("i_lat", "i_lon").withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    if not itself:
        out = out.where("di <> 0 OR dj <> 0")
    return out.select("i_lat", "i_lon", (F.col("i_lat") + F.col("di")).alias("n_lat"), (F.col("i_lon") + F.col("dj")).alias("n_lon"))


def yearly_origins(spark, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.make_timestamp(F.col("id").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("origin"))


def by_origin(events: DataFrame, first: int, last: int) -> DataFrame:
    """Adds ``since``: the first yearly origin (a year) whose history holds the event; later events go."""
    since = F.greatest(F.year("t") + 1, F.lit(first))
    return events.withColumn("since", since).where(F.col("since") <= last)


def asof_backward(probes: DataFrame, events: DataFrame, t_probe: str, t_event: str, values: list[str]) -> DataFrame:
    """The values of the latest event strictly before each probe; null where there is none.

    Probes are a small dimension: events are reduced per probe by a partial aggregate, nothing is sorted.
    """
    packed = F.struct(F.col(t_event), *values)
    joined = probes.join(events, F.col(t_event) < F.col(t_probe), "left")
    return joined.groupBy(*probes.columns).agg(F.max(packed).alias("_e")).select(*probes.columns, *[F.col(f"_e.{v}").alias(v) for v in [t_event, *values]])


def counted_before(probes: DataFrame, events: DataFrame, at: str, t: str, inclusive: bool = False) -> DataFrame:
    """Adds n_before to ``probes``: events with t < at (<= with ``inclusive``). ``at``: microseconds; ``t``: a timestamp.

    Probes and events are sorted together within a day, and days are added up, so no pair is made.
    """
    day = lambda c: F.floor(c / 86400000000)
    us = F.unix_micros(t)
    days = events.groupBy(day(us).alias("_day")).agg(F.count("*").alias("n"))
    # A row per day of the catalog or of the probes.
    every = days.unionByName(probes.select(day(F.col(at)).alias("_day"), F.lit(0).cast("long").alias("n")).distinct()).groupBy("_day").agg(F.sum("n").alias("n"))
    before = every.select("_day", F.coalesce(F.sum("n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    marked = probes.select(F.struct(*probes.columns).alias("_probe"), F.col(at).alias("_us"), F.lit(0).cast("long").alias("_one"))
    others = events.select(F.lit(None).cast(marked.schema["_probe"].dataType).alias("_probe"), us.alias("_us"), F.lit(1).cast("long").alias("_one"))
    rows = marked.unionByName(others).withColumn("_day", day(F.col("_us")))
    # Of equal times, events that count come first.
    order = F.col("_one") if not inclusive else -F.col("_one")
    seen = F.sum("_one").over(Window.partitionBy("_day").orderBy("_us", order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_seen", seen).where("_probe IS NOT NULL").join(before, "_day").select("_probe.*", (F.col("_seen") + F.col("_before")).alias("n_before"))
