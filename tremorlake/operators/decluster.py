"""Declustering by space-time windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tremorlake import constants as C
from tremorlake.functions.geo import haversine_km
from tremorlake.functions.seismo import gk_days, gk_radius_km, rupture_length_km
from tremorlake.operators.etas_blocks import _ragged
from tremorlake.operators.joins import near_cells
from tremorlake.operators.lineage import dropped, written
from tremorlake.operators.settling import settled

#: Points of a block of time that one task grows, besides those around it: at least, and at most where blocks are more
#: than tasks run at once.
BLOCK_EVENTS, MOST_EVENTS = 75_000, 1_000_000
#: Events of the first chunk of magnitudes.
CHUNK = 2_000
#: Clusters of more events are few and are broadcast.
HEAVY = 2_000


def _coverage(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b): a event of ``first`` of higher rank (magnitude, then time, then id) whose window holds b of ``second``.

    The window grows with magnitude, so buckets of time and cells of space are those of half a magnitude's widest window
    and radius. An event is dealt once to the buckets of every band from its own one up that ``first`` has, where events
    that may cover it look for it; all bands are one join.
    """
    cols = ["event_id", "t", "latitude", "longitude", "m"]
    a, b = (events.select(*[F.col(c).alias(f"{c}_{side}") for c in cols]) for events, side in ((first, "a"), (second, "b")))
    low, high, lat = first.agg(*[F.coalesce(x, F.lit(0.0)) for x in (F.min("m"), F.max("m"), F.max(F.abs("latitude")))]).first()
    lat = max(lat, second.agg(F.coalesce(F.max(F.abs("latitude")), F.lit(0.0))).first()[0])
    low = math.floor(low * 2)
    bands = range(math.floor(high * 2) - low + 1)
    band = lambda m: (F.floor(m * 2) - low).cast("int")
    top = [(low + k + 1) / 2 for k in bands]
    bucket = lambda us, m: F.floor(us / round(86400e6 * 10 ** (0.5 * m - 0.052)))
    cells = lambda side, m, around: near_cells(F.col(f"latitude_{side}"), F.col(f"longitude_{side}"), (0.1238 * m + 0.983) * 111.0, lat, around)
    us_a, us_b = F.unix_micros("t_a"), F.unix_micros("t_b")
    found = F.array(*[F.struct(F.lit(k).alias("_band"), bucket(us_b, m).alias("_k"), cells("b", m, False)[0].alias("_c")) for k, m in enumerate(top)])
    own = b.select("*", F.inline(F.filter(found, lambda x: x["_band"] >= band(F.col("m_b")))))
    mine = lambda values: F.element_at(F.array(*values), F.col("_band") + 1)
    wide = a.withColumn("_band", band(F.col("m_a"))).withColumn("_k", mine([bucket(us_a, m) for m in top]))
    wide = wide.withColumn("_c", F.explode(mine([cells("a", m, True) for m in top]))).withColumn("_k", F.explode(F.array(*[F.col("_k") + d for d in (-1, 0, 1)])))
    pairs = wide.join(own, ["_band", "_k", "_c"]).withColumnsRenamed({"event_id_a": "a", "event_id_b": "b"})
    higher = (F.col("m_a") > F.col("m_b")) | ((F.col("m_a") == F.col("m_b")) & (F.struct("t_a", "a") < F.struct("t_b", "b")))
    days = F.abs(F.unix_micros("t_b") - F.unix_micros("t_a")) / 86400e6
    near = haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b")) <= gk_radius_km(F.col("m_a"))
    return pairs.where(higher & (days <= gk_days(F.col("m_a"))) & near).select("a", "b", "m_a", "t_a", "t_b")


def _points(events: DataFrame) -> DataFrame:
    """Event of highest rank of each time and place: one window holds all events of a point or none."""
    known = events.where("t IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL AND m IS NOT NULL")
    best = F.max_by(F.struct("event_id", "m"), F.struct("m", -F.col("event_id"))).alias("o")
    return known.groupBy("t", "latitude", "longitude").agg(best).select("o.event_id", "t", "latitude", "longitude", "o.m")


def gardner_knopoff(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """event_id, seed_id, role of every event.

    An event is a mainshock iff no mainshock of higher rank covers it. Others belong to the highest-ranked mainshock that
    covers them. Mainshocks are found from large magnitudes down, in chunks that double: mainshocks so far cover most of
    a chunk, and only events that they leave are linked with each other, so that links do not grow with the density.
    """
    points = written(_points(events), "points")
    n = points.count()
    shares = []
    while n * 0.5 ** (len(shares) + 1) >= chunk:
        shares.append(1 - 0.5 ** (len(shares) + 1))
    cuts = points.agg(F.percentile_approx("m", shares, 10_000)).first()[0] if shares else []
    marks = [math.inf, *sorted(set(cuts), reverse=True), -math.inf]
    mains = None
    for high, low in zip(marks, marks[1:]):
        part = points.where((F.col("m") >= low) & ((F.col("m") < high) | F.lit(high == math.inf)))
        if mains is not None:
            taken = _coverage(mains, part).select(F.col("b").alias("event_id")).distinct()
            part = written(part.join(taken, "event_id", "left_anti"), "open")
        links = written(_coverage(part, part).select("a", "b"), "coverage")
        covered = settled(links).where("NOT seed").select(F.col("a").alias("event_id"))
        fresh = written(part.join(covered, "event_id", "left_anti"), "mainshocks")
        mains = fresh if mains is None else mains.unionByName(fresh)
    # Only a point's owner is looked for; where that is the point's own event, others of the point belong to it.
    owner = _coverage(mains, points).groupBy(F.col("b").alias("event_id")).agg(F.max_by(F.struct("a", "t_a"), F.struct("m_a", -F.unix_micros("t_a"), -F.col("a"))).alias("o"))
    place = ["t", "latitude", "longitude"]
    owned = points.join(owner, "event_id", "left").select(*place, F.coalesce("o.a", "event_id").alias("seed_id"), F.coalesce("o.t_a", "t").alias("_t"))
    out = events.select("event_id", *place, "m").join(owned, place, "left").withColumn("seed_id", F.when(F.col("m").isNull(), F.col("event_id")).otherwise(F.coalesce("seed_id", "event_id")))
    role = F.when(F.col("seed_id") == F.col("event_id"), "main").when(F.col("t") < F.col("_t"), "foreshock").otherwise("aftershock")
    return out.select("event_id", "seed_id", role.alias("role"))


def summary(clustered: DataFrame) -> DataFrame:
    """One row: events, clusters, main events alone, fore- and aftershocks of ``gardner_knopoff``'s result."""
    sizes = clustered.groupBy("seed_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "foreshock").alias("f"), F.count_if(F.col("role") == "aftershock").alias("a"))
    return sizes.agg(F.sum("n").alias("n_events"), F.count("*").alias("n_main"), F.count_if(F.col("n") == 1).alias("n_single"), F.sum("f").alias("n_foreshocks"), F.sum("a").alias("n_aftershocks"), F.max("n").alias("largest"))


def background(events: DataFrame, least: int = 10, fallback: int = 5) -> DataFrame:
    """Rows of ``events`` that are main ones; none of fewer than ``least`` events; by ``reasenberg`` where the other
    method leaves fewer than ``fallback``."""
    if events.count() < least:
        return events.where("FALSE")
    mains = events.join(written(gardner_knopoff(events).where("role = 'main'").select("event_id"), "background"), "event_id", "left_semi")
    if mains.count() >= fallback:
        return mains
    return events.join(reasenberg(events).where("event_id = main_id").select("event_id"), "event_id", "left_semi")


def _groups(us: np.ndarray, latitude: np.ndarray, longitude: np.ndarray, window: int, km: float) -> np.ndarray:
    """A number for each point, the same for points that steps of at most ``window`` and ``km`` join.

    Cells of space and time are so small that their points are near each other; cells around that are not joined yet are
    joined by any pair of their points that is near.
    """
    lat, lon = np.radians(latitude), np.radians(longitude)
    cos = np.cos(lat)
    side = 0.999 * km / math.sqrt(3)
    at = [us // window, *(np.floor(C.EARTH_RADIUS_KM * x / side).astype("int64") for x in (cos * np.cos(lon), cos * np.sin(lon), np.sin(lat)))]
    span = [int(x.max() - x.min()) + 5 for x in at]
    key, steps = np.zeros(len(us), "int64"), np.zeros(1, "int64")
    for x, n, d in zip(at, span, ([0, 1, -1], *[[0, 1, -1, 2, -2]] * 3), strict=True):
        key, steps = key * n + x - x.min() + 2, np.add.outer(steps * n, d).ravel()
    order = np.argsort(key, kind="stable")
    keys, start, size = np.unique(key[order], return_index=True, return_counts=True)
    us, lat, lon, cos = us[order], lat[order], lon[order], cos[order]
    root = np.arange(len(keys))
    for step in steps[steps > 0]:
        b = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
        a = np.flatnonzero((keys[b] == keys + step) & (root != root[b]))
        b = b[a]
        # A row for each point of the first cell, which meets all points of the second one.
        row = np.repeat(np.arange(len(a)), size[a])
        i = np.arange(len(row)) - np.repeat(np.cumsum(size[a]) - size[a], size[a]) + start[a][row]
        for r, j in _ragged(start[b][row], (start[b] + size[b])[row]):
            k = i[r]
            arc = np.sin((lat[j] - lat[k]) / 2) ** 2 + cos[k] * cos[j] * np.sin((lon[j] - lon[k]) / 2) ** 2
            near = (np.abs(us[j] - us[k]) <= window) & (2 * C.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(arc, 1.0))) <= km)
            met = np.unique(row[r[near]])
            one, other = a[met], b[met]
            while len(open_ := np.flatnonzero(root[one] != root[other])):
                one, other = root[one[open_]], root[other[open_]]
                np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
                while (root != root[root]).any():
                    root = root[root]
    out = np.empty(len(us), "int64")
    out[order] = np.repeat(root, size)
    return np.unique(out, return_inverse=True)[1]


def _grow(r, window: int, factor: float, shortest: float, max_depth: int):
    """The row of each group's seed, its time, id and size, depth of every group of one block, and whether labels were cut.

    The block's points have groups, which are always taken whole: no seed's steps are shorter than theirs. Seeds are taken
    in order of time; each takes all groups that it reaches, from points around the block that bear its label, too.
    ``depth`` counts the blocks that a label has crossed since its seed; deeper labels than ``max_depth`` are not taken over.
    """
    us, ids, group, size, as_seed = (np.asarray(x) for x in (r.o_us, r.o_event_id, r.o_grp, r.o_size, r.o_as_seed))
    lat, lon = np.radians(r.o_latitude), np.radians(r.o_longitude)
    cos = np.cos(lat)
    members = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group))
    starts = np.r_[0, ends[:-1]]
    heads = members[starts]
    far = np.flatnonzero(size > shortest)
    far = far[np.argsort(group[far], kind="stable")]
    far_ends = np.cumsum(np.bincount(group[far], minlength=len(ends)))
    open_, cut = np.ones(len(us), bool), False
    label_us, label_id, label_size, depth = us[heads], ids[heads], as_seed[heads], np.zeros(len(heads), "int64")
    own = {(us[k], ids[k]): g for g, k in enumerate(heads)}
    outside: dict[tuple[int, int], list[int]] = {}
    if r.g_block is not None and r.h_us is not None:
        named = {x: n for n, x in enumerate(zip(r.g_block, r.g_grp, strict=True))}
        which = np.array([named[x] for x in zip(r.h_block, r.h_grp, strict=True)])
        # Labels that name an event of this block which begins no group are void.
        void = np.isin(r.g_seed_id, ids)
        for k, n in enumerate(which):
            seed = (r.g_seed_us[n], r.g_seed_id[n])
            if not void[n] or seed in own:
                outside.setdefault(seed, []).append(k)

    def reached(first: int, last: int, y: float, x: float, km: float) -> np.ndarray:
        found = first + np.flatnonzero(open_[first:last])
        # Most are told by their latitude.
        found = found[np.abs(lat[found] - y) <= km / C.EARTH_RADIUS_KM * (1 + 1e-9)]
        a = np.sin((lat[found] - y) / 2) ** 2 + math.cos(y) * cos[found] * np.sin((lon[found] - x) / 2) ** 2
        return found[2 * C.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0))) <= km]

    def spread(us_: np.ndarray, lat_: np.ndarray, lon_: np.ndarray, size_: np.ndarray):
        first, last = np.searchsorted(us, us_ - window, "left"), np.searchsorted(us, us_ + window, "right")
        return lambda k, reach: reached(first[k], last[k], lat_[k], lon_[k], factor * (reach + size_[k]))

    within = spread(us, lat, lon, size)
    if outside:
        around = spread(np.asarray(r.h_us), np.radians(r.h_latitude), np.radians(r.h_longitude), np.asarray(r.h_size))
    for seed in sorted({*own, *outside}):
        mine = own.get(seed)
        if mine is not None and not open_[heads[mine]]:
            # The seed itself belongs to an earlier cluster, so labels around the block that name it are void.
            continue
        reach = as_seed[heads[mine]] if mine is not None else r.g_seed_size[which[outside[seed][0]]]

        def taken(groups: np.ndarray, level: int) -> list[int]:
            """Takes groups; their points that may reach other groups."""
            out = []
            for g in groups:
                label_us[g], label_id[g], label_size[g], depth[g] = *seed, reach, level  # noqa: B023
                open_[members[starts[g] : ends[g]]] = False
                out += (members[starts[g] : ends[g]] if reach > shortest else far[far_ends[g - 1] if g else 0 : far_ends[g]]).tolist()  # noqa: B023
            return out

        # Fewest crossings first, so that depths do not depend on the order of the search.
        levels: dict[int, list] = {0: [(True, k) for k in taken(np.array([mine]), 0)]} if mine is not None else {}
        for k in outside.get(seed, ()):
            levels.setdefault(int(r.g_depth[which[k]]) + 1, []).append((False, k))
        while levels:
            level = min(levels)
            todo = levels.pop(level)
            while todo:
                inside, k = todo.pop()
                found = (within if inside else around)(k, reach)
                if not len(found):
                    continue
                if level > max_depth:
                    cut = True
                    continue
                todo += [(True, k) for k in taken(np.unique(group[found]), level)]
    return label_us, label_id, label_size, depth, cut


def reasenberg(events: DataFrame, days: float = 30.0, factor: float = 10.0, block_events: int | None = None) -> DataFrame:
    """event_id, main_id of every event: the largest event of its cluster, the earliest of equal ones.

    The first event (by time, then id) without a cluster is the next seed. Its cluster takes every event without one
    that is within ``days``, before or after, of any member and no farther from that member than ``factor`` times
    the rupture lengths of seed and member together.

    Events of one time and place are always taken together, so they grow as one point: as a seed of its first event's size,
    as a member of its largest event's. Points of a block of time that steps of the least rupture length join are taken
    together, too; they are one group, found once. Blocks are grown each in its own task, given the labels of groups up to
    ``days`` around; rounds repeat until no label and no depth changes, and only labels of groups near a block's ends go
    from round to round. Every label then stands on a chain of links from its seed.
    """
    spark = events.sparkSession
    rows = events.select("event_id", F.unix_micros("t").alias("us"), "latitude", "longitude", "m")
    place = ["us", "latitude", "longitude"]
    known = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (*place, "m")))
    points = known.groupBy(*place).agg(F.min(F.struct("event_id", "m")).alias("o"), F.max(F.struct("m", (-F.col("event_id")).alias("_i"))).alias("g"), F.count("*").alias("n"))
    points = written(points.select(F.col("o.event_id").alias("event_id"), *place, F.col("g.m").alias("m"), rupture_length_km(F.col("g.m")).alias("size"), rupture_length_km(F.col("o.m")).alias("as_seed"), (-F.col("g._i")).alias("largest_id"), "n"), "points")
    n, shortest = points.agg(F.count("*"), F.coalesce(F.min(F.least("size", "as_seed")), F.lit(1.0))).first()
    # Labels cross a block a round, so that blocks are no more than tasks run at once, but for their size.
    count = max(1, math.ceil(n / block_events) if block_events else min(math.ceil(n / BLOCK_EVENTS), max(spark.sparkContext.defaultParallelism, math.ceil(n / MOST_EVENTS))))
    cuts = points.agg(F.percentile_approx("us", [k / count for k in range(1, count)], 100 * count)).first()[0] if count > 1 and n else []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast("array<long>")
    block = lambda x: F.size(F.filter(bounds, lambda c: c <= x))
    window = round(days * 86400e6)
    apart = lambda frame: frame.repartitionByRange(4 * count, "block")

    def grouped(rows: pd.DataFrame) -> pd.DataFrame:
        at = (rows[x].to_numpy() for x in place)
        return rows.assign(grp=_groups(*at, window, factor * (shortest + shortest)))

    placed = points.withColumn("block", block(F.col("us")))
    placed = written(apart(placed).groupBy("block").applyInPandas(grouped, StructType([*placed.schema.fields, StructField("grp", LongType())])), "groups")
    reach = F.sequence(block(F.col("us") - window), block(F.col("us") + window))
    near = placed.select(*place, "event_id", "size", F.col("block").alias("_from"), "grp", F.explode(reach).alias("block")).where("block != _from")
    listed = lambda frame, names, side: frame.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*names.values()))).alias("x")).select("block", *[F.col(f"x.{c}").alias(f"{side}_{x}") for x, c in names.items()])
    own = {x: x for x in ("us", "event_id", "latitude", "longitude", "size", "as_seed", "grp", "m", "largest_id", "n")}
    halo = {"us": "us", "event_id": "event_id", "latitude": "latitude", "longitude": "longitude", "size": "size", "block": "_from", "grp": "grp"}
    edges = near.groupBy(F.col("_from").alias("block")).agg(F.collect_set("grp").alias("e_grp"))
    dealt = listed(placed, own, "o").join(listed(near, halo, "h"), "block", "left").join(edges, "block", "left")
    dealt = written(apart(dealt), "blocks")
    met = written(near.select("block", F.col("_from"), "grp").distinct(), "met")
    label = ["block", "grp", "seed_us", "seed_id", "seed_size", "depth"]

    def around(labels: DataFrame | None, names: list[str]) -> DataFrame:
        """Blocks with what is needed of their points, and labels of the groups around them."""
        rows = dealt.select("block", "e_grp", *[f"o_{x}" for x in names], *[f"h_{x}" for x in halo])
        given = (met.join(labels.withColumnRenamed("block", "_from"), ["_from", "grp"]) if labels is not None else met.limit(0).selectExpr("block", "_from", "grp", "0L AS seed_us", "0L AS seed_id", "0D AS seed_size", "0L AS depth"))
        given = given.groupBy("block").agg(F.collect_list(F.struct("_from", *label[1:])).alias("x")).select("block", F.col("x._from").alias("g_block"), *[F.col(f"x.{c}").alias(f"g_{c}") for c in label[1:]])
        return rows.join(F.broadcast(given), "block", "left")

    def ends(max_depth: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    seed_us, seed_id, seed_size, depth, cut = _grow(r, window, factor, shortest, max_depth)
                    g = np.asarray(r.e_grp if r.e_grp is not None else (), "int64")
                    yield pd.DataFrame({"block": r.block, "grp": g, "seed_us": seed_us[g], "seed_id": seed_id[g], "seed_size": seed_size[g], "depth": depth[g], "cut": cut})

        return run

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                seed_id = _grow(r, window, factor, shortest, max_depth)[1]
                yield pd.DataFrame({"seed_id": seed_id[np.asarray(r.o_grp)], **{x: getattr(r, f"o_{x}") for x in kept}})

    labels, max_depth = None, 2 * count
    while True:
        fresh = written(around(labels, list(own)[:7]).mapInPandas(ends(max_depth), "block int, grp long, seed_us long, seed_id long, seed_size double, depth long, cut boolean"), "labels")
        changed = not fresh.isEmpty() and (labels is None or not fresh.join(labels, label, "left_anti").isEmpty())
        cut = bool(fresh.agg(F.max("cut")).first()[0])
        if labels is not None:
            dropped(labels)
        labels = fresh.drop("cut")
        if not changed and not cut:
            break
        if not changed:
            # Only what is cut off is left: either deep chains, or nothing once deeper ones have been tried.
            max_depth *= 2
    kept = [*place, "m", "largest_id", "n"]
    grown = written(around(labels, list(own)).mapInPandas(whole, "seed_id long, us long, latitude double, longitude double, m double, largest_id long, n long"), "clusters")
    dropped(dealt)
    mains = grown.groupBy("seed_id").agg(F.max_by("largest_id", F.struct("m", -F.col("us"), -F.col("largest_id"))).alias("main_id"), F.count("*").alias("n"))
    mains = written(mains, "mains")
    # A cluster may hold most of the catalog; there are few of such ones, and the others are joined by key.
    heavy = mains.where(F.col("n") > HEAVY).select("seed_id", "main_id")
    tagged = grown.select("seed_id", *place).join(F.broadcast(heavy), "seed_id", "left")
    light = tagged.where("main_id IS NULL").drop("main_id").join(mains.where(F.col("n") <= HEAVY), "seed_id")
    owned = tagged.where("main_id IS NOT NULL").select(*place, "main_id").unionByName(light.select(*place, "main_id"))
    # An event without a time, a place or a magnitude is a cluster of its own.
    alone = rows.where("NOT (" + " AND ".join(f"{c} IS NOT NULL" for c in (*place, "m")) + ")").select("event_id", F.col("event_id").alias("main_id"))
    return known.join(owned, place).select("event_id", "main_id").unionByName(alone)
