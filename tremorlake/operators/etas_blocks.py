"""Kernel sums over blocks of events: a row holds a block's events and all earlier ones that can trigger them.

Blocks are dealt and written once. Each pass of a fit then reads them, evaluates all its kernels within a block, and
shuffles no event again. Events of one time, place and magnitude are one point with their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.operators.joins import near_cells
from tremorlake.operators.lineage import written

DAY_US = 86400000000
#: Points whose sums a block asks for, and how often buckets as wide as the longest lag are halved at most.
MOST_IN_TIME, MOST_IN_SPACE, MOST_HALVINGS = 20_000, 2_000, 3
#: Pairs that a task holds at once.
PAIRS = 500_000
#: Pairs whose columns stay in a core's cache, and pairs of a block from which its points are split by place.
CACHED, SPLIT = 60_000, 1_000_000
#: As in the tree of ``etas``: buckets of a block are halved until an event shares its own with few others, a bucket is
#: a whole if an event is ``APART`` widths away, and has ``MOMENTS`` moments.
WIDEST, HALVINGS, SHARED, APART, MOMENTS = 8, 24, 12, 4, 10
LN10 = math.log(10)


def _dealt(targets: DataFrame, sources: DataFrame, keys: list[str], limit: int, most: int, of_target: list[str], of_source: list[str]) -> DataFrame:
    """A row for each block of ``targets``: arrays t_<name> of its points, and s_<name> of all points of ``sources`` up to
    ``limit`` before them, both by time. Where halved buckets still hold more than ``most``, their targets are dealt to parts."""
    counted = lambda width: targets.groupBy(*keys, F.floor(F.col("us") / width).cast("long").alias("_k")).agg(F.count("*").alias("_n"))
    n = counted(limit).agg(F.max("_n")).first()[0] or 0
    width = max(1, limit >> min(MOST_HALVINGS, max(0, math.ceil(math.log2(max(n, 1) / most)))))
    bucket = lambda us: F.floor(us / width).cast("long")
    parts = counted(width).select(*keys, "_k", F.ceil(F.col("_n") / most).alias("_parts"))
    by = [*keys, "_k", "_part"]
    listed = lambda rows, names, side: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("x")).select(*by, *[F.col(f"x.{c}").alias(f"{side}_{c}") for c in names])
    mine = targets.withColumn("_k", bucket(F.col("us"))).join(parts, by[:-1]).withColumn("_part", F.pmod(F.xxhash64(*of_target), "_parts"))
    reach = F.sequence(bucket(F.col("us")), bucket(F.col("us") + limit))
    back = sources.withColumn("_k", F.explode(reach)).join(parts, by[:-1]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    spark = targets.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return written(listed(mine, of_target, "t").join(listed(back, of_source, "s"), by).drop(*by).repartition(files), "blocks")


def in_time(events: DataFrame, max_days: float) -> DataFrame:
    """Blocks of time of ``events`` (t, m)."""
    points = written(events.groupBy(F.unix_micros("t").alias("us"), "m").agg(F.count("*").alias("n")), "points")
    return _dealt(points, points, [], round(max_days * DAY_US), MOST_IN_TIME, ["us", "m", "n"], ["us", "m", "n"])


def in_space(events: DataFrame, max_days: float, reach_km: float) -> DataFrame:
    """Blocks of time and space of ``events`` (t, latitude, longitude, m, density): cells of the reach with all around."""
    place = ["latitude", "longitude", "m", "density"]
    points = written(events.groupBy(F.unix_micros("t").alias("us"), *place).agg(F.count("*").alias("n")), "points")
    lat = points.agg(F.coalesce(F.max(F.abs("latitude")), F.lit(0.0))).first()[0]
    cells = lambda around: near_cells(F.col("latitude"), F.col("longitude"), reach_km, lat, around)
    targets, sources = points.withColumn("_c", cells(False)[0]), points.withColumn("_c", F.explode(cells(True)))
    return _dealt(targets, sources, ["_c"], round(max_days * DAY_US), MOST_IN_SPACE, ["us", *place, "n"], ["us", "latitude", "longitude", "m", "n"])


def _ragged(low: np.ndarray, high: np.ndarray, pairs: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and element of the ranges [low, high) of all rows, some ``pairs`` (``PAIRS``) at a time."""
    pairs = pairs or PAIRS
    size = np.maximum(high - low, 0)
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + pairs, "right")))
        some = size[a:z]
        before = np.repeat(np.cumsum(some) - some, some)
        yield np.repeat(np.arange(a, z), some), np.arange(some.sum()) - before + np.repeat(low[a:z], some)
        a = z


def tree_sums(tb: np.ndarray, ta: np.ndarray, m: np.ndarray, n: np.ndarray, kernels: list[tuple[float, float, float]], limit: int) -> np.ndarray:
    """s, s_alpha, s_c, s_q (kernel, sum, target) at the sorted times ``tb`` from the sorted ``ta`` up to ``limit`` before;
    ``m``: magnitudes above the threshold, ``n``: weights. ``kernels``: alpha, c, q.

    Near pairs one by one, buckets that double with the lag by the moments of their weights, as ``etas.TimeTree`` has it.
    """
    out = np.zeros((len(kernels), 4, len(tb)))
    finest = max(1, -(-limit // (WIDEST << HALVINGS)))
    lowest = 0
    for level in range(HALVINGS, -1, -1):
        own = np.unique(ta // finest >> level, return_counts=True)[1].astype(float)
        if (own * own).sum() <= SHARED * len(ta):
            lowest = level
            break
    width, top = finest << lowest, HALVINGS - lowest
    b, sb, first = tb // width, ta // width, (tb - limit) // width + 1
    weights = [n * 10 ** (alpha * m) for alpha, _, _ in kernels]

    oldest, latest = np.searchsorted(ta, tb - limit), np.searchsorted(ta, tb)
    near = np.searchsorted(sb, b - APART)
    split = first - 1 < b - APART
    for low, high in ((np.where(split, near, oldest), latest), (oldest, np.where(split, np.searchsorted(sb, first), oldest))):
        for i, j in _ragged(low, high):
            lag = (tb[i] - ta[j]) / DAY_US
            for g, (_, c, q) in enumerate(kernels):
                x = lag + c
                log = np.log(x)
                v = weights[g][j] * np.exp(-q * log)
                for d, value in enumerate((v, LN10 * m[j] * v, -q * v / x, -log * v)):
                    out[g, d] += np.bincount(i, value, len(tb))

    for k in range(top + 1):
        wide = width << k
        end, start = (b >> k) - APART - 1, -(-first >> k)
        begin = np.maximum(start, 2 * ((b >> (k + 1)) - APART)) if k < top else start
        spans = [(begin <= end - o, end - o) for o in range(max(0, int((end - begin).max()) + 1))]
        if k < top:
            # Of the first bucket the parent may begin too early.
            spans.append(((start % 2 == 1) & (start < begin) & (start <= end), start))
        ids, at = np.unique(sb >> k, return_index=True)
        i, p = [], []
        for held, which in spans:
            row = np.flatnonzero(held)
            place = np.minimum(np.searchsorted(ids, which[row]), len(ids) - 1)
            met = ids[place] == which[row]
            i.append(row[met])
            p.append(place[met])
        i, p = (np.concatenate(x) if x else np.zeros(0, int) for x in (i, p))
        if not len(i):
            continue
        d = (ta - (sb >> k) * wide - wide / 2) / DAY_US
        lag = (tb[i] - ids[p] * wide - wide / 2) / DAY_US
        powers = [np.ones(len(ta))]
        for _ in range(MOMENTS - 1):
            powers.append(powers[-1] * d)
        for g, (_, c, q) in enumerate(kernels):
            x = lag + c
            y, log = 1 / x, np.log(x)
            acc = np.zeros((4, len(i)))
            factor, harmonic, terms = 1.0, 0.0, []
            for j in range(MOMENTS):
                terms.append((factor, harmonic))
                harmonic, factor = harmonic + 1 / (q + j), factor * (q + j) / (j + 1)
            for j in range(MOMENTS - 1, -1, -1):
                factor, harmonic = terms[j]
                moment = factor * np.add.reduceat(weights[g] * powers[j], at)
                slope = factor * np.add.reduceat(weights[g] * powers[j] * m, at)
                mine = moment[p]
                acc *= y
                acc[0] += mine
                acc[1] += slope[p]
                acc[2] += (q + j) * mine
                acc[3] += harmonic * mine
            v = np.exp(-q * log)
            for e, value in enumerate((v * acc[0], LN10 * v * acc[1], -v * y * acc[2], v * (acc[3] - log * acc[0]))):
                out[g, e] += np.bincount(i, value, len(tb))
    return out


def sums_in_time(blocks: DataFrame, kernels: list[tuple[int, float, float, float]], mc: float, max_days: float) -> DataFrame:
    """theta_id, us, m, n, s, s_alpha, s_c, s_q of every point of ``in_time`` under each of ``kernels`` (id, alpha, c, q)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                tb, ta, m, n = (np.asarray(x) for x in (r.t_us, r.s_us, r.s_m, r.s_n))
                found = tree_sums(tb, ta, m - mc, n.astype(float), [x[1:] for x in kernels], round(max_days * DAY_US))
                for g, x in enumerate(kernels):
                    yield pd.DataFrame({"theta_id": np.int32(x[0]), "us": tb, "m": r.t_m, "n": r.t_n, **dict(zip(("s", "s_alpha", "s_c", "s_q"), found[g], strict=True))})

    return blocks.mapInPandas(run, "theta_id int, us long, m double, n long, s double, s_alpha double, s_c double, s_q double")


#: Cells of the whole time whose points are counted on the driver to find the width of a block.
COUNTED = 4096


def _block_width(points: DataFrame, low: int, high: int) -> int:
    """Of the whole time, halved as often as it takes until no block holds more than ``MOST_IN_TIME`` points."""
    span = high - low + 1
    cell = -(-span // COUNTED)
    counts = np.zeros(COUNTED, int)
    for r in points.groupBy(F.floor((F.col("us") - low) / cell).cast("int").alias("k")).agg(F.count("*").alias("n")).collect():
        counts[r["k"]] = r["n"]
    most = [int(counts.reshape(2**j, -1).sum(axis=1).max()) for j in range(COUNTED.bit_length())]
    fine = next((j for j, n in enumerate(most) if n <= MOST_IN_TIME), None)
    if fine is None:
        return max(1, cell >> math.ceil(math.log2(most[-1] / MOST_IN_TIME)))
    return cell * (COUNTED >> fine)


def all_before(events: DataFrame, alpha: float, c: float, q: float, mc: float) -> DataFrame:
    """us, s: the sum of 10 ** (alpha * (m - mc)) * (lag + c) ** -q over all events of ``events`` (t, m) before each time of one.

    A block takes the points of its own and of the ``APART`` blocks before it, and of earlier ones the moments of ever
    wider buckets: a row for each block and bucket, none for each event.
    """
    points = written(events.where(F.col("t").isNotNull()).groupBy(F.unix_micros("t").alias("us"), "m").agg(F.count("*").alias("n")), "points")
    low, high = points.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return points.selectExpr("us", "CAST(NULL AS DOUBLE) AS s")
    width = _block_width(points, low, high)
    top = ((high - low) // width).bit_length()
    placed = points.withColumn("_k", F.floor((F.col("us") - low) / width).cast("long"))
    parts = placed.groupBy("_k").agg(F.ceil(F.count("*") / MOST_IN_TIME).alias("_parts"))
    part = F.pmod(F.xxhash64("us"), "_parts")
    mine = placed.join(parts, "_k").groupBy("_k", part.alias("_part")).agg(F.sort_array(F.collect_set("us")).alias("t_us"))
    near = placed.withColumn("_k", F.explode(F.sequence(F.col("_k"), F.col("_k") + APART))).join(parts.select("_k"), "_k")
    listed = near.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("us", "m", "n"))).alias("x")).select("_k", *[F.col(f"x.{x}").alias(f"s_{x}") for x in ("us", "m", "n")])

    middle = low + F.expr(f"shiftleft({width}L, _l)") * (F.col("_b") + 0.5)
    marks = F.array(*[F.struct(F.lit(j).alias("_l"), F.shiftright("_k", j).alias("_b")) for j in range(top + 1)])
    spread = placed.select("us", "m", "n", F.inline(marks)).withColumn("_d", (F.col("us") - middle) / DAY_US)
    weight, power, moments = F.col("n") * F.pow(F.lit(10.0), alpha * (F.col("m") - mc)), F.lit(1.0), []
    for _ in range(MOMENTS):
        moments.append(F.sum(weight * power))
        power = power * F.col("_d")
    buckets = spread.groupBy("_l", "_b").agg(F.array(*moments).alias("_m")).withColumn("_at", middle)
    on_level = lambda j: lambda x: F.struct(F.lit(j).alias("_l"), x.alias("_b"))
    spans = []
    for j in range(top):
        begin, end = F.greatest(F.lit(0).cast("long"), 2 * (F.shiftright("_k", j + 1) - APART)), F.shiftright("_k", j) - APART - 1
        spans.append(F.when(begin <= end, F.transform(F.sequence(begin, end), on_level(j))))
    none = F.array().cast("array<struct<_l:int,_b:bigint>>")
    met = parts.select("_k", F.inline(F.concat(none, *[F.coalesce(x, none) for x in spans]))).join(buckets, ["_l", "_b"])
    far = met.groupBy("_k").agg(F.collect_list("_at").alias("f_at"), F.collect_list("_m").alias("f_m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                tb, ta, m, n = (np.asarray(x) for x in (r.t_us, r.s_us, r.s_m, r.s_n))
                s = tree_sums(tb, ta, m - mc, n.astype(float), [(alpha, c, q)], (APART + 1) * width)[0, 0]
                for at, sums in zip(r.f_at if r.f_at is not None else (), r.f_m if r.f_m is not None else (), strict=True):
                    base = (tb - at) / DAY_US + c
                    y, term, factor = 1 / base, np.zeros(len(tb)), np.ones(MOMENTS)
                    for j in range(1, MOMENTS):
                        factor[j] = factor[j - 1] * (q + j - 1) / j
                    for j in range(MOMENTS - 1, -1, -1):
                        term = term * y + factor[j] * sums[j]
                    s += term * base**-q
                # Without earlier events there is no row, as in kernel_sums.
                yield pd.DataFrame({"us": tb, "s": s})[tb > low]

    spark = events.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return mine.join(listed, "_k").join(far, "_k", "left").drop("_k", "_part").repartition(files).mapInPandas(run, "us long, s double")


SPACE_SUMS = ("s", "s_alpha", "s_c", "s_p", "s_sigma_km", "s_gamma", "s_q")


def _unit(lat, lon) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.array([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def _neighbours(here: np.ndarray, there: np.ndarray, chord: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points of one place ``here`` and those of ``there`` that may be within ``chord`` of one of them, both rising."""
    if here.shape[1] * there.shape[1] <= SPLIT:
        yield np.arange(here.shape[1]), np.arange(there.shape[1])
        return
    cells = np.unique(np.floor(here * (4 / chord)).astype("int64"), axis=1, return_inverse=True)[1].ravel()
    for part in np.split(np.argsort(cells, kind="stable"), np.cumsum(np.bincount(cells))[:-1]):
        middle = here[:, part].mean(axis=1)[:, None]
        wide = np.sqrt(((here[:, part] - middle) ** 2).sum(axis=0).max()) + chord * (1 + 1e-9)
        yield part, np.flatnonzero(((there - middle) ** 2).sum(axis=0) <= wide * wide)


def _block_in_space(r, thetas: list[dict], mc: float, limit: int, chord: float) -> np.ndarray:
    """``SPACE_SUMS`` (theta, sum, point) of a block's points, pair by pair."""
    tb, ta, m = np.asarray(r.t_us), np.asarray(r.s_us), np.asarray(r.s_m) - mc
    here, there = _unit(r.t_latitude, r.t_longitude), _unit(r.s_latitude, r.s_longitude)
    out = np.zeros((len(thetas), len(SPACE_SUMS), len(tb)))
    weight = [r.s_n * np.exp((x["alpha"] * LN10 - 2 * x["gamma"]) * m) * (x["q"] / (math.pi * x["sigma_km"] ** 2)) for x in thetas]
    inverse = [np.exp(-2 * x["gamma"] * m) / x["sigma_km"] ** 2 for x in thetas]
    for mine, theirs in _neighbours(here, there, chord):
        times = ta[theirs]
        for i, j in _ragged(np.searchsorted(times, tb[mine] - limit), np.searchsorted(times, tb[mine]), CACHED):
            i, j = mine[i], theirs[j]
            gap = (here[0][i] - there[0][j]) ** 2
            for d in (1, 2):
                gap += (here[d][i] - there[d][j]) ** 2
            near = np.flatnonzero(gap <= chord * chord)
            if not len(near):
                continue
            i, j = i[near], j[near]
            r2 = (2 * C.EARTH_RADIUS_KM * np.arcsin(np.sqrt(gap[near]) / 2)) ** 2
            lag, above = (tb[i] - ta[j]) / DAY_US, m[j]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            rows = i[first]
            for g, x in enumerate(thetas):
                t, stretched = lag + x["c"], 1 + r2 * inverse[g][j]
                flat, log = np.log(stretched), np.log(t)
                v = weight[g][j] * np.exp(-x["p"] * log - (1 + x["q"]) * flat)
                w = v / stretched
                for d, value in enumerate((v, v * above, v / t, v * log, w, w * above, v * flat)):
                    out[g, d, rows] += np.add.reduceat(value, first)
    for g, x in enumerate(thetas):
        s, by_m, by_lag, by_log, w, w_by_m, by_flat = out[g].copy()
        q = x["q"]
        out[g] = s, LN10 * by_m, -x["p"] * by_lag, -by_log, 2 * (q * s - (1 + q) * w) / x["sigma_km"], 2 * (q * by_m - (1 + q) * w_by_m), s / q - by_flat
    return out


def _limits(max_days: float, reach_km: float) -> tuple[int, float]:
    return round(max_days * DAY_US), 2 * math.sin(min(math.pi / 2, reach_km / C.EARTH_RADIUS_KM / 2))


def sums_in_space(blocks: DataFrame, thetas: list[dict], mc: float, max_days: float, reach_km: float) -> DataFrame:
    """theta_id, us, m, n, density and ``SPACE_SUMS`` of every point of ``in_space`` under each of ``thetas``."""
    limit, chord = _limits(max_days, reach_km)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                for x, found in zip(thetas, _block_in_space(r, thetas, mc, limit, chord), strict=True):
                    yield pd.DataFrame({"theta_id": np.int32(x["theta_id"]), "us": r.t_us, "m": r.t_m, "n": r.t_n, "density": r.t_density, **dict(zip(SPACE_SUMS, found, strict=True))})

    return blocks.mapInPandas(run, "theta_id int, us long, m double, n long, density double, " + ", ".join(f"{x} double" for x in SPACE_SUMS))


def likelihoods_in_space(blocks: DataFrame, thetas: list[dict], mc: float, end: int, days: float, max_days: float, reach_km: float) -> DataFrame:
    """theta_id, nll, d_<name>, i_<name>_<name> as ``etas.nll_in_space`` has them, added up within the blocks of ``in_space``.

    ``end``: microseconds of the catalog's last event; ``days``: its length.
    """
    limit, chord = _limits(max_days, reach_km)
    names = ("mu_per_year", "k", "alpha", "c", "p", "sigma_km", "gamma", "q")
    upper = np.triu_indices(len(names))
    columns = ["nll", *[f"d_{x}" for x in names], *[f"i_{names[a]}_{names[b]}" for a, b in zip(*upper, strict=True)]]

    def summed(r, x: dict, sums: np.ndarray) -> list[float]:
        k, c, p = x["k"], x["c"], x["p"]
        s, by_alpha, by_c, by_p, *by_place = sums
        n, density = np.asarray(r.t_n, float), np.asarray(r.t_density)
        scale = k * (p - 1) * c ** (p - 1)
        held = np.maximum(x["mu_per_year"] / 365.25 * density + scale * s, 1e-30)
        slopes = [density / 365.25, scale / k * s, scale * by_alpha, scale * ((p - 1) / c * s + by_c), scale * ((1 / (p - 1) + math.log(c)) * s + by_p), *[scale * y for y in by_place]]
        scores = np.array(slopes) / held
        above, left = np.asarray(r.t_m) - mc, np.minimum((end - np.asarray(r.t_us)) / DAY_US, float(max_days))
        w, part = 10 ** (x["alpha"] * above), c / (left + c)
        over = part ** (p - 1)
        made = w * (1 - over)
        totals = {"k": made, "alpha": k * LN10 * made * above, "c": -k * w * (p - 1) * over * left / (c * (left + c)), "p": -k * w * over * np.log(part)}
        d = [float(n @ (totals.get(name, 0.0) - score)) for name, score in zip(names, scores, strict=True)]
        return [x["theta_id"], float(n @ (k * made - np.log(held))), *d, *((scores * n) @ scores.T)[upper]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                found = _block_in_space(r, thetas, mc, limit, chord)
                yield pd.DataFrame([summed(r, x, sums) for x, sums in zip(thetas, found, strict=True)], columns=["theta_id", *columns])

    parts = blocks.mapInPandas(run, "theta_id int, " + ", ".join(f"{x} double" for x in columns))
    years = days / 365.25
    rates = F.create_map(*[F.lit(y) for x in thetas for y in (x["theta_id"], x["mu_per_year"])])
    return parts.groupBy("theta_id").agg(*[F.sum(x).alias(x) for x in columns]).withColumns({"nll": F.col("nll") + F.element_at(rates, F.col("theta_id")) * years, "d_mu_per_year": F.col("d_mu_per_year") + years})
