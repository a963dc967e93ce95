"""Uncertainty of rates, its propagation to probabilities, and sensitivity to choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions.quantiles import garwood, jeffreys
from tremorlake.functions.seismo import p_at_least_one
from tremorlake.operators.completeness import LOG10_E, b_value
from tremorlake.operators.intervals import uniform_prior, with_intervals
from tremorlake.operators.rates import spatial_poisson


def counts_above(events: DataFrame, thresholds: list[float], near: float = 0.41) -> DataFrame:
    """threshold, n, n_near (events within ``near`` of it), zero counts too, in one pass."""
    m = F.col("m")
    sums = events.agg(*[F.count_if(m >= t).alias(f"n{k}") for k, t in enumerate(thresholds)], *[F.count_if(F.abs(m - t) < near).alias(f"k{k}") for k, t in enumerate(thresholds)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{k}").alias("n"), F.col(f"k{k}").alias("n_near")) for k, t in enumerate(thresholds)])))


def _horizons():
    return F.inline(F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(v).alias("years")) for k, v in C.HORIZONS.items()]))


def temporal_poisson(counts: DataFrame, years: float) -> DataFrame:
    """threshold, horizon, n, rate, expected number, P and its bounds from the exact interval of the rate."""
    rows = with_intervals(counts, "n", years).select("*", _horizons())
    p = lambda c: F.round(p_at_least_one(c, F.col("years")), 6)
    rate = F.col("n") / years
    return rows.select("threshold", "horizon", "n", F.round(rate, 6).alias("rate"), F.round(rate * F.col("years"), 6).alias("expected"), p(rate).alias("p"), p(F.col("rate_lower")).alias("p_lower"), p(F.col("rate_upper")).alias("p_upper"))


def large_events(counts: DataFrame, years: float, horizons: tuple[str, ...] = ("30d", "1y")) -> DataFrame:
    """Rates with three kinds of interval, how much the prior matters, P with Jeffreys bounds, sufficiency."""
    rows = counts
    for name, law in (("garwood", garwood), ("jeffreys", jeffreys), ("uniform", uniform_prior)):
        rows = with_intervals(rows, "n", years, law, (f"{name}_lower", f"{name}_upper"))
    n, rate = F.col("n"), F.col("n") / years
    note = F.when(n == 0, "none observed: an upper bound only").when(n < 5, "few observed: indicative").when(n < 20, "limited precision").otherwise("sufficient")
    bounds = [f"{name}_{side}" for name in ("garwood", "jeffreys", "uniform") for side in ("lower", "upper")]
    ps = [F.round(p_at_least_one(x, C.HORIZONS[h]), 6).alias(f"p_{h}{s}") for h in horizons for x, s in ((rate, ""), (F.col("jeffreys_lower"), "_lower"), (F.col("jeffreys_upper"), "_upper"))]
    return rows.select("threshold", "n", F.round(rate, 6).alias("rate"), *[F.round(c, 6).alias(c) for c in bounds], F.round(F.col("jeffreys_upper") / F.col("uniform_upper"), 6).alias("prior_ratio"), *ps, (n >= 20).alias("sufficient"), note.alias("note"))


def propagated(events: DataFrame, thresholds: list[float], years: float, flipped: float = 0.3) -> DataFrame:
    """Rates with counting uncertainty (half the exact interval) and that of conversion (a share ``flipped`` of the
    events near the threshold), and both carried over to P by the slope of 1 - exp(-rate t)."""
    rows = with_intervals(counts_above(events, thresholds), "n", years)
    rate = F.col("n") / years
    aleatory, epistemic = (F.col("rate_upper") - F.col("rate_lower")) / 2, flipped * F.col("n_near") / years
    total = F.sqrt(aleatory * aleatory + epistemic * epistemic)
    ps = []
    for h in ("7d", "30d"):
        t = C.HORIZONS[h]
        ps += [F.round(p_at_least_one(rate, t), 6).alias(f"p_{h}"), F.round(F.exp(-rate * t) * total * t, 6).alias(f"p_{h}_total")]
    return rows.select("threshold", "n", "n_near", F.round(rate, 6).alias("rate"), F.round(aleatory, 6).alias("aleatory"), F.round(epistemic, 6).alias("epistemic"), F.round(total, 6).alias("total"), *ps)


def documents(cells: DataFrame, years: float, horizon: float) -> DataFrame:
    """Per threshold the summed rate, P with bounds, and the cells (a grid's, so few) as one text. ``cells``: cell_id, n and bounds."""
    p = lambda c: F.round(p_at_least_one(c, horizon), 6)
    rate = F.sum("n") / years
    line = F.concat(F.col("cell_id"), F.lit("="), F.col("n").cast("string"))
    return cells.groupBy("threshold").agg(F.round(rate, 6).alias("rate"), p(rate).alias("p"), p(F.sum("rate_lower")).alias("p_lower"), p(F.sum("rate_upper")).alias("p_upper"), F.array_join(F.array_sort(F.collect_list(line)), ";").alias("cells"))


def mc_sensitivity(events: DataFrame, mcs: list[float], targets: list[float], years: float) -> DataFrame:
    """Per completeness magnitude b, the rate above it, its probabilities, and yearly P of larger events by the law."""
    fits = b_value(events, mcs).select("mc", "n", "b", "a")
    above = counts_above(events, mcs).select(F.col("threshold").alias("mc"), F.col("n").alias("n_above"))
    rate = F.col("n_above") / years
    law = lambda t: 1 - F.exp(-F.pow(F.lit(10.0), F.col("a") - F.col("b") * t) / years)
    return fits.join(above, "mc").select("mc", "n", "b", F.round(rate, 6).alias("rate"), *[F.round(p_at_least_one(rate, v), 6).alias(f"p_{k}") for k, v in C.HORIZONS.items()], *[F.round(law(t), 6).alias(f"p_year_{round(t * 10)}") for t in targets])


def grid_sensitivity(events: DataFrame, sizes: list[float], threshold: float, days: float, origin: int) -> DataFrame:
    """Per cell size the scores of one origin's forecast."""
    p, y = F.col("p"), F.col("y")
    parts = [spatial_poisson(events, threshold, days, origin, origin, size=s).agg(F.lit(float(s)).alias("size"), F.count("*").alias("n_cells"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.sum(p), 6).alias("sum_p"), F.round(F.max(p), 6).alias("max_p")) for s in sizes]
    return reduce(DataFrame.unionByName, parts)


def source_sensitivity(obs: DataFrame, mc: float, years: float) -> DataFrame:
    """Per source, and over all, the observations, the rate from ``mc`` on and b."""
    m = F.col("original_magnitude")
    tagged = obs.select(m, F.explode(F.array("source_catalog", F.lit("all"))).alias("source"))
    mine = m >= mc - 0.05
    stats = tagged.groupBy("source").agg(F.count("*").alias("n"), F.count_if(m >= mc).alias("n_mc"), F.count_if(mine).alias("n_b"), F.avg(F.when(mine, m)).alias("mean_b"))
    b = F.when(F.col("n_b") >= 20, LOG10_E / (F.col("mean_b") - (mc - 0.05))).otherwise(1.0)
    return stats.select("source", "n", F.round(F.col("n_mc") / years, 6).alias(f"rate_{round(mc * 10)}"), F.round(b, 6).alias("b"))
