"""Magnitude completeness and frequency-magnitude statistics. All work on counts per 0.1 bin after one shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.seismo import magnitude_bin

LOG10_E = math.log10(math.e)


def fmd(events: DataFrame) -> DataFrame:
    """bin, n, sum_m: counts per 0.1 magnitude bin (bin 41 is 4.1 to 4.2)."""
    return events.groupBy(magnitude_bin(F.col("m")).alias("bin")).agg(F.count("*").alias("n"), F.sum("m").alias("sum_m"))


def reverse_cumulative(bins: DataFrame) -> DataFrame:
    """Adds n_above: events in the bin and all higher ones. At most a hundred rows, so one window is enough."""
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumns({"n_above": F.sum("n").over(above), "sum_above": F.sum("sum_m").over(above)})


def mc_maxc(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Centre of the fullest bin (the lowest of equals), per group."""
    by = by or []
    counts = events.groupBy(*by, magnitude_bin(F.col("m")).alias("bin")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("x"), F.sum("n").alias("n_events"))
    return best.select(*by, F.round((-F.col("x.b") + 0.5) / 10, 6).alias("mc"), F.lit(0.05).alias("uncertainty"), "n_events")


def mc_gft(events: DataFrame, least: int = 10) -> DataFrame:
    """Per candidate bin the goodness of fit R of the Gutenberg-Richter law: mc, b, n_above, r."""
    bins = reverse_cumulative(fmd(events))
    cand = bins.where(F.col("n_above") >= least).select(F.col("bin").alias("c"), F.col("n_above").alias("n_c"), (F.col("sum_above") / F.col("n_above")).alias("mean_c"))
    b = LOG10_E / (F.col("mean_c") - F.col("c") / 10.0)
    pairs = F.broadcast(cand.withColumn("b", b)).join(bins.select("bin", "n_above"), F.col("bin") >= F.col("c"))
    model = F.col("n_c") * F.pow(F.lit(10.0), -F.col("b") * (F.col("bin") - F.col("c")) / 10.0)
    r = 1 - F.sum(F.abs(F.col("n_above") - model)) / F.sum("n_above")
    return pairs.groupBy("c", "n_c", "b").agg(r.alias("r")).select(F.round((F.col("c") + 0.5) / 10, 6).alias("mc"), F.col("n_c").alias("n_above"), F.round("b", 6).alias("b"), F.round("r", 6).alias("r"))


def mc_stepp(events: DataFrame) -> DataFrame:
    """Per threshold (lower bin edge) the variation of yearly counts: threshold, n, years, cv."""
    yearly = events.groupBy(magnitude_bin(F.col("m")).alias("bin"), F.year("t").alias("year")).agg(F.count("*").alias("n"))
    marks = yearly.select(F.col("bin").alias("c")).distinct()
    per = F.broadcast(marks).join(yearly, F.col("bin") >= F.col("c")).groupBy("c", "year").agg(F.sum("n").alias("n"))
    stats = per.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("years"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))
    return stats.where("n >= 20 AND years >= 5").select(F.round(F.col("c") / 10, 6).alias("threshold"), "n", "years", F.round("cv", 6).alias("cv"))


def b_value(events: DataFrame, mcs: list[float], dm: float = 0.1) -> DataFrame:
    """Maximum-likelihood b and a per completeness magnitude, in one pass; null under 20 events.

    sigma: 2.30 b^2 s / sqrt(n - 1), s the sample standard deviation.
    """
    marks = F.array(*[F.lit(x) for x in mcs])
    hit = events.select("m", F.explode(marks).alias("mc")).where(F.col("m") >= F.col("mc") - dm / 2)
    stats = hit.groupBy("mc").agg(F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("s"))
    gap = F.col("mean") - (F.col("mc") - dm / 2)
    b = F.when((F.col("n") >= 20) & (gap > 0), LOG10_E / gap)
    return stats.withColumn("b", b).select(
        "mc",
        "n",
        F.round("b", 6).alias("b"),
        F.round(F.col("b") / F.sqrt("n"), 6).alias("sigma_aki"),
        F.round(2.30 * F.col("b") * F.col("b") * F.col("s") / F.sqrt(F.col("n") - 1), 6).alias("sigma_shi_bolt"),
        F.round(F.log10("n") + F.col("b") * F.col("mc"), 6).alias("a"),
    )


def b_least_squares(events: DataFrame, mc_bin: int) -> DataFrame:
    """Regression of log10 of the reverse cumulative counts on bin centres from ``mc_bin`` on."""
    bins = reverse_cumulative(fmd(events)).where(F.col("bin") >= mc_bin)
    enough = F.count("*") >= 3
    y, x = F.log10(F.col("n_above").cast("double")), (F.col("bin") + 0.5) / 10
    return bins.agg(F.count("*").alias("n_bins"), F.when(enough, F.round(-F.regr_slope(y, x), 6)).alias("b"), F.when(enough, F.round(F.regr_intercept(y, x), 6)).alias("a"))


def rolling_mc(events: DataFrame, years: int = 5, step: int = 1, first: int = 1975, least: int = 30) -> DataFrame:
    """Fullest-bin Mc of every window of ``years`` whole years. Years and bins are counted before windows overlap."""
    counts = events.groupBy(F.year("t").alias("year"), magnitude_bin(F.col("m")).alias("bin")).agg(F.count("*").alias("n"))
    starts = F.sequence(F.col("year") - years + 1, F.col("year"))
    hops = counts.withColumn("start", F.explode(starts)).where((F.col("start") >= first) & ((F.col("start") - first) % step == 0))
    per = hops.groupBy("start", "bin").agg(F.sum("n").alias("n"))
    best = per.groupBy("start").agg(F.sum("n").alias("n_events"), F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("x"))
    return best.where(F.col("n_events") >= least).select(F.col("start").alias("start_year"), "n_events", F.round((-F.col("x.b") + 0.5) / 10, 6).alias("mc"))


def magnitude_series(events: DataFrame, least_share: float = 0.5) -> DataFrame:
    """Adds ``series`` and ``scale``: Mw for all events if ``least_share`` of them have one (the others go), else the
    original magnitude. ``events``: m, mw. One decision for the whole catalog."""
    share = events.agg(F.avg(F.col("mw").isNotNull().cast("double")).alias("_share"))
    taken = F.col("_share") >= least_share
    rows = events.join(F.broadcast(share)).withColumns({"scale": F.when(taken, "mw").otherwise("original"), "series": F.when(taken, F.col("mw")).otherwise(F.col("m"))})
    return rows.where("series IS NOT NULL").drop("_share")


def mc_gft_choice(events: DataFrame, least: int = 10, good: float = 0.95) -> DataFrame:
    """mc, r: the lowest candidate whose fit reaches ``good``, else the one of the best fit."""
    fits = mc_gft(events, least)
    low = F.min(F.when(F.col("r") >= good, F.struct("mc", "r")))
    best = F.max(F.struct("r", (-F.col("mc")).alias("m")))
    return fits.agg(low.alias("low"), best.alias("best")).select(F.coalesce("low.mc", -F.col("best.m")).alias("mc"), F.coalesce("low.r", "best.r").alias("r"))


def mc_stepp_choice(events: DataFrame, steady: float = 0.5) -> DataFrame:
    """mc, cv: the lowest threshold whose yearly counts vary by no more than ``steady``, else the steadiest."""
    marks = mc_stepp(events)
    low = F.min(F.when(F.col("cv") <= steady, F.struct("threshold", "cv")))
    best = F.min(F.struct("cv", "threshold"))
    return marks.agg(low.alias("low"), best.alias("best")).select(F.coalesce("low.threshold", "best.threshold").alias("mc"), F.coalesce("low.cv", "best.cv").alias("cv"))


def normal_cdf(z: Column) -> Column:
    """By the rational approximation of Abramowitz and Stegun, 7.1.26 (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # Fixed values of the approximation.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def mc_emr(events: DataFrame, bs: tuple[float, ...] = (0.6, 0.8, 1.0, 1.2), sigmas: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """mc, b, sigma, nll: the point of a grid with the least Poisson misfit of all bins, where counts fall off above mu
    and detection is a normal distribution around mu. Bins between the smallest and largest magnitude count, empty too."""
    bins = fmd(events)
    span = bins.agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.sum("n").alias("total"))
    # At most a few hundred bins.
    every = span.select("total", F.explode(F.sequence("low", "high")).alias("bin")).join(bins.select("bin", "n"), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "total")
    centre = lambda c: (F.col(c) + 0.5) / 10
    tried = every.select(F.col("bin").alias("mu_bin")).withColumn("b", F.explode(F.array(*[F.lit(b) for b in bs]))).withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in sigmas])))
    past = centre("bin") - centre("mu_bin")
    met = F.broadcast(every).join(tried)
    model = F.greatest(F.col("total") * F.pow(F.lit(10.0), -F.col("b") * F.greatest(past, F.lit(0.0))) * normal_cdf(past / F.col("sigma")), F.lit(1e-12))
    misfit = met.groupBy("mu_bin", "b", "sigma").agg(F.round(-F.sum(F.col("n") * F.ln(model) - model), 4).alias("nll"))
    best = misfit.agg(F.min(F.struct("nll", "mu_bin", "b", "sigma")).alias("x"))
    return best.select(F.round((F.col("x.mu_bin") + 0.5) / 10, 6).alias("mc"), "x.b", "x.sigma", "x.nll")


def mc_recommended(events: DataFrame) -> DataFrame:
    """mc: the median of the four estimates, which stand beside it, with events at or above and below it."""
    parts = {"maxc": mc_maxc(events).select("mc"), "gft": mc_gft_choice(events).select("mc"), "emr": mc_emr(events).select("mc"), "stepp": mc_stepp_choice(events).select("mc")}
    one = None
    for name, frame in parts.items():
        frame = frame.select(F.col("mc").alias(name))
        one = frame if one is None else one.join(F.broadcast(frame))
    found = F.array_sort(F.array_compact(F.array(*parts)))
    k = F.size("found")
    middle = (F.get("found", F.floor((k - 1) / 2).cast("int")) + F.get("found", F.floor(k / 2).cast("int"))) / 2
    one = one.withColumn("found", found).withColumn("mc", F.round(middle, 6)).drop("found")
    return events.select("m").join(F.broadcast(one)).groupBy(*one.columns).agg(F.count_if(F.col("m") >= F.col("mc")).alias("n_above"), F.count_if(F.col("m") < F.col("mc")).alias("n_below"))


def mc_of_regions(events: DataFrame, regions: list[tuple[str, float, float, float, float]], least: int = 30) -> DataFrame:
    """region, n_events, mc of named boxes (name, lowest and highest latitude and longitude), which may overlap; null
    Mc under ``least`` events."""
    boxes = F.array(*[F.when(F.col("latitude").between(a, b) & F.col("longitude").between(c, d), F.lit(name)) for name, a, b, c, d in regions])
    inside = events.select("m", F.explode(F.array_compact(boxes)).alias("region"))
    found = mc_maxc(inside, ["region"])
    return found.select("region", "n_events", F.when(F.col("n_events") >= least, F.col("mc")).alias("mc"))


def gutenberg_richter(events: DataFrame, mcs: list[float], targets: list[float], years: float) -> DataFrame:
    """b, a and their sigmas per completeness magnitude, with the yearly rates that they give above ``targets``."""
    out = b_value(events, mcs)
    n, b, s = F.col("n"), F.col("b"), F.col("sigma_shi_bolt")
    sigma_a = F.sqrt(1 / (n * math.log(10) ** 2) + F.col("mc") * F.col("mc") * s * s)
    rates = {f"rate_{round(t * 10)}": F.round(F.pow(F.lit(10.0), F.col("a") - b * t) / years, 6) for t in targets}
    return out.withColumn("sigma_a", F.round(sigma_a, 6)).withColumns(rates)


def quick_b(events: DataFrame, mc: float) -> DataFrame:
    """One row: b by maximum likelihood from mc - 0.05 on, 1 under twenty events or without spread."""
    stats = events.where(F.col("m") >= mc - 0.05).agg(F.count("*").alias("n"), F.avg("m").alias("mean"))
    gap = F.col("mean") - (mc - 0.05)
    return stats.select("n", F.round(F.when((F.col("n") >= 20) & (gap > 0), LOG10_E / gap).otherwise(1.0), 6).alias("b"))
