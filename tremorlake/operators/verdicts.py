"""Comparison of models, validation designs, choices of parameters and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.seismo import depth_group, p_at_least_one
from tremorlake.operators.joins import grid, small
from tremorlake.operators.rates import outcomes, regional_backtest, spatial_poisson


def with_uniform(forecasts: DataFrame, years: float) -> DataFrame:
    """Rows of the model ``spatial`` and of ``uniform``, which gives every cell the mean rate of its origin."""
    mean = F.avg("rate").over(Window.partitionBy("origin_year"))
    flat = forecasts.withColumn("rate", mean).withColumn("p", p_at_least_one(F.col("rate"), years))
    return forecasts.withColumn("model", F.lit("spatial")).unionByName(flat.withColumn("model", F.lit("uniform")))


def side_by_side(rows: DataFrame, a: str, b: str) -> DataFrame:
    """origin_year, cell, y, and the probabilities ``a`` and ``b`` of two models."""
    cols = ["origin_year", "cell_id"]
    right = rows.where(F.col("model") == b).select(*cols, F.col("p").alias("b"))
    return rows.where(F.col("model") == a).select(*cols, "i_lat", "i_lon", "y", F.col("p").alias("a")).join(right, cols)


def best(rows: DataFrame, name: str, score: str) -> DataFrame:
    """One row: the name with the least score, the first of equal ones."""
    return rows.agg(F.min(F.struct(score, name)).alias("x")).select(F.col(f"x.{name}").alias("best"), F.round(f"x.{score}", 6).alias(score))


def designs(events: DataFrame, threshold: float, days: float, first: int, last: int) -> DataFrame:
    """Scores of the regional backtest with origins every 1, 2 and 3 years, over a rolling window of 10 years, and over
    the first half, the next and the last quarter of the origins."""
    p, y = F.col("p"), F.col("y")
    score = lambda rows, name: rows.agg(F.lit(name).alias("design"), F.count("*").alias("n"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("base_rate"))
    run = lambda **more: regional_backtest(events, threshold, days, first, last, **more)
    n = last - first + 1
    cut, late = first + n // 2 + n % 2, first + n // 2 + n % 2 + n // 4
    year, every = F.col("origin_year"), run()
    parts = [
        score(every, "every year"),
        score(run(step=2), "every 2 years"),
        score(run(step=3), "every 3 years"),
        score(run(rolling=10), "rolling 10 years"),
        score(every.where(year < cut), "development"),
        score(every.where((year >= cut) & (year < late)), "selection"),
        score(every.where(year >= late), "evaluation"),
    ]
    return reduce(DataFrame.unionByName, parts)


def by_depth(events: DataFrame, threshold: float, days: float, first: int, last: int, least: int = 50) -> DataFrame:
    """depth_group, n, brier, base_rate of gridded forecasts that see and predict one depth group, and all."""
    p, y = F.col("p"), F.col("y")
    tagged = events.where(F.col("m") >= threshold).withColumn("depth_group", depth_group(F.col("depth_km")))
    groups = [r[0] for r in tagged.groupBy("depth_group").count().where((F.col("count") >= least) & F.col("depth_group").isNotNull()).collect()]
    parts = [(g, tagged.where(F.col("depth_group") == g)) for g in sorted(groups)]
    if tagged.limit(least).count() == least:
        parts.append(("all", tagged))
    score = lambda g, rows: spatial_poisson(rows, threshold, days, first, last).agg(F.lit(g).alias("depth_group"), F.count("*").alias("n"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(y), 6).alias("base_rate"))
    return reduce(DataFrame.unionByName, [score(g, rows) for g, rows in parts])


def bandwidths(events: DataFrame, widths: list[float], threshold: float, days: float, first: int, last: int, start: int = 1975) -> DataFrame:
    """bandwidth, brier, chosen: Gaussian smoothing of past events, scored at yearly origins for each width (degrees).

    Events are summed into the cells once per (cell, width, first origin that sees them); running sums over origins
    do the rest. Cells and widths are small dimensions.
    """
    from tremorlake.functions.geo import local_degrees
    from tremorlake.functions.seismo import gaussian_kernel

    spark = events.sparkSession
    cells = grid(spark)
    since = F.greatest(F.year("t") + 1, F.lit(first))
    seen = events.where(F.col("m") >= threshold).select("latitude", "longitude", since.alias("origin_year")).where(F.col("origin_year") <= last)
    r = local_degrees(F.col("latitude"), F.col("longitude"), F.col("lat_center"), F.col("lon_center"))
    near = seen.join(small(cells)).withColumn("_r", r).withColumn("bandwidth", F.explode(F.array(*[F.lit(w) for w in widths])))
    fresh = near.groupBy("bandwidth", "cell_id", "origin_year").agg(F.sum(gaussian_kernel(F.col("_r"), F.col("bandwidth"))).alias("k"))
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("origin_year"))
    every = cells.join(F.broadcast(years)).withColumn("bandwidth", F.explode(F.array(*[F.lit(w) for w in widths])))
    upto = Window.partitionBy("bandwidth", "cell_id").orderBy("origin_year")
    summed = every.join(fresh, ["bandwidth", "cell_id", "origin_year"], "left").withColumn("k", F.sum(F.coalesce("k", F.lit(0.0))).over(upto))
    exposure = F.datediff(F.make_date("origin_year", F.lit(1), F.lit(1)), F.make_date(F.lit(start), F.lit(1), F.lit(1))) / 365.25
    future = outcomes(events, threshold, days, first, last)
    rows = summed.withColumn("p", p_at_least_one(F.col("k") / exposure, days / 365.25)).join(future, ["origin_year", "i_lat", "i_lon"], "left").withColumn("y", (F.coalesce("n_future", F.lit(0)) > 0).cast("int"))
    p, y = F.col("p"), F.col("y")
    scores = rows.groupBy("bandwidth").agg(F.round(F.avg((p - y) * (p - y)), 8).alias("brier"))
    least = F.min(F.struct("brier", "bandwidth")).over(Window.partitionBy())
    return scores.withColumn("_b", least).select("bandwidth", "brier", (F.col("bandwidth") == F.col("_b.bandwidth")).alias("chosen"))


def variants(rows: DataFrame) -> DataFrame:
    """Adds verdict to rows with n_significant, n_rejected, ppc_pass and difference: D where the simulated catalogs do not
    fit, or nothing is significant and the mean is not better; A with two significant and two rejected; else C."""
    verdict = F.when(~F.col("ppc_pass"), "D").when((F.col("n_significant") >= 2) & (F.col("n_rejected") >= 2), "A").when((F.col("n_significant") == 0) & (F.col("difference") >= 0), "D").otherwise("C")
    return rows.withColumn("verdict", verdict)


def promotable(summaries: DataFrame, least: int = 20) -> DataFrame:
    """Adds eligible: at least ``least`` evaluated forecasts."""
    return summaries.withColumn("eligible", F.col("n_evaluated") >= least)
