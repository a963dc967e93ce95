"""Rates on the grid, expanding over forecast origins, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.geo import cell
from tremorlake.functions.seismo import p_at_least_one
from tremorlake.operators.joins import by_origin, grid, neighbours


def celled(events: DataFrame, size: float = 1.0, edge: str = "clamp") -> DataFrame:
    i, j = cell(F.col("latitude"), F.col("longitude"), size, edge)
    return events.withColumns({"i_lat": i, "i_lon": j})


def expanding_rates(events: DataFrame, threshold: float, first: int, last: int, start: int = 1975, size: float = 1.0) -> DataFrame:
    """origin_year, cell, n_train, rate of every cell and yearly origin from all events before the origin.

    Events are counted once per (cell, first origin that sees them); running sums over origins do the rest, so the
    history is not repeated per origin.
    """
    spark = events.sparkSession
    fresh = by_origin(celled(events.where(F.col("m") >= threshold), size), first, last).groupBy("i_lat", "i_lon", "since").agg(F.count("*").alias("n"))
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("origin_year"))
    # Both dimensions are a few thousand rows at most.
    frame = grid(spark, size).join(F.broadcast(years))
    joined = frame.join(fresh.withColumnRenamed("since", "origin_year"), ["i_lat", "i_lon", "origin_year"], "left")
    upto = Window.partitionBy("i_lat", "i_lon").orderBy("origin_year").rowsBetween(Window.unboundedPreceding, 0)
    counted = joined.withColumn("n_train", F.sum(F.coalesce("n", F.lit(0))).over(upto)).drop("n")
    exposure = F.datediff(F.make_date("origin_year", F.lit(1), F.lit(1)), F.make_date(F.lit(start), F.lit(1), F.lit(1))) / 365.25
    return counted.withColumns({"exposure_years": exposure, "rate": F.col("n_train") / exposure})


def recent_rates(events: DataFrame, threshold: float, first: int, last: int, years: int = 5, size: float = 1.0) -> DataFrame:
    """origin_year, cell, n_train, rate of every cell and yearly origin from the ``years`` (of 365.25 days) before it.

    An event is counted by the few origins whose window holds it; no history is repeated.
    """
    spark = events.sparkSession
    window = round(years * 365.25 * 86400e6)
    start = lambda y: F.unix_micros(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    near = celled(events.where(F.col("m") >= threshold), size).withColumn("origin_year", F.explode(F.sequence(F.year("t") + 1, F.year("t") + years + 1)))
    inside = near.where(F.col("origin_year").between(first, last) & (F.unix_micros("t") >= start(F.col("origin_year")) - window) & (F.unix_micros("t") < start(F.col("origin_year"))))
    counts = inside.groupBy("i_lat", "i_lon", "origin_year").agg(F.count("*").alias("n"))
    every = grid(spark, size).join(F.broadcast(spark.range(first, last + 1).select(F.col("id").cast("int").alias("origin_year"))))
    out = every.join(counts, ["i_lat", "i_lon", "origin_year"], "left").withColumn("n_train", F.coalesce("n", F.lit(0))).drop("n")
    return out.withColumns({"exposure_years": F.lit(float(years)), "rate": F.col("n_train") / float(years)})


def smoothed(rates: DataFrame) -> DataFrame:
    """Adds rate_smoothed: the mean of the cell and its neighbours inside the grid, per origin."""
    near = neighbours(rates.select("i_lat", "i_lon").distinct(), True)
    around = rates.select("origin_year", F.col("i_lat").alias("n_lat"), F.col("i_lon").alias("n_lon"), F.col("rate").alias("r"))
    mean = near.join(around, ["n_lat", "n_lon"]).groupBy("origin_year", "i_lat", "i_lon").agg(F.avg("r").alias("rate_smoothed"))
    return rates.join(mean, ["origin_year", "i_lat", "i_lon"])


def outcomes(events: DataFrame, threshold: float, horizon_days: float, first: int, last: int, size: float = 1.0) -> DataFrame:
    """origin_year, cell, n_future: events from the origin on for the horizon (at most a year), half open."""
    year = F.year("t")
    since = F.unix_micros("t") - F.unix_micros(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    hit = events.where((F.col("m") >= threshold) & year.between(first, last) & (since < round(horizon_days * 86400e6)))
    return celled(hit, size).groupBy(year.alias("origin_year"), "i_lat", "i_lon").agg(F.count("*").alias("n_future"))


def spatial_poisson(events: DataFrame, threshold: float, horizon_days: float, first: int, last: int, start: int = 1975, size: float = 1.0) -> DataFrame:
    """Forecast p and outcome y of every (origin, cell)."""
    rates = expanding_rates(events, threshold, first, last, start, size)
    seen = outcomes(events, threshold, horizon_days, first, last, size)
    p = p_at_least_one(F.col("rate"), horizon_days / 365.25)
    joined = rates.withColumn("p", p).join(seen, ["origin_year", "i_lat", "i_lon"], "left").withColumn("n_future", F.coalesce("n_future", F.lit(0)))
    return joined.withColumn("y", (F.col("n_future") > 0).cast("int"))


def grid_summary(events: DataFrame, thresholds: list[float], years: float) -> DataFrame:
    """Per cell: counts and rates above each threshold, mean and largest magnitude, few-events flag; empty cells stay."""
    spark = events.sparkSession
    inside = celled(events, edge="drop").where("i_lat IS NOT NULL AND i_lon IS NOT NULL")
    aggs = [F.count_if(F.col("m") >= t).alias(f"n_{round(t * 10)}") for t in thresholds]
    per = inside.groupBy("i_lat", "i_lon").agg(F.count("*").alias("n"), *aggs, F.round(F.avg("m"), 6).alias("mean_m"), F.max("m").alias("max_m"))
    zero = {c: 0 for c in ["n", *[f"n_{round(t * 10)}" for t in thresholds]]}
    out = grid(spark).join(per, ["i_lat", "i_lon"], "left").fillna(zero)
    rates = {f"rate_{round(t * 10)}": F.round(F.col(f"n_{round(t * 10)}") / years, 6) for t in thresholds}
    return out.withColumns(rates).withColumn("low_statistics", F.col(f"n_{round(thresholds[0] * 10)}") < 5)


def concentration(rates: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Gini coefficient, shares of the top three cells and of the top tenth, number of empty cells, per group of cells."""
    w = Window.partitionBy(*by)
    ranked = rates.withColumns({"_k": F.row_number().over(w.orderBy(value, "cell_id")), "_n": F.count("*").over(w)})
    x = F.col(value)
    gini = F.sum((2 * F.col("_k") - F.col("_n") - 1) * x) / (F.max("_n") * F.sum(x))
    share = lambda n: F.round(F.sum(F.when(F.col("_k") > F.col("_n") - n, x).otherwise(0.0)) / F.sum(x), 6)
    return ranked.groupBy(*by).agg(F.round(gini, 6).alias("gini"), share(3).alias("top3_share"), share(F.floor(F.col("_n") / 10)).alias("top_tenth_share"), F.count_if(x == 0).alias("n_empty"))


def gamma_poisson(rates: DataFrame, horizon_years: float, by: list[str]) -> DataFrame:
    """Empirical-Bayes Gamma prior from active cells per group (mean and sample variance), posterior mean and P.

    Fewer than five active cells, or no spread, give the weak prior (0.5, 0.5 / mean rate).
    """
    active = rates.where("rate > 0").groupBy(*by).agg(F.count("*").alias("k"), F.avg("rate").alias("mu"), F.var_samp("rate").alias("v"))
    fits = (F.col("k") >= 5) & (F.col("v") > 0)
    prior = active.withColumns({"alpha": F.when(fits, F.col("mu") * F.col("mu") / F.col("v")).otherwise(0.5), "beta": F.when(fits, F.col("mu") / F.col("v")).otherwise(0.5 / F.col("mu"))})
    post = rates.join(prior.select(*by, "alpha", "beta"), by)
    a, b = F.col("alpha") + F.col("n_train"), F.col("beta") + F.col("exposure_years")
    return post.withColumns({"posterior_mean": a / b, "p": 1 - F.pow(b / (b + horizon_years), a)})


def regional_backtest(events: DataFrame, threshold: float, horizon_days: float, first: int, last: int, start: int = 1975, rolling: int | None = None, step: int = 1) -> DataFrame:
    """origin_year, n_train, exposure_years, rate, p, n_future, y of the whole region at each ``step``-th yearly origin.

    History is all since ``start``, or the ``rolling`` calendar years before the origin. Yearly counts come first, so
    no event is repeated per origin.
    """
    spark = events.sparkSession
    yearly = events.where(F.col("m") >= threshold).groupBy(F.year("t").alias("year")).agg(F.count("*").alias("n"))
    years = spark.range(first, last + 1, step).select(F.col("id").cast("int").alias("origin_year"))
    since = F.greatest(F.lit(start), F.col("origin_year") - rolling) if rolling else F.lit(start)
    # Two dimensions of a row a year.
    history = years.join(F.broadcast(yearly), (F.col("year") < F.col("origin_year")) & (F.col("year") >= since), "left").groupBy("origin_year").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_train"))
    seen = outcomes(events, threshold, horizon_days, first, last).groupBy("origin_year").agg(F.sum("n_future").alias("n_future"))
    day = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    exposure = F.datediff(day(F.col("origin_year")), day(since)) / 365.25
    out = history.join(seen, "origin_year", "left").withColumns({"exposure_years": exposure, "n_future": F.coalesce("n_future", F.lit(0))})
    out = out.withColumn("rate", F.col("n_train") / F.col("exposure_years"))
    return out.withColumns({"p": p_at_least_one(F.col("rate"), horizon_days / 365.25), "y": (F.col("n_future") > 0).cast("int")})


def posterior(rates: DataFrame, by: list[str]) -> DataFrame:
    """``gamma_poisson`` with the shape and rate of each cell's posterior Gamma law."""
    out = gamma_poisson(rates, 0.0, by)
    return out.withColumns({"shape": F.col("alpha") + F.col("n_train"), "scale_rate": F.col("beta") + F.col("exposure_years")})
