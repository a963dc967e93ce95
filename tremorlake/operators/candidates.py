"""Candidate models against baselines: bootstrap bounds in every configuration, quadrants held out, a predictive check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.seismo import p_at_least_one
from tremorlake.operators import inference
from tremorlake.operators.rates import spatial_poisson

# Fixed values of the decision rule: configurations, quadrants, and the loss in a quadrant that counts.
LEAST_CONFIGS, LEAST_QUADRANTS, LOSS = 2, 3, 0.005
REPLICATES = 500


def shrunken(n_train: Column, exposure: Column, mean: Column, years: float) -> Column:
    """A cell's rate drawn to the mean one, which counts as ``years`` of exposure."""
    return (n_train + years * mean) / (exposure + years)


def configurations(events: DataFrame, configs: list[tuple[float, float]], first: int, last: int, strengths: dict[str, float]) -> DataFrame:
    """config, model, origin_year, i_lat, i_lon, y, p, and the mean and variance of the cell's number of events, of the
    models ``spatial`` and ``uniform`` and of a shrunken one for each of ``strengths``. ``configs``: threshold, days."""
    parts = None
    for threshold, days in configs:
        rows = spatial_poisson(events, threshold, days, first, last)
        mean = rows.groupBy("origin_year").agg(F.avg("rate").alias("mean"))
        rows = rows.join(F.broadcast(mean), "origin_year").withColumn("config", F.lit(f"{threshold}/{days:g}d")).withColumn("h", F.lit(days / 365.25))
        exposure = F.datediff(F.make_date("origin_year", F.lit(1), F.lit(1)), F.lit("1975-01-01").cast("date")) / 365.25
        models = [F.struct(F.lit("spatial").alias("model"), F.col("rate").alias("r"), exposure.alias("e")), F.struct(F.lit("uniform").alias("model"), F.col("mean").alias("r"), exposure.alias("e"))]
        models += [F.struct(F.lit(name).alias("model"), shrunken(F.col("n_train"), exposure, F.col("mean"), k).alias("r"), (exposure + k).alias("e")) for name, k in strengths.items()]
        one = rows.select("config", "origin_year", "i_lat", "i_lon", "n_future", "y", "h", F.inline(F.array(*models)))
        parts = one if parts is None else parts.unionByName(one)
    # A rate of r over e years of exposure is that of a gamma law; its counts have this variance.
    return parts.select("config", "model", "origin_year", "i_lat", "i_lon", "n_future", "y", p_at_least_one(F.col("r"), F.col("h")).alias("p"), (F.col("r") * F.col("h")).alias("expected"), (F.col("r") * F.col("h") * (1 + F.col("h") / F.col("e"))).alias("variance"))


def _err() -> Column:
    return (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))


def bounds(rows: DataFrame, candidates: list[str], baselines: list[str]) -> DataFrame:
    """config, model, base, difference (squared error of the base less that of the model), lower, upper, p_value: over
    replicates that weigh whole origins. Origins and configurations are few; rows may be many."""
    sums = rows.groupBy("config", "model", "origin_year").agg(F.sum(_err()).alias("e"), F.count("*").alias("n"))
    a = sums.where(F.col("model").isin(candidates))
    b = sums.where(F.col("model").isin(baselines)).select("config", "origin_year", F.col("model").alias("base"), F.col("e").alias("_b"))
    pairs = a.join(b, ["config", "origin_year"]).withColumn("name", F.concat_ws("|", "config", "model", "base")).withColumn("d", F.col("_b") - F.col("e"))
    names = sorted(f"{r['config']}|{c}|{base}" for r in rows.select("config").distinct().collect() for c in candidates for base in baselines)
    wide = pairs.groupBy("origin_year").pivot("name", names).agg(F.sum("d").alias("d"), F.sum("n").alias("n")).na.fill(0)
    wide = wide.select(F.col("origin_year").cast("long").alias("key"), *[F.col(f"`{x}_{v}`").cast("double").alias(f"{v}{k}") for k, x in enumerate(names) for v in "dn"])

    def values(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(f"{v}{k}").to_numpy(zero_copy_only=False) for v in "dn" for k in range(len(names))])

    drawn = inference.weighted_sums(wide, "key", values, REPLICATES)
    m = len(names)
    each = drawn.groupBy("r", (F.col("k") % m).alias("k")).agg((F.max(F.when(F.col("k") < m, F.col("s"))) / F.nullif(F.max(F.when(F.col("k") >= m, F.col("s"))), F.lit(0.0))).alias("d")).where("d IS NOT NULL")
    at = lambda q: F.round(F.percentile("d", F.lit(q)), 9)
    share = lambda c: (F.count_if(c) + 1) / (F.count("*") + 1)
    p_value = F.round(F.least(F.lit(1.0), 2 * F.least(share(F.col("d") <= 0), share(F.col("d") >= 0))), 9)
    found = each.groupBy("k").agg(at(0.025).alias("lower"), at(0.975).alias("upper"), p_value.alias("p_value"))
    label = F.split(F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("k") + 1).cast("int")), r"\|")
    found = found.select(label[0].alias("config"), label[1].alias("model"), label[2].alias("base"), "lower", "upper", "p_value")
    whole = pairs.groupBy("config", "model", "base").agg(F.round(F.sum("d") / F.sum("n"), 9).alias("difference"))
    return whole.join(found, ["config", "model", "base"])


def predictive(rows: DataFrame, z: float = 1.96) -> DataFrame:
    """model, ppc_pass: in every configuration the number of events lies within ``z`` deviations of what is expected."""
    per = rows.groupBy("model", "config").agg(F.sum("n_future").alias("n"), F.sum("expected").alias("m"), F.sqrt(F.sum("variance")).alias("s"))
    return per.groupBy("model").agg(F.min(F.abs(F.col("n") - F.col("m")) <= z * F.col("s")).alias("ppc_pass"))


def candidate(rows: DataFrame, name: str, baselines: tuple[str, str]) -> DataFrame:
    """One row: the verdict on model ``name`` of ``configurations`` against two baselines, and what it follows from.

    A: less error than both on the whole, bounds above 0 in two configurations and less error in three quadrants against
    each, a predictive check and probabilities without faults. D: bounds below 0 in two configurations against either,
    or no predictive check. B: else, no loss in any quadrant and a smaller calibration error than either; else C.
    """
    found = bounds(rows, [name], list(baselines))
    significant = found.groupBy("base").agg(F.count_if(F.col("lower") > 0).alias("better"), F.count_if(F.col("upper") < 0).alias("worse"))
    mine = rows.where(F.col("model").isin(name, *baselines))
    quadrants = mine.groupBy("model", (F.col("i_lat") < 4).alias("s"), (F.col("i_lon") < 4).alias("w")).agg(F.avg(_err()).alias("e"))
    held = quadrants.where(F.col("model") == name).drop("model").join(quadrants.where(F.col("model") != name).select(F.col("model").alias("base"), "s", "w", F.col("e").alias("_b")), ["s", "w"])
    held = held.groupBy("base").agg(F.count_if(F.col("e") < F.col("_b")).alias("quadrants"), F.max(F.col("e") - F.col("_b")).alias("loss"))
    bins = mine.groupBy("model", F.least(F.floor(F.col("p") * 5), F.lit(4)).alias("b")).agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    scores = bins.groupBy("model").agg((F.sum(F.abs(F.col("mp") - F.col("my")) * F.col("n")) / F.sum("n")).alias("ece")).join(mine.groupBy("model").agg(F.avg(_err()).alias("brier")), "model")
    own = F.broadcast(scores.where(F.col("model") == name).select(F.col("brier").alias("_brier"), F.col("ece").alias("_ece")))
    against = scores.where(F.col("model") != name).withColumnRenamed("model", "base").join(significant, "base").join(held, "base").join(own)
    one = against.agg(
        F.min("better").alias("n_better"),
        F.max("worse").alias("n_worse"),
        F.min("quadrants").alias("quadrants"),
        F.min(F.col("_brier") < F.col("brier")).alias("_less"),
        F.max("loss").alias("_loss"),
        F.max(F.col("_ece") < F.col("ece")).alias("_calibrated"),
    )
    sound = rows.where(F.col("model") == name).agg(F.coalesce(F.count_if(F.col("p").isNull() | (F.col("p") < 0) | (F.col("p") > 1)) == 0, F.lit(True)).alias("integrity"))
    checked = predictive(rows.where(F.col("model") == name)).select("ppc_pass")
    superior = F.col("_less") & (F.col("n_better") >= LEAST_CONFIGS) & (F.col("quadrants") >= LEAST_QUADRANTS) & F.col("ppc_pass") & F.col("integrity")
    worse = (F.col("n_worse") >= LEAST_CONFIGS) | ~F.col("ppc_pass")
    verdict = F.when(superior, "A").when(worse, "D").when((F.col("_loss") < LOSS) & F.col("_calibrated"), "B").otherwise("C")
    return one.join(F.broadcast(sound)).join(F.broadcast(checked)).select("n_better", "n_worse", "quadrants", "ppc_pass", "integrity", verdict.alias("verdict"))


def variant_rows(rows: DataFrame, names: list[str], base: str, alpha: float = 0.05) -> DataFrame:
    """model, n_significant, n_rejected, ppc_pass, difference of each variant against ``base``: configurations whose
    bounds are above 0, those of them that step-up control of false discoveries over all variants keeps, the predictive
    check, and the mean difference (below 0 where the variant has less error)."""
    found = bounds(rows, names, [base])
    tests = found.select(F.concat_ws("|", "model", "config").alias("test"), "p_value")
    kept = inference.benjamini_hochberg(tests, alpha).where("bh").select(F.split("test", r"\|")[0].alias("model"), F.split("test", r"\|")[1].alias("config"), F.lit(1).alias("_kept"))
    met = found.join(kept, ["model", "config"], "left")
    counts = met.groupBy("model").agg(F.count_if(F.col("lower") > 0).alias("n_significant"), F.count_if((F.col("lower") > 0) & F.col("_kept").isNotNull()).alias("n_rejected"), F.round(-F.avg("difference"), 9).alias("difference"))
    return counts.join(predictive(rows), "model")
