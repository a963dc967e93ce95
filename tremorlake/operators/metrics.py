"""Verification of probabilities p against outcomes y (0 or 1), per group, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import constants as C


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(C.LOG_EPS)), F.lit(1 - C.LOG_EPS))


def log_likelihood(p: Column, y: Column) -> Column:
    q = _clipped(p)
    return F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q))


def scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, positives, brier, log_likelihood, sharpness, climatology_brier and information gain per group."""
    p, y = F.col("p"), F.col("y")
    base = F.avg(y)
    q = _clipped(base)
    reference = base * F.ln(q) + (1 - base) * F.ln(1 - q)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("y").alias("n_positive"),
        F.round(F.avg((p - y) * (p - y)), 6).alias("brier"),
        F.round(F.avg(log_likelihood(p, y)), 6).alias("log_likelihood"),
        F.round(F.stddev_pop("p"), 6).alias("sharpness"),
        F.round(F.avg(log_likelihood(p, y)) - reference, 6).alias("information_gain"),
    )


def binned(rows: DataFrame, edges: list[float], by: list[str], closed: bool = True) -> DataFrame:
    """bin, n, mean_p, mean_y per group; bins are half open, the last one ``closed`` or not; empty bins are left out."""
    bin_ = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        upper = (F.col("p") <= edges[k + 1]) if closed and k == len(edges) - 2 else (F.col("p") < edges[k + 1])
        bin_ = F.when((F.col("p") >= edges[k]) & upper, k).otherwise(bin_)
    return rows.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability diagram over equal bins of [0, 1], empty bins included."""
    found = binned(rows, [k / bins for k in range(bins + 1)], [])
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_p", 6).alias("mean_p"), F.round("mean_y", 6).alias("mean_y"))


def calibration_errors(rows: DataFrame) -> DataFrame:
    """Unweighted error over 5 equal bins, ECE over 5, over 7 equal (all half open, p = 1 goes) and over 7 uneven bins."""

    def error(edges: list[float], weighted: bool, name: str) -> DataFrame:
        b = binned(rows, edges, [], name != "ece_7")
        gap = F.abs(F.col("mean_p") - F.col("mean_y"))
        return b.agg(F.round(F.sum(gap * F.col("n")) / F.sum("n") if weighted else F.avg(gap), 6).alias("value")).select(F.lit(name).alias("metric"), "value")

    five, seven = [k / 5 for k in range(6)], [k / 7 for k in range(8)]
    out = error(five, False, "unweighted_5")
    for edges, name in ((five, "ece_5"), (seven, "ece_7"), (C.ECE_EDGES, "ece_7_uneven")):
        out = out.unionByName(error(edges, True, name))
    return out


def roc_pr(rows: DataFrame, by: list[str]) -> DataFrame:
    """ROC-AUC (ties count half) and average precision per group; null where one class is missing.

    Rows are counted per distinct p first, so windows run over distinct scores only.
    """
    s = rows.groupBy(*by, "p").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.col("p").desc())
    every = Window.partitionBy(*by)
    tp, seen = F.sum("pos").over(down), F.sum("n").over(down)
    s = s.withColumns({"tp": tp, "seen": seen, "all_pos": F.sum("pos").over(every), "all_n": F.sum("n").over(every)})
    neg = F.col("n") - F.col("pos")
    neg_below = (F.col("all_n") - F.col("all_pos")) - (F.col("seen") - F.col("tp"))
    auc = F.sum(F.col("pos") * (neg_below + neg / 2.0)) / F.try_divide(F.lit(1.0), 1.0 / F.nullif(F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos"))), F.lit(0)))
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.max("all_pos"), F.lit(0))
    return s.groupBy(*by).agg(F.round(auc, 6).alias("roc_auc"), F.round(ap, 6).alias("pr_auc"))


def contingency(rows: DataFrame, by: list[str], alarm: float = 0.10) -> DataFrame:
    on, y = F.col("p") >= alarm, F.col("y") == 1
    return rows.groupBy(*by).agg(F.count_if(on & y).alias("hits"), F.count_if(on & ~y).alias("false_alarms"), F.count_if(~on & y).alias("misses"), F.count_if(~on & ~y).alias("correct_negatives"))


def interval_score(rows: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Mean score of the interval (lo, hi) for the count ``n_future``, and its coverage and width."""
    lo, hi, n = F.col("lo"), F.col("hi"), F.col("n_future")
    score = (hi - lo) + F.when(n < lo, 2 / alpha * (lo - n)).otherwise(0.0) + F.when(n > hi, 2 / alpha * (n - hi)).otherwise(0.0)
    return rows.groupBy(*by).agg(F.round(F.avg(score), 6).alias("interval_score"), F.round(F.avg(((n >= lo) & (n <= hi)).cast("double")), 6).alias("coverage"), F.round(F.avg(hi - lo), 6).alias("width"))


def ks_exponential(gaps: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Largest |i/n - F(x)| of gaps scaled to mean 1 against the unit exponential, per group."""
    w = Window.partitionBy(*by)
    x = gaps.withColumn("_x", F.col(value) / F.avg(value).over(w))
    x = x.withColumns({"_i": F.row_number().over(w.orderBy("_x")), "_n": F.count("*").over(w)})
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col("_i") / F.col("_n") - (1 - F.exp(-F.col("_x"))))), 6).alias("ks"))


def paired_gain(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Mean log-likelihood of ``a`` less that of ``b`` on the same rows, and the difference of their Brier scores."""
    y = F.col("y")
    gain = F.avg(log_likelihood(F.col(a), y) - log_likelihood(F.col(b), y))
    brier = F.avg((F.col(a) - y) * (F.col(a) - y) - (F.col(b) - y) * (F.col(b) - y))
    return rows.groupBy(*by).agg(F.round(gain, 6).alias("information_gain"), F.round(brier, 6).alias("brier_difference"))


def alarm_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Hit and false-alarm rate of alarms from max(0.005, half the median of p) on, per group."""
    level = rows.groupBy(*by).agg(F.greatest(F.lit(0.005), 0.5 * F.percentile("p", F.lit(0.5))).alias("alarm"))
    # One row a group; groups are models and configurations.
    met = rows.join(F.broadcast(level), by)
    on, y = F.col("p") >= F.col("alarm"), F.col("y") == 1
    rate = lambda k, n: F.round(F.try_divide(F.count_if(k), F.count_if(n)), 6)
    return met.groupBy(*by).agg(F.round(F.first("alarm"), 6).alias("alarm"), rate(on & y, y).alias("hit_rate"), rate(on & ~y, ~y).alias("false_alarm_rate"))


#: Two-sided normal quantiles by level.
Z = {50: 0.6744897501960817, 80: 1.2815515655446004, 90: 1.6448536269514722, 95: 1.959963984540054}


def coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """level, coverage, its error and mean width of the intervals of the count ``n_future`` around ``mean``, whose 95 %
    half-width ``half`` is scaled to each level; lower ends are cut at 0."""
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(z / Z[95]).alias("_s")) for k, z in Z.items()])
    half = F.col("half") * F.col("_s")
    wide = rows.select("*", F.inline(levels)).withColumns({"_lo": F.greatest(F.col("mean") - half, F.lit(0.0)), "_hi": F.col("mean") + half})
    hit = F.avg(F.col("n_future").between(F.col("_lo"), F.col("_hi")).cast("double"))
    return wide.groupBy(*by, "level").agg(F.round(hit, 6).alias("coverage"), F.round(hit - F.col("level") / 100, 6).alias("error"), F.round(F.avg(F.col("_hi") - F.col("_lo")), 6).alias("width"))


def composite(rows: DataFrame, by: list[str]) -> DataFrame:
    """All scores of each model or configuration in one row: ``scores``, ``roc_pr``, ECE over 5 bins, alarms at 0.1."""
    gap = F.abs(F.col("mean_p") - F.col("mean_y"))
    ece = binned(rows, [k / 5 for k in range(6)], by).groupBy(*by).agg(F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece"))
    return scores(rows, by).join(roc_pr(rows, by), by).join(ece, by).join(contingency(rows, by), by)


def calibration_line(rows: DataFrame, rounds: int = 25, penalty: float = 1e-6) -> tuple[float, float]:
    """Intercept and slope of the logistic regression of y on p, by Newton steps; each one is an aggregate of five sums.

    ``penalty``: of the squared slope, as a weak regularisation.
    """
    a = b = 0.0
    p, y = F.col("p"), F.col("y")
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.lit(a) + b * p)))
        w = q * (1 - q)
        g0, g1, h00, h01, h11 = rows.agg(F.sum(y - q), F.sum((y - q) * p), F.sum(w), F.sum(w * p), F.sum(w * p * p)).first()
        g1, h11 = g1 - penalty * b, h11 + penalty
        det = h00 * h11 - h01 * h01
        if not det:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b
