"""Bootstrap, permutation and multiple comparison. Replicates work on sums per origin, so they stay small."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.seismo import lcg


def origin_sums(rows: DataFrame, a: str, b: str, origin: str) -> DataFrame:
    """i (0-based number of the origin), n, and the summed squared errors of the forecasts a and b."""
    err = lambda c: F.sum((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    sums = rows.groupBy(origin).agg(F.count("*").alias("n"), err(a).alias("sse_a"), err(b).alias("sse_b"))
    # Origins are a small dimension (tens of rows).
    return sums.withColumn("i", F.row_number().over(Window.orderBy(origin)) - 1)


def block_bootstrap(sums: DataFrame, replicates: int = 500, seed: int = 42) -> DataFrame:
    """delta (mean squared error of a less b) with its 2.5 and 97.5 percentiles over resampled origins."""
    spark = sums.sparkSession
    size = sums.agg(F.count("*").alias("size"))
    draws = spark.range(replicates).withColumnRenamed("id", "r").join(F.broadcast(size)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    draws = draws.select("r", lcg(F.col("r"), F.col("k"), F.col("size"), seed).alias("i"))
    delta = (F.sum("sse_a") - F.sum("sse_b")) / F.sum("n")
    per = draws.join(F.broadcast(sums), "i").groupBy("r").agg(delta.alias("d"))
    ci = per.agg(F.round(F.percentile("d", F.lit(0.025)), 6).alias("lower"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("upper"))
    return sums.agg(F.round(delta, 6).alias("delta")).join(ci)


def sign_swap(sums: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Two-sided p of the difference under swapping a and b per origin."""
    spark = sums.sparkSession
    each = sums.select("i", (F.col("sse_a") - F.col("sse_b")).alias("d"))
    total = each.agg(F.sum("d").alias("observed"))
    signs = spark.range(replicates).withColumnRenamed("id", "r").join(F.broadcast(each))
    swapped = signs.groupBy("r").agg(F.sum(F.when(lcg(F.col("r"), F.col("i"), 2, seed) == 1, F.col("d")).otherwise(-F.col("d"))).alias("s"))
    return swapped.join(F.broadcast(total)).agg(F.first("observed").alias("o"), F.count_if(F.abs("s") >= F.abs("observed") - 1e-12).alias("k"), F.count("*").alias("n")).select(F.round("o", 6).alias("observed"), F.round((F.col("k") + 1) / (F.col("n") + 1), 6).alias("p_value"))


def benjamini_hochberg(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds Bonferroni and step-up decisions to rows (test, p_value); comparisons are few."""
    w = Window.orderBy("p_value", "test")
    every = Window.partitionBy()
    ranked = tests.withColumns({"k": F.row_number().over(w), "n": F.count("*").over(every)})
    ranked = ranked.withColumn("last", F.max(F.when(F.col("p_value") <= F.col("k") / F.col("n") * alpha, F.col("k"))).over(every))
    return ranked.select("test", "p_value", F.col("k").alias("rank"), (F.col("p_value") <= alpha / F.col("n")).alias("bonferroni"), F.coalesce(F.col("k") <= F.col("last"), F.lit(False)).alias("bh"))


#: Draws are whole numbers below this prime; a row's weight in a replicate is how many of the steps its draw reaches,
#: so weights follow the Poisson law of mean 1.
PRIME = 2147483647
STEPS = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(13)]
#: Multipliers of the two rounds that mix a row's key with the replicate; squares leave no straight lines.
MIX = ((1103515, 12345, 42), (48271, 69621))


def weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """Weight of each key (a whole number) in each replicate, from numbers that every engine draws alike."""
    (a, b, c), rounds = MIX[0], MIX[1]
    x = (np.arange(replicates, dtype=np.int64)[None, :] * a + np.mod(keys.astype(np.int64), PRIME)[:, None] * b + c) % PRIME
    for k in rounds:
        x = (x * x % PRIME + x * k + c) % PRIME
    return np.searchsorted(np.array(STEPS), x, "right")


def weights_sql(replicate: str, key: str) -> str:
    """The same weight as SQL, of columns of whole numbers, keys from 0 on."""
    (a, b, c), rounds = MIX[0], MIX[1]
    x = f"({replicate}::BIGINT * {a} + {key}::BIGINT % {PRIME} * {b} + {c}) % {PRIME}"
    for k in rounds:
        x = f"(({x}) * ({x}) % {PRIME} + ({x}) * {k} + {c}) % {PRIME}"
    return "(" + " + ".join(f"(({x}) >= {s})::INT" for s in STEPS) + ")"


def weighted_sums(rows: DataFrame, key: str, values: Callable[[pa.RecordBatch], np.ndarray], replicates: int) -> DataFrame:
    """r, k, s: the sum of the k-th value over all ``rows`` with each replicate's weights; rows drawn never count 0.

    A bootstrap without numbering and without draws as rows: every task multiplies the weights of its rows, a batch at a
    time, with their ``values`` (a matrix of a row each), and hands on one sum for each replicate and value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = weights(batch.column(key).to_numpy(zero_copy_only=False), replicates).T.astype(float) @ values(batch)
            total = part if total is None else total + part
        if total is not None:
            r, k = np.indices(total.shape)
            yield pa.record_batch([pa.array(r.ravel()), pa.array(k.ravel()), pa.array(total.ravel())], names=["r", "k", "s"])

    return rows.mapInArrow(run, "r long, k long, s double").groupBy("r", "k").agg(F.sum("s").alias("s"))


def weighted_means(rows: DataFrame, key: str, value: str, replicates: int) -> DataFrame:
    """r, n, mean: the drawn number of ``rows`` and the mean of ``value`` in each replicate."""
    both = lambda batch: np.column_stack([np.ones(batch.num_rows), batch.column(value).to_numpy(zero_copy_only=False)])
    sums = weighted_sums(rows.select(key, F.col(value).cast("double").alias(value)), key, both, replicates)
    n, s = (F.max(F.when(F.col("k") == k, F.col("s"))) for k in (0, 1))
    return sums.groupBy("r").agg(n.alias("n"), (s / F.nullif(n, F.lit(0.0))).alias("mean"))


def percentile_interval(values: DataFrame, column: str, places: int = 6) -> DataFrame:
    """One row: lower and upper, the 2.5 and 97.5 percentiles."""
    at = lambda q: F.round(F.percentile(column, F.lit(q)), places)
    return values.agg(at(0.025).alias("lower"), at(0.975).alias("upper"))
