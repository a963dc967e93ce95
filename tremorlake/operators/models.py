"""Supervised forecasts on spark.ml, trained on earlier origins only."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
CALIBRATED = ("isotonic", "platt")
#: Rows of a task of a fit, and fits that run at a time: fits of few rows leave most of a cluster idle.
ROWS_OF_A_TASK, FITS_AT_A_TIME = 50_000, 8
#: Trees and depth of the ensembles, and the boosting step.
FOREST, BOOSTED, STEP = (200, 8), (200, 3), 0.1


def weighted(rows: DataFrame, balanced: bool = True) -> DataFrame:
    """Adds weight: n / (2 n_k) of the row's class, or for positives alone n_neg / n_pos."""
    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    negative = n - positive
    pair = (n / (2 * positive), n / (2 * negative)) if balanced else (negative / positive, 1.0)
    return rows.withColumn("weight", F.when(F.col("label") == 1, float(pair[0])).otherwise(float(pair[1])))


def _assembled(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="raw")


def _logistic(names: list[str], n: int, l1_ratio: float, c: float = 1.0) -> Pipeline:
    scaled = StandardScaler(inputCol="raw", outputCol="x", withMean=True)
    # The weights of both classes sum to the number of rows.
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1 / (c * n), elasticNetParam=l1_ratio, maxIter=200, standardization=False)
    return Pipeline(stages=[_assembled(names), scaled, model])


def _boosted(names: list[str], trees: int) -> Pipeline:
    return Pipeline(stages=[_assembled(names), GBTClassifier(featuresCol="raw", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=BOOSTED[1], stepSize=STEP, seed=SEED)])


def _second(c: str = "probability") -> Column:
    return vector_to_array(c)[1]


def _out(frame: DataFrame, p: Column) -> DataFrame:
    return frame.select("origin", "cell_id", "label", p.alias("p"))


def predicted(kind: str, train: DataFrame, test: DataFrame, names: list[str], trees: int | None = None) -> DataFrame:
    """origin, cell_id, label, p of ``test`` by a model of ``kind`` fitted on ``train`` (features, label).

    Kinds: base (the share of positives), logistic, elastic (half l1), forest, boosted, isotonic and platt (boosted,
    calibrated on three folds). A training set of one class gives its share of positives.
    """
    n, positive = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if kind == "base" or positive in (0, n):
        return _out(test, F.lit(positive / n if n else 0.0))
    if kind in ("logistic", "elastic"):
        return _out(_logistic(names, n, 0.5 if kind == "elastic" else 0.0).fit(weighted(train)).transform(test), _second())
    if kind == "forest":
        forest = RandomForestClassifier(featuresCol="raw", labelCol="label", weightCol="weight", numTrees=trees or FOREST[0], maxDepth=FOREST[1], seed=SEED)
        return _out(Pipeline(stages=[_assembled(names), forest]).fit(weighted(train)).transform(test), _second())
    if kind == "boosted":
        return _out(_boosted(names, trees or BOOSTED[0]).fit(weighted(train, False)).transform(test), _second())
    if kind in CALIBRATED:
        return calibrated(train, test, names, [kind], trees)[kind]
    raise ValueError(f"model {kind!r}")


def calibrated(train: DataFrame, test: DataFrame, names: list[str], kinds: list[str], trees: int | None = None) -> dict[str, DataFrame]:
    """``predicted`` of boosted trees and of their calibrations, which share the trees.

    Three folds are scored by trees that have not seen them; on these scores an isotonic line (``isotonic``) or a
    logistic curve (``platt``) is fitted, and applied to the scores of trees that have seen all rows.
    """
    fold = F.pmod(F.xxhash64("origin", "cell_id"), F.lit(3))
    scored = predicted("boosted", train, test, names, trees)
    out = {"boosted": scored}
    if set(kinds) & set(CALIBRATED):
        raw = reduce(DataFrame.unionByName, [predicted("boosted", train.where(fold != k), train.where(fold == k), names, trees) for k in range(3)])
        for kind in set(kinds) & set(CALIBRATED):
            out[kind] = calibration(kind, raw, scored)
    return {kind: out[kind] for kind in kinds}


def calibration(kind: str, raw: DataFrame, scored: DataFrame) -> DataFrame:
    """``scored`` with its p (and those of ``raw``, with their labels) calibrated by an isotonic line or a logistic curve."""
    if kind == "isotonic":
        return _out(IsotonicRegression(featuresCol="p", labelCol="label").fit(raw).transform(scored), F.col("prediction"))
    one = _assembled(["p"])
    line = LogisticRegression(featuresCol="raw", labelCol="label", regParam=0.0, maxIter=200, standardization=True).fit(one.transform(raw))
    return _out(line.transform(one.transform(scored)), _second())


def chronological(rows: DataFrame, kinds: list[str], names: list[str], first: int = 1, trees: int | None = None) -> DataFrame:
    """model, origin, cell_id, label, p: for each origin from the ``first``-th on, every kind fitted on all earlier ones.

    Origins are few; each fit is a Spark job over the rows before its origin, and several fits run at a time. ``rows``
    should be stored.
    """
    return compared(rows, {kind: (kind, names) for kind in kinds}, first, trees)


def compared(rows: DataFrame, kinds: dict[str, tuple[str, list[str]]], first: int = 1, trees: int | None = None) -> DataFrame:
    """``chronological`` for models of a name each: their kind and the names of their features."""
    n = rows.count()
    rows = rows.coalesce(max(1, -(-n // ROWS_OF_A_TASK)))
    origins = [r[0] for r in rows.select("origin").distinct().orderBy("origin").collect()]
    boosted = {name: names for name, (kind, names) in kinds.items() if kind in ("boosted", *CALIBRATED)}

    def single(at, name: str) -> list[DataFrame]:
        train, test = rows.where(F.col("origin") < at), rows.where(F.col("origin") == at)
        return [predicted(kinds[name][0], train, test, kinds[name][1], trees).withColumn("model", F.lit(name))]

    def together(at, names: list[str]) -> list[DataFrame]:
        train, test = rows.where(F.col("origin") < at), rows.where(F.col("origin") == at)
        found = calibrated(train, test, kinds[names[0]][1], [kinds[name][0] for name in names], trees)
        return [found[kinds[name][0]].withColumn("model", F.lit(name)) for name in names]

    # Trees are shared by the models that have the same features.
    shared = [[name for name in boosted if boosted[name] == x] for x in {tuple(v): v for v in boosted.values()}.values()]
    tasks = [(single, at, name) for at in origins[first:] for name in kinds if name not in boosted] + [(together, at, names) for at in origins[first:] for names in shared]
    with ThreadPoolExecutor(FITS_AT_A_TIME) as pool:
        parts = [x for found in pool.map(lambda t: t[0](*t[1:]), tasks) for x in found]
    return reduce(DataFrame.unionByName, parts)


def uniform_poisson(rows: DataFrame, years: float) -> DataFrame:
    """origin, cell_id, label, p: every cell gets the mean of the cells' historical rates."""
    mean = rows.groupBy("origin").agg(F.avg("hist_rate_above_45").alias("rate"))
    return rows.join(F.broadcast(mean), "origin").select("origin", "cell_id", "label", (1 - F.exp(-F.col("rate") * years)).alias("p"))
