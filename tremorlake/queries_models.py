"""Queries of features, supervised models and the forecast ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.seismo import p_at_least_one
from tremorlake.operators import features, joins, metrics, models, verdicts
from tremorlake.operators.lineage import written
from tremorlake.plans import ledger
from tremorlake.queries import _LCG, _LEDGER, _ORIGINS, _YY, DAY_US, FIRST, GRID, LAST, _hav, _ledger, _q, _r, query
from tremorlake.sources import catalog

# ---- features ------------------------------------------------------------------------------------------------

_AGE = "(epoch_us(o.origin) - epoch_us(t)) / 86400e6::DOUBLE"
_BIG = """big AS (SELECT origin, x, (SELECT max({'t': t, 'a': latitude, 'o': longitude}) FROM q WHERE m >= 5.0 AND t < origin) AS m5, (SELECT max({'t': t, 'a': latitude, 'o': longitude}) FROM q WHERE m >= 6.0 AND t < origin) AS m6,
  (SELECT count(*) FROM q WHERE t < origin AND epoch_us(origin) - epoch_us(t) <= 30 * 86400000000) AS g30, (SELECT count(*) FROM q WHERE t < origin AND m >= 5.0 AND epoch_us(origin) - epoch_us(t) <= 90 * 86400000000) AS main90
  FROM (SELECT origin, (epoch_us(origin) - 157766400000000) / 86400e6::DOUBLE / 365.25::DOUBLE AS x FROM origins)),
globe AS (SELECT *, (SELECT count(*) FROM q WHERE t >= m5['t'] AND epoch_us(t) < epoch_us(m5['t']) + 7 * 86400000000 AND t < origin) AS post5, (SELECT count(*) FROM q WHERE t >= m6['t'] AND epoch_us(t) < epoch_us(m6['t']) + 7 * 86400000000 AND t < origin) AS post6 FROM big)"""
_CELL = f"""percell AS (SELECT o.origin AS origin, g.cell_id AS cell_id, count(m) AS n_all, count(m) FILTER (m >= 4.5) AS n_45, count(m) FILTER (m >= 5.0) AS n_50, count(m) FILTER (m >= 5.5) AS n_55,
  {", ".join(f"count(m) FILTER (age <= {k}) AS n_{k}" for k in (1, 7, 30, 90, 365))}, min(age) AS last_age, arg_min(dist, (age, event_id)) AS last_dist,
  max(m) FILTER (age <= 30) AS max_30, max(m) FILTER (age <= 90) AS max_90, avg(m) FILTER (age <= 90) AS mean_90, var_pop(m) FILTER (age <= 90) AS var_90, quantile_cont(m, 0.9) FILTER (age <= 90) AS p90,
  count(m) FILTER (age <= 30 AND m >= 4.5) AS k45, count(m) FILTER (age <= 30 AND m >= 5.0) AS k50, count(m) FILTER (age <= 90 AND m >= 5.5) AS k55, count(m) FILTER (age <= 365 AND m >= 4.45::DOUBLE) AS k365, avg(m) FILTER (age <= 365 AND m >= 4.45::DOUBLE) AS mean365,
  avg(depth_km) FILTER (age <= 90) AS dm, var_pop(depth_km) FILTER (age <= 90) AS dv, count(m) FILTER (age <= 90 AND depth_km < 25) AS sh, count(m) FILTER (age <= 90 AND depth_km >= 25 AND depth_km < 70) AS im, count(m) FILTER (age <= 90 AND depth_km >= 70) AS de,
  sum(1 / (1 + dist / 50)) FILTER (dist > 0) AS wd
  FROM globe o, grid g LEFT JOIN LATERAL (SELECT event_id, m, depth_km, {_AGE} AS age, {_hav("g.clat", "g.clon", "latitude", "longitude")} AS dist FROM q WHERE q.i = g.i AND q.j = g.j AND t < o.origin) ON TRUE GROUP BY o.origin, g.cell_id)"""
_NEAR = f"""near AS (SELECT o.origin AS origin, g.cell_id AS cell_id, count(*) FILTER (d <= 50) AS d50, count(*) FILTER (d <= 100) AS d100 FROM (SELECT o.origin, g.cell_id, {_hav("g.clat", "g.clon", "z.latitude", "z.longitude")} AS d FROM origins o JOIN q z ON z.t < o.origin, grid g) g JOIN origins o USING (origin) GROUP BY o.origin, g.cell_id),
ring AS (SELECT o.origin AS origin, g.cell_id AS cell_id, count(z.m) AS n FROM origins o CROSS JOIN grid g LEFT JOIN q z ON z.t < o.origin AND epoch_us(o.origin) - epoch_us(z.t) <= {30 * DAY_US} AND abs(z.i - g.i) <= 1 AND abs(z.j - g.j) <= 1 AND (z.i <> g.i OR z.j <> g.j) GROUP BY o.origin, g.cell_id)"""


def _far(e: str) -> str:
    return f"coalesce({_hav('clat', 'clon', f'''{e}['a']''', f'''{e}['o']''')}, 500.0::DOUBLE)"


def _after(e: str) -> str:
    return f"(epoch_us(origin) - epoch_us({e}['t'])) / 86400e6::DOUBLE"


_NAMED = {
    "hist_rate_all": "n_all / x",
    "hist_rate_above_45": "n_45 / x",
    "hist_rate_above_50": "n_50 / x",
    "hist_rate_above_55": "n_55 / x",
    **{f"n_prev_{k}d": f"n_{k}::DOUBLE" for k in (1, 7, 30, 90, 365)},
    "time_since_last_event_days": "coalesce(last_age, x * 365.25::DOUBLE)",
    "time_since_last_m5_days": f"coalesce({_after('m5')}, x * 365.25::DOUBLE)",
    "time_since_last_m6_days": f"coalesce({_after('m6')}, x * 365.25::DOUBLE)",
    "rolling_rate_30d": "n_30 / 30::DOUBLE",
    "rolling_rate_90d": "n_90 / 90::DOUBLE",
    "max_mag_recent_30d": "coalesce(max_30, 0)",
    "max_mag_recent_90d": "coalesce(max_90, 0)",
    "mean_mag_recent_90d": "coalesce(mean_90, 0)",
    "mag_var_recent_90d": "coalesce(var_90, 0)",
    "mag_p90_recent_90d": "coalesce(p90, 0)",
    "n_above_45_recent_30d": "k45::DOUBLE",
    "n_above_50_recent_30d": "k50::DOUBLE",
    "n_above_55_recent_90d": "k55::DOUBLE",
    "rolling_b_value_365d": "CASE WHEN k365 >= 20 AND mean365 > 4.4::DOUBLE THEN log10(exp(1.0::DOUBLE)) / (mean365 - 4.4::DOUBLE) ELSE 0 END",
    "local_density_50km": "coalesce(d50, 0) / x",
    "local_density_100km": "coalesce(d100, 0) / x",
    "neighbor_activity_8cells": "ring.n::DOUBLE",
    "dist_to_last_event_km": "coalesce(last_dist, 500)",
    "dist_to_last_m5_km": _far("m5"),
    "dist_to_last_m6_km": _far("m6"),
    "spatial_concentration": "CASE WHEN g30 > 0 THEN coalesce(d50, 0) / g30 ELSE 0 END",
    "mean_depth_recent_90d": "coalesce(dm, 0)",
    "depth_var_recent_90d": "coalesce(dv, 0)",
    "n_shallow_recent_90d": "sh::DOUBLE",
    "n_intermediate_recent_90d": "im::DOUBLE",
    "n_deep_recent_90d": "de::DOUBLE",
    "depth_weighted_density": "coalesce(wd, 0) / x",
    "rate_acceleration_30d_vs_90d": "(n_30 / 30::DOUBLE - n_90 / 90::DOUBLE) / greatest(n_90 / 90::DOUBLE, 1e-6::DOUBLE)",
    "omori_time_since_m5": f"coalesce(1 / ({_after('m5')} + 1), 0)",
    "omori_time_since_m6": f"coalesce(1 / ({_after('m6')} + 1), 0)",
    "post_m5_activity_7d": "post5::DOUBLE",
    "post_m6_activity_7d": "post6::DOUBLE",
    "n_mainshocks_90d": "main90::DOUBLE",
    "dcfs_cumulative_Pa": "0.0::DOUBLE",
}
_FEATURES = [GRID, _ORIGINS, _BIG, _CELL, _NEAR]
_FROM = "percell JOIN globe USING (origin) JOIN grid USING (cell_id) LEFT JOIN near USING (origin, cell_id) JOIN ring USING (origin, cell_id)"
_COLUMNS = ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in _NAMED.items())


@query(_q(f"SELECT origin, cell_id, {_COLUMNS} FROM {_FROM}", *_FEATURES))
def features_all(spark, sf_dir):
    return features.features(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST))


@query(
    _q(
        f"""SELECT *, (n_future > 0)::INT AS label FROM (SELECT origin, cell_id, hist_rate_all, n_prev_365d, (SELECT count(*) FROM quakes z WHERE z.m >= 4.0 AND z.t >= f.origin AND epoch_us(z.t) < epoch_us(f.origin) + 30 * 86400000000 AND z.latitude < 28 AND z.longitude < 96 AND printf('cell_%02d_%02d', floor(z.latitude - 20)::INT, floor(z.longitude - 88)::INT) = f.cell_id) AS n_future FROM (SELECT origin, cell_id, {_COLUMNS} FROM {_FROM}) f)""",
        *_FEATURES,
    )
)
def features_labelled(spark, sf_dir):
    rows = features.labelled(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), 4.0, 30.0)
    return rows.select("origin", "cell_id", "hist_rate_all", "n_prev_365d", "n_future", "label")


@query()
def feature_groups(spark, sf_dir):
    """The features of each ablation group, with the number of cells that have them at the last origin."""
    rows = features.features(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, LAST, LAST))
    groups = {letter: features.group(rows, letter) for letter in "ABCDEFG"}
    marks = [F.struct(F.lit(letter).alias("ablation"), F.lit(k).alias("position"), F.lit(name).alias("feature"), F.col(f"n_{name}").alias("n_present")) for letter, names in groups.items() for k, name in enumerate(names)]
    return rows.agg(*[F.count(c).alias(f"n_{c}") for c in {x for names in groups.values() for x in names}]).select(F.inline(F.array(*marks)))


def _labelled(spark, sf_dir) -> DataFrame:
    return written(features.labelled(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), 4.0, 30.0), "features")


@query(_q("SELECT origin, cell_id, round(1 - exp(-avg(hist_rate_above_45) OVER (PARTITION BY origin) * (30 / 365.25::DOUBLE)), 6) AS p FROM (SELECT origin, cell_id, " + _COLUMNS + f" FROM {_FROM})", *_FEATURES))
def uniform_poisson(spark, sf_dir):
    rows = features.labelled(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), 4.0, 30.0)
    return models.uniform_poisson(rows, 30 / 365.25).select("origin", "cell_id", _r("p", "p"))


#: Trees of the ensembles in the registered query; the operators' default is 200.
TREES = 40


@query()
def model_backtest(spark, sf_dir):
    """Scores of logistic models and the base rate at every origin, each trained on all earlier ones."""
    rows = _labelled(spark, sf_dir)
    out = models.chronological(rows, ["base", "logistic", "elastic"], features.group(rows, "G"))
    return metrics.composite(out.withColumnRenamed("label", "y"), ["model"])


@query()
def ensemble_backtest(spark, sf_dir):
    """Forest, boosted and calibrated boosted trees on all features at every origin, each trained on all earlier ones."""
    rows = _labelled(spark, sf_dir)
    out = models.chronological(rows, ["base", "forest", "boosted", "isotonic", "platt"], features.group(rows, "G"), trees=TREES)
    return metrics.scores(out.withColumnRenamed("label", "y"), ["model"])


@query()
def ablation(spark, sf_dir):
    """Logistic models on each of the seven groups of features at every origin."""
    rows = _labelled(spark, sf_dir)
    out = models.compared(rows, {g: ("logistic", features.group(rows, g)) for g in "ABCDEFG"})
    return metrics.scores(out.withColumnRenamed("label", "y"), ["model"])


# ---- ledger --------------------------------------------------------------------------------------------------

_SPOILED = """spoiled AS (SELECT *, CASE WHEN (i * 8 + j) % 11 = 0 THEN NULL WHEN (i * 8 + j) % 13 = 0 THEN 1.5::DOUBLE WHEN (i * 8 + j) % 17 = 0 THEN p + 0.25::DOUBLE ELSE p END AS bad, n_train / exposure AS r, CASE WHEN n_train > 0 THEN 2.0::DOUBLE * sqrt(n_train) / exposure ELSE 0 END AS half, CASE WHEN (i + j) % 5 = 0 THEN 'v0' ELSE 'v1' END AS version FROM cp)"""


def _spoiled(spark, sf_dir):
    n = F.col("i_lat") * 8 + F.col("i_lon")
    rows = ledger.with_bounds(_ledger(spark, sf_dir))
    bad = F.when(n % 11 == 0, F.lit(None)).when(n % 13 == 0, 1.5).when(n % 17 == 0, F.col("p") + 0.25).otherwise(F.col("p"))
    return rows.withColumns({"p": bad, "version": F.when((F.col("i_lat") + F.col("i_lon")) % 5 == 0, "v0").otherwise("v1")})


@query(
    _q(
        """SELECT origin_year, threshold, horizon, count(*) FILTER (bad IS NULL) AS n_missing, count(*) FILTER (bad < 0 OR bad > 1) AS n_out_of_range, count(*) FILTER (abs(bad - p) > 1e-9) AS n_inconsistent,
    count(*) FILTER (bad < 1 - exp(-greatest(r - half, 0) * (days / 365.25::DOUBLE)) OR bad > 1 - exp(-(r + half) * (days / 365.25::DOUBLE))) AS n_disordered, count(*) FILTER (version <> 'v1') AS n_other_version FROM spoiled GROUP BY origin_year, threshold, horizon""",
        GRID,
        _YY,
        _LEDGER,
        _SPOILED,
    )
)
def ledger_integrity(spark, sf_dir):
    """Faults of a ledger into which wrong values were put."""
    return ledger.integrity(_spoiled(spark, sf_dir), "v1")


def _hash(p: str) -> str:
    return f"substr(sha256(string_agg(concat_ws(':', cell_id, n_train, printf('%.6f', round({p}, 6))), ';' ORDER BY cell_id)), 1, 16)"


@query(
    _q(
        f"""SELECT origin_year, threshold, horizon, {_hash("p")} = {_hash("CASE WHEN origin_year % 3 = 0 AND i = 0 THEN p / 2 ELSE p END")} AS intact FROM cp GROUP BY origin_year, threshold, horizon""",
        GRID,
        _YY,
        _LEDGER,
    )
)
def ledger_hashes(spark, sf_dir):
    """Records whose cells were changed after they were written."""
    cells = _ledger(spark, sf_dir)
    changed = cells.withColumn("p", F.when((F.col("origin_year") % 3 == 0) & (F.col("i_lat") == 0), F.col("p") / 2).otherwise(F.col("p")))
    return ledger.hash_faults(ledger.records(cells), changed)


@query(_q(f"SELECT origin_year, threshold, horizon, {_hash('p')} AS forecast_hash, origin_year = {LAST} AS is_latest FROM cp GROUP BY origin_year, threshold, horizon", GRID, _YY, _LEDGER))
def ledger_history(spark, sf_dir):
    return ledger.history(ledger.records(_ledger(spark, sf_dir))).select("origin_year", "threshold", "horizon", "forecast_hash", "is_latest")


_NOW = "2023-01-20"
_SCORED = f"""cy AS (SELECT threshold, horizon, origin_year, cell_id, p, epoch_us(make_timestamp(origin_year, 1, 1, 0, 0, 0)) + days * 86400000000 <= epoch_us(TIMESTAMP '{_NOW} 00:00:00') AS done, (EXISTS (SELECT 1 FROM q WHERE q.i = cp.i AND q.j = cp.j AND m >= threshold AND yr = origin_year AND epoch_us(t) - epoch_us(make_timestamp(origin_year, 1, 1, 0, 0, 0)) < days * 86400000000))::INT AS y FROM cp)"""


def _scores(spark, sf_dir) -> DataFrame:
    cells, events = ledger.closed(_ledger(spark, sf_dir), _NOW), catalog.quakes(spark, sf_dir)
    parts = [ledger.scored(cells, events, t, h, d, FIRST, LAST) for t in (4.0, 4.5) for h, d in (("7d", 7), ("30d", 30))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


@query(
    _q(
        """SELECT *, CASE WHEN n_forecasts >= 50 AND n_evaluated >= 30 THEN 4 WHEN n_forecasts >= 20 AND n_evaluated >= 10 THEN 3 WHEN n_forecasts >= 5 AND n_evaluated >= 3 THEN 2 WHEN n_forecasts >= 1 AND n_evaluated >= 1 THEN 1 ELSE 0 END AS evidence_level FROM (
    SELECT threshold, horizon, count(DISTINCT origin_year) AS n_forecasts, count(DISTINCT origin_year) FILTER (done) AS n_evaluated, round(avg((p - y) * (p - y)) FILTER (done), 6) AS brier,
    round(avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) ELSE ln(1 - least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) END) FILTER (done), 6) AS log_likelihood FROM cy GROUP BY GROUPING SETS ((threshold, horizon), ()))""",
        GRID,
        _YY,
        _LEDGER,
        _SCORED,
    )
)
def ledger_summary(spark, sf_dir):
    """Scores as of a day on which the last windows of 30 days are still open."""
    return ledger.summary(_scores(spark, sf_dir))


@query(
    _q(
        f"""SELECT threshold, horizon, n_evaluated, brier, lower, upper FROM (SELECT threshold, horizon, count(DISTINCT origin_year) AS n_evaluated, round(avg((p - y) * (p - y)), 6) AS brier FROM cy WHERE done GROUP BY threshold, horizon) JOIN (
    SELECT threshold, horizon, round(quantile_cont(b, 0.025), 6) AS lower, round(quantile_cont(b, 0.975), 6) AS upper FROM (SELECT threshold, horizon, r, sum(e) / sum(n) AS b FROM (SELECT threshold, horizon, r, {_LCG.format(r="r", i="k")} % size AS i FROM range(200) x(r), (SELECT threshold, horizon, count(*) AS size, unnest(range(count(*))) AS k FROM sums GROUP BY threshold, horizon)) JOIN sums USING (threshold, horizon, i) GROUP BY threshold, horizon, r) GROUP BY threshold, horizon) USING (threshold, horizon)""",
        GRID,
        _YY,
        _LEDGER,
        _SCORED,
        "sums AS (SELECT threshold, horizon, row_number() OVER (PARTITION BY threshold, horizon ORDER BY origin_year) - 1 AS i, sum((p - y) * (p - y)) AS e, count(*) AS n FROM cy WHERE done GROUP BY threshold, horizon, origin_year)",
    )
)
def ledger_intervals(spark, sf_dir):
    return ledger.brier_intervals(_scores(spark, sf_dir).where("done"))


@query(
    _q(
        """SELECT threshold, horizon, count(DISTINCT origin_year) AS n_evaluated, round(avg((p - y) * (p - y)), 6) AS brier_1, round(avg((p2 - y) * (p2 - y)), 6) AS brier_2, round(avg((p2 - y) * (p2 - y)) - avg((p - y) * (p - y)), 6) AS difference, FALSE AS eligible
    FROM cy JOIN (SELECT origin_year, threshold, horizon, cell_id, 1 - exp(-avg(rate) OVER (PARTITION BY origin_year, threshold, horizon) * (days / 365.25::DOUBLE)) AS p2 FROM cp WHERE origin_year % 2 = 1) USING (origin_year, threshold, horizon, cell_id) WHERE done GROUP BY threshold, horizon""",
        GRID,
        _YY,
        _LEDGER,
        _SCORED,
    )
)
def ledgers_compared(spark, sf_dir):
    """Two ledgers on the forecasts that both hold; the second one has the mean rate and every other origin."""
    from pyspark.sql import Window

    mean = F.avg("rate").over(Window.partitionBy("origin_year", "threshold", "horizon"))
    other = _ledger(spark, sf_dir).where("origin_year % 2 = 1").withColumn("p", p_at_least_one(mean, F.col("horizon_days") / 365.25))
    return verdicts.promotable(ledger.compared(_scores(spark, sf_dir).where("done"), other))


@query(_q("SELECT count(*) AS n, round(min((epoch_us(TIMESTAMP '2023-06-01 00:00:00') - epoch_us(t)) / 86400e6::DOUBLE), 6) AS age_days, count(*) FILTER ((epoch_us(TIMESTAMP '2023-06-01 00:00:00') - epoch_us(t)) / 86400e6::DOUBLE <= 30) AS n_30d, CASE WHEN min((epoch_us(TIMESTAMP '2023-06-01 00:00:00') - epoch_us(t)) / 86400e6::DOUBLE) > 7 THEN 'stale' ELSE 'fresh' END AS status FROM q WHERE t <= TIMESTAMP '2023-06-01 00:00:00'"))
def freshness(spark, sf_dir):
    return ledger.freshness(catalog.quakes(spark, sf_dir), "2023-06-01")


