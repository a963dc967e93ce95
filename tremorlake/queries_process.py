"""Queries of the point process: diagnostics, conditioned forecasts, sweeps and simulated catalogs; stress audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions import seismo
from tremorlake.operators import coulomb, etas, inference, joins, rates, rings, simulate
from tremorlake.queries import _LCG, _ORIGINS, FIRST, GRID, LAST, YEARS, _forecast, _hav, _q, _r, query
from tremorlake.queries_rates import _posterior, _POST
from tremorlake.sources import catalog

ETAS = C.ETAS
_LOG = etas.log_edges(0.01, 365.0, 19)
_LOG_KM = etas.log_edges(1.0, 500.0, 19)


def _case(x: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {edges[k]!r}::DOUBLE AND {x} < {edges[k + 1]!r}::DOUBLE THEN {k}" for k in range(len(edges) - 1)) + " END"


def _omori_sql(main: float, target: float, edges: list[float]) -> str:
    us = [round(e * 86400000000) for e in edges]
    bins = "CASE " + " ".join(f"WHEN g >= {us[k]} AND g < {us[k + 1]} THEN {k}" for k in range(len(us) - 1)) + " END"
    values = ", ".join(f"({k}, {edges[k]!r}::DOUBLE, {edges[k + 1]!r}::DOUBLE)" for k in range(len(edges) - 1))
    return f"""omori AS (SELECT e.bin, lag_from, coalesce(n, 0)::BIGINT AS n, round(x, 6) AS exposure_days, round(coalesce(n, 0) / nullif(x, 0) / base, 6) AS ratio FROM (
      SELECT b.bin, lo AS lag_from, sum(greatest(0, least(hi, (epoch_us(t1) - epoch_us(t)) / 86400e6::DOUBLE) - lo)) AS x FROM q, w, (VALUES {values}) b(bin, lo, hi) WHERE m >= {main} GROUP BY b.bin, lo) e
    LEFT JOIN (SELECT bin, count(*) AS n FROM (SELECT {bins} AS bin FROM (SELECT epoch_us(b.t) - epoch_us(a.t) AS g FROM q a JOIN q b ON a.m >= {main} AND b.m >= {target} AND b.t > a.t AND b.t <= a.t + INTERVAL 366 DAY)) WHERE bin IS NOT NULL GROUP BY bin) c USING (bin), w)"""


def _span(target: float) -> str:
    return f"w AS (SELECT min(t) AS t0, max(t) AS t1, count(*) / ((epoch_us(max(t)) - epoch_us(min(t))) / 86400e6::DOUBLE) AS base FROM q WHERE m >= {target})"


@query(_q("SELECT * FROM omori", _span(4.0), _omori_sql(5.5, 4.0, _LOG)))
def omori_log_bins(spark, sf_dir):
    return etas.omori_ratio(catalog.quakes(spark, sf_dir), 5.5, 4.0, _LOG)


@query(
    _q(
        f"""SELECT max(ratio) AS peak_ratio, round(arg_max(centre, (ratio, -bin)), 6) AS peak_days, count(*) FILTER (centre < 7 AND ratio > 2) > 0 AS omori_like FROM omori JOIN (VALUES {", ".join(f"({k}, {(_LOG[k] * _LOG[k + 1]) ** 0.5!r}::DOUBLE)" for k in range(19))}) c(bin, centre) USING (bin) WHERE ratio IS NOT NULL""",
        _span(4.0),
        _omori_sql(5.5, 4.0, _LOG),
    )
)
def omori_summary(spark, sf_dir):
    return etas.omori_summary(etas.omori_ratio(catalog.quakes(spark, sf_dir), 5.5, 4.0, _LOG), _LOG)


_RING_AREA = "CASE " + " ".join(f"WHEN bin = {k} THEN {3.141592653589793 * (_LOG_KM[k + 1] ** 2 - _LOG_KM[k] ** 2)!r}::DOUBLE" for k in range(19)) + " END"
_RINGS = f"""post AS (SELECT bin, count(*) AS n FROM (SELECT {_case("d", _LOG_KM)} AS bin FROM (SELECT {_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} AS d FROM q a JOIN q b ON a.m >= 5.5 AND b.m >= 4.0 AND b.t > a.t AND b.t <= a.t + INTERVAL 30 DAY)) WHERE bin IS NOT NULL GROUP BY bin),
pairs AS (SELECT bin, count(*) AS n FROM (SELECT {_case("d", _LOG_KM)} AS bin FROM (SELECT {_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} AS d FROM q a JOIN q b ON a.m >= 5.5 AND b.m >= 5.5 AND a.event_id < b.event_id)) WHERE bin IS NOT NULL GROUP BY bin)"""
_NEAR = [k for k in range(19) if (_LOG_KM[k] * _LOG_KM[k + 1]) ** 0.5 < 50]


@query(
    _q(
        f"""SELECT round(a * 1e6, 6) AS post, round(b * 1e6, 6) AS pairs, round(a / nullif(b, 0), 6) AS ratio, coalesce(a / nullif(b, 0) > 2, FALSE) AS clustered FROM (SELECT (SELECT sum(n / {_RING_AREA}) FILTER (bin IN ({", ".join(map(str, _NEAR))})) / sum(n) FROM post) AS a, (SELECT sum(n / {_RING_AREA}) FILTER (bin IN ({", ".join(map(str, _NEAR))})) / sum(n) FROM pairs) AS b)""",
        _RINGS,
    )
)
def aftershock_concentration(spark, sf_dir):
    """Do aftershocks lie nearer to mainshocks than large events lie to each other?"""
    q = catalog.quakes(spark, sf_dir)
    post = etas.spatial_aftershocks(q, 5.5, 4.0, 30.0, _LOG_KM).select("bin", "n")
    pairs = rings.pair_distances(q.where("m >= 5.5D"), _LOG_KM).where("bin IS NOT NULL")
    return etas.near_ratio(post, pairs, _LOG_KM)


_REGULAR = "regular AS (SELECT make_timestamp(unnest(range(a, z + 1, 30 * 86400000000))) AS origin FROM (SELECT epoch_us(min(t)) + 365 * 86400000000 AS a, epoch_us(max(t)) AS z FROM q))"
_COND = """cond AS (SELECT 'background' AS label, origin FROM regular WHERE NOT EXISTS (SELECT 1 FROM q WHERE m >= 6.0 AND t < origin AND epoch_us(origin) - epoch_us(t) <= 90 * 86400000000)
  UNION ALL SELECT l, t + to_days(d) FROM q, (VALUES (1, '0-24h'), (7, '1-7d'), (30, '8-30d'), (90, '31-90d')) v(d, l) WHERE m >= 6.0)"""


def _conditioned(spark, sf_dir):
    q = catalog.quakes(spark, sf_dir)
    after = etas.conditioned_origins(q, 6.0).select("label", "origin")
    calm = etas.background_origins(q, etas.regular_origins(q), 6.0).select(F.lit("background").alias("label"), "origin")
    return calm.unionByName(after)


@query(
    _q(
        "SELECT label, origin, "
        + ", ".join(f"(SELECT count(*) FROM q WHERE t < origin AND epoch_us(t) >= epoch_us(origin) - {d} * 86400000000) AS n_{d}d" for d in (1, 7, 30, 90))
        + ", (SELECT count(*) FROM q WHERE m >= 6.0 AND t < origin AND epoch_us(t) >= epoch_us(origin) - 90 * 86400000000) AS n_main_90d FROM cond",
        _REGULAR,
        _COND,
    )
)
def origin_context(spark, sf_dir):
    """Origins after mainshocks and calm ones, with the events of the days before them."""
    return etas.with_context(_conditioned(spark, sf_dir), catalog.quakes(spark, sf_dir), 6.0)


_EXPECTED = """scored AS (SELECT label, origin, (20.0::DOUBLE / 365.25::DOUBLE * 7.0::DOUBLE + coalesce((SELECT sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)) * pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 0.01::DOUBLE, -0.1::DOUBLE) - pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 7.01::DOUBLE, -0.1::DOUBLE))) FROM q WHERE t < origin AND m >= 3.95), 0)) AS e,
  (SELECT count(*) FROM q WHERE m >= 4.0 AND t < origin) / ((epoch_us(origin) - 157766400000000) / 86400e6::DOUBLE) * 7 AS e0, (EXISTS (SELECT 1 FROM q WHERE m >= 4.0 AND t >= origin AND epoch_us(t) < epoch_us(origin) + 7 * 86400000000))::INT AS y FROM cond)"""


@query(
    _q(
        """SELECT label, count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg(pow(1 - exp(-e) - y, 2)), 6) AS brier_etas, round(avg(pow(1 - exp(-e0) - y, 2)), 6) AS brier_poisson FROM scored GROUP BY label""",
        _REGULAR,
        _COND,
        _EXPECTED,
    )
)
def conditioned_scores(spark, sf_dir):
    """Self-exciting and Poisson forecasts for a week, by how long ago the last mainshock was."""
    q = catalog.quakes(spark, sf_dir)
    rows = simulate.conditioned(q, _conditioned(spark, sf_dir), 7.0, {"etas": ETAS})
    err = lambda c: _r(F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), err("p_etas").alias("brier_etas"), err("p_poisson").alias("brier_poisson"))


@query()
def conditioned_with_fit(spark, sf_dir):
    """The same with a third model, fitted to the events before the first origin."""
    q = catalog.quakes(spark, sf_dir)
    origins = _conditioned(spark, sf_dir)
    until = str(origins.agg(F.min("origin") - F.expr("INTERVAL 1 DAY")).first()[0])
    rows = simulate.conditioned(q, origins, 7.0, {"etas": ETAS, "local": simulate.fitted_model(q, until, 4.0)})
    err = lambda c: _r(F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("y").alias("n_positive"), *[err(f"p_{x}").alias(f"brier_{x}") for x in ("etas", "local", "poisson")])


_SHORT = [("1h", 1 / 24), ("6h", 0.25), ("1d", 1.0), ("3d", 3.0), ("7d", 7.0), ("30d", 30.0)]


@query(
    _q(
        "SELECT horizon, count(*) AS n, round(avg(pow(1 - exp(-e) - y, 2)), 6) AS brier_etas, round(avg(pow(1 - exp(-e0) - y, 2)), 6) AS brier_poisson FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{h}' AS horizon, 20.0::DOUBLE / 365.25::DOUBLE * {d!r}::DOUBLE + coalesce((SELECT sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)) * pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 0.01::DOUBLE, -0.1::DOUBLE) - pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + {d!r}::DOUBLE + 0.01::DOUBLE, -0.1::DOUBLE))) FROM q WHERE t < origin AND m >= 3.95), 0) AS e,
      (SELECT count(*) FROM q WHERE m >= 4.0 AND t < origin) / ((epoch_us(origin) - 157766400000000) / 86400e6::DOUBLE) * {d!r}::DOUBLE AS e0, (EXISTS (SELECT 1 FROM q WHERE m >= 4.0 AND t >= origin AND epoch_us(t) < epoch_us(origin) + {round(d * 86400000000)}))::INT AS y FROM after"""
            for h, d in _SHORT
        )
        + ") GROUP BY horizon",
        "after AS (SELECT make_timestamp(epoch_us(t) + 3600000000) AS origin FROM q WHERE m >= 6.0)",
    )
)
def short_horizons(spark, sf_dir):
    """Forecasts from an hour after each large event on, for six horizons."""
    q = catalog.quakes(spark, sf_dir)
    return simulate.short_horizons(q, 6.0, _SHORT, ETAS)


_TAU = """tau AS (SELECT e.event_id, e.t, 20.0::DOUBLE / 365.25::DOUBLE * (epoch_us(e.t) - (SELECT epoch_us(min(t)) FROM q WHERE m >= 4.0)) / 86400e6::DOUBLE + coalesce(sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (a.m - 4.0::DOUBLE)) * (1 - pow(0.01::DOUBLE / ((epoch_us(e.t) - epoch_us(a.t)) / 86400e6::DOUBLE + 0.01::DOUBLE), 0.1::DOUBLE))), 0) AS tau
  FROM (SELECT * FROM q WHERE m >= 4.0) e LEFT JOIN (SELECT * FROM q WHERE m >= 4.0) a ON a.t < e.t GROUP BY e.event_id, e.t),
gp AS (SELECT rank, gap FROM (SELECT row_number() OVER (ORDER BY t, event_id) AS rank, tau - lag(tau) OVER (ORDER BY t, event_id) AS gap FROM tau) WHERE gap IS NOT NULL)"""


def _gaps(spark, sf_dir):
    return etas.gaps(etas.transformed_times(catalog.quakes(spark, sf_dir), **ETAS))


@query(_q("SELECT count(*) AS n, round(avg(gap), 6) AS mean_gap, round(max(abs(i / n - (1 - exp(-greatest(gap, 1e-12::DOUBLE))))), 6) AS ks FROM (SELECT gap, row_number() OVER (ORDER BY gap) AS i, count(*) OVER ()::DOUBLE AS n FROM gp)", _TAU))
def residual_gaps(spark, sf_dir):
    """How far transformed gaps are from a unit exponential."""
    return etas.ks_of_gaps(_gaps(spark, sf_dir))


@query(
    _q(
        'SELECT w AS "window", round(avg(gap), 5) AS mean FROM (SELECT rank - 2 AS n, gap FROM gp) JOIN (SELECT unnest(range(0, (SELECT count(*) FROM gp) // 5 + 1)) AS w) ON n BETWEEN w * 5 AND w * 5 + 9 GROUP BY w HAVING count(*) = 10',
        _TAU,
    )
)
def rolling_gaps(spark, sf_dir):
    return etas.rolling_gaps(_gaps(spark, sf_dir), 10, 5).select("window", F.round("mean", 5).alias("mean"))


@query(_q("SELECT bin, observed, round(total * (pow(10.0::DOUBLE, -0.9::DOUBLE * 0.2::DOUBLE * bin) - pow(10.0::DOUBLE, -0.9::DOUBLE * 0.2::DOUBLE * (bin + 1))), 6) AS expected FROM (SELECT floor((m - 4.0::DOUBLE) / 0.2::DOUBLE + 1e-9)::INT AS bin, count(*) AS observed, (SELECT count(*) FROM q WHERE m >= 4.0) AS total FROM q WHERE m >= 4.0 GROUP BY ALL)"))
def magnitude_residuals(spark, sf_dir):
    return etas.magnitude_residuals(catalog.quakes(spark, sf_dir), 4.0, 0.9)


_FLAT = "sqrt(pow(radians(clon - longitude) * cos(radians((latitude + clat) / 2)), 2) + pow(radians(clat - latitude), 2)) * 6371.0088::DOUBLE"


@query(
    _q(
        f"""SELECT g.origin AS origin, g.cell_id AS cell_id, round(1e6 * (20.0::DOUBLE / 365.25::DOUBLE * share / (110.574::DOUBLE * 111.320::DOUBLE * cos(radians(clat))) + coalesce(s, 0)), 6) AS per_million_km2 FROM (SELECT * FROM origins, (SELECT *, cos(radians(clat)) / sum(cos(radians(clat))) OVER () AS share FROM grid)) g LEFT JOIN (
    SELECT origin, cell_id, sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)) * 0.1::DOUBLE * pow(0.01::DOUBLE, 0.1::DOUBLE) * pow(lag + 0.01::DOUBLE, -1.1::DOUBLE) * 1.5::DOUBLE / (pi() * 400) * pow(1 + d * d / 400.0::DOUBLE, -2.5::DOUBLE)) AS s
    FROM (SELECT origin, cell_id, m, (epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE AS lag, {_FLAT} AS d FROM origins JOIN q ON t < origin AND m >= 4.0 AND epoch_us(origin) - epoch_us(t) <= 365 * 86400000000, grid) GROUP BY origin, cell_id) x ON x.origin = g.origin AND x.cell_id = g.cell_id""",
        GRID,
        _ORIGINS,
    )
)
def conditional_intensity(spark, sf_dir):
    out = etas.conditional_intensity(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), joins.grid(spark), **ETAS)
    return out.select("origin", "cell_id", F.round(F.col("lambda_per_day_km2") * 1e6, 6).alias("per_million_km2"))


@query(_q("SELECT event_id, round((epoch_us(t) - (SELECT epoch_us(min(t)) FROM q WHERE m >= 4.0::DOUBLE - 0.05::DOUBLE AND depth_km < 70)) / 86400e6::DOUBLE, 6) AS days, latitude, longitude, depth_km, m FROM q WHERE m >= 4.0::DOUBLE - 0.05::DOUBLE AND depth_km >= 0 AND depth_km < 70"))
def prepared_catalog(spark, sf_dir):
    out = etas.prepared(catalog.quakes(spark, sf_dir), 4.0, (0.0, 70.0))
    return out.withColumn("days", _r("days"))


_SWEEP = [(0, 20.0, 0.02, 0.8, 0.01, 1.1), (1, 10.0, 0.02, 0.8, 0.01, 1.1), (2, 20.0, 0.05, 0.8, 0.01, 1.1), (3, 20.0, 0.02, 1.0, 0.01, 1.1), (4, 20.0, 0.02, 0.8, 0.05, 1.1), (5, 20.0, 0.02, 0.8, 0.01, 1.3)]
_SWEEP_SQL = "sweep AS (SELECT param_id, origin, e, (EXISTS (SELECT 1 FROM q WHERE m >= 4.5 AND t >= origin AND epoch_us(t) < epoch_us(origin) + 30 * 86400000000))::INT AS y FROM (SELECT param_id, origin, (mu / 365.25::DOUBLE * 30 + coalesce((SELECT sum(k * pow(10.0::DOUBLE, alpha * (m - 4.0::DOUBLE)) * pow(c, p - 1) * (pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + c, 1 - p) - pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 30 + c, 1 - p))) FROM q WHERE t < origin AND m >= 4.0::DOUBLE - 0.05::DOUBLE), 0)) * pow(10.0::DOUBLE, -0.45::DOUBLE) AS e FROM origins, (VALUES " + ", ".join("(" + ", ".join([str(x[0]), *[f"{v!r}::DOUBLE" for v in x[1:]]]) + ")" for x in _SWEEP) + ") v(param_id, mu, k, alpha, c, p)))"


@query(_q("SELECT param_id, count(*) AS n, round(avg(e), 6) AS mean_expected, round(avg(pow(1 - exp(-e) - y, 2)), 6) AS brier FROM sweep GROUP BY param_id", _ORIGINS, _SWEEP_SQL))
def parameter_sweep(spark, sf_dir):
    """Scores of forecasts under one parameter changed at a time."""
    q = catalog.quakes(spark, sf_dir)
    params = spark.createDataFrame(_SWEEP, "param_id int, mu_per_year double, k double, alpha double, c double, p double")
    rows = etas.swept(q, joins.yearly_origins(spark, FIRST, LAST), params, 30.0, 4.5, 4.0, 0.9)
    seen = rates.outcomes(q, 4.5, 30.0, FIRST, LAST).groupBy(F.make_timestamp("origin_year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("origin")).agg(F.sum("n_future").alias("n"))
    rows = rows.join(seen, "origin", "left").withColumn("y", (F.coalesce("n", F.lit(0)) > 0).cast("int"))
    return rows.groupBy("param_id").agg(F.count("*").alias("n"), _r(F.avg("expected"), "mean_expected"), _r(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), "brier"))


_DRAW = "((({x}) + 1) / 1000004.0::DOUBLE)"


def _u(k: int, of: str = "param_id") -> str:
    return _DRAW.format(x=f"({_LCG.format(r='r', i=f'({of} * 2 + {k})')} % 1000003)")


@query(
    _q(
        f"""SELECT param_id, any_value(observed) AS observed, round(avg(total), 6) AS mean_total, round(quantile_cont(total, 0.025), 6) AS lower, round(quantile_cont(total, 0.975), 6) AS upper, any_value(observed) BETWEEN quantile_cont(total, 0.025) AND quantile_cont(total, 0.975) AS passes FROM (
    SELECT param_id, floor(greatest(round(mu * {YEARS}::DOUBLE + sqrt(mu * {YEARS}::DOUBLE) * sqrt(-2 * ln({_u(0)})) * cos(2 * pi() * {_u(1)})), 0) / greatest(1 - least(ratio, 0.95), 0.05)) AS total, (SELECT count(*) FROM q WHERE m >= 4.0) AS observed
    FROM range(200) x(r), (SELECT 0 AS param_id, (SELECT count(*) FROM q WHERE m >= 4.0) / {YEARS}::DOUBLE AS mu, 0.0::DOUBLE AS ratio UNION ALL SELECT 1, 20.0::DOUBLE, 0.1::DOUBLE)) GROUP BY param_id"""
    )
)
def simulated_catalogs(spark, sf_dir):
    """Is the observed number of events among those of simulated catalogs?"""
    n = catalog.quakes(spark, sf_dir).where("m >= 4.0D").agg(F.count("*").alias("observed"))
    params = n.select(F.inline(F.array(F.struct(F.lit(0).alias("param_id"), (F.col("observed") / YEARS).alias("mu_per_year"), F.lit(0.0).alias("ratio")), F.struct(F.lit(1).alias("param_id"), F.lit(20.0).alias("mu_per_year"), F.lit(0.1).alias("ratio")))))
    return simulate.checked(etas.simulated_totals(params, YEARS, 200), n)


@query(
    _q(
        f"""SELECT stat, round(any_value(seen), 6) AS observed, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper, any_value(seen) BETWEEN quantile_cont(v, 0.025) AND quantile_cont(v, 0.975) AS passes FROM (
    SELECT r, unnest(['total', 'occupied', 'largest', 'top3_share']) AS stat, unnest([sum(n), count(*) FILTER (n > 0), max(n), sum(n) FILTER (k <= 3) / nullif(sum(n), 0)]::DOUBLE[]) AS v FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, cell_id) AS k FROM draws) GROUP BY r)
    JOIN (SELECT unnest(['total', 'occupied', 'largest', 'top3_share']) AS stat, unnest([sum(n), count(*) FILTER (n > 0), max(n), sum(n) FILTER (k <= 3) / nullif(sum(n), 0)]::DOUBLE[]) AS seen FROM (SELECT *, row_number() OVER (ORDER BY n DESC, cell_id) AS k FROM per)) USING (stat) GROUP BY stat""",
        GRID,
        _forecast(),
        _POST,
        "per AS (SELECT cell_id, n_train AS n, exposure FROM fc WHERE origin_year = 2023)",
        f"draws AS (SELECT r, cell_id, greatest(round(mu + sqrt(mu) * sqrt(-2 * ln({_u(0, 'c')})) * cos(2 * pi() * {_u(1, 'c')})), 0) AS n FROM range(100) x(r), (SELECT cell_id, shape / rate * exposure AS mu, i * 8 + j AS c FROM post JOIN per USING (cell_id) JOIN grid USING (cell_id)))",
    )
)
def posterior_predictive(spark, sf_dir):
    """Counts per cell drawn under the posterior against the observed ones: total, occupied cells, largest, top three."""
    cells = _posterior(spark, sf_dir).select("cell_id", (F.col("i_lat") * 8 + F.col("i_lon")).alias("cell"), F.col("n_train").alias("n"), (F.col("shape") / F.col("scale_rate") * F.col("exposure_years")).alias("mean"))
    return simulate.posterior_predictive(cells, 100)


@query(
    _q(
        f"""SELECT origin, round(sum(e), 6) AS expected, round(1 - exp(sum(ln(greatest(exp(-e), 1e-300::DOUBLE)))), 6) AS p FROM (SELECT origin, g, 6.0::DOUBLE / 365.25::DOUBLE * 30 + coalesce((SELECT sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)) * pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 0.01::DOUBLE, -0.1::DOUBLE) - pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 30.01::DOUBLE, -0.1::DOUBLE))) FROM q WHERE t < origin AND m >= 3.95 AND CASE WHEN depth_km < 25 THEN 'shallow' WHEN depth_km < 70 THEN 'intermediate' ELSE 'deep' END = g), 0) AS e FROM origins, (VALUES ('shallow'), ('intermediate'), ('deep')) v(g)) GROUP BY origin""",
        _ORIGINS,
    )
)
def combined_depths(spark, sf_dir):
    """Forecasts of each depth group by itself, combined."""
    q = catalog.quakes(spark, sf_dir).withColumn("g", seismo.depth_group(F.col("depth_km")))
    parts = [etas.temporal_forecast(q.where(F.col("g") == g), joins.yearly_origins(spark, FIRST, LAST), 30.0, 4.0, **(ETAS | {"mu_per_year": 6.0})) for g in ("shallow", "intermediate", "deep")]
    return etas.combined_regimes(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["origin"])


@query(
    _q(
        f"""SELECT g, n, round(n / {YEARS}::DOUBLE, 6) AS rate, round(mean_m, 6) AS mean_m, round(CASE WHEN n_b >= 20 THEN log10(exp(1.0::DOUBLE)) / (mean_b - (4.0::DOUBLE - 0.05::DOUBLE)) ELSE 1.0::DOUBLE END, 6) AS b, round(0.02::DOUBLE * prod, 6) AS ratio, CASE WHEN 0.02::DOUBLE * prod >= 1 THEN 'explosive' WHEN 0.02::DOUBLE * prod >= 0.5 THEN 'high' WHEN 0.02::DOUBLE * prod >= 0.2 THEN 'moderate' ELSE 'low' END AS label FROM (
    SELECT CASE WHEN depth_km < 25 THEN 'shallow' WHEN depth_km < 70 THEN 'intermediate' ELSE 'deep' END AS g, count(*) FILTER (m >= 4) AS n, avg(m) FILTER (m >= 4) AS mean_m, count(*) AS n_b, avg(m) AS mean_b, avg(pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE))) AS prod FROM q WHERE m >= 4.0::DOUBLE - 0.05::DOUBLE GROUP BY 1)"""
    )
)
def depth_dependence(spark, sf_dir):
    """Rate, b and branching ratio of each depth group."""
    m = F.col("m")
    sel = catalog.quakes(spark, sf_dir).where(m >= 4.0 - 0.05).groupBy(seismo.depth_group(F.col("depth_km")).alias("g"))
    mine = m >= 4
    per = sel.agg(F.count_if(mine).alias("n"), F.avg(F.when(mine, m)).alias("mean_m"), F.count("*").alias("n_b"), F.avg(m).alias("mean_b"), (0.02 * F.avg(F.pow(F.lit(10.0), 0.8 * (m - 4.0)))).alias("ratio"))
    b = F.when(F.col("n_b") >= 20, 0.4342944819032518 / (F.col("mean_b") - (4.0 - 0.05))).otherwise(1.0)
    return per.select("g", "n", _r(F.col("n") / YEARS, "rate"), _r("mean_m", "mean_m"), _r(b, "b"), _r("ratio", "ratio"), seismo.branching_label(F.col("ratio")).alias("label"))


_DEG = "sqrt(pow((clon - longitude) * cos(radians(24.0::DOUBLE)), 2) + pow(clat - latitude, 2))"


@query(
    _q(
        f"""SELECT cell_id, round(h, 6) AS bandwidth, round(sum(exp(-d * d / (2 * h * h)) / (2 * pi() * h * h)) / {YEARS}::DOUBLE, 6) AS rate FROM (SELECT cell_id, {_DEG} AS d FROM q, grid WHERE m >= 4.5) JOIN (SELECT cell_id, greatest(d, 1e-3::DOUBLE) AS h FROM (SELECT cell_id, d, row_number() OVER (PARTITION BY cell_id ORDER BY d) AS k FROM (SELECT cell_id, {_DEG} AS d FROM q, grid WHERE m >= 4.5)) WHERE k = 5) USING (cell_id) GROUP BY cell_id, h""",
        GRID,
    )
)
def adaptive_rates(spark, sf_dir):
    out = etas.adaptive_kernel_rates(catalog.quakes(spark, sf_dir).where("m >= 4.5D"), joins.grid(spark), YEARS, 5)
    return out.select("cell_id", _r("bandwidth", "bandwidth"), _r("rate", "rate"))


@query(
    _q(
        f"""SELECT cell_id, round(quantile_cont(rate, 0.025), 6) AS lower, round(quantile_cont(rate, 0.975), 6) AS upper FROM (
      SELECT r, cell_id, sum(w * v) / {YEARS}::DOUBLE AS rate FROM (SELECT r, event_id, {inference.weights_sql("r", "event_id")} AS w FROM range(50) x(r), q WHERE m >= 4.0)
      JOIN (SELECT event_id, cell_id, exp(-d * d / 0.5::DOUBLE) / (2 * pi() * 0.25::DOUBLE) AS v FROM (SELECT event_id, cell_id, {_DEG} AS d FROM q, grid WHERE m >= 4.0)) USING (event_id) GROUP BY r, cell_id) GROUP BY cell_id""",
        GRID,
    )
)
def smoothed_rate_bootstrap(spark, sf_dir):
    """Intervals of smoothed rates over replicates that weigh all events from magnitude 4 on."""
    return simulate.rate_bootstrap(catalog.quakes(spark, sf_dir).where("m >= 4.0D"), joins.grid(spark), YEARS, 0.5, 50)


@query(
    _q(
        """SELECT origin_year, round(1 - exp(sum(ln(greatest(1 - p, 1e-300::DOUBLE)))), 6) AS p_spatial, any_value(pe) AS p_etas, max(y) AS y FROM fc JOIN (SELECT year(origin)::INT AS origin_year, round(1 - exp(-((20.0::DOUBLE / 365.25::DOUBLE * 30 + coalesce((SELECT sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)) * pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 0.01::DOUBLE, -0.1::DOUBLE) - pow((epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE + 30.01::DOUBLE, -0.1::DOUBLE))) FROM q WHERE t < origin AND m >= 3.95), 0)))), 6) AS pe FROM origins) USING (origin_year) GROUP BY origin_year""",
        GRID,
        _forecast(),
        _ORIGINS,
    )
)
def etas_against_spatial(spark, sf_dir):
    """Regional probabilities of two models at the same origins."""
    from tremorlake.queries import _forecasts

    cells = _forecasts(spark, sf_dir).groupBy("origin_year").agg(_r(1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("p"), F.lit(1e-300))))), "p_spatial"), F.max("y").alias("y"))
    other = etas.temporal_forecast(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), 30.0, 4.0, **ETAS).select(F.year("origin").alias("origin_year"), _r("p", "p_etas"))
    return cells.join(other, "origin_year")


@query()
def etas_identifiability(spark, sf_dir):
    theta = {"mu_per_year": 20.0, "k": 0.02, "alpha": 0.8, "c": 0.01, "p": 1.1}
    out = etas.identifiability(catalog.quakes(spark, sf_dir), theta, 4.0)
    return out.select("name", "value", "at_bound", _r("standard_error", "standard_error"), "weak")


# ---- stress --------------------------------------------------------------------------------------------------


@query(
    _q(
        """SELECT event_id, latitude, longitude, depth_km, m AS mw, (event_id * 7 % 360)::DOUBLE AS strike, (event_id % 90)::DOUBLE AS dip, 90.0::DOUBLE AS rake, round(log10(CASE WHEN event_id % 2 = 0 THEN 3.0e10::DOUBLE * 100.0::DOUBLE * 1e6::DOUBLE * 1.5::DOUBLE ELSE pow(10.0::DOUBLE, 1.5::DOUBLE * m + 9.1::DOUBLE) END), 6) AS log_moment FROM q WHERE m >= 5.5 AND event_id % 9 <> 0"""
    )
)
def stress_sources(spark, sf_dir):
    """Large events that have a mechanism, with their moment from slip where that is known."""
    n = F.col("event_id")
    mech = catalog.quakes(spark, sf_dir).where(n % 9 != 0).select("event_id", (n * 7 % 360).cast("double").alias("strike"), (n % 90).cast("double").alias("dip"), F.lit(90.0).alias("rake"))
    rows = coulomb.sources(catalog.quakes(spark, sf_dir), mech, 5.5)
    slip, area = F.when(n % 2 == 0, 1.5), F.when(n % 2 == 0, 100.0)
    return rows.withColumn("log_moment", _r(F.log10(seismo.moment_from_slip(F.col("mw"), area, slip))))


@query(_q("SELECT cell_id AS receiver_id, clat AS r_lat, clon AS r_lon, round(avg(depth_km), 6) AS r_depth_km, 320.0::DOUBLE AS r_strike, 20.0::DOUBLE AS r_dip, 90.0::DOUBLE AS r_rake FROM grid g JOIN q ON q.i = g.i AND q.j = g.j WHERE m >= 4.0 GROUP BY ALL", GRID))
def stress_receivers(spark, sf_dir):
    """Receivers in the cells that hold events, at their mean depth."""
    held = rates.celled(catalog.quakes(spark, sf_dir).where("m >= 4.0D")).groupBy("i_lat", "i_lon").agg(F.avg("depth_km").alias("depth"))
    cells = joins.grid(spark).join(held, ["i_lat", "i_lon"])
    return coulomb.receivers(cells, _r(F.col("depth")), 320.0, 20.0, 90.0)


@query()
def stress_audit(spark, sf_dir):
    """What a stress forecast lacks: fields of sources by how many have them."""
    n = F.col("event_id")
    rows = catalog.quakes(spark, sf_dir).where("m >= 5.5D").select("latitude", "longitude", "depth_km", "m", F.when(n % 9 != 0, (n * 7 % 360).cast("double")).alias("strike"), F.when(n % 9 != 0, (n % 90).cast("double")).alias("dip"), F.when(n % 2 == 0, 1.5).alias("slip_m"))
    return coulomb.audit(rows, {"latitude": True, "longitude": True, "depth_km": True, "m": True, "strike": True, "dip": True, "slip_m": False})
