"""Queries of completeness, rates with their uncertainty, sensitivities and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions import geo, seismo
from tremorlake.functions.quantiles import jeffreys
from tremorlake.operators import candidates, completeness, inference, intervals, metrics, rates, uncertainty, verdicts
from tremorlake.queries import FIRST, GRID, LAST, OBS, SQL, YEARS, _forecast, _forecasts, _q, _r, query
from tremorlake.sources import catalog

_MW = "CASE WHEN magnitude_type IN ('mw', 'mww') THEN m WHEN magnitude_type = 'mb' AND m BETWEEN 3.5 AND 6.2 THEN 0.85::DOUBLE * m + 1.03::DOUBLE WHEN magnitude_type = 'ms' AND m BETWEEN 3.0 AND 6.1 THEN 0.67::DOUBLE * m + 2.07::DOUBLE WHEN magnitude_type = 'ms' AND m BETWEEN 5.8 AND 8.0 THEN 1.10::DOUBLE * m - 0.57::DOUBLE END"


def gamma_sql(keys: str) -> str:
    """Clauses bis and gq(a, p, x): the p-quantile x of the Gamma law of shape a, by halving; ``keys``: select of (a, p).

    The distribution function is its series, so it shares nothing with the Spark side but the definition.
    """
    cdf = "(SELECT sum(exp(-(lo + hi) / 2 + (a + j) * ln((lo + hi) / 2) - lgamma(a + j + 1))) FROM range(0, 1500) u(j))"
    return f"""keys AS ({keys}),
bis AS (SELECT a::DOUBLE AS a, p::DOUBLE AS p, 0.0::DOUBLE AS lo, a + 12 * sqrt(a) + 25.0::DOUBLE AS hi, 0 AS k FROM keys
  UNION ALL SELECT a, p, CASE WHEN f < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f < p THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, {cdf} AS f FROM bis WHERE k < 56)),
gq AS (SELECT a, p, (lo + hi) / 2 AS x FROM bis WHERE k = 56)"""


def _lo(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE (SELECT x FROM gq WHERE a = {n} AND p = 0.025::DOUBLE) END)"


def _hi(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN (SELECT x FROM gq WHERE a = 1 AND p = 0.95::DOUBLE) ELSE (SELECT x FROM gq WHERE a = {n} + 1 AND p = 0.975::DOUBLE) END)"


def _garwood_keys(counts: str) -> str:
    return f"SELECT DISTINCT n::DOUBLE AS a, 0.025::DOUBLE AS p FROM ({counts}) WHERE n > 0 UNION SELECT DISTINCT n + 1.0::DOUBLE, 0.975::DOUBLE FROM ({counts}) WHERE n > 0 UNION SELECT 1.0::DOUBLE, 0.95::DOUBLE"


def _half_keys(counts: str, shift: float) -> str:
    return f"SELECT DISTINCT n + {shift}::DOUBLE AS a, p FROM ({counts}), (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) v(p)"


# ---- completeness --------------------------------------------------------------------------------------------

_RC = "rc AS (SELECT bin, (sum(count(*)) OVER (ORDER BY bin DESC))::BIGINT AS n_above, sum(sum(m)) OVER (ORDER BY bin DESC) AS s_above FROM q GROUP BY bin)"
_GFT = """gft AS (SELECT round((c + 0.5::DOUBLE) / 10, 6) AS mc, round(1 - sum(abs(n_above - n_c * pow(10.0::DOUBLE, -b * (bin - c) / 10.0::DOUBLE))) / sum(n_above), 6) AS r
  FROM (SELECT bin AS c, n_above AS n_c, log10(exp(1.0::DOUBLE)) / (s_above / n_above - bin / 10.0::DOUBLE) AS b FROM rc WHERE n_above >= 10) x JOIN rc ON rc.bin >= c GROUP BY c, n_c, b)"""
_GFT_PICK = "coalesce((SELECT min(mc) FROM gft WHERE r >= 0.95), (SELECT mc FROM gft ORDER BY r DESC, mc LIMIT 1))"
_STEPP = """stepp AS (SELECT round(c / 10.0::DOUBLE, 6) AS mc, round(stddev_pop(n) / avg(n), 6) AS cv FROM (
  SELECT c, yr, count(*) AS n FROM q JOIN (SELECT DISTINCT bin AS c FROM q) ON bin >= c GROUP BY c, yr) GROUP BY c HAVING sum(n) >= 20 AND count(*) >= 5)"""
_STEPP_PICK = "coalesce((SELECT min(mc) FROM stepp WHERE cv <= 0.5), (SELECT mc FROM stepp ORDER BY cv, mc LIMIT 1))"
_CDF = "(CASE WHEN z >= 0 THEN 1 - up ELSE up END)"
_EMR = f"""eb AS (SELECT b AS bin, coalesce(n, 0) AS n, (SELECT count(*) FROM q) AS total FROM range((SELECT min(bin) FROM q), (SELECT max(bin) + 1 FROM q)) r(b) LEFT JOIN (SELECT bin, count(*) AS n FROM q GROUP BY bin) c ON c.bin = b),
grid3 AS (SELECT bin AS mu, bb AS b, ss AS sigma FROM eb, (VALUES (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE), (1.2::DOUBLE)) v(bb), (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) w(ss)),
e1 AS (SELECT mu, b, sigma, n, total, (bin + 0.5::DOUBLE) / 10 - (mu + 0.5::DOUBLE) / 10 AS d FROM eb, grid3),
e2 AS (SELECT *, d / sigma AS z, 1 / (1 + 0.3275911::DOUBLE * (abs(d / sigma) / sqrt(2.0::DOUBLE))) AS t FROM e1),
e3 AS (SELECT *, 0.5::DOUBLE * (t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE))))) * exp(-z * z / 2) AS up FROM e2),
e4 AS (SELECT mu, b, sigma, n, greatest(total * pow(10.0::DOUBLE, -b * greatest(d, 0)) * {_CDF}, 1e-12::DOUBLE) AS pred FROM e3),
emr AS (SELECT mu, b, sigma, round(-sum(n * ln(pred) - pred), 4) AS nll FROM e4 GROUP BY mu, b, sigma)"""
_MAXC_PICK = "(SELECT round((bin + 0.5::DOUBLE) / 10, 6) FROM q GROUP BY bin ORDER BY count(*) DESC, bin LIMIT 1)"
_EMR_PICK = "(SELECT round((mu + 0.5::DOUBLE) / 10, 6) FROM emr ORDER BY nll, mu, b, sigma LIMIT 1)"


@query(_q(f"SELECT mc, r FROM gft WHERE mc = {_GFT_PICK}", _RC, _GFT))
def mc_gft_choice(spark, sf_dir):
    return completeness.mc_gft_choice(catalog.quakes(spark, sf_dir))


@query(_q(f"SELECT mc, cv FROM stepp WHERE mc = {_STEPP_PICK}", _STEPP))
def mc_stepp_choice(spark, sf_dir):
    return completeness.mc_stepp_choice(catalog.quakes(spark, sf_dir))


@query(_q("SELECT round((mu + 0.5::DOUBLE) / 10, 6) AS mc, b, sigma, nll FROM emr ORDER BY nll, mu, b, sigma LIMIT 1", _EMR))
def mc_emr(spark, sf_dir):
    return completeness.mc_emr(catalog.quakes(spark, sf_dir))


@query(
    _q(
        f"""SELECT *, (SELECT count(*) FROM q WHERE m >= mc) AS n_above, (SELECT count(*) FROM q WHERE m < mc) AS n_below FROM (
    SELECT *, round(list_median([maxc, gft, emr, stepp]), 6) AS mc FROM (SELECT {_MAXC_PICK} AS maxc, {_GFT_PICK} AS gft, {_EMR_PICK} AS emr, {_STEPP_PICK} AS stepp))""".replace("list_median([maxc, gft, emr, stepp])", "list_aggregate([maxc, gft, emr, stepp], 'median')"),
        _RC,
        _GFT,
        _STEPP,
        _EMR,
    )
)
def mc_recommended(spark, sf_dir):
    return completeness.mc_recommended(catalog.quakes(spark, sf_dir))


@query(
    _q(
        f"""SELECT CASE WHEN share >= 0.5 THEN 'mw' ELSE 'original' END AS scale, count(*) AS n, round(avg(CASE WHEN share >= 0.5 THEN mw ELSE m END), 6) AS mean_m FROM (SELECT m, {_MW} AS mw, avg(({_MW} IS NOT NULL)::INT) OVER () AS share FROM quakes) WHERE share < 0.5 OR mw IS NOT NULL GROUP BY ALL"""
    )
)
def magnitude_series(spark, sf_dir):
    rows = completeness.magnitude_series(catalog.with_mw(catalog.quakes(spark, sf_dir)))
    return rows.groupBy("scale").agg(F.count("*").alias("n"), _r(F.avg("series"), "mean_m"))


REGIONS = [("southwest", 20.0, 24.0, 88.0, 92.0), ("northeast", 24.0, 28.0, 92.0, 96.0), ("middle", 22.0, 26.0, 90.0, 94.0), ("corner", 27.9, 28.0, 95.9, 96.0)]


@query(
    _q(
        """SELECT region, sum(n)::BIGINT AS n_events, CASE WHEN sum(n) >= 30 THEN round((arg_max(bin, (n, -bin)) + 0.5::DOUBLE) / 10, 6) END AS mc FROM (
    SELECT region, bin, count(*) AS n FROM q JOIN (VALUES """
        + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in REGIONS)
        + ") r(region, a, b, c, d) ON latitude BETWEEN a AND b AND longitude BETWEEN c AND d GROUP BY region, bin) GROUP BY region"
    )
)
def mc_of_regions(spark, sf_dir):
    return completeness.mc_of_regions(catalog.quakes(spark, sf_dir), REGIONS)


_GR = """gr AS (SELECT mc, n, round(b, 6) AS b, round(b / sqrt(n), 6) AS sigma_aki, round(2.30::DOUBLE * b * b * s / sqrt(n - 1), 6) AS sigma_shi_bolt, round(log10(n) + b * mc, 6) AS a FROM (
  SELECT mc, count(*) AS n, stddev_samp(m) AS s, CASE WHEN count(*) >= 20 AND avg(m) > mc - 0.05::DOUBLE THEN log10(exp(1.0::DOUBLE)) / (avg(m) - (mc - 0.1::DOUBLE / 2)) END AS b
  FROM q JOIN (SELECT unnest([4.0, 4.5, 5.0]::DOUBLE[]) AS mc) ON m >= mc - 0.1::DOUBLE / 2 GROUP BY mc))"""


@query(
    _q(
        f"""SELECT *, round(sqrt(1 / (n * pow(ln(10.0::DOUBLE), 2)) + mc * mc * sigma_shi_bolt * sigma_shi_bolt), 6) AS sigma_a, round(pow(10.0::DOUBLE, a - b * 6.0::DOUBLE) / {YEARS}::DOUBLE, 6) AS rate_60, round(pow(10.0::DOUBLE, a - b * 6.5::DOUBLE) / {YEARS}::DOUBLE, 6) AS rate_65, round(pow(10.0::DOUBLE, a - b * 7.0::DOUBLE) / {YEARS}::DOUBLE, 6) AS rate_70 FROM gr""",
        _GR,
    )
)
def gutenberg_richter(spark, sf_dir):
    return completeness.gutenberg_richter(catalog.quakes(spark, sf_dir), [4.0, 4.5, 5.0], [6.0, 6.5, 7.0], YEARS)


@query(
    _q(
        f"""SELECT mc, gr.n AS n, b, round(c.n / {YEARS}::DOUBLE, 6) AS rate, {", ".join(f"round(1 - exp(-c.n / {YEARS}::DOUBLE * {v!r}::DOUBLE), 6) AS p_{k}" for k, v in C.HORIZONS.items())},
    round(1 - exp(-pow(10.0::DOUBLE, a - b * 6.0::DOUBLE) / {YEARS}::DOUBLE), 6) AS p_year_60, round(1 - exp(-pow(10.0::DOUBLE, a - b * 7.0::DOUBLE) / {YEARS}::DOUBLE), 6) AS p_year_70 FROM gr JOIN (SELECT mc, count(*) AS n FROM q JOIN (SELECT unnest([4.0, 4.5, 5.0]::DOUBLE[]) AS mc) ON m >= mc GROUP BY mc) c USING (mc)""",
        _GR,
    )
)
def mc_sensitivity(spark, sf_dir):
    """b, rate and probabilities, and what the law gives for larger events, per completeness magnitude."""
    return uncertainty.mc_sensitivity(catalog.quakes(spark, sf_dir), [4.0, 4.5, 5.0], [6.0, 7.0], YEARS)


@query(_q("SELECT n, round(CASE WHEN n >= 20 AND mean > 4.4::DOUBLE THEN log10(exp(1.0::DOUBLE)) / (mean - (4.5::DOUBLE - 0.05::DOUBLE)) ELSE 1.0::DOUBLE END, 6) AS b FROM (SELECT count(*) AS n, avg(m) AS mean FROM q WHERE m >= 4.5::DOUBLE - 0.05::DOUBLE)"))
def quick_b(spark, sf_dir):
    return completeness.quick_b(catalog.quakes(spark, sf_dir), 4.5)


@query(
    _q(
        f"""SELECT round(quantile_cont(b, 0.025), 6) AS lower, round(quantile_cont(b, 0.975), 6) AS upper FROM (
    SELECT r, log10(exp(1.0::DOUBLE)) / (sum(w * m) / sum(w) - 4.95::DOUBLE) AS b FROM (SELECT r, m, {inference.weights_sql("r", "event_id")} AS w FROM range(200) x(r), q WHERE m >= 4.95) GROUP BY r HAVING sum(w) >= 20)"""
    )
)
def b_value_bootstrap(spark, sf_dir):
    """Percentile interval of b at Mc 5 over replicates that weigh all events."""
    per = inference.weighted_means(catalog.quakes(spark, sf_dir).where("m >= 4.95D"), "event_id", "m", 200).where("n >= 20")
    return inference.percentile_interval(per.select((completeness.LOG10_E / (F.col("mean") - 4.95)).alias("b")), "b")


# ---- rates and their uncertainty -----------------------------------------------------------------------------

THRESHOLDS = [4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0]
_TH = "th AS (SELECT x AS t, (SELECT count(*) FROM q WHERE m >= x) AS n FROM (SELECT unnest([" + ", ".join(map(str, THRESHOLDS)) + "]::DOUBLE[]) AS x))"
_H = "h AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in C.HORIZONS.items()) + ") v(horizon, years))"


def _counts(spark, sf_dir) -> DataFrame:
    return uncertainty.counts_above(catalog.quakes(spark, sf_dir), THRESHOLDS)


@query(
    _q(
        f"""SELECT t AS threshold, horizon, n, round(n / {YEARS}::DOUBLE, 6) AS rate, round(n / {YEARS}::DOUBLE * years, 6) AS expected, round(1 - exp(-n / {YEARS}::DOUBLE * years), 6) AS p, round(1 - exp(-lo / {YEARS}::DOUBLE * years), 6) AS p_lower, round(1 - exp(-hi / {YEARS}::DOUBLE * years), 6) AS p_upper
    FROM (SELECT *, {_lo("n")} AS lo, {_hi("n")} AS hi FROM th), h""",
        _TH,
        _H,
        gamma_sql(_garwood_keys("SELECT n FROM th")),
    )
)
def temporal_poisson(spark, sf_dir):
    """Count, rate, expected number and P with exact intervals per threshold and horizon."""
    return uncertainty.temporal_poisson(_counts(spark, sf_dir), YEARS)


_PER = f"per AS (SELECT cell_id, x AS threshold, count(m) AS n FROM grid, (VALUES (4.5::DOUBLE), (5.0::DOUBLE)) v(x) LEFT JOIN q ON q.i = grid.i AND q.j = grid.j AND m >= x GROUP BY cell_id, x)"
SQL["poisson_intervals"] = _q(
    f"""SELECT cell_id, threshold, horizon, n, round(1 - exp(-n / {YEARS}::DOUBLE * years), 6) AS p, round(1 - exp(-lo / {YEARS}::DOUBLE * years), 6) AS p_lower, round(1 - exp(-hi / {YEARS}::DOUBLE * years), 6) AS p_upper FROM (SELECT *, {_lo("n")} AS lo, {_hi("n")} AS hi FROM per), h""",
    GRID,
    _PER,
    _H,
    gamma_sql(_garwood_keys("SELECT n FROM per")),
)


@query(
    _q(
        f"""SELECT cell_id, threshold, n, round((SELECT x FROM gq WHERE a = n + 0.5::DOUBLE AND p = 0.025::DOUBLE) / {YEARS}::DOUBLE, 6) AS rate_lower, round((SELECT x FROM gq WHERE a = n + 0.5::DOUBLE AND p = 0.975::DOUBLE) / {YEARS}::DOUBLE, 6) AS rate_upper,
    round(n / (110.574::DOUBLE * (111.320::DOUBLE * cos(radians(clat)))), 9) AS per_km2 FROM per JOIN (SELECT cell_id, clat FROM grid) USING (cell_id)""",
        GRID,
        _PER,
        gamma_sql(_half_keys("SELECT n FROM per", 0.5)),
    )
)
def grid_uncertainty(spark, sf_dir):
    """Jeffreys intervals and densities of every cell, empty ones too."""
    per = rates.grid_summary(catalog.quakes(spark, sf_dir), [4.5, 5.0], YEARS).select("cell_id", "lat_center", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(c).alias("n")) for t, c in ((4.5, "n_45"), (5.0, "n_50"))])))
    rows = intervals.with_intervals(per, "n", YEARS, jeffreys)
    return rows.select("cell_id", "threshold", "n", _r("rate_lower", "rate_lower"), _r("rate_upper", "rate_upper"), F.round(F.col("n") / geo.cell_area_km2(F.col("lat_center")), 9).alias("per_km2"))


@query(
    _q(
        f"""SELECT t AS threshold, n, round(n / {YEARS}::DOUBLE, 6) AS rate, round(glo / {YEARS}::DOUBLE, 6) AS garwood_lower, round(ghi / {YEARS}::DOUBLE, 6) AS garwood_upper, round(jlo / {YEARS}::DOUBLE, 6) AS jeffreys_lower, round(jhi / {YEARS}::DOUBLE, 6) AS jeffreys_upper, round(ulo / {YEARS}::DOUBLE, 6) AS uniform_lower, round(uhi / {YEARS}::DOUBLE, 6) AS uniform_upper,
    round(jhi / uhi, 6) AS prior_ratio, {", ".join(f"round(1 - exp(-{x} / {YEARS}::DOUBLE * {C.HORIZONS[h]!r}::DOUBLE), 6) AS p_{h}{s}" for h in ("30d", "1y") for x, s in (("n", ""), ("jlo", "_lower"), ("jhi", "_upper")))},
    n >= 20 AS sufficient, CASE WHEN n = 0 THEN 'none observed: an upper bound only' WHEN n < 5 THEN 'few observed: indicative' WHEN n < 20 THEN 'limited precision' ELSE 'sufficient' END AS note
    FROM (SELECT *, {_lo("n")} AS glo, {_hi("n")} AS ghi, (SELECT x FROM gq WHERE a = n + 0.5::DOUBLE AND p = 0.025::DOUBLE) AS jlo, (SELECT x FROM gq WHERE a = n + 0.5::DOUBLE AND p = 0.975::DOUBLE) AS jhi, (SELECT x FROM gq WHERE a = n + 1 AND p = 0.025::DOUBLE) AS ulo, (SELECT x FROM gq WHERE a = n + 1 AND p = 0.975::DOUBLE) AS uhi FROM th WHERE t >= 5.5)""",
        _TH,
        gamma_sql(_garwood_keys("SELECT n FROM th WHERE t >= 5.5") + " UNION " + _half_keys("SELECT n FROM th WHERE t >= 5.5", 0.5) + " UNION " + _half_keys("SELECT n FROM th WHERE t >= 5.5", 1.0)),
    )
)
def large_events(spark, sf_dir):
    """Rates of large events under three priors, and whether they suffice."""
    return uncertainty.large_events(_counts(spark, sf_dir).where("threshold >= 5.5D"), YEARS)


@query(
    _q(
        f"""SELECT threshold, n, n_near, round(rate, 6) AS rate, round(al, 6) AS aleatory, round(ep, 6) AS epistemic, round(sqrt(al * al + ep * ep), 6) AS total, {", ".join(f"round(1 - exp(-rate * {C.HORIZONS[h]!r}::DOUBLE), 6) AS p_{h}, round(exp(-rate * {C.HORIZONS[h]!r}::DOUBLE) * sqrt(al * al + ep * ep) * {C.HORIZONS[h]!r}::DOUBLE, 6) AS p_{h}_total" for h in ("7d", "30d"))}
    FROM (SELECT t AS threshold, n, n_near, n / {YEARS}::DOUBLE AS rate, ({_hi("n")} - {_lo("n")}) / {YEARS}::DOUBLE / 2 AS al, 0.3::DOUBLE * n_near / {YEARS}::DOUBLE AS ep FROM (SELECT *, (SELECT count(*) FROM q WHERE abs(m - th.t) < 0.41::DOUBLE) AS n_near FROM th))""",
        _TH,
        gamma_sql(_garwood_keys("SELECT n FROM th")),
    )
)
def uncertainty_propagation(spark, sf_dir):
    """Counting and conversion uncertainty of rates, carried over to probabilities."""
    return uncertainty.propagated(catalog.quakes(spark, sf_dir), THRESHOLDS, YEARS)


_POST = """post AS (SELECT cell_id, alpha + n_train AS shape, beta + exposure AS rate FROM fc, (
  SELECT CASE WHEN count(*) >= 5 AND var_samp(rate) > 0 THEN avg(rate) * avg(rate) / var_samp(rate) ELSE 0.5::DOUBLE END AS alpha, CASE WHEN count(*) >= 5 AND var_samp(rate) > 0 THEN avg(rate) / var_samp(rate) ELSE 0.5::DOUBLE / avg(rate) END AS beta FROM fc WHERE rate > 0 AND origin_year = 2023) WHERE origin_year = 2023)"""


def _posterior(spark, sf_dir):
    return rates.posterior(rates.expanding_rates(catalog.quakes(spark, sf_dir), 4.0, LAST, LAST), ["origin_year"])


@query(
    _q(
        """SELECT cell_id, round(shape / rate, 6) AS mean, round((SELECT x FROM gq WHERE a = shape AND p = 0.025::DOUBLE) / rate, 6) AS lower, round((SELECT x FROM gq WHERE a = shape AND p = 0.975::DOUBLE) / rate, 6) AS upper FROM post""",
        GRID,
        _forecast(),
        _POST,
        gamma_sql("SELECT DISTINCT shape AS a, p FROM post, (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) v(p)"),
    )
)
def posterior_quantiles(spark, sf_dir):
    """Exact quantiles of the Gamma posterior of each cell's rate at the last origin."""
    rows = intervals.with_gamma_quantiles(_posterior(spark, sf_dir), "shape", "scale_rate", {"lower": 0.025, "upper": 0.975})
    return rows.select("cell_id", _r(F.col("shape") / F.col("scale_rate"), "mean"), _r("lower", "lower"), _r("upper", "upper"))


@query(
    _q(
        """SELECT cell_id, """
        + ", ".join(f"(SELECT min(k)::INT FROM cum WHERE cum.cell_id = c.cell_id AND f >= {q}::DOUBLE) AS {n}" for n, q in (("lo_50", 0.25), ("lo_95", 0.025), ("hi_50", 0.75), ("hi_95", 0.975)))
        + """ FROM post c""",
        GRID,
        _forecast(),
        _POST,
        "cum AS (SELECT cell_id, k, sum(exp(lgamma(shape + k) - lgamma(shape) - lgamma(k + 1.0::DOUBLE) + shape * ln(rate / (rate + 1.0::DOUBLE)) + k * ln(1.0::DOUBLE / (rate + 1.0::DOUBLE)))) OVER (PARTITION BY cell_id ORDER BY k) AS f FROM post, range(0, 400) t(k))",
    )
)
def count_intervals(spark, sf_dir):
    """Intervals of next year's count in each cell, negative binomial under the posterior."""
    rows = _posterior(spark, sf_dir).withColumn("success", F.col("scale_rate") / (F.col("scale_rate") + 1.0))
    return intervals.with_count_intervals(rows, "shape", "success", [0.5, 0.95]).select("cell_id", "lo_50", "lo_95", "hi_50", "hi_95")


@query(
    _q(
        f"""SELECT threshold, round(sum(n) / {YEARS}::DOUBLE, 6) AS rate, round(1 - exp(-sum(n) / {YEARS}::DOUBLE * {C.HORIZONS["30d"]!r}::DOUBLE), 6) AS p, round(1 - exp(-sum(lo) / {YEARS}::DOUBLE * {C.HORIZONS["30d"]!r}::DOUBLE), 6) AS p_lower, round(1 - exp(-sum(hi) / {YEARS}::DOUBLE * {C.HORIZONS["30d"]!r}::DOUBLE), 6) AS p_upper,
    array_to_string(list(concat(cell_id, '=', n) ORDER BY cell_id), ';') AS cells FROM (SELECT *, (SELECT x FROM gq WHERE a = n + 0.5::DOUBLE AND p = 0.025::DOUBLE) AS lo, (SELECT x FROM gq WHERE a = n + 0.5::DOUBLE AND p = 0.975::DOUBLE) AS hi FROM per) GROUP BY threshold""",
        GRID,
        _PER,
        gamma_sql(_half_keys("SELECT n FROM per", 0.5)),
    )
)
def forecast_documents(spark, sf_dir):
    """A regional forecast per threshold: summed rates with bounds, P, and its cells in one document."""
    per = rates.grid_summary(catalog.quakes(spark, sf_dir), [4.5, 5.0], YEARS).select("cell_id", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(c).alias("n")) for t, c in ((4.5, "n_45"), (5.0, "n_50"))])))
    return uncertainty.documents(intervals.with_intervals(per, "n", YEARS, jeffreys), YEARS, C.HORIZONS["30d"])


@query(
    _q(
        """SELECT oy AS origin_year, cell_id, count(m) AS n_train, round(count(m) / 5.0::DOUBLE, 6) AS rate FROM grid g, years y LEFT JOIN q ON q.i = g.i AND q.j = g.j AND m >= 4.0 AND t < make_timestamp(oy, 1, 1, 0, 0, 0) AND epoch_us(t) >= epoch_us(make_timestamp(oy, 1, 1, 0, 0, 0)) - 157788000000000 GROUP BY oy, cell_id""",
        GRID,
        f"years AS (SELECT y::INT AS oy FROM range({FIRST}, {LAST + 1}) r(y))",
    )
)
def recent_rates(spark, sf_dir):
    out = rates.recent_rates(catalog.quakes(spark, sf_dir), 4.0, FIRST, LAST)
    return out.select("origin_year", "cell_id", "n_train", _r("rate", "rate"))


def _regional(first: int, last: int, step: int = 1, rolling: int | None = None, name: str = "rb", threshold: float = 4.5, days: int = 30) -> str:
    since = f"greatest(1975, oy - {rolling})" if rolling else "1975"
    return f"""{name} AS (SELECT origin_year, n_train, exposure_years, n_train / exposure_years AS rate, 1.0::DOUBLE - exp(-(n_train / exposure_years) * ({days} / 365.25::DOUBLE)) AS p, n_future, (n_future > 0)::INT AS y FROM (
  SELECT oy::INT AS origin_year, (SELECT count(*) FROM q WHERE m >= {threshold}::DOUBLE AND yr < oy AND yr >= {since}) AS n_train, date_diff('day', make_date({since}::INT, 1, 1), make_date(oy::INT, 1, 1)) / 365.25::DOUBLE AS exposure_years,
    (SELECT count(*) FROM q WHERE m >= {threshold}::DOUBLE AND yr = oy AND epoch_us(t) - epoch_us(make_timestamp(oy, 1, 1, 0, 0, 0)) < {days} * 86400000000) AS n_future FROM range({first}, {last + 1}, {step}) r(oy)))"""


@query(_q("SELECT origin_year, n_train, round(exposure_years, 6) AS exposure_years, round(rate, 6) AS rate, round(p, 6) AS p, n_future, y FROM rb", _regional(1995, 2023)))
def regional_backtest(spark, sf_dir):
    """Yearly origins from 1995 on, the whole region as one cell, history expanding."""
    out = rates.regional_backtest(catalog.quakes(spark, sf_dir), 4.5, 30.0, 1995, 2023)
    return out.select("origin_year", "n_train", _r("exposure_years", "exposure_years"), _r("rate", "rate"), _r("p", "p"), "n_future", "y")


_DESIGN = "SELECT '{d}' AS design, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS base_rate FROM {v}"


@query(
    _q(
        " UNION ALL ".join(_DESIGN.format(d=d, v=v) for d, v in (("every year", "d1"), ("every 2 years", "d2"), ("every 3 years", "d3"), ("rolling 10 years", "d4"), ("development", "(SELECT * FROM d1 WHERE origin_year < 2010)"), ("selection", "(SELECT * FROM d1 WHERE origin_year BETWEEN 2010 AND 2016)"), ("evaluation", "(SELECT * FROM d1 WHERE origin_year > 2016)"))),
        _regional(1995, 2023, name="d1"),
        _regional(1995, 2023, 2, name="d2"),
        _regional(1995, 2023, 3, name="d3"),
        _regional(1995, 2023, rolling=10, name="d4"),
    )
)
def validation_designs(spark, sf_dir):
    """The regional backtest under other origins, a rolling window, and a chronological split in 50, 25 and 25 percent."""
    return verdicts.designs(catalog.quakes(spark, sf_dir), 4.5, 30.0, 1995, 2023)


_BYDEPTH = """dq AS (SELECT *, CASE WHEN depth_km < 25 THEN 'shallow' WHEN depth_km < 70 THEN 'intermediate' ELSE 'deep' END AS g FROM q WHERE m >= 4.0),
dall AS (SELECT *, g AS grp FROM dq UNION ALL SELECT *, 'all' FROM dq),
dcells AS (SELECT gg AS grp, oy, cell_id, count(m) FILTER (yr < oy) / exposure AS rate, count(m) FILTER (yr = oy AND epoch_us(t) - epoch_us(make_timestamp(oy, 1, 1, 0, 0, 0)) < 30 * 86400000000) AS n_future
  FROM (SELECT DISTINCT dall.grp AS gg FROM dall) x, years, grid LEFT JOIN dall ON dall.grp = gg AND dall.i = grid.i AND dall.j = grid.j GROUP BY gg, oy, exposure, cell_id)"""


@query(
    _q(
        """SELECT grp AS depth_group, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y), 6) AS base_rate FROM (SELECT grp, 1.0::DOUBLE - exp(-rate * (30 / 365.25::DOUBLE)) AS p, (n_future > 0)::INT AS y FROM dcells) JOIN (SELECT grp, count(*) AS k FROM dall GROUP BY grp) USING (grp) WHERE k >= 50 GROUP BY grp""",
        GRID,
        f"years AS (SELECT y::INT AS oy, date_diff('day', DATE '1975-01-01', make_date(y, 1, 1)) / 365.25::DOUBLE AS exposure FROM range({FIRST}, {LAST + 1}) r(y))",
        _BYDEPTH,
    )
)
def depth_stratified(spark, sf_dir):
    """Gridded forecasts of each depth group by itself and of all together; groups under fifty events are left out."""
    return verdicts.by_depth(catalog.quakes(spark, sf_dir), 4.0, 30.0, FIRST, LAST)


@query(
    _q(
        """SELECT size, count(*) AS n_cells, round(avg((p - y) * (p - y)), 6) AS brier, round(sum(p), 6) AS sum_p, round(max(p), 6) AS max_p FROM ("""
        + " UNION ALL ".join(
            f"""SELECT {s}::DOUBLE AS size, 1.0::DOUBLE - exp(-(count(m) FILTER (yr < 2020) / (date_diff('day', DATE '1975-01-01', DATE '2020-01-01') / 365.25::DOUBLE)) * (7 / 365.25::DOUBLE)) AS p, (count(m) FILTER (yr = 2020 AND epoch_us(t) - epoch_us(make_timestamp(2020, 1, 1, 0, 0, 0)) < 7 * 86400000000) > 0)::INT AS y
      FROM range({round(8 / s)}) a(ii), range({round(8 / s)}) b(jj) LEFT JOIN q ON least(greatest(floor((latitude - 20) / {s}::DOUBLE), 0), {round(8 / s) - 1}) = ii AND least(greatest(floor((longitude - 88) / {s}::DOUBLE), 0), {round(8 / s) - 1}) = jj AND m >= 4.0 GROUP BY ii, jj"""
            for s in (0.5, 1.0, 2.0)
        )
        + ") GROUP BY size"
    )
)
def grid_sensitivity(spark, sf_dir):
    return uncertainty.grid_sensitivity(catalog.quakes(spark, sf_dir), [0.5, 1.0, 2.0], 4.0, 7.0, 2020)


@query(
    _q(
        f"""SELECT source, n, round(n_45 / {YEARS}::DOUBLE, 6) AS rate_45, round(CASE WHEN n_b >= 20 THEN log10(exp(1.0::DOUBLE)) / (mean_b - 4.45::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS b FROM (
    SELECT source, count(*) AS n, count(*) FILTER (original_magnitude >= 4.5) AS n_45, count(*) FILTER (original_magnitude >= 4.45::DOUBLE) AS n_b, avg(original_magnitude) FILTER (original_magnitude >= 4.45::DOUBLE) AS mean_b FROM (SELECT source_catalog AS source, original_magnitude FROM obs UNION ALL SELECT 'all', original_magnitude FROM obs) GROUP BY source)""",
        OBS,
    )
)
def source_sensitivity(spark, sf_dir):
    """Counts, rates and b of each source alone and of all observations."""
    return uncertainty.source_sensitivity(catalog.observations(spark, sf_dir), 4.5, YEARS)


# ---- verification --------------------------------------------------------------------------------------------

_MODELS = """models AS (SELECT 'spatial' AS model, origin_year, i, j, cell_id, p, y, n_future, rate FROM fc UNION ALL SELECT 'uniform', origin_year, i, j, cell_id, 1.0::DOUBLE - exp(-avg(rate) OVER (PARTITION BY origin_year) * (30 / 365.25::DOUBLE)), y, n_future, avg(rate) OVER (PARTITION BY origin_year) FROM fc)"""
_LL = "CASE WHEN y = 1 THEN ln(least(greatest({p}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) ELSE ln(1 - least(greatest({p}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) END"


def _models(spark, sf_dir):
    return verdicts.with_uniform(_forecasts(spark, sf_dir), 30 / 365.25)


@query(
    _q(
        f"""SELECT a.origin_year, round(avg({_LL.format(p="a.p").replace("y = 1", "a.y = 1")} - {_LL.format(p="b.p").replace("y = 1", "a.y = 1")}), 6) AS information_gain, round(avg((a.p - a.y) * (a.p - a.y) - (b.p - a.y) * (b.p - a.y)), 6) AS brier_difference
    FROM models a JOIN models b ON a.model = 'spatial' AND b.model = 'uniform' AND a.origin_year = b.origin_year AND a.cell_id = b.cell_id GROUP BY a.origin_year""",
        GRID,
        _forecast(),
        _MODELS,
    )
)
def paired_gain(spark, sf_dir):
    rows = verdicts.side_by_side(_models(spark, sf_dir), "spatial", "uniform")
    return metrics.paired_gain(rows, "a", "b", ["origin_year"])


@query(
    _q(
        """SELECT model, round(any_value(alarm), 6) AS alarm, round(count(*) FILTER (p >= alarm AND y = 1) / nullif(count(*) FILTER (y = 1), 0), 6) AS hit_rate, round(count(*) FILTER (p >= alarm AND y = 0) / nullif(count(*) FILTER (y = 0), 0), 6) AS false_alarm_rate
    FROM models JOIN (SELECT model, greatest(0.005::DOUBLE, 0.5::DOUBLE * quantile_cont(p, 0.5)) AS alarm FROM models GROUP BY model) USING (model) GROUP BY model""",
        GRID,
        _forecast(),
        _MODELS,
    )
)
def alarm_rates(spark, sf_dir):
    return metrics.alarm_rates(_models(spark, sf_dir), ["model"])


@query(
    _q(
        "SELECT level, round(avg((n_future BETWEEN greatest(mean - h, 0) AND mean + h)::INT), 6) AS coverage, round(avg((n_future BETWEEN greatest(mean - h, 0) AND mean + h)::INT) - level / 100, 6) AS error, round(avg(mean + h - greatest(mean - h, 0)), 6) AS width FROM (SELECT n_future, level, rate * 30 / 365.25::DOUBLE AS mean, 2 * sqrt(rate * 30 / 365.25::DOUBLE) * s AS h FROM fc, (VALUES "
        + ", ".join(f"({k}, {z!r}::DOUBLE / {metrics.Z[95]!r}::DOUBLE)" for k, z in metrics.Z.items())
        + ") v(level, s)) GROUP BY level",
        GRID,
        _forecast(),
    )
)
def coverage(spark, sf_dir):
    mean = F.col("rate") * 30 / 365.25
    rows = _forecasts(spark, sf_dir).withColumns({"mean": mean, "half": 2 * F.sqrt(mean), "all": F.lit(1)})
    return metrics.coverage(rows, ["all"]).drop("all")


_AUC = """SELECT model, round(sum(pos * ((all_n - all_pos) - (seen - tp) + (n - pos) / 2.0::DOUBLE)) / nullif(max(all_pos * (all_n - all_pos)), 0), 6) AS roc_auc, round(sum(pos * tp / seen::DOUBLE) / nullif(max(all_pos), 0), 6) AS pr_auc FROM (
  SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY p DESC) AS seen, sum(pos) OVER (PARTITION BY model) AS all_pos, sum(n) OVER (PARTITION BY model) AS all_n FROM (SELECT model, p, sum(y) AS pos, count(*) AS n FROM {v} GROUP BY model, p)) GROUP BY model"""


def composite_sql(view: str) -> str:
    return f"""SELECT * FROM (SELECT model, count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg((p - y) * (p - y)), 6) AS brier, round(avg({_LL.format(p="p")}), 6) AS log_likelihood, round(stddev_pop(p), 6) AS sharpness,
      round(avg({_LL.format(p="p")}) - (avg(y) * ln(least(greatest(avg(y), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) + (1 - avg(y)) * ln(1 - least(greatest(avg(y), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE))), 6) AS information_gain,
      count(*) FILTER (p >= 0.1 AND y = 1) AS hits, count(*) FILTER (p >= 0.1 AND y = 0) AS false_alarms, count(*) FILTER (p < 0.1 AND y = 1) AS misses, count(*) FILTER (p < 0.1 AND y = 0) AS correct_negatives FROM {view} GROUP BY model)
    JOIN ({_AUC.format(v=view)}) USING (model)
    JOIN (SELECT model, round(sum(abs(mp - my) * n) / sum(n), 6) AS ece FROM (SELECT model, least(floor(p * 5), 4) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM {view} GROUP BY model, b) GROUP BY model) USING (model)"""


@query(_q(composite_sql("models"), GRID, _forecast(), _MODELS))
def model_scores(spark, sf_dir):
    """All scores of each model in one row."""
    return metrics.composite(_models(spark, sf_dir), ["model"])


@query(
    _q(
        f"""SELECT round(quantile_cont(d, 0.025), 6) AS lower, round(quantile_cont(d, 0.975), 6) AS upper FROM (
    SELECT r, sum(w * e) / sum(w) AS d FROM (SELECT r, e, {inference.weights_sql("r", "k")} AS w FROM range(200) x(r), (SELECT (p - y) * (p - y) AS e, origin_year * 64 + substr(cell_id, 6, 2)::INT * 8 + substr(cell_id, 9, 2)::INT AS k FROM fc)) GROUP BY r)""",
        GRID,
        _forecast(),
    )
)
def brier_bootstrap(spark, sf_dir):
    """Percentile interval of the Brier score over replicates that weigh all rows."""
    e = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    key = F.col("origin_year") * 64 + F.substring("cell_id", 6, 2).cast("int") * 8 + F.substring("cell_id", 9, 2).cast("int")
    rows = _forecasts(spark, sf_dir).select(key.cast("long").alias("key"), e.alias("e"))
    return inference.percentile_interval(inference.weighted_means(rows, "key", "e", 200), "mean")


@query()
def calibration_line(spark, sf_dir):
    """Intercept and slope of the logistic regression of outcomes on probabilities."""
    a, b = metrics.calibration_line(_forecasts(spark, sf_dir).select("p", "y"))
    return spark.createDataFrame([(a, b)], "intercept double, slope double")


@query(_q("SELECT arg_min(model, (brier, model)) AS best, round(min(brier), 6) AS brier FROM (SELECT model, round(avg((p - y) * (p - y)), 9) AS brier FROM models GROUP BY model)", GRID, _forecast(), _MODELS))
def best_model(spark, sf_dir):
    e = F.round(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), 9)
    return verdicts.best(_models(spark, sf_dir).groupBy("model").agg(e.alias("brier")), "model", "brier")


@query(
    _q(
        f"""SELECT category, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS base_rate FROM (SELECT *, CASE WHEN n_train = 0 THEN '0' WHEN n_train < 5 THEN '1-4' WHEN n_train < 20 THEN '5-19' ELSE '>=20' END AS category FROM fc) GROUP BY category""",
        GRID,
        _forecast(),
    )
)
def sparse_cells(spark, sf_dir):
    """Scores of cells by how many events their history holds."""
    p, y = F.col("p"), F.col("y")
    rows = _forecasts(spark, sf_dir).withColumn("category", seismo.count_category(F.col("n_train")))
    return rows.groupBy("category").agg(F.count("*").alias("n"), _r(F.avg((p - y) * (p - y)), "brier"), _r(F.avg(p), "mean_p"), _r(F.avg(y), "base_rate"))


def _bands() -> str:
    one = "sqrt(pow((clon - longitude) * cos(radians(24.0::DOUBLE)), 2) + pow(clat - latitude, 2))"
    return f"""smooth AS (SELECT h, oy, cell_id, sum(exp(-d * d / (2 * h * h)) / (2 * pi() * h * h)) / exposure AS rate FROM (SELECT h, oy, exposure, cell_id, {one} AS d FROM years JOIN q ON yr < oy AND m >= 4.5, grid, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) v(h)) GROUP BY h, oy, cell_id, exposure),
band AS (SELECT h, round(avg((p - y) * (p - y)), 8) AS brier FROM (SELECT h, 1.0::DOUBLE - exp(-rate * (30 / 365.25::DOUBLE)) AS p, (EXISTS (SELECT 1 FROM q JOIN grid g ON q.i = g.i AND q.j = g.j WHERE g.cell_id = s.cell_id AND m >= 4.5 AND yr = oy AND epoch_us(t) - epoch_us(make_timestamp(oy, 1, 1, 0, 0, 0)) < 30 * 86400000000))::INT AS y FROM smooth s) GROUP BY h)"""


@query(
    _q(
        "SELECT h AS bandwidth, brier, h = (SELECT arg_min(h, (brier, h)) FROM band) AS chosen FROM band",
        GRID,
        "years AS (SELECT y::INT AS oy, date_diff('day', DATE '1975-01-01', make_date(y, 1, 1)) / 365.25::DOUBLE AS exposure FROM range(2010, 2015) r(y))",
        _bands(),
    )
)
def bandwidth_selection(spark, sf_dir):
    """The bandwidth of smoothed rates with the least Brier score on the selection years."""
    return verdicts.bandwidths(catalog.quakes(spark, sf_dir), [0.3, 0.5, 1.0], 4.5, 30.0, 2010, 2014)


# ---- verdicts ------------------------------------------------------------------------------------------------

_SETTINGS = [(4.0, 7.0), (4.0, 30.0), (4.5, 7.0), (4.5, 30.0)]
_STRENGTHS = {"weak": 1.0, "medium": 5.0, "strong": 25.0}


def _setting(threshold: float, days: float) -> str:
    return f"""SELECT '{threshold}/{days:g}d' AS config, oy, i, j, exposure, n_train, n_future, {days}::DOUBLE / 365.25::DOUBLE AS h, avg(n_train / exposure) OVER (PARTITION BY oy) AS mean FROM (SELECT oy, g.i, g.j, exposure,
    (SELECT count(*) FROM q WHERE q.i = g.i AND q.j = g.j AND m >= {threshold}::DOUBLE AND q.yr < oy) AS n_train,
    (SELECT count(*) FROM q WHERE q.i = g.i AND q.j = g.j AND m >= {threshold}::DOUBLE AND q.yr = oy AND epoch_us(t) - epoch_us(make_timestamp(oy, 1, 1, 0, 0, 0)) < {int(days * 86400000000)}) AS n_future FROM grid g, years)"""


_TRIED = f"""years AS (SELECT y::INT AS oy, date_diff('day', DATE '1975-01-01', make_date(y, 1, 1)) / 365.25::DOUBLE AS exposure FROM range({FIRST}, {LAST + 1}) r(y)),
settings AS ({" UNION ALL ".join(_setting(t, d) for t, d in _SETTINGS)}),
tried AS (SELECT config, model, oy, i, j, n_future, (n_future > 0)::INT AS y, 1 - exp(-rate * h) AS p, rate * h AS expected, rate * h * (1 + h / e) AS variance, pow(1 - exp(-rate * h) - (n_future > 0)::INT, 2) AS err FROM (
  SELECT *, 'spatial' AS model, n_train / exposure AS rate, exposure AS e FROM settings UNION ALL SELECT *, 'uniform', mean, exposure FROM settings
  {" ".join(f"UNION ALL SELECT *, '{name}', (n_train + {k}::DOUBLE * mean) / (exposure + {k}::DOUBLE), exposure + {k}::DOUBLE FROM settings" for name, k in _STRENGTHS.items())})),
per_origin AS (SELECT config, model, oy, sum(err) AS e, count(*) AS n FROM tried GROUP BY config, model, oy),
per_pair AS (SELECT a.config, a.model, b.model AS base, a.oy, b.e - a.e AS d, a.n FROM per_origin a JOIN per_origin b USING (config, oy) WHERE a.model NOT IN ('spatial', 'uniform') AND b.model IN ('spatial', 'uniform')),
drawn AS (SELECT config, model, base, r, sum(w * d) / nullif(sum(w * n), 0) AS d FROM per_pair JOIN (SELECT oy, r, {inference.weights_sql("r", "oy")} AS w FROM years, range({candidates.REPLICATES}) x(r)) USING (oy) GROUP BY config, model, base, r),
found AS (SELECT * FROM (SELECT config, model, base, round(quantile_cont(d, 0.025), 9) AS lower, round(quantile_cont(d, 0.975), 9) AS upper, round(least(1.0::DOUBLE, 2.0::DOUBLE * least((count(*) FILTER (d <= 0) + 1) / (count(*) + 1)::DOUBLE, (count(*) FILTER (d >= 0) + 1) / (count(*) + 1)::DOUBLE)), 9) AS p_value FROM drawn WHERE d IS NOT NULL GROUP BY config, model, base)
  JOIN (SELECT config, model, base, round(sum(d) / sum(n), 9) AS difference FROM per_pair GROUP BY config, model, base) USING (config, model, base)),
checks AS (SELECT model, bool_and(abs(n - m) <= 1.96::DOUBLE * s) AS ppc_pass FROM (SELECT model, config, sum(n_future) AS n, sum(expected) AS m, sqrt(sum(variance)) AS s FROM tried GROUP BY model, config) GROUP BY model)"""


def _tried(spark, sf_dir) -> DataFrame:
    return candidates.configurations(catalog.quakes(spark, sf_dir), _SETTINGS, FIRST, LAST, _STRENGTHS)


@query(_q("SELECT config, model, base, round(difference, 8) AS difference, round(lower, 8) AS lower, round(upper, 8) AS upper, round(p_value, 6) AS p_value FROM found", GRID, _TRIED))
def candidate_bounds(spark, sf_dir):
    """How much less squared error shrunken models have than two baselines, with bootstrap bounds, by configuration."""
    rows = candidates.bounds(_tried(spark, sf_dir), list(_STRENGTHS), ["spatial", "uniform"])
    return rows.select("config", "model", "base", *[F.round(c, 8).alias(c) for c in ("difference", "lower", "upper")], F.round("p_value", 6).alias("p_value"))


@query(
    _q(
        """SELECT n_better, n_worse, quadrants, ppc_pass, TRUE AS integrity, CASE WHEN less AND n_better >= 2 AND quadrants >= 3 AND ppc_pass THEN 'A' WHEN n_worse >= 2 OR NOT ppc_pass THEN 'D' WHEN loss < 0.005 AND calibrated THEN 'B' ELSE 'C' END AS verdict FROM (
    SELECT min(better) AS n_better, max(worse) AS n_worse, min(quadrants) AS quadrants, bool_and(own.brier < b.brier) AS less, max(loss) AS loss, bool_or(own.ece < b.ece) AS calibrated FROM scored b, (SELECT brier, ece FROM scored WHERE model = 'medium') own
    JOIN (SELECT base AS model, count(*) FILTER (lower > 0) AS better, count(*) FILTER (upper < 0) AS worse FROM found WHERE model = 'medium' GROUP BY base) s ON s.model = b.model
    JOIN (SELECT b.model, count(*) FILTER (a.e < b.e) AS quadrants, max(a.e - b.e) AS loss FROM held a JOIN held b ON a.model = 'medium' AND b.model IN ('spatial', 'uniform') AND a.s = b.s AND a.w = b.w GROUP BY b.model) h ON h.model = b.model), (SELECT ppc_pass FROM checks WHERE model = 'medium')""",
        GRID,
        _TRIED,
        """held AS (SELECT model, i < 4 AS s, j < 4 AS w, avg(err) AS e FROM tried GROUP BY ALL), scored AS (SELECT * FROM (SELECT model, avg(err) AS brier FROM tried GROUP BY model) JOIN (SELECT model, sum(abs(mp - my) * n) / sum(n) AS ece FROM (SELECT model, least(floor(p * 5), 4) AS b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM tried GROUP BY ALL) GROUP BY model) USING (model))""",
    )
)
def candidate_verdict(spark, sf_dir):
    """A to D: a model that draws cells to the mean rate against the spatial and the uniform one."""
    return candidates.candidate(_tried(spark, sf_dir), "medium", ("spatial", "uniform"))


@query(
    _q(
        """SELECT model, n_significant, n_rejected, ppc_pass, CASE WHEN NOT ppc_pass THEN 'D' WHEN n_significant >= 2 AND n_rejected >= 2 THEN 'A' WHEN n_significant = 0 AND difference >= 0 THEN 'D' ELSE 'C' END AS verdict FROM (
    SELECT model, count(*) FILTER (lower > 0) AS n_significant, count(*) FILTER (lower > 0 AND k <= last) AS n_rejected, -avg(difference) AS difference FROM (SELECT *, coalesce(max(CASE WHEN p_value <= k / n * 0.05::DOUBLE THEN k END) OVER (), 0) AS last FROM (
      SELECT *, row_number() OVER (ORDER BY p_value, model || '|' || config) AS k, count(*) OVER () AS n FROM found WHERE base = 'spatial')) GROUP BY model) JOIN checks USING (model)""",
        GRID,
        _TRIED,
    )
)
def variant_verdicts(spark, sf_dir):
    """Verdicts on models that draw cells to the mean rate more or less, each against the spatial one."""
    rows = candidates.variant_rows(_tried(spark, sf_dir), list(_STRENGTHS), "spatial")
    return verdicts.variants(rows).drop("difference")
