"""The queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions import geo, seismo
from tremorlake.operators import completeness, coulomb, decluster, etas, inference, intervals, joins, metrics, rates, reconcile
from tremorlake.plans import ledger
from tremorlake.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FIRST, LAST = 2015, 2023
YEARS = 49.3
DAY_US = 86400000000
ETAS = C.ETAS

QUAKES = """quakes AS (
  SELECT event_id, make_timestamp(157766400000000 + (epoch_us(ts) - 1704067200000000) * 600) AS t,
    20.0::DOUBLE + (((user_id*53+event_id*7) % 800) * ((user_id*53+event_id*7) % 800)) / 80000.0::DOUBLE AS latitude,
    88.0::DOUBLE + (((user_id*97+event_id*11) % 800) * ((user_id*97+event_id*11) % 800)) / 80000.0::DOUBLE AS longitude,
    CAST(json_extract_string(props, '$.k') AS INT) * 1.5::DOUBLE AS depth_km,
    round(3.0::DOUBLE + value / 100.0::DOUBLE, 4) AS m,
    CASE event_type WHEN 'click' THEN 'mb' WHEN 'view' THEN 'mww' WHEN 'error' THEN 'ml' WHEN 'purchase' THEN 'ms' ELSE 'mw' END AS magnitude_type
  FROM events),
q AS (SELECT *, least(greatest(floor(latitude - 20)::INT, 0), 7) AS i, least(greatest(floor(longitude - 88)::INT, 0), 7) AS j, year(t)::INT AS yr, floor(m * 10 + 1e-9)::INT AS bin FROM quakes)"""
OBS = """obs AS (
  SELECT 'usgs' AS source_catalog, concat('us', event_id) AS native_event_id, t AS origin_time, latitude, longitude, depth_km, m AS original_magnitude, magnitude_type,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 9) / 20.0::DOUBLE END AS magnitude_uncertainty,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 17) / 2.0::DOUBLE END AS horizontal_uncertainty_km,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 60 END AS n_stations,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id * 13 % 360) / 1.0::DOUBLE END AS gap_deg,
    CASE event_id % 3 WHEN 0 THEN 'automatic' WHEN 1 THEN 'reviewed' ELSE 'unknown' END AS quality_flag
  FROM quakes
  UNION ALL
  SELECT 'isc', concat('isc:', event_id), t + to_seconds(event_id % 90), latitude + 0.05::DOUBLE, longitude + 0.05::DOUBLE, depth_km, m + 0.1::DOUBLE, 'mb', NULL, NULL, NULL, NULL,
    CASE event_id % 2 WHEN 0 THEN 'reviewed' ELSE 'automatic' END
  FROM quakes WHERE event_id % 3 = 0)"""
GRID = "grid AS (SELECT a.i::INT AS i, b.j::INT AS j, printf('cell_%02d_%02d', a.i, b.j) AS cell_id, 20.5::DOUBLE + a.i AS clat, 88.5::DOUBLE + b.j AS clon FROM range(8) a(i), range(8) b(j))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088::DOUBLE * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0::DOUBLE))))"


def _forecast(threshold: float = 4.0, days: int = 30) -> str:
    return f"""years AS (SELECT y::INT AS oy, date_diff('day', DATE '1975-01-01', make_date(y, 1, 1)) / 365.25::DOUBLE AS exposure FROM range({FIRST}, {LAST + 1}) r(y)),
sp AS (
  SELECT oy, g.i, g.j, g.cell_id, exposure,
    (SELECT count(*) FROM q WHERE q.i = g.i AND q.j = g.j AND m >= {threshold}::DOUBLE AND q.yr < oy) AS n_train,
    (SELECT count(*) FROM q WHERE q.i = g.i AND q.j = g.j AND m >= {threshold}::DOUBLE AND q.yr = oy AND epoch_us(t) - epoch_us(make_timestamp(oy, 1, 1, 0, 0, 0)) < {days * DAY_US}) AS n_future
  FROM grid g, years),
fc AS (SELECT oy AS origin_year, i, j, cell_id, n_train, n_future, exposure, n_train / exposure AS rate, 1.0::DOUBLE - exp(-(n_train / exposure) * ({days} / 365.25::DOUBLE)) AS p, (n_future > 0)::INT AS y FROM sp)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name; ``sql`` follows the views above, each other clause by its name."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _q(select: str, *views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([QUAKES, *views]) + "\n" + select


def _r(c, name: str | None = None):
    out = F.round(c, 6)
    return out.alias(name) if name else out


def _forecasts(spark: SparkSession, sf_dir: str, threshold: float = 4.0, days: float = 30) -> DataFrame:
    return rates.spatial_poisson(catalog.quakes(spark, sf_dir), threshold, days, FIRST, LAST)


# ---- catalog -------------------------------------------------------------------------------------------------


@query(_q("SELECT * FROM quakes"))
def catalog_view(spark, sf_dir):
    return catalog.quakes(spark, sf_dir)


@query(_q("SELECT * FROM obs", OBS))
def observation_view(spark, sf_dir):
    return catalog.observations(spark, sf_dir)


@query(
    _q(
        """SELECT event_id, magnitude_type, round(CASE WHEN magnitude_type IN ('mw', 'mww') THEN m WHEN magnitude_type = 'mb' AND m BETWEEN 3.5 AND 6.2 THEN 0.85::DOUBLE * m + 1.03::DOUBLE
      WHEN magnitude_type = 'ms' AND m BETWEEN 3.0 AND 6.1 THEN 0.67::DOUBLE * m + 2.07::DOUBLE WHEN magnitude_type = 'ms' AND m BETWEEN 5.8 AND 8.0 THEN 1.10::DOUBLE * m - 0.57::DOUBLE END, 6) AS mw,
    CASE WHEN magnitude_type = 'mb' AND m BETWEEN 3.5 AND 6.2 THEN 'mb' WHEN magnitude_type = 'ms' AND m BETWEEN 3.0 AND 6.1 THEN 'ms_low' WHEN magnitude_type = 'ms' AND m BETWEEN 5.8 AND 8.0 THEN 'ms_high' END AS mw_relation,
    CASE WHEN magnitude_type IN ('mw', 'mww') OR magnitude_type = 'mb' AND m BETWEEN 3.5 AND 6.2 OR magnitude_type = 'ms' AND m BETWEEN 3.0 AND 8.0 THEN 'available' WHEN magnitude_type = 'ml' THEN 'no_relation' ELSE 'out_of_range' END AS reason FROM quakes"""
    )
)
def mw_conversion(spark, sf_dir):
    rows = catalog.with_mw(catalog.quakes(spark, sf_dir))
    return rows.select("event_id", "magnitude_type", _r("mw", "mw"), "mw_relation", seismo.missing_mw_reason(F.col("m"), F.col("magnitude_type")).alias("reason"))


@query(
    _q(
        f"""SELECT event_id, round({_hav("latitude", "longitude", "24.0::DOUBLE", "92.0::DOUBLE")}, 6) AS haversine_km,
    round(6371.0088::DOUBLE * sqrt(pow(radians(92.0::DOUBLE - longitude) * cos(radians((latitude + 24.0::DOUBLE) / 2)), 2) + pow(radians(24.0::DOUBLE - latitude), 2)), 6) AS equirect_km,
    round(sqrt(pow((92.0::DOUBLE - longitude) * (111.320::DOUBLE * cos(radians(24.0::DOUBLE))), 2) + pow((24.0::DOUBLE - latitude) * 110.574::DOUBLE, 2)), 6) AS local_km,
    round(sqrt(pow((92.0::DOUBLE - longitude) * cos(radians(24.0::DOUBLE)), 2) + pow(24.0::DOUBLE - latitude, 2)), 6) AS local_degrees FROM quakes"""
    )
)
def distances(spark, sf_dir):
    a = (F.col("latitude"), F.col("longitude"), F.lit(24.0), F.lit(92.0))
    return catalog.quakes(spark, sf_dir).select("event_id", _r(geo.haversine_km(*a), "haversine_km"), _r(geo.equirect_km(*a), "equirect_km"), _r(geo.local_km(*a), "local_km"), _r(geo.local_degrees(*a), "local_degrees"))


@query(
    _q(
        """SELECT rule, i, j, count(*) AS n FROM (
    SELECT 'clamp' AS rule, least(greatest(floor((x - 20) / 2)::INT, 0), 3) AS i, least(greatest(floor((y - 88) / 2)::INT, 0), 3) AS j FROM s UNION ALL
    SELECT 'drop', least(greatest(floor((x - 20) / 2)::INT, 0), 3), least(greatest(floor((y - 88) / 2)::INT, 0), 3) FROM s WHERE x BETWEEN 20 AND 28 AND y BETWEEN 88 AND 96 UNION ALL
    SELECT 'halfopen', floor((x - 20) / 2)::INT, floor((y - 88) / 2)::INT FROM s WHERE x >= 20 AND x < 28 AND y >= 88 AND y < 96) GROUP BY ALL""",
        "s AS (SELECT latitude - 0.5::DOUBLE AS x, longitude + 0.5::DOUBLE AS y FROM quakes)",
    )
)
def cell_rules(spark, sf_dir):
    moved = catalog.quakes(spark, sf_dir).select((F.col("latitude") - 0.5).alias("x"), (F.col("longitude") + 0.5).alias("y"))
    rules = []
    for rule in ("clamp", "drop", "halfopen"):
        i, j = geo.cell(F.col("x"), F.col("y"), 2.0, rule)
        rules.append(F.struct(F.lit(rule).alias("rule"), i.alias("i"), j.alias("j")))
    return moved.select(F.inline(F.array(*rules))).where("i IS NOT NULL AND j IS NOT NULL").groupBy("rule", "i", "j").agg(F.count("*").alias("n"))


@query(
    _q(
        """SELECT event_id, round(CASE WHEN TRUE THEN 0.1::DOUBLE * pow(0.01::DOUBLE, 0.1::DOUBLE) * pow(depth_km + 0.01::DOUBLE, -1.1::DOUBLE) END, 6) AS omori,
    round(pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow(depth_km + 0.01::DOUBLE, -0.1::DOUBLE) - pow(depth_km + 7.01::DOUBLE, -0.1::DOUBLE)), 6) AS omori_7d,
    round(exp(-depth_km / 30.0::DOUBLE) / 30.0::DOUBLE, 6) AS exponential, round(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)), 6) AS productivity,
    round(1.5::DOUBLE / (pi() * 400) * pow(1 + depth_km * depth_km / 400.0::DOUBLE, -2.5::DOUBLE) * 1000, 6) AS power_law,
    (0.1238::DOUBLE * m + 0.983::DOUBLE) * 111.0::DOUBLE AS gk_km, round(pow(10.0::DOUBLE, 0.5::DOUBLE * m - 0.052::DOUBLE), 6) AS gk_days,
    round(CASE WHEN m < 4 THEN 1.0::DOUBLE ELSE greatest(pow(10.0::DOUBLE, -3.22::DOUBLE + 0.69::DOUBLE * m), 1.0::DOUBLE) END, 6) AS rupture_km,
    round(log10(pow(10.0::DOUBLE, 1.5::DOUBLE * m + 9.1::DOUBLE)), 6) AS log_moment,
    CASE WHEN depth_km < 25 THEN 'shallow' WHEN depth_km < 70 THEN 'intermediate' WHEN depth_km < 800 THEN 'deep' END AS depth_group FROM quakes"""
    )
)
def kernels(spark, sf_dir):
    d, m = F.col("depth_km"), F.col("m")
    return catalog.quakes(spark, sf_dir).select(
        "event_id",
        _r(seismo.omori_kernel(d, 0.01, 1.1), "omori"),
        _r(seismo.omori_integral(d, d + 7.0, 0.01, 1.1), "omori_7d"),
        _r(seismo.exponential_kernel(d, 30.0), "exponential"),
        _r(seismo.productivity(m, 0.02, 0.8, 4.0), "productivity"),
        _r(seismo.power_law_kernel(d, 20.0, 1.5, "normalised") * 1000, "power_law"),
        seismo.gk_radius_km(m).alias("gk_km"),
        _r(seismo.gk_days(m), "gk_days"),
        _r(seismo.rupture_length_km(m), "rupture_km"),
        _r(F.log10(seismo.moment_nm(m)), "log_moment"),
        seismo.depth_group(d).alias("depth_group"),
    )


@query(
    _q(
        """SELECT magnitude_type, count(*) AS n, min(m) AS min_m, max(m) AS max_m, round(avg(depth_km), 6) AS mean_depth, round(quantile_cont(depth_km, 0.5), 6) AS median_depth, min(yr) AS first_year, max(yr) AS last_year,
    count(*) FILTER (m >= 4.5) AS n_45 FROM q GROUP BY magnitude_type"""
    )
)
def catalog_stats(spark, sf_dir):
    m = F.col("m")
    return catalog.quakes(spark, sf_dir).groupBy("magnitude_type").agg(F.count("*").alias("n"), F.min("m").alias("min_m"), F.max("m").alias("max_m"), _r(F.avg("depth_km"), "mean_depth"), _r(F.percentile("depth_km", F.lit(0.5)), "median_depth"), F.min(F.year("t")).alias("first_year"), F.max(F.year("t")).alias("last_year"), F.count_if(m >= 4.5).alias("n_45"))


@query(
    _q(
        """SELECT y::INT AS year, count(m) AS n_40, count(m) FILTER (m >= 5.0) AS n_50, (sum(count(m)) OVER (ORDER BY y))::BIGINT AS total FROM range(1975, 2025) r(y) LEFT JOIN q ON q.yr = y AND m >= 4.0 GROUP BY y"""
    )
)
def annual_counts(spark, sf_dir):
    """Years without events stay."""
    per = catalog.quakes(spark, sf_dir).where("m >= 4.0D").groupBy(F.year("t").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("m") >= 5.0).alias("k"))
    years = spark.range(1975, 2025).select(F.col("id").cast("int").alias("year"))
    rows = years.join(per, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n_40"), F.coalesce("k", F.lit(0)).alias("n_50"))
    return rows.withColumn("total", F.sum("n_40").over(Window.orderBy("year")))


@query(
    _q(
        """SELECT g, floor(depth_km / 5)::INT AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY g)::DOUBLE, 6) AS share
    FROM (SELECT depth_km, CASE WHEN depth_km < 25 THEN 'shallow' WHEN depth_km < 70 THEN 'intermediate' ELSE 'deep' END AS g FROM quakes) GROUP BY g, floor(depth_km / 5)"""
    )
)
def depth_histogram(spark, sf_dir):
    rows = catalog.quakes(spark, sf_dir).groupBy(seismo.depth_group(F.col("depth_km")).alias("g"), F.floor(F.col("depth_km") / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return rows.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy("g"))))


@query(
    _q(
        """SELECT g, count(*) AS n_gaps, round(avg(gap), 6) AS mean_days, round(quantile_cont(gap, 0.5), 6) AS median_days, round(stddev_pop(gap) / avg(gap), 6) AS cv FROM (
    SELECT g, (epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY g ORDER BY t, event_id)) / 86400e6::DOUBLE AS gap FROM (
      SELECT t, event_id, CASE WHEN depth_km < 25 THEN 'shallow' WHEN depth_km < 70 THEN 'intermediate' ELSE 'deep' END AS g FROM quakes WHERE m >= 4.0)) WHERE gap IS NOT NULL GROUP BY g"""
    )
)
def interevent_by_depth(spark, sf_dir):
    rows = catalog.quakes(spark, sf_dir).where("m >= 4.0D").withColumn("g", seismo.depth_group(F.col("depth_km")))
    gap = joins.days_between(F.col("t"), F.lag("t").over(Window.partitionBy("g").orderBy("t", "event_id")))
    return rows.withColumn("gap", gap).where("gap IS NOT NULL").groupBy("g").agg(F.count("*").alias("n_gaps"), _r(F.avg("gap"), "mean_days"), _r(F.percentile("gap", F.lit(0.5)), "median_days"), _r(F.stddev_pop("gap") / F.avg("gap"), "cv"))


@query(
    _q(
        """SELECT g, count(*) AS n, round(max(abs(i / n - (1 - exp(-x)))), 6) AS ks FROM (
    SELECT g, gap / avg(gap) OVER (PARTITION BY g) AS x, row_number() OVER (PARTITION BY g ORDER BY gap) AS i, count(*) OVER (PARTITION BY g)::DOUBLE AS n FROM (
      SELECT g, (epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY g ORDER BY t, event_id)) / 86400e6::DOUBLE AS gap FROM (SELECT t, event_id, magnitude_type AS g FROM quakes WHERE m >= 4.0)) WHERE gap IS NOT NULL) GROUP BY g"""
    )
)
def ks_exponential(spark, sf_dir):
    rows = catalog.quakes(spark, sf_dir).where("m >= 4.0D").withColumnRenamed("magnitude_type", "g")
    gap = joins.days_between(F.col("t"), F.lag("t").over(Window.partitionBy("g").orderBy("t", "event_id")))
    return metrics.ks_exponential(rows.withColumn("gap", gap).where("gap IS NOT NULL"), "gap", ["g"])


@query(_q("SELECT event_id, t, m FROM quakes ORDER BY t DESC, event_id DESC LIMIT 20"))
def latest_events(spark, sf_dir):
    """The 20 latest events, a top-k report."""
    return catalog.quakes(spark, sf_dir).orderBy(F.col("t").desc(), F.col("event_id").desc()).limit(20).select("event_id", "t", "m")


# ---- reconciliation ------------------------------------------------------------------------------------------


@query(
    _q(
        f"""SELECT * FROM (SELECT a.native_event_id AS id_a, b.native_event_id AS id_b, round(abs(epoch_us(b.origin_time) - epoch_us(a.origin_time)) / 1e6::DOUBLE, 6) AS dt_s,
      round({_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")}, 6) AS dist_km
    FROM obs a JOIN obs b ON a.native_event_id < b.native_event_id AND b.origin_time BETWEEN a.origin_time - INTERVAL 120 SECOND AND a.origin_time + INTERVAL 120 SECOND) WHERE dist_km <= 50""",
        OBS,
    )
)
def near_duplicate_pairs(spark, sf_dir):
    return reconcile.near_duplicate_pairs(catalog.observations(spark, sf_dir))


#: The anchor of each observation: in every block (a run without a longer gap) the first free one, then what it covers.
MATCH = f"""ordered AS (SELECT *, row_number() OVER (ORDER BY origin_time, native_event_id) AS rn, (epoch_us(origin_time) - lag(epoch_us(origin_time)) OVER (ORDER BY origin_time, native_event_id) > 120000000) AS gap FROM obs),
blocks AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap THEN 1 ELSE 0 END) OVER (ORDER BY rn) AS block FROM ordered),
ranked AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY rn) AS k FROM blocks),
covers AS (SELECT a.block, a.k AS a, b.k AS b FROM ranked a JOIN ranked b ON a.block = b.block AND a.k < b.k AND epoch_us(b.origin_time) - epoch_us(a.origin_time) <= 120000000 AND {_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 50),
cov AS (SELECT block, b, list(a ORDER BY a) AS by_ FROM covers GROUP BY block, b),
walk AS (
  SELECT block, 1::BIGINT AS k, [1::BIGINT] AS anchors, 1::BIGINT AS mine FROM ranked WHERE k = 1
  UNION ALL
  SELECT w.block, w.k + 1, CASE WHEN list_has_any(w.anchors, coalesce(c.by_, [])) THEN w.anchors ELSE list_append(w.anchors, w.k + 1) END,
    CASE WHEN list_has_any(w.anchors, coalesce(c.by_, [])) THEN list_min(list_filter(c.by_, lambda x: list_contains(w.anchors, x))) ELSE w.k + 1 END
  FROM walk w JOIN ranked r ON r.block = w.block AND r.k = w.k + 1 LEFT JOIN cov c ON c.block = w.block AND c.b = w.k + 1),
matched AS (SELECT r.*, a.native_event_id AS anchor_id FROM ranked r JOIN walk w ON r.block = w.block AND r.k = w.k JOIN ranked a ON a.block = w.block AND a.k = w.mine)"""


@query(_q("SELECT native_event_id, anchor_id FROM matched", OBS, MATCH))
def matched_observations(spark, sf_dir):
    return reconcile.match_observations(catalog.observations(spark, sf_dir)).select("native_event_id", "anchor_id")


@query(
    _q(
        """SELECT anchor_id, o.origin_time AS origin_time, o.latitude AS latitude, o.longitude AS longitude, o.depth_km AS depth_km, o.id AS origin_from, g.m AS original_magnitude, g.k AS magnitude_type, g.id AS magnitude_from, n_observations, sources FROM (
    SELECT anchor_id, count(*) AS n_observations, string_agg(DISTINCT source_catalog, ',' ORDER BY source_catalog) AS sources,
      first({'origin_time': origin_time, 'latitude': latitude, 'longitude': longitude, 'depth_km': depth_km, 'id': native_event_id} ORDER BY CASE quality_flag WHEN 'reviewed' THEN 0 WHEN 'automatic' THEN 3 ELSE 4 END, coalesce(horizontal_uncertainty_km, 25.0::DOUBLE), -coalesce(n_stations, 0), coalesce(gap_deg, 360.0::DOUBLE), source_catalog, native_event_id) AS o,
      first({'m': original_magnitude, 'k': magnitude_type, 'id': native_event_id} ORDER BY CASE WHEN magnitude_type IN ('mw', 'mww') THEN 0 ELSE 1 END, coalesce(magnitude_uncertainty, 0.3::DOUBLE), source_catalog, native_event_id) AS g
    FROM matched GROUP BY anchor_id)""",
        OBS,
        MATCH,
    )
)
def canonical_events(spark, sf_dir):
    return reconcile.canonical_events(reconcile.match_observations(catalog.observations(spark, sf_dir)))


@query(_q("SELECT 'isc' AS source_a, 'usgs' AS source_b, count(*) AS n_events FROM (SELECT anchor_id FROM matched GROUP BY anchor_id HAVING count(DISTINCT source_catalog) = 2)", OBS, MATCH))
def source_overlap(spark, sf_dir):
    return reconcile.source_overlap(reconcile.match_observations(catalog.observations(spark, sf_dir)))


# ---- completeness --------------------------------------------------------------------------------------------


@query(_q("SELECT bin, count(*) AS n, (sum(count(*)) OVER (ORDER BY bin DESC))::BIGINT AS n_above FROM q GROUP BY bin"))
def fmd_reverse_cumulative(spark, sf_dir):
    return completeness.reverse_cumulative(completeness.fmd(catalog.quakes(spark, sf_dir))).select("bin", "n", "n_above")


@query(_q("SELECT round((bin + 0.5::DOUBLE) / 10, 6) AS mc, 0.05::DOUBLE AS uncertainty, (SELECT count(*) FROM q) AS n_events FROM q GROUP BY bin ORDER BY count(*) DESC, bin LIMIT 1"))
def mc_maxc(spark, sf_dir):
    return completeness.mc_maxc(catalog.quakes(spark, sf_dir))


@query(
    _q(
        """SELECT region, round((bin + 0.5::DOUBLE) / 10, 6) AS mc, 0.05::DOUBLE AS uncertainty, n_events FROM (
    SELECT region, bin, sum(count(*)) OVER (PARTITION BY region)::BIGINT AS n_events, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, bin) AS k
    FROM (SELECT bin, concat(CASE WHEN i < 4 THEN 'S' ELSE 'N' END, CASE WHEN j < 4 THEN 'W' ELSE 'E' END) AS region FROM q) GROUP BY region, bin) WHERE k = 1"""
    )
)
def mc_by_region(spark, sf_dir):
    named = F.concat(F.when(F.col("i_lat") < 4, "S").otherwise("N"), F.when(F.col("i_lon") < 4, "W").otherwise("E"))
    return completeness.mc_maxc(rates.celled(catalog.quakes(spark, sf_dir)).withColumn("region", named), ["region"])


@query(
    _q(
        """SELECT round((c + 0.5::DOUBLE) / 10, 6) AS mc, n_c AS n_above, round(b, 6) AS b, round(1 - sum(abs(n_above - n_c * pow(10.0::DOUBLE, -b * (bin - c) / 10.0::DOUBLE))) / sum(n_above), 6) AS r
    FROM (SELECT bin AS c, n_above AS n_c, log10(exp(1.0::DOUBLE)) / (s_above / n_above - bin / 10.0::DOUBLE) AS b FROM rc WHERE n_above >= 10) x JOIN rc ON rc.bin >= c GROUP BY c, n_c, b""",
        "rc AS (SELECT bin, (sum(count(*)) OVER (ORDER BY bin DESC))::BIGINT AS n_above, sum(sum(m)) OVER (ORDER BY bin DESC) AS s_above FROM q GROUP BY bin)",
    )
)
def mc_gft(spark, sf_dir):
    return completeness.mc_gft(catalog.quakes(spark, sf_dir))


@query(
    _q(
        """SELECT round(c / 10.0::DOUBLE, 6) AS threshold, sum(n)::BIGINT AS n, count(*) AS years, round(stddev_pop(n) / avg(n), 6) AS cv FROM (
    SELECT c, yr, count(*) AS n FROM q JOIN (SELECT DISTINCT bin AS c FROM q) ON bin >= c GROUP BY c, yr) GROUP BY c HAVING sum(n) >= 20 AND count(*) >= 5"""
    )
)
def mc_stepp(spark, sf_dir):
    return completeness.mc_stepp(catalog.quakes(spark, sf_dir))


@query(
    _q(
        """SELECT s::INT AS start_year, n_events, round((bin + 0.5::DOUBLE) / 10, 6) AS mc FROM (
    SELECT s, bin, sum(count(*)) OVER (PARTITION BY s)::BIGINT AS n_events, row_number() OVER (PARTITION BY s ORDER BY count(*) DESC, bin) AS k FROM q JOIN range(1975, 2025) r(s) ON yr BETWEEN s AND s + 4 GROUP BY s, bin) WHERE k = 1 AND n_events >= 30"""
    )
)
def mc_rolling(spark, sf_dir):
    return completeness.rolling_mc(catalog.quakes(spark, sf_dir))


@query(
    _q(
        """SELECT mc, n, round(b, 6) AS b, round(b / sqrt(n), 6) AS sigma_aki, round(2.30::DOUBLE * b * b * s / sqrt(n - 1), 6) AS sigma_shi_bolt, round(log10(n) + b * mc, 6) AS a FROM (
    SELECT mc, count(*) AS n, stddev_samp(m) AS s, CASE WHEN count(*) >= 20 AND avg(m) > mc - 0.05::DOUBLE THEN log10(exp(1.0::DOUBLE)) / (avg(m) - (mc - 0.1::DOUBLE / 2)) END AS b
    FROM q JOIN (SELECT unnest([3.8, 4.0, 4.13, 4.3, 4.5]::DOUBLE[]) AS mc) ON m >= mc - 0.1::DOUBLE / 2 GROUP BY mc)"""
    )
)
def b_value_by_mc(spark, sf_dir):
    return completeness.b_value(catalog.quakes(spark, sf_dir), [3.8, 4.0, 4.13, 4.3, 4.5])


@query(
    _q(
        "SELECT count(*) AS n_bins, round(-regr_slope(log10(n_above), (bin + 0.5::DOUBLE) / 10), 6) AS b, round(regr_intercept(log10(n_above), (bin + 0.5::DOUBLE) / 10), 6) AS a FROM rc WHERE bin >= 40",
        "rc AS (SELECT bin, (sum(count(*)) OVER (ORDER BY bin DESC))::BIGINT AS n_above FROM q GROUP BY bin)",
    )
)
def b_value_least_squares(spark, sf_dir):
    return completeness.b_least_squares(catalog.quakes(spark, sf_dir), 40)


# ---- rates and forecasts -------------------------------------------------------------------------------------


@query(_q("SELECT origin_year, cell_id, n_train, n_future, round(rate, 6) AS rate, round(p, 6) AS p, y FROM fc", GRID, _forecast()))
def spatial_poisson(spark, sf_dir):
    return _forecasts(spark, sf_dir).select("origin_year", "cell_id", "n_train", "n_future", _r("rate", "rate"), _r("p", "p"), "y")


_SCORES = """count(*) AS n, sum(y)::BIGINT AS n_positive, round(avg((p - y) * (p - y)), 6) AS brier,
  round(avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) ELSE ln(1 - least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) END), 6) AS log_likelihood, round(stddev_pop(p), 6) AS sharpness,
  round(avg(CASE WHEN y = 1 THEN ln(least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) ELSE ln(1 - least(greatest(p, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) END)
    - (avg(y) * ln(least(greatest(avg(y), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) + (1 - avg(y)) * ln(1 - least(greatest(avg(y), 1e-12::DOUBLE), 1 - 1e-12::DOUBLE))), 6) AS information_gain"""


@query(_q(f"SELECT origin_year, {_SCORES} FROM fc GROUP BY origin_year", GRID, _forecast()))
def backtest_scores(spark, sf_dir):
    return metrics.scores(_forecasts(spark, sf_dir), ["origin_year"])


@query(
    _q(
        "SELECT a.origin_year, a.cell_id, round(a.rate, 6) AS rate, round(avg(b.rate), 6) AS rate_smoothed FROM fc a JOIN fc b ON a.origin_year = b.origin_year AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.origin_year, a.cell_id, a.rate",
        GRID,
        _forecast(),
    )
)
def smoothed_rates(spark, sf_dir):
    out = rates.smoothed(rates.expanding_rates(catalog.quakes(spark, sf_dir), 4.0, FIRST, LAST))
    return out.select("origin_year", "cell_id", _r("rate", "rate"), _r("rate_smoothed", "rate_smoothed"))


@query(
    _q(
        f"""SELECT i AS i_lat, j AS i_lon, cell_id, clat AS lat_center, clon AS lon_center, count(m) AS n, count(m) FILTER (m >= 4.5) AS n_45, count(m) FILTER (m >= 5.0) AS n_50, round(avg(m), 6) AS mean_m, max(m) AS max_m,
    round(count(m) FILTER (m >= 4.5) / {YEARS}::DOUBLE, 6) AS rate_45, round(count(m) FILTER (m >= 5.0) / {YEARS}::DOUBLE, 6) AS rate_50, count(m) FILTER (m >= 4.5) < 5 AS low_statistics FROM grid LEFT JOIN q USING (i, j) GROUP BY i, j, cell_id, clat, clon""",
        GRID,
    )
)
def grid_summary(spark, sf_dir):
    return rates.grid_summary(catalog.quakes(spark, sf_dir), [4.5, 5.0], YEARS)


@query(
    _q(
        """SELECT origin_year, round(sum((2 * k - n - 1) * rate) / (max(n) * sum(rate)), 6) AS gini, round(sum(CASE WHEN k > n - 3 THEN rate ELSE 0 END) / sum(rate), 6) AS top3_share, round(sum(CASE WHEN k > n - floor(n / 10) THEN rate ELSE 0 END) / sum(rate), 6) AS top_tenth_share, count(*) FILTER (rate = 0) AS n_empty
    FROM (SELECT *, row_number() OVER (PARTITION BY origin_year ORDER BY rate, cell_id) AS k, count(*) OVER (PARTITION BY origin_year) AS n FROM fc) GROUP BY origin_year""",
        GRID,
        _forecast(),
    )
)
def concentration(spark, sf_dir):
    return rates.concentration(rates.expanding_rates(catalog.quakes(spark, sf_dir), 4.0, FIRST, LAST), "rate", ["origin_year"])


@query(
    _q(
        """SELECT f.origin_year, cell_id, round((alpha + n_train) / (beta + exposure), 6) AS posterior_mean, round(1 - pow((beta + exposure) / (beta + exposure + 30 / 365.25::DOUBLE), alpha + n_train), 6) AS p FROM fc f JOIN (
    SELECT origin_year, CASE WHEN count(*) >= 5 AND var_samp(rate) > 0 THEN avg(rate) * avg(rate) / var_samp(rate) ELSE 0.5::DOUBLE END AS alpha, CASE WHEN count(*) >= 5 AND var_samp(rate) > 0 THEN avg(rate) / var_samp(rate) ELSE 0.5::DOUBLE / avg(rate) END AS beta
    FROM fc WHERE rate > 0 GROUP BY origin_year) USING (origin_year)""",
        GRID,
        _forecast(),
    )
)
def gamma_poisson(spark, sf_dir):
    out = rates.gamma_poisson(rates.expanding_rates(catalog.quakes(spark, sf_dir), 4.0, FIRST, LAST), 30 / 365.25, ["origin_year"])
    return out.select("origin_year", "cell_id", _r("posterior_mean", "posterior_mean"), _r("p", "p"))


@query(
    _q(
        "SELECT origin_year, round(1 - exp(sum(ln(greatest(1 - p, 1e-300::DOUBLE)))), 6) AS p_region, round(sum(p), 6) AS sum_p, sum(y)::BIGINT AS observed, abs(sum(p) - sum(y)) < 0.5 * greatest(sum(y), 0.01::DOUBLE) AS passes FROM fc GROUP BY origin_year",
        GRID,
        _forecast(),
    )
)
def base_rate_check(spark, sf_dir):
    p, y = F.sum("p"), F.sum("y")
    return _forecasts(spark, sf_dir).groupBy("origin_year").agg(_r(1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("p"), F.lit(1e-300))))), "p_region"), _r(p, "sum_p"), y.alias("observed"), (F.abs(p - y) < 0.5 * F.greatest(y, F.lit(0.01))).alias("passes"))


@query()
def poisson_intervals(spark, sf_dir):
    """Counts, rates and exact intervals per cell and threshold, probabilities of each horizon with their bounds."""
    per = rates.grid_summary(catalog.quakes(spark, sf_dir), [4.5, 5.0], YEARS).select("cell_id", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(c).alias("n")) for t, c in ((4.5, "n_45"), (5.0, "n_50"))])))
    rows = intervals.with_intervals(per, "n", YEARS)
    h = F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(v).alias("years")) for k, v in C.HORIZONS.items()])
    p = lambda c: _r(seismo.p_at_least_one(c, F.col("years")))
    return rows.select("*", F.inline(h)).select("cell_id", "threshold", "horizon", "n", p(F.col("n") / YEARS).alias("p"), p(F.col("rate_lower")).alias("p_lower"), p(F.col("rate_upper")).alias("p_upper"))


# ---- verification --------------------------------------------------------------------------------------------


def _binned(edges: list[float], last: str = "<=") -> str:
    cases = " ".join(f"WHEN p >= {edges[k]!r}::DOUBLE AND p {last if k == len(edges) - 2 else '<'} {edges[k + 1]!r}::DOUBLE THEN {k}" for k in range(len(edges) - 1))
    return f"(SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM (SELECT p, y, CASE {cases} END AS bin FROM fc) WHERE bin IS NOT NULL GROUP BY bin)"


@query(_q(f"SELECT b::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM range(10) r(b) LEFT JOIN {_binned([k / 10 for k in range(11)])} ON bin = b", GRID, _forecast()))
def reliability_bins(spark, sf_dir):
    return metrics.reliability(_forecasts(spark, sf_dir))


@query(
    _q(
        f"""SELECT 'unweighted_5' AS metric, round(avg(abs(mp - my)), 6) AS value FROM {_binned([k / 5 for k in range(6)])} UNION ALL
    SELECT 'ece_5', round(sum(abs(mp - my) * n) / sum(n), 6) FROM {_binned([k / 5 for k in range(6)])} UNION ALL
    SELECT 'ece_7', round(sum(abs(mp - my) * n) / sum(n), 6) FROM {_binned([k / 7 for k in range(8)], "<")} UNION ALL
    SELECT 'ece_7_uneven', round(sum(abs(mp - my) * n) / sum(n), 6) FROM {_binned(C.ECE_EDGES)}""",
        GRID,
        _forecast(),
    )
)
def calibration_errors(spark, sf_dir):
    return metrics.calibration_errors(_forecasts(spark, sf_dir))


@query(
    _q(
        """SELECT round(sum(pos * ((all_n - all_pos) - (seen - tp) + (n - pos) / 2.0::DOUBLE)) / nullif(max(all_pos * (all_n - all_pos)), 0), 6) AS roc_auc, round(sum(pos * tp / seen::DOUBLE) / nullif(max(all_pos), 0), 6) AS pr_auc FROM (
    SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS all_pos, sum(n) OVER () AS all_n FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM fc GROUP BY p))""",
        GRID,
        _forecast(),
    )
)
def roc_pr(spark, sf_dir):
    rows = _forecasts(spark, sf_dir)
    return metrics.roc_pr(rows.withColumn("all", F.lit(1)), ["all"]).drop("all")


@query(_q("SELECT origin_year, count(*) FILTER (p >= 0.1 AND y = 1) AS hits, count(*) FILTER (p >= 0.1 AND y = 0) AS false_alarms, count(*) FILTER (p < 0.1 AND y = 1) AS misses, count(*) FILTER (p < 0.1 AND y = 0) AS correct_negatives FROM fc GROUP BY origin_year", GRID, _forecast()))
def contingency(spark, sf_dir):
    return metrics.contingency(_forecasts(spark, sf_dir), ["origin_year"])


@query(
    _q(
        """SELECT origin_year, round(avg(hi - lo + CASE WHEN n_future < lo THEN 40.0::DOUBLE * (lo - n_future) ELSE 0 END + CASE WHEN n_future > hi THEN 40.0::DOUBLE * (n_future - hi) ELSE 0 END), 6) AS interval_score,
    round(avg((n_future BETWEEN lo AND hi)::INT), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM (SELECT origin_year, n_future, 0.0::DOUBLE AS lo, rate * 30 / 365.25::DOUBLE + 2 * sqrt(rate * 30 / 365.25::DOUBLE) AS hi FROM fc) GROUP BY origin_year""",
        GRID,
        _forecast(),
    )
)
def interval_score(spark, sf_dir):
    mean = F.col("rate") * 30 / 365.25
    return metrics.interval_score(_forecasts(spark, sf_dir).withColumns({"lo": F.lit(0.0), "hi": mean + 2 * F.sqrt(mean)}), ["origin_year"])


@query(_q(f"SELECT quadrant, {_SCORES} FROM (SELECT *, concat(CASE WHEN i < 4 THEN 'S' ELSE 'N' END, CASE WHEN j < 4 THEN 'W' ELSE 'E' END) AS quadrant FROM fc) GROUP BY quadrant", GRID, _forecast()))
def quadrant_scores(spark, sf_dir):
    named = F.concat(F.when(F.col("i_lat") < 4, "S").otherwise("N"), F.when(F.col("i_lon") < 4, "W").otherwise("E"))
    return metrics.scores(_forecasts(spark, sf_dir).withColumn("quadrant", named), ["quadrant"])


# ---- inference -----------------------------------------------------------------------------------------------

_SUMS = """fu AS (SELECT *, avg(p) OVER (PARTITION BY origin_year) AS u FROM fc),
sums AS (SELECT row_number() OVER (ORDER BY origin_year) - 1 AS i, count(*) AS n, sum((p - y) * (p - y)) AS a, sum((u - y) * (u - y)) AS b FROM fu GROUP BY origin_year)"""
_LCG = "(((({r} * 1103515 + {i} * 12345 + 42) % 2147483647) * 48271) % 2147483647)"


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir)
    uniform = rows.withColumn("u", F.avg("p").over(Window.partitionBy("origin_year")))
    return inference.origin_sums(uniform, "p", "u", "origin_year")


@query(
    _q(
        f"""SELECT (SELECT round((sum(a) - sum(b)) / sum(n), 6) FROM sums) AS delta, round(quantile_cont(d, 0.025), 6) AS lower, round(quantile_cont(d, 0.975), 6) AS upper FROM (
    SELECT r, (sum(a) - sum(b)) / sum(n) AS d FROM (SELECT r, {_LCG.format(r="r", i="k")} % 9 AS i FROM range(500) x(r), range(9) z(k)) JOIN sums USING (i) GROUP BY r)""",
        GRID,
        _forecast(),
        _SUMS,
    )
)
def block_bootstrap(spark, sf_dir):
    return inference.block_bootstrap(_sums(spark, sf_dir))


@query(
    _q(
        f"""SELECT round((SELECT sum(a - b) FROM sums), 6) AS observed, round((count(*) FILTER (abs(s) >= abs((SELECT sum(a - b) FROM sums)) - 1e-12) + 1) / 1001::DOUBLE, 6) AS p_value FROM (
    SELECT r, sum(CASE WHEN {_LCG.format(r="r", i="i")} % 2 = 1 THEN a - b ELSE b - a END) AS s FROM range(1000) x(r), sums GROUP BY r)""",
        GRID,
        _forecast(),
        _SUMS,
    )
)
def sign_swap(spark, sf_dir):
    return inference.sign_swap(_sums(spark, sf_dir))


@query(
    _q(
        """SELECT test, p_value, k AS rank, p_value <= 0.05 / n AS bonferroni, k <= coalesce(max(CASE WHEN p_value <= k / n * 0.05::DOUBLE THEN k END) OVER (), 0) AS bh FROM (SELECT *, row_number() OVER (ORDER BY p_value, test) AS k, count(*) OVER ()::DOUBLE AS n FROM (
    SELECT cell_id AS test, round(exp(-count(m) / 20.0::DOUBLE), 9) AS p_value FROM grid LEFT JOIN q ON q.i = grid.i AND q.j = grid.j AND m >= 4.0 GROUP BY cell_id))""",
        GRID,
    )
)
def false_discovery(spark, sf_dir):
    """Step-up decisions on one small p per cell, made from its count."""
    n = rates.grid_summary(catalog.quakes(spark, sf_dir), [4.0], YEARS)
    return inference.benjamini_hochberg(n.select(F.col("cell_id").alias("test"), F.round(F.exp(-F.col("n_40") / 20.0), 9).alias("p_value")))


@query(_q("SELECT origin_year, n, round(2.8::DOUBLE * sqrt(2 * b * (1 - b) / n), 6) AS mde_brier, round(2.8::DOUBLE * sqrt(2.0::DOUBLE / n), 6) AS mde_log FROM (SELECT origin_year, count(*) AS n, avg((p - y) * (p - y)) AS b FROM fc GROUP BY origin_year)", GRID, _forecast()))
def detectable_effects(spark, sf_dir):
    b, n = F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), F.count("*")
    rows = _forecasts(spark, sf_dir).groupBy("origin_year").agg(n.alias("n"), b.alias("b"))
    return rows.select("origin_year", "n", _r(2.8 * F.sqrt(2 * F.col("b") * (1 - F.col("b")) / F.col("n")), "mde_brier"), _r(2.8 * F.sqrt(2.0 / F.col("n")), "mde_log"))


# ---- point process -------------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT a.m AS ma, b.event_id AS b, (epoch_us(b.t) - epoch_us(a.t)) / 86400e6::DOUBLE AS lag FROM q a JOIN q b ON a.m >= 4.0 AND b.m >= 4.0 AND b.t > a.t AND b.t <= a.t + INTERVAL 365 DAY)"
_OMORI = "(0.1::DOUBLE * pow(0.01::DOUBLE, 0.1::DOUBLE) * pow(lag + 0.01::DOUBLE, -1.1::DOUBLE))"


@query(
    _q(
        f"SELECT event_id, round(20.0::DOUBLE / 365.25::DOUBLE + coalesce(s, 0), 6) AS lambda_per_day FROM (SELECT event_id FROM q WHERE m >= 4.0) LEFT JOIN (SELECT b AS event_id, sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (ma - 4.0::DOUBLE)) * {_OMORI}) AS s FROM pairs GROUP BY b) USING (event_id)",
        _PAIRS,
    )
)
def etas_intensity(spark, sf_dir):
    return etas.intensity(catalog.quakes(spark, sf_dir), **ETAS).select("event_id", _r("lambda_per_day", "lambda_per_day"))


@query(
    _q(
        f"""SELECT theta_id, round(sum(-ln(mu / 365.25::DOUBLE + k * coalesce(s, 0)) + k * pow(10.0::DOUBLE, alpha * (m - 4.0::DOUBLE)) * pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow(0.01::DOUBLE, -0.1::DOUBLE) - pow(least((epoch_us(t1) - epoch_us(t)) / 86400e6::DOUBLE, 365.0::DOUBLE) + 0.01::DOUBLE, -0.1::DOUBLE)))
      + any_value(mu / 365.25::DOUBLE * (epoch_us(t1) - epoch_us(t0)) / 86400e6::DOUBLE), 3) AS nll
    FROM (SELECT event_id, m, t, min(t) OVER () AS t0, max(t) OVER () AS t1 FROM q WHERE m >= 4.0) e, (VALUES (0, 20.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE), (1, 20.0::DOUBLE, 0.02::DOUBLE, 0.5::DOUBLE), (2, 25.0::DOUBLE, 0.05::DOUBLE, 0.8::DOUBLE), (3, 10.0::DOUBLE, 0.1::DOUBLE, 0.8::DOUBLE)) th(theta_id, mu, k, alpha)
    LEFT JOIN (SELECT al, b, sum(pow(10.0::DOUBLE, al * (ma - 4.0::DOUBLE)) * {_OMORI}) AS s FROM pairs, (VALUES (0.5::DOUBLE), (0.8::DOUBLE)) v(al) GROUP BY al, b) ks ON ks.b = e.event_id AND ks.al = alpha GROUP BY theta_id""",
        _PAIRS,
    )
)
def etas_likelihoods(spark, sf_dir):
    thetas = spark.createDataFrame([(0, 20.0, 0.0, 0.5), (1, 20.0, 0.02, 0.5), (2, 25.0, 0.05, 0.8), (3, 10.0, 0.1, 0.8)], "theta_id int, mu_per_year double, k double, alpha double")
    out = etas.nll_grid(catalog.quakes(spark, sf_dir), thetas, 4.0, 0.01, 1.1, 365.0)
    return out.select("theta_id", F.round("nll", 3).alias("nll"))


_ORIGINS = f"origins AS (SELECT make_timestamp(y, 1, 1, 0, 0, 0) AS origin FROM range({FIRST}, {LAST + 1}) r(y))"


@query(
    _q(
        """SELECT origin, round(e, 6) AS expected, round(1 - exp(-e), 6) AS p FROM (SELECT origin, (20.0::DOUBLE / 365.25::DOUBLE * 30 + coalesce(sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)) * pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow(lag + 0.01::DOUBLE, -0.1::DOUBLE) - pow(lag + 30.01::DOUBLE, -0.1::DOUBLE))), 0)) * pow(10.0::DOUBLE, -0.45::DOUBLE) AS e FROM (
    SELECT origin, m, (epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE AS lag FROM origins LEFT JOIN q ON t < origin AND m >= 3.95) GROUP BY origin)""",
        _ORIGINS,
    )
)
def etas_forecast(spark, sf_dir):
    out = etas.temporal_forecast(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), 30.0, 4.5, **ETAS)
    return out.select("origin", _r("expected", "expected"), _r("p", "p"))


@query(
    _q(
        """SELECT origin, cell_id, round(tr, 6) AS triggered, round(e, 6) AS expected, round(1 - exp(-e), 6) AS p FROM (SELECT g.origin AS origin, g.cell_id AS cell_id, coalesce(tr, 0) AS tr, 20.0::DOUBLE / 365.25::DOUBLE * 30.0::DOUBLE * share + coalesce(tr, 0) AS e FROM (SELECT * FROM origins, (SELECT *, cos(radians(clat)) / sum(cos(radians(clat))) OVER () AS share FROM grid)) g LEFT JOIN (
    SELECT origin, cell_id, sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE)) * pow(0.01::DOUBLE, 0.1::DOUBLE) * (pow(lag + 0.01::DOUBLE, -0.1::DOUBLE) - pow(lag + 30.01::DOUBLE, -0.1::DOUBLE)) * 1.5::DOUBLE / (pi() * 400) * pow(1 + d * d / 400.0::DOUBLE, -2.5::DOUBLE) * 110.574::DOUBLE * 111.320::DOUBLE * cos(radians(clat))) AS tr
    FROM (SELECT origin, cell_id, clat, m, (epoch_us(origin) - epoch_us(t)) / 86400e6::DOUBLE AS lag, """
        + _hav("latitude", "longitude", "clat", "clon")
        + """ AS d FROM origins JOIN q ON t < origin AND m >= 4.0 AND epoch_us(origin) - epoch_us(t) <= 365 * 86400000000, grid) GROUP BY origin, cell_id) x ON x.origin = g.origin AND x.cell_id = g.cell_id)""",
        GRID,
        _ORIGINS,
    )
)
def etas_spatial_forecast(spark, sf_dir):
    out = etas.spatial_forecast(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), joins.grid(spark), 30.0, **ETAS)
    return out.select("origin", "cell_id", _r("triggered", "triggered"), _r("expected", "expected"), _r("p", "p"))


@query(
    _q(
        """SELECT e.event_id, round(20.0::DOUBLE / 365.25::DOUBLE * (epoch_us(e.t) - (SELECT epoch_us(min(t)) FROM q WHERE m >= 4.0)) / 86400e6::DOUBLE + coalesce(sum(0.02::DOUBLE * pow(10.0::DOUBLE, 0.8::DOUBLE * (a.m - 4.0::DOUBLE)) * (1 - pow(0.01::DOUBLE / ((epoch_us(e.t) - epoch_us(a.t)) / 86400e6::DOUBLE + 0.01::DOUBLE), 0.1::DOUBLE))), 0), 4) AS tau
    FROM (SELECT * FROM q WHERE m >= 4.0) e LEFT JOIN (SELECT * FROM q WHERE m >= 4.0) a ON a.t < e.t GROUP BY e.event_id, e.t"""
    )
)
def etas_transformed_times(spark, sf_dir):
    return etas.transformed_times(catalog.quakes(spark, sf_dir), **ETAS).select("event_id", F.round("tau", 4).alias("tau"))


@query()
def etas_fit(spark, sf_dir):
    return etas.fit(catalog.quakes(spark, sf_dir), 4.5).select("start_id", *[_r(c, c) for c in ("mu_per_year", "k", "alpha", "c", "p", "nll")], "triggering")


@query()
def etas_fit_in_space(spark, sf_dir):
    """The process in time and space over a background of main events, from magnitude 4.5 on."""
    big = catalog.quakes(spark, sf_dir).where("m >= 4.5D")
    out = etas.fit_in_space(big, joins.grid(spark), decluster.background(big), 4.5)
    return out.select("start_id", *[_r(c, c) for c in (*etas.IN_TIME, *etas.IN_SPACE, "nll")], "triggering")


_LAGS = [0.0, 0.1, 1.0, 7.0, 30.0, 90.0, 365.0]
_LAG_BIN = "CASE " + " ".join(f"WHEN lag >= {_LAGS[k]} AND lag < {_LAGS[k + 1]} THEN {k}" for k in range(6)) + " END"


@query(
    _q(
        f"""SELECT e.bin, lag_from, coalesce(n, 0)::BIGINT AS n, round(x, 6) AS exposure_days, round(coalesce(n, 0) / nullif(x, 0) / base, 6) AS ratio FROM (
      SELECT b.bin, lo AS lag_from, sum(greatest(0, least(hi, (epoch_us(t1) - epoch_us(t)) / 86400e6::DOUBLE) - lo)) AS x FROM q, w, (VALUES {", ".join(f"({k}, {_LAGS[k]}::DOUBLE, {_LAGS[k + 1]}::DOUBLE)" for k in range(6))}) b(bin, lo, hi) WHERE m >= 5.5 GROUP BY b.bin, lo) e
    LEFT JOIN (SELECT bin, count(*) AS n FROM (SELECT {_LAG_BIN} AS bin FROM (SELECT (epoch_us(b.t) - epoch_us(a.t)) / 86400e6::DOUBLE AS lag FROM q a JOIN q b ON a.m >= 5.5 AND b.m >= 4.0 AND b.t > a.t AND b.t <= a.t + INTERVAL 365 DAY)) WHERE bin IS NOT NULL GROUP BY bin) c USING (bin), w""",
        "w AS (SELECT min(t) AS t0, max(t) AS t1, count(*) / ((epoch_us(max(t)) - epoch_us(min(t))) / 86400e6::DOUBLE) AS base FROM q WHERE m >= 4.0)",
    )
)
def omori_ratio(spark, sf_dir):
    return etas.omori_ratio(catalog.quakes(spark, sf_dir), 5.5, 4.0, _LAGS)


_RINGS = [1.0, 10.0, 25.0, 50.0, 100.0, 200.0, 500.0]


@query(
    _q(
        "SELECT bin, count(*) AS n, round(count(*) / any_value(area) * 1e6, 6) AS per_million_km2 FROM (SELECT CASE "
        + " ".join(f"WHEN d >= {_RINGS[k]} AND d < {_RINGS[k + 1]} THEN {k}" for k in range(6))
        + " END AS bin, CASE "
        + " ".join(f"WHEN d >= {_RINGS[k]} AND d < {_RINGS[k + 1]} THEN {math.pi * (_RINGS[k + 1] ** 2 - _RINGS[k] ** 2)!r}::DOUBLE" for k in range(6))
        + f" END AS area FROM (SELECT {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS d FROM q a JOIN q b ON a.m >= 5.5 AND b.m >= 4.0 AND b.t > a.t AND b.t <= a.t + INTERVAL 30 DAY)) WHERE bin IS NOT NULL GROUP BY bin"
    )
)
def spatial_aftershocks(spark, sf_dir):
    return etas.spatial_aftershocks(catalog.quakes(spark, sf_dir), 5.5, 4.0, 30.0, _RINGS)


@query(_q(f"SELECT round({0.02 * 0.9 * math.log(10) / (0.9 * math.log(10) - 0.8)!r}::DOUBLE, 6) AS n_analytic, round(0.02::DOUBLE * avg(pow(10.0::DOUBLE, 0.8::DOUBLE * (m - 4.0::DOUBLE))), 6) AS n_empirical, FALSE AS explosive FROM q WHERE m >= 3.95"))
def branching_ratio(spark, sf_dir):
    return etas.branching(catalog.quakes(spark, sf_dir), ETAS["k"], ETAS["alpha"], ETAS["mc"], ETAS["b"])


@query(_q("SELECT origin FROM origins WHERE NOT EXISTS (SELECT 1 FROM q WHERE m >= 6.5 AND t < origin AND epoch_us(origin) - epoch_us(t) <= 90 * 86400000000)", _ORIGINS))
def background_origins(spark, sf_dir):
    return etas.background_origins(catalog.quakes(spark, sf_dir), joins.yearly_origins(spark, FIRST, LAST), 6.5)


@query(_q("SELECT event_id, d AS lag_days, l AS label, t + to_days(d) AS origin FROM q, (VALUES (1, '0-24h'), (7, '1-7d'), (30, '8-30d'), (90, '31-90d')) v(d, l) WHERE m >= 6.0"))
def conditioned_origins(spark, sf_dir):
    return etas.conditioned_origins(catalog.quakes(spark, sf_dir))


@query(_q("SELECT origin, max_by(t, (t, event_id)) AS t, max_by(m, (t, event_id)) AS m FROM origins LEFT JOIN q ON t < origin AND q.m >= 6.0 GROUP BY origin", _ORIGINS))
def last_large_event(spark, sf_dir):
    big = catalog.quakes(spark, sf_dir).where("m >= 6.0D").select("t", "event_id", "m")
    return joins.asof_backward(joins.yearly_origins(spark, FIRST, LAST), big, "origin", "t", ["event_id", "m"]).drop("event_id")


@query(
    _q(
        """SELECT cell_id, round(sum(exp(-(pow(latitude - clat, 2) + pow(longitude - clon, 2)) / (2 * h * h)) / (2 * pi() * h * h)) / any_value(n), 6) AS density FROM (
    SELECT *, count(*) OVER () AS n, greatest(0.9::DOUBLE * least(stddev_pop(latitude) OVER (), stddev_pop(longitude) OVER ()) * pow(count(*) OVER (), -1.0::DOUBLE / 6), 0.1::DOUBLE) AS h FROM q WHERE m >= 4.5), grid GROUP BY cell_id""",
        GRID,
    )
)
def kde_background(spark, sf_dir):
    out = etas.kde_background(catalog.quakes(spark, sf_dir).where("m >= 4.5D"), joins.grid(spark))
    return out.select("cell_id", _r("density", "density"))


_DEG = "sqrt(pow((clon - longitude) * cos(radians(24.0::DOUBLE)), 2) + pow(clat - latitude, 2))"


@query(_q(f"SELECT cell_id, round(sum(exp(-d * d / (2 * 0.5::DOUBLE * 0.5::DOUBLE)) / (2 * pi() * 0.5::DOUBLE * 0.5::DOUBLE)) / {YEARS}::DOUBLE, 6) AS rate FROM (SELECT cell_id, {_DEG} AS d FROM q, grid WHERE m >= 4.5) GROUP BY cell_id", GRID))
def adaptive_rate_fixed(spark, sf_dir):
    out = etas.adaptive_rates(catalog.quakes(spark, sf_dir).where("m >= 4.5D"), joins.grid(spark), YEARS, 0.5)
    return out.select("cell_id", _r("rate", "rate"))


@query(_q(f"SELECT cell_id, round(greatest(d, 1e-3::DOUBLE), 6) AS bandwidth FROM (SELECT cell_id, d, row_number() OVER (PARTITION BY cell_id ORDER BY d) AS k FROM (SELECT cell_id, {_DEG} AS d FROM q, grid WHERE m >= 4.5)) WHERE k = 5", GRID))
def adaptive_bandwidth(spark, sf_dir):
    out = etas.nearest_bandwidths(catalog.quakes(spark, sf_dir).where("m >= 4.5D"), joins.grid(spark), 5)
    return out.select("cell_id", _r("bandwidth", "bandwidth"))


@query()
def gardner_knopoff(spark, sf_dir):
    return decluster.gardner_knopoff(catalog.quakes(spark, sf_dir))


@query()
def reasenberg(spark, sf_dir):
    return decluster.reasenberg(catalog.quakes(spark, sf_dir))


# ---- features, stress, ledger --------------------------------------------------------------------------------


@query(
    _q(
        """SELECT event_id, round(least(greatest(exp(least(x / 0.05::DOUBLE, 700)), 0.01::DOUBLE), 100), 6) AS rate_and_state, round(least(greatest(exp(2.0::DOUBLE * x), 0.01::DOUBLE), 100), 6) AS exponential, CASE WHEN x > 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS step
    FROM (SELECT event_id, ((depth_km - 75) * 1000.0::DOUBLE) / 1e6::DOUBLE AS x FROM quakes)"""
    )
)
def stress_coupling(spark, sf_dir):
    pa = (F.col("depth_km") - 75) * 1000.0
    return catalog.quakes(spark, sf_dir).select("event_id", *[_r(seismo.stress_rate_factor(pa, f), f) for f in ("rate_and_state", "exponential", "step")])


def _receivers(spark: SparkSession) -> DataFrame:
    return joins.grid(spark).select(F.col("cell_id").alias("receiver_id"), F.col("lat_center").alias("r_lat"), F.col("lon_center").alias("r_lon"), F.lit(10.0).alias("r_depth_km"), F.lit(320.0).alias("r_strike"), F.lit(20.0).alias("r_dip"), F.lit(90.0).alias("r_rake"))


@query()
def coulomb_forecast(spark, sf_dir):
    """Stress of M >= 6 events, with one mechanism for all, on the grid, and the forecast that it modulates."""
    sources = catalog.quakes(spark, sf_dir).where("m >= 6.0D").select("latitude", "longitude", "depth_km", F.col("m").alias("mw"), F.lit(300.0).alias("strike"), F.lit(30.0).alias("dip"), F.lit(90.0).alias("rake"))
    stress = coulomb.point_source_dcfs(sources, _receivers(spark))
    base = rates.grid_summary(catalog.quakes(spark, sf_dir), [4.5], YEARS).select(F.col("cell_id").alias("receiver_id"), F.col("rate_45").alias("rate"))
    return coulomb.modulated_forecast(base, stress, 30 / 365.25).select("receiver_id", F.round("factor", 6).alias("factor"), _r("rate", "rate"), _r("p", "p"))


@query(
    _q(
        """SELECT k AS bin, count(*) AS n_cells, sum(n)::BIGINT AS n_events, round(sum(n) / count(*) / any_value(base), 6) AS ratio FROM (SELECT least(greatest(floor((x + 1000) / 200), 0), 9)::INT AS k, n, sum(n) OVER () / count(*) OVER ()::DOUBLE AS base FROM (
    SELECT (clat - 24) * 250 AS x, count(m) FILTER (m >= 4.0) AS n FROM grid LEFT JOIN q USING (i, j) GROUP BY cell_id, clat)) GROUP BY k""",
        GRID,
    )
)
def rate_by_stress(spark, sf_dir):
    cells = rates.grid_summary(catalog.quakes(spark, sf_dir), [4.0], YEARS).select(((F.col("lat_center") - 24) * 250).alias("dcfs_pa"), F.col("n_40").alias("n"))
    return coulomb.rate_by_stress(cells, -1000.0, 1000.0)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.forecasts(catalog.quakes(spark, sf_dir), [4.0, 4.5], {"7d": 7, "30d": 30}, FIRST, LAST)


_LEDGER = "cells AS (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, '{h}' AS horizon, oy AS origin_year, cell_id, g.i, g.j, (SELECT count(*) FROM q WHERE q.i = g.i AND q.j = g.j AND m >= {t} AND yr < oy) AS n_train, exposure, {d} AS days FROM grid g, yy" for t in (4.0, 4.5) for h, d in (("7d", 7), ("30d", 30))) + f"), cp AS (SELECT *, n_train / exposure AS rate, 1.0::DOUBLE - exp(-(n_train / exposure) * (days / 365.25::DOUBLE)) AS p FROM cells)"
_YY = f"yy AS (SELECT y::INT AS oy, date_diff('day', DATE '1975-01-01', make_date(y, 1, 1)) / 365.25::DOUBLE AS exposure FROM range({FIRST}, {LAST + 1}) r(y))"


@query(
    _q(
        """SELECT origin_year, threshold, horizon, count(*) AS n_cells, round(sum(rate), 6) AS rate, round(1 - exp(sum(ln(greatest(1 - p, 1e-300::DOUBLE)))), 6) AS p_region,
    substr(sha256(string_agg(concat_ws(':', cell_id, n_train, printf('%.6f', round(p, 6))), ';' ORDER BY cell_id)), 1, 16) AS forecast_hash FROM cp GROUP BY origin_year, threshold, horizon""",
        GRID,
        _YY,
        _LEDGER,
    )
)
def ledger_records(spark, sf_dir):
    return ledger.records(_ledger(spark, sf_dir))
