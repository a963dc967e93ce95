"""Queries of audits, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions import geo, seismo
from tremorlake.operators import audit, decluster, joins, reconcile, rings
from tremorlake.queries import MATCH, OBS, _q, _r, query
from tremorlake.sources import catalog, sinks

_REASON = """CASE WHEN magnitude_type IN ('mw', 'mww') OR magnitude_type = 'mb' AND {m} BETWEEN 3.5 AND 6.2 OR magnitude_type = 'ms' AND {m} BETWEEN 3.0 AND 8.0 THEN 'available' WHEN magnitude_type IN ('ml', 'md') THEN 'no_relation' WHEN magnitude_type IN ('mb', 'ms') THEN 'out_of_range' ELSE 'unrecognised' END"""


@query(
    _q(
        f"""SELECT facet, value, count(*) AS n FROM (SELECT unnest(['source', 'magnitude_type', 'quality', 'year', 'magnitude_bin', 'mw']) AS facet,
    unnest([source_catalog, magnitude_type, quality_flag, year(origin_time)::VARCHAR, floor(original_magnitude * 10 + 1e-9)::INT::VARCHAR, {_REASON.format(m="original_magnitude")}]) AS value FROM obs) GROUP BY facet, value""",
        OBS,
    )
)
def catalog_facets(spark, sf_dir):
    return audit.facets(catalog.observations(spark, sf_dir))


@query(
    _q(
        f"""SELECT count(*) AS n, min(origin_time) AS first_time, max(origin_time) AS last_time, min(original_magnitude) AS min_m, max(original_magnitude) AS max_m, round(avg(depth_km), 6) AS mean_depth, round(quantile_cont(depth_km, 0.5), 6) AS median_depth,
    round(avg(({_REASON.format(m="original_magnitude")} = 'available')::INT), 6) AS mw_share, round(avg((quality_flag = 'reviewed')::INT), 6) AS reviewed_share FROM obs""",
        OBS,
    )
)
def quality_summary(spark, sf_dir):
    return audit.quality_summary(catalog.observations(spark, sf_dir))


@query(
    _q(
        """SELECT count(*) AS n_events, count(*) FILTER (s > 1) AS n_multi, round(count(*) FILTER (s > 1) / count(*)::DOUBLE, 6) AS multi_share, round(avg(n), 6) AS observations_per_event, max(n) AS most
    FROM (SELECT anchor_id, count(*) AS n, count(DISTINCT source_catalog) AS s FROM matched GROUP BY anchor_id)""",
        OBS,
        MATCH,
    )
)
def overlap_summary(spark, sf_dir):
    return reconcile.overlap_summary(reconcile.match_observations(catalog.observations(spark, sf_dir)))


@query(_q("SELECT printf('ev_%06d', row_number() OVER (ORDER BY origin_time, native_event_id)) AS canonical_id, native_event_id AS anchor_id FROM matched WHERE native_event_id = anchor_id", OBS, MATCH))
def canonical_ids(spark, sf_dir):
    return reconcile.numbered(reconcile.match_observations(catalog.observations(spark, sf_dir)))


@query(_q("SELECT anchor_id FROM (SELECT DISTINCT anchor_id FROM matched) WHERE anchor_id IN (SELECT anchor_id FROM matched WHERE source_catalog = 'isc')", OBS, MATCH))
def events_of_a_source(spark, sf_dir):
    """Events with an observation of one source, a semi join."""
    return reconcile.seen_by(reconcile.match_observations(catalog.observations(spark, sf_dir)), "isc")


@query(_q("SELECT anchor_id FROM matched EXCEPT SELECT anchor_id FROM matched WHERE source_catalog = 'isc'", OBS, MATCH))
def events_without_a_source(spark, sf_dir):
    m = reconcile.match_observations(catalog.observations(spark, sf_dir))
    return m.select("anchor_id").distinct().join(reconcile.seen_by(m, "isc"), "anchor_id", "left_anti")


@query(_q("SELECT event_id FROM quakes WHERE m >= 4.5 INTERSECT SELECT event_id FROM quakes WHERE depth_km < 25"))
def shallow_and_large(spark, sf_dir):
    q = catalog.quakes(spark, sf_dir)
    return q.where("m >= 4.5D").select("event_id").intersect(q.where("depth_km < 25").select("event_id"))


_SPOILED = """spoiled AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN latitude + 90 ELSE latitude END AS latitude, CASE WHEN event_id % 13 = 0 THEN longitude - 300 ELSE longitude END AS longitude,
  CASE WHEN event_id % 17 = 0 THEN -1.0::DOUBLE WHEN event_id % 19 = 0 THEN NULL ELSE depth_km END AS depth_km, CASE WHEN event_id % 23 = 0 THEN m + 9 ELSE m END AS m FROM quakes)"""


@query(
    _q(
        """SELECT faults, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN NOT (depth_km BETWEEN 0 AND 800) THEN 'depth_km' END, CASE WHEN NOT (latitude BETWEEN -90 AND 90) THEN 'latitude' END, CASE WHEN NOT (longitude BETWEEN -180 AND 180) THEN 'longitude' END, CASE WHEN NOT (m BETWEEN -2 AND 10.5) THEN 'm' END], lambda x: x IS NOT NULL), ',') AS faults FROM spoiled) GROUP BY faults""",
        _SPOILED,
    )
)
def range_validation(spark, sf_dir):
    """Faults of a catalog into which wrong values were put."""
    n = F.col("event_id")
    spoiled = catalog.quakes(spark, sf_dir).select(
        "event_id",
        F.when(n % 11 == 0, F.col("latitude") + 90).otherwise(F.col("latitude")).alias("latitude"),
        F.when(n % 13 == 0, F.col("longitude") - 300).otherwise(F.col("longitude")).alias("longitude"),
        F.when(n % 17 == 0, -1.0).when(n % 19 == 0, F.lit(None)).otherwise(F.col("depth_km")).alias("depth_km"),
        F.when(n % 23 == 0, F.col("m") + 9).otherwise(F.col("m")).alias("m"),
    )
    return audit.range_faults(spoiled).groupBy(F.array_join("faults", ",").alias("faults")).agg(F.count("*").alias("n"))


@query(
    _q(
        """SELECT count(*) AS n, min(m) AS min_m, max(m) AS max_m, count(*) FILTER (m < 4) AS n_below_40, count(*) FILTER (m < 3.5) AS n_below_35, count(*) FILTER (m < 3) AS n_below_30, count(*) FILTER (m < 2.5) AS n_below_25,
    (SELECT b / 10::DOUBLE FROM (SELECT round_even(m * 10, 0)::INT AS b, count(*) AS k FROM quakes GROUP BY 1 ORDER BY k DESC, b LIMIT 1)) AS fullest_bin, (SELECT max(k) FROM (SELECT count(*) AS k FROM quakes GROUP BY round_even(m * 10, 0))) AS n_fullest FROM quakes"""
    )
)
def magnitude_floor(spark, sf_dir):
    return audit.magnitude_floor(catalog.quakes(spark, sf_dir))


@query(
    _q(
        """SELECT coalesce(a.bin, b.bin) AS bin, a.n AS a, b.n AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS difference FROM (SELECT round_even(original_magnitude * 10, 0)::INT AS bin, count(*) AS n FROM obs WHERE source_catalog = 'usgs' GROUP BY 1) a
    FULL JOIN (SELECT round_even(original_magnitude * 10, 0)::INT AS bin, count(*) AS n FROM obs WHERE source_catalog = 'isc' GROUP BY 1) b USING (bin)""",
        OBS,
    )
)
def catalogs_compared(spark, sf_dir):
    """Magnitude bins of two catalogs side by side."""
    obs = catalog.observations(spark, sf_dir)
    bins = lambda s: obs.where(F.col("source_catalog") == s).groupBy(F.bround(F.col("original_magnitude") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return audit.compared(bins("usgs"), bins("isc"), "bin", "n")


_MECH = """mech AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'gcmt' WHEN 1 THEN 'isc' ELSE 'other' END AS source_catalog, concat('a', event_id) AS native_event_id, (event_id * 7 % 360)::DOUBLE AS strike, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 90)::DOUBLE END AS dip, 90.0::DOUBLE AS rake FROM quakes WHERE m >= 5.5
  UNION ALL SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'usgs' ELSE 'isc-gem' END, concat('b', event_id), (event_id * 11 % 360)::DOUBLE, 45.0::DOUBLE, -90.0::DOUBLE FROM quakes WHERE m >= 5.5 AND event_id % 2 = 0)"""


def _mechanisms(spark, sf_dir):
    n = F.col("event_id")
    big = catalog.quakes(spark, sf_dir).where("m >= 5.5D")
    a = big.select(n, F.when(n % 5 == 0, "gcmt").when(n % 5 == 1, "isc").otherwise("other").alias("source_catalog"), F.concat(F.lit("a"), n).alias("native_event_id"), (n * 7 % 360).cast("double").alias("strike"), F.when(n % 9 != 0, (n % 90).cast("double")).alias("dip"), F.lit(90.0).alias("rake"))
    b = big.where(n % 2 == 0).select(n, F.when(n % 3 == 0, "usgs").otherwise("isc-gem").alias("source_catalog"), F.concat(F.lit("b"), n).alias("native_event_id"), (n * 11 % 360).cast("double").alias("strike"), F.lit(45.0).alias("dip"), F.lit(-90.0).alias("rake"))
    return a.unionByName(b)


@query(
    _q(
        """SELECT event_id, source_catalog, native_event_id, strike, dip, rake FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE source_catalog WHEN 'gcmt' THEN 0 WHEN 'usgs' THEN 1 WHEN 'isc-gem' THEN 2 WHEN 'isc' THEN 3 ELSE 4 END, native_event_id) AS k FROM mech WHERE dip IS NOT NULL) WHERE k = 1""",
        _MECH,
    )
)
def best_mechanisms(spark, sf_dir):
    return audit.best_mechanisms(_mechanisms(spark, sf_dir))


_FAULTS = """faults AS (SELECT p_partkey::VARCHAR AS fault_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 1.5::DOUBLE END AS dip, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice / 100 END AS slip_rate, CASE WHEN p_size % 5 = 0 THEN p_size * 100.0::DOUBLE END AS recurrence_years,
  CASE p_size % 7 WHEN 0 THEN 'placeholder' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, 19.0::DOUBLE + p_partkey % 12 AS lat, 86.0::DOUBLE + p_partkey % 13 AS lon FROM part)"""


def _faults(spark, sf_dir):
    n = F.col("p_size")
    lat, lon = 19.0 + F.col("p_partkey") % 12, 86.0 + F.col("p_partkey") % 13
    trace = F.array(F.struct(lon.alias("lon"), lat.alias("lat")), F.struct((lon + 1).alias("lon"), (lat + 1).alias("lat")))
    return catalog.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("fault_id"),
        F.when(n % 3 != 0, n * 1.5).alias("dip"),
        F.when(n % 4 != 0, F.col("p_retailprice") / 100).alias("slip_rate"),
        F.when(n % 5 == 0, n * 100.0).alias("recurrence_years"),
        F.when(n % 7 == 0, "placeholder").when(n % 7 == 1, "medium").otherwise("low").alias("confidence"),
        trace.alias("trace"),
    )


@query(
    _q(
        """SELECT fault_id, confidence <> 'placeholder' AND dip IS NOT NULL AS for_coulomb, confidence <> 'placeholder' AND (slip_rate IS NOT NULL OR recurrence_years IS NOT NULL) AS for_hazard
    FROM faults WHERE (lat BETWEEN 20 AND 28 AND lon BETWEEN 88 AND 96) OR (lat + 1 BETWEEN 20 AND 28 AND lon + 1 BETWEEN 88 AND 96)""",
        _FAULTS,
    )
)
def fault_uses(spark, sf_dir):
    """Faults of the region, made from the part table, and what they are fit for."""
    return audit.fault_uses(audit.near_region(_faults(spark, sf_dir))).select("fault_id", "for_coulomb", "for_hazard")


@query(_q("SELECT fault_id, dip FROM faults WHERE confidence <> 'placeholder' AND dip IS NOT NULL", _FAULTS))
def coulomb_faults(spark, sf_dir):
    """The guard lets fit faults through; an unfit one would fail the query."""
    fit = audit.fault_uses(_faults(spark, sf_dir)).where("for_coulomb").drop("for_coulomb", "for_hazard")
    return audit.require_for_coulomb(fit).select("fault_id", "dip")


@query(
    _q(
        """SELECT anchor_id, array_to_string(list_concat([concat('match: ', n, ' observations'), concat('origin: ', o), concat('magnitude: ', g['id'])], CASE
      WHEN g['k'] = 'ms' AND g['m'] BETWEEN 3.0 AND 6.1 THEN ['convert: ms_low'] WHEN g['k'] = 'mb' AND g['m'] BETWEEN 3.5 AND 6.2 THEN ['convert: mb'] WHEN g['k'] = 'ms' AND g['m'] BETWEEN 5.8 AND 8.0 THEN ['convert: ms_high'] ELSE [] END), '; ') AS steps FROM (
    SELECT anchor_id, count(*) AS n,
      first(native_event_id ORDER BY CASE quality_flag WHEN 'reviewed' THEN 0 WHEN 'automatic' THEN 3 ELSE 4 END, coalesce(horizontal_uncertainty_km, 25.0::DOUBLE), -coalesce(n_stations, 0), coalesce(gap_deg, 360.0::DOUBLE), source_catalog, native_event_id) AS o,
      first({'m': original_magnitude, 'k': magnitude_type, 'id': native_event_id} ORDER BY CASE WHEN magnitude_type IN ('mw', 'mww') THEN 0 ELSE 1 END, coalesce(magnitude_uncertainty, 0.3::DOUBLE), source_catalog, native_event_id) AS g
    FROM matched GROUP BY anchor_id)""",
        OBS,
        MATCH,
    )
)
def provenance_steps(spark, sf_dir):
    events = audit.provenance(reconcile.canonical_events(reconcile.match_observations(catalog.observations(spark, sf_dir))))
    return events.select("anchor_id", F.array_join(F.transform("steps", lambda s: F.concat_ws(": ", s["step"], s["detail"])), "; ").alias("steps"))


@query(
    _q(
        f"""SELECT event_id, CASE {_REASON.format(m="m")} WHEN 'out_of_range' THEN concat(magnitude_type, ' ', printf('%.4f', m), ' is outside ', CASE magnitude_type WHEN 'mb' THEN '3.5 to 6.2' ELSE '3.0 to 6.1, 5.8 to 8.0' END) WHEN 'no_relation' THEN concat('no relation for ', magnitude_type) WHEN 'unrecognised' THEN 'unrecognised magnitude type' END AS why,
    round(CASE WHEN magnitude_type IN ('mw', 'mww') THEN u WHEN magnitude_type = 'mb' AND m BETWEEN 3.5 AND 6.2 THEN sqrt(pow(coalesce(u, 0), 2) + pow(0.41::DOUBLE, 2)) WHEN magnitude_type = 'ms' AND m BETWEEN 3.0 AND 6.1 THEN sqrt(pow(coalesce(u, 0), 2) + pow(0.37::DOUBLE, 2)) WHEN magnitude_type = 'ms' AND m BETWEEN 5.8 AND 8.0 THEN sqrt(pow(coalesce(u, 0), 2) + pow(0.28::DOUBLE, 2)) ELSE u END, 6) AS sigma
    FROM (SELECT event_id, m, magnitude_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 9) / 20.0::DOUBLE END AS u FROM quakes)"""
    )
)
def mw_explanations(spark, sf_dir):
    """Why an event has no Mw, and its uncertainty with that of the relation."""
    rows = catalog.with_mw(catalog.quakes(spark, sf_dir)).withColumn("u", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 9 / 20.0))
    return rows.select("event_id", audit.missing_mw_text(F.col("m"), F.col("magnitude_type")).alias("why"), _r(seismo.quadrature(F.col("u"), F.col("mw_sigma")), "sigma"))


_RELATIONS = "(VALUES " + ", ".join(f"('{r[0]}', '{r[1]}', " + ", ".join(f"{x!r}::DOUBLE" for x in r[2:]) + ")" for r in C.MAG_RELATIONS) + ") v(relation, input_type, slope, intercept, sigma, lowest, highest)"


@query(_q(f"SELECT relation, input_type, slope, intercept, sigma, lowest, highest, count(m) AS n_events, round(avg(slope * m + intercept), 6) AS mean_mw FROM {_RELATIONS} LEFT JOIN quakes ON magnitude_type = input_type AND m BETWEEN lowest AND highest GROUP BY ALL"))
def magnitude_relations(spark, sf_dir):
    """Every relation with the events in its range and the mean Mw that it gives them."""
    table = spark.createDataFrame(C.MAG_RELATIONS, "relation string, input_type string, slope double, intercept double, sigma double, lowest double, highest double")
    met = catalog.quakes(spark, sf_dir).join(F.broadcast(table), (F.col("magnitude_type") == F.col("input_type")) & F.col("m").between(F.col("lowest"), F.col("highest")))
    used = met.groupBy("relation").agg(F.count("*").alias("n_events"), _r(F.avg(F.col("slope") * F.col("m") + F.col("intercept")), "mean_mw"))
    return table.join(used, "relation", "left").fillna(0, ["n_events"])


@query(_q("SELECT source_id, class, product, reader, count(native_event_id) AS n_observations FROM (VALUES " + ", ".join(str(s) for s in sinks.SOURCES) + ") v(source_id, class, product, reader) LEFT JOIN obs ON source_catalog = split_part(source_id, '-', 1) WHERE class = 'catalog' GROUP BY ALL", OBS))
def source_registry(spark, sf_dir):
    """Registered catalogs with the observations of each one's agency."""
    seen = catalog.observations(spark, sf_dir).groupBy(F.col("source_catalog").alias("agency")).agg(F.count("*").alias("n_observations"))
    rows = sinks.registry(spark).where("class = 'catalog'").withColumn("agency", F.split("source_id", "-")[0])
    return rows.join(seen, "agency", "left").fillna(0, ["n_observations"]).drop("agency")


@query(_q("SELECT event_type AS raw, CASE WHEN event_type = 'earthquake' THEN 'earthquake' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN ' Earthquake ' WHEN 1 THEN 'quarry' ELSE NULL END AS event_type, 1 AS one FROM events) GROUP BY event_type").replace("CASE WHEN event_type = 'earthquake'", "CASE WHEN lower(trim(event_type)) = 'earthquake'"))
def event_kinds(spark, sf_dir):
    n = F.col("event_id")
    rows = catalog.table(spark, sf_dir, "events").select(F.when(n % 3 == 0, " Earthquake ").when(n % 3 == 1, "quarry").alias("raw"))
    return rows.select("raw", audit.event_kind(F.col("raw")).alias("kind")).groupBy("raw", "kind").agg(F.count("*").alias("n"))


@query(_q("SELECT event_id FROM (SELECT event_id, latitude + 3 AS y, longitude - 4 AS x FROM quakes) WHERE y BETWEEN 20 AND 28 AND x BETWEEN 88 AND 96"))
def region_filter(spark, sf_dir):
    return catalog.quakes(spark, sf_dir).where(geo.in_bbox(F.col("latitude") + 3, F.col("longitude") - 4)).select("event_id")


@query(
    _q(
        """SELECT regexp_replace(native_event_id, '[^0-9]', '', 'g')::BIGINT AS event, count(*) AS n, array_to_string(list(concat(magnitude_type, ' ', printf('%.4f', original_magnitude)) ORDER BY source_catalog, native_event_id), ', ') AS magnitudes FROM obs GROUP BY 1""",
        OBS,
    )
)
def magnitudes_of_events(spark, sf_dir):
    """All magnitudes that were observed of an event."""
    obs = catalog.observations(spark, sf_dir).withColumn("event", F.regexp_replace("native_event_id", "[^0-9]", "").cast("long"))
    return catalog.all_magnitudes(obs, "event").select("event", "n", F.array_join(F.transform("magnitudes", lambda x: F.format_string("%s %.4f", x["magnitude_type"], x["magnitude"])), ", ").alias("magnitudes"))


@query(
    _q(
        """SELECT 'cells' AS kind, NULL::VARCHAR AS magnitude_type, i, j, count(*) AS n, NULL::DOUBLE AS mean_m FROM q GROUP BY i, j UNION ALL SELECT 'types', magnitude_type, NULL, NULL, count(*), round(avg(m), 6) FROM q GROUP BY magnitude_type"""
    )
)
def merged_results(spark, sf_dir):
    """Two result tables of different columns in one."""
    from tremorlake.operators.rates import celled

    q = catalog.quakes(spark, sf_dir)
    cells = celled(q).groupBy(F.lit("cells").alias("kind"), F.col("i_lat").alias("i"), F.col("i_lon").alias("j")).agg(F.count("*").alias("n"))
    types = q.groupBy(F.lit("types").alias("kind"), "magnitude_type").agg(F.count("*").alias("n"), _r(F.avg("m"), "mean_m"))
    return audit.merged([cells, types])


@query(
    _q(
        """SELECT event_id, latitude AS place_latitude, longitude AS place_longitude, depth_km AS place_depth_km, m AS size_m, magnitude_type AS size_type_name FROM quakes"""
    )
)
def flattened_events(spark, sf_dir):
    nested = catalog.quakes(spark, sf_dir).select("event_id", F.struct("latitude", "longitude", "depth_km").alias("place"), F.struct("m", F.struct(F.col("magnitude_type").alias("name")).alias("type")).alias("size"))
    return audit.flattened(nested)


@query(
    _q(
        """SELECT event_id, substr(sha256(to_json({'depth_km': printf('%.3f', depth_km), 'event_id': event_id::VARCHAR, 'm': printf('%.4f', m), 'magnitude_type': magnitude_type})), 1, 16) AS content_hash FROM quakes"""
    )
)
def content_hashes(spark, sf_dir):
    q = catalog.quakes(spark, sf_dir).select("event_id", F.format_string("%.3f", "depth_km").alias("depth_km"), F.format_string("%.4f", "m").alias("m"), "magnitude_type", F.lit("x").alias("scored"))
    return sinks.content_hash(q, ["scored"]).select("event_id", "content_hash")


@query(
    _q(
        """SELECT g, count(*) AS n, round(avg(depth_km), 6) AS mean_depth, round(quantile_cont(depth_km, 0.5), 6) AS median_depth, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share
    FROM (SELECT depth_km, CASE WHEN depth_km < 25 THEN 'shallow' WHEN depth_km < 70 THEN 'intermediate' ELSE 'deep' END AS g FROM quakes WHERE depth_km BETWEEN 0 AND 300) GROUP BY g"""
    )
)
def depth_regimes(spark, sf_dir):
    d = F.col("depth_km")
    rows = catalog.quakes(spark, sf_dir).where(d.between(0, 300)).groupBy(seismo.depth_group(d).alias("g")).agg(F.count("*").alias("n"), _r(F.avg(d), "mean_depth"), _r(F.percentile(d, F.lit(0.5)), "median_depth"))
    return rows.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query(
    _q(
        """SELECT year, n, round(avg(n) OVER (ORDER BY year), 6) AS mean_so_far FROM (SELECT y::INT AS year, count(m) AS n FROM range(1975, 2025) r(y) LEFT JOIN q ON q.yr = y AND m >= 4.0 GROUP BY y)"""
    )
)
def expanding_mean(spark, sf_dir):
    """Yearly counts, those of zero too, with the mean of all years so far."""
    per = catalog.quakes(spark, sf_dir).where("m >= 4.0D").groupBy(F.year("t").alias("year")).agg(F.count("*").alias("n"))
    rows = spark.range(1975, 2025).select(F.col("id").cast("int").alias("year")).join(per, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("mean_so_far", _r(F.avg("n").over(Window.orderBy("year"))))


@query(
    _q(
        """SELECT event_id, magnitude_type FROM (SELECT event_id, magnitude_type, row_number() OVER (PARTITION BY magnitude_type ORDER BY (((event_id * 12345 + 42) % 2147483647) * 48271) % 2147483647 % 2147483647, event_id) AS k FROM quakes) WHERE k <= 50"""
    )
)
def sampled_events(spark, sf_dir):
    """Fifty events of each magnitude type, drawn alike by every engine; a sampling operator."""
    return audit.sampled(catalog.quakes(spark, sf_dir).select("event_id", "magnitude_type"), "event_id", ["magnitude_type"], 50)


@query()
def declustering_summary(spark, sf_dir):
    return decluster.summary(decluster.gardner_knopoff(catalog.quakes(spark, sf_dir)))


@query()
def declustered_background(spark, sf_dir):
    return decluster.background(catalog.quakes(spark, sf_dir).where("m >= 4.5D")).select("event_id", "latitude", "longitude")


@query(
    _q(
        "SELECT bin, count(*) AS n FROM (SELECT CASE "
        + " ".join(f"WHEN d >= {a} AND d < {b} THEN {k}" for k, (a, b) in enumerate([(0, 10), (10, 25), (25, 50), (50, 100), (100, 200), (200, 500), (500, 20100)]))
        + " END AS bin FROM (SELECT 2 * 6371.0088::DOUBLE * asin(sqrt(least(pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2), 1.0::DOUBLE))) AS d FROM quakes a JOIN quakes b ON a.event_id < b.event_id AND a.m >= 5.5 AND b.m >= 5.5)) GROUP BY bin"
    )
)
def pair_distances(spark, sf_dir):
    """Distances of all pairs of large events, as a histogram."""
    return rings.pair_distances(catalog.quakes(spark, sf_dir).where("m >= 5.5D"), [0, 10, 25, 50, 100, 200, 500, 20100])
