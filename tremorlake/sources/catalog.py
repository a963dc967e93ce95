"""Views of the driver's event stream as an earthquake catalog, and catalog sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions.seismo import derive_mw

#: 2024-01-01 and 1975-01-01 in microseconds; time is stretched by STRETCH between them.
BASE_US, START_US, STRETCH = 1704067200000000, 157766400000000, 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agency's catalog: event_id, t, latitude, longitude, depth_km, m, magnitude_type."""
    a = (F.col("user_id") * 53 + F.col("event_id") * 7) % 800
    b = (F.col("user_id") * 97 + F.col("event_id") * 11) % 800
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = {"click": "mb", "view": "mww", "error": "ml", "purchase": "ms"}
    kind = F.lit("mw")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.timestamp_micros(START_US + (micros - BASE_US) * STRETCH).alias("t"),
        (20.0 + a * a / 80000.0).alias("latitude"),
        (88.0 + b * b / 80000.0).alias("longitude"),
        (F.get_json_object("props", "$.k").cast("int") * 1.5).alias("depth_km"),
        F.round(3.0 + F.col("value") / 100.0, 4).alias("m"),
        kind.alias("magnitude_type"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two agencies' observations of the same catalog, the second one late, displaced and incomplete."""
    q = quakes(spark, sf_dir)
    n = F.col("event_id")
    skip = lambda every, value: F.when(n % every != 0, value)
    first = q.select(
        F.lit("usgs").alias("source_catalog"),
        F.concat(F.lit("us"), n).alias("native_event_id"),
        F.col("t").alias("origin_time"),
        "latitude",
        "longitude",
        "depth_km",
        F.col("m").alias("original_magnitude"),
        "magnitude_type",
        skip(4, (n % 9) / 20.0).alias("magnitude_uncertainty"),
        skip(5, (n % 17) / 2.0).alias("horizontal_uncertainty_km"),
        skip(7, n % 60).alias("n_stations"),
        skip(6, (n * 13 % 360) / 1.0).alias("gap_deg"),
        F.when(n % 3 == 0, "automatic").when(n % 3 == 1, "reviewed").otherwise("unknown").alias("quality_flag"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    second = q.where(n % 3 == 0).select(
        F.lit("isc").alias("source_catalog"),
        F.concat(F.lit("isc:"), n).alias("native_event_id"),
        F.timestamp_micros(F.unix_micros("t") + (n % 90) * 1000000).alias("origin_time"),
        (F.col("latitude") + 0.05).alias("latitude"),
        (F.col("longitude") + 0.05).alias("longitude"),
        "depth_km",
        (F.col("m") + 0.1).alias("original_magnitude"),
        F.lit("mb").alias("magnitude_type"),
        none("double").alias("magnitude_uncertainty"),
        none("double").alias("horizontal_uncertainty_km"),
        none("long").alias("n_stations"),
        none("double").alias("gap_deg"),
        F.when(n % 2 == 0, "reviewed").otherwise("automatic").alias("quality_flag"),
    )
    return first.unionByName(second)


def with_mw(catalog: DataFrame, magnitude: str = "m") -> DataFrame:
    """Adds mw (null where no relation holds), its relation and sigma."""
    d = derive_mw(F.col(magnitude), F.col("magnitude_type"))
    return catalog.withColumn("_d", d).withColumns({"mw": F.col("_d.mw"), "mw_relation": F.col("_d.relation"), "mw_sigma": F.col("_d.sigma")}).drop("_d")


_NULLS = ["", "None", "null"]


def _clean(name: str, kind: str):
    text = F.trim(F.col(name))
    return F.when(~text.isin(_NULLS), text).try_cast(kind)


def read_usgs_csv(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a comma-separated catalog with a header; rows without a magnitude go."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    return raw.select(
        F.lit("usgs").alias("source_catalog"),
        F.col("id").alias("native_event_id"),
        F.try_to_timestamp(F.regexp_replace("time", "Z$", "+00:00")).alias("origin_time"),
        *[_clean(c, "double").alias(to) for c, to in (("latitude", "latitude"), ("longitude", "longitude"), ("depth", "depth_km"), ("mag", "original_magnitude"))],
        F.lower(F.trim("magType")).alias("magnitude_type"),
        _clean("magError", "double").alias("magnitude_uncertainty"),
        _clean("horizontalError", "double").alias("horizontal_uncertainty_km"),
        F.floor(_clean("nst", "double")).alias("n_stations"),
        _clean("gap", "double").alias("gap_deg"),
        quality_flag(F.col("status")).alias("quality_flag"),
    ).where("original_magnitude IS NOT NULL AND origin_time IS NOT NULL")


def read_usgs_geojson(spark: SparkSession, path: str) -> DataFrame:
    schema = "features array<struct<id:string,properties:struct<time:bigint,mag:double,magType:string,nst:bigint,gap:double,status:string>,geometry:struct<coordinates:array<double>>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p, x = F.col("f.properties"), F.col("f.geometry.coordinates")
    return f.select(
        F.lit("usgs").alias("source_catalog"),
        F.col("f.id").alias("native_event_id"),
        F.timestamp_millis(p["time"]).alias("origin_time"),
        F.get(x, 1).alias("latitude"),
        F.get(x, 0).alias("longitude"),
        F.coalesce(F.get(x, 2), F.lit(0.0)).alias("depth_km"),
        p["mag"].alias("original_magnitude"),
        F.lower(F.trim(p["magType"])).alias("magnitude_type"),
        p["nst"].alias("n_stations"),
        p["gap"].alias("gap_deg"),
        quality_flag(p["status"]).alias("quality_flag"),
    ).where("original_magnitude IS NOT NULL")


def read_isc_text(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a bar-separated text; the header, comments and short lines go."""
    parts = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.transform(F.split("value", r"\|"), F.trim).alias("p")).where(F.size("p") >= 12)
    at = lambda k, kind="string": F.get("p", F.lit(k)).try_cast(kind)
    return parts.select(
        F.lit("isc").alias("source_catalog"),
        F.concat(F.lit("isc:"), at(0)).alias("native_event_id"),
        F.try_to_timestamp(at(1)).alias("origin_time"),
        at(2, "double").alias("latitude"),
        at(3, "double").alias("longitude"),
        at(4, "double").alias("depth_km"),
        at(10, "double").alias("original_magnitude"),
        F.lower(at(9)).alias("magnitude_type"),
        F.when(F.lower(at(9)).contains("tmp") | F.lower(at(5)).contains("auto"), "automatic").otherwise("reviewed").alias("quality_flag"),
    ).where("origin_time IS NOT NULL AND original_magnitude BETWEEN -2 AND 10.5")


def all_magnitudes(obs: DataFrame, key: str) -> DataFrame:
    """key, n, magnitudes: all observed magnitudes of an event in order of source and id."""
    one = F.struct("source_catalog", "native_event_id", F.col("original_magnitude").alias("magnitude"), "magnitude_type")
    return obs.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("magnitudes"))


def read_isc_allmags(spark: SparkSession, path: str) -> DataFrame:
    """Every magnitude of each event of a bar-separated text."""
    return all_magnitudes(read_isc_text(spark, path), "native_event_id")


#: The names that a column of the format has, in the order in which they are taken.
ISCGEM_NAMES = {
    "time": ["origin_time", "time", "date_time", "datetime"],
    "mag": ["mw", "m", "magnitude"],
    "type": ["mtype", "magtype", "magnitude_type"],
    "id": ["eventid", "event_id", "iscid"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "longitude"],
    "depth": ["depth", "depth_km"],
    "error": ["msigma", "mag_error", "m_sigma"],
    "axis": ["smaj", "smin", "err_smaj"],
    "depth_error": ["depth_err", "depth_error"],
}


def read_iscgem_csv(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a file with a header in any case; of the names of a column the first that is not empty counts.

    Rows without time, magnitude or place go; a missing depth is 0, a missing type that of the catalog.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    aliases = ISCGEM_NAMES

    def first(name: str):
        found = [F.when(~F.trim(c).isin(_NULLS), F.trim(c)) for c in aliases[name] if c in raw.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    kind = F.lower(first("type"))
    return raw.select(
        F.lit("isc-gem").alias("source_catalog"),
        F.coalesce(first("id"), F.lit("")).alias("native_event_id"),
        F.try_to_timestamp(first("time")).alias("origin_time"),
        first("lat").try_cast("double").alias("latitude"),
        first("lon").try_cast("double").alias("longitude"),
        F.coalesce(first("depth").try_cast("double"), F.lit(0.0)).alias("depth_km"),
        first("mag").try_cast("double").alias("original_magnitude"),
        F.when(kind.isNull() | kind.isin("mw", "iscgem"), "mw_iscgem").otherwise(kind).alias("magnitude_type"),
        first("error").try_cast("double").alias("magnitude_uncertainty"),
        first("axis").try_cast("double").alias("horizontal_uncertainty_km"),
        first("depth_error").try_cast("double").alias("depth_uncertainty_km"),
        F.lit("reviewed").alias("quality_flag"),
    ).where("origin_time IS NOT NULL AND original_magnitude IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")


def read_faults_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Fault traces with their slip and geometry; -999 and below is null."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p = F.col("f.properties")

    def number(key: str):
        x = p[key].try_cast("double")
        return F.when(x > -999, x)

    line = F.from_json("f.geometry.coordinates", "array<array<double>>")
    multi = F.flatten(F.from_json("f.geometry.coordinates", "array<array<array<double>>>"))
    out = f.select(
        p["fault_id"].alias("fault_id"),
        p["fault_name"].alias("fault_name"),
        F.transform(F.when(F.col("f.geometry.type") == "MultiLineString", multi).otherwise(line), lambda x: F.struct(F.get(x, 0).alias("lon"), F.get(x, 1).alias("lat"))).alias("trace"),
        number("average_dip").alias("dip"),
        number("rake").alias("rake"),
        number("slip_rate").alias("slip_rate"),
    )
    kinematic, rate = F.col("dip").isNotNull() & F.col("rake").isNotNull(), F.col("slip_rate").isNotNull()
    return out.withColumn("confidence", F.when(kinematic & rate, "medium").when(kinematic | rate, "low").otherwise("placeholder"))


def read_gcmt_ndk(spark: SparkSession, path: str) -> DataFrame:
    """Moment tensors of five-line blocks of fixed width, with their first nodal plane; the centroid stands where there
    is no hypocentre; the magnitude ends the first line or follows from the scalar moment. Files must not be split inside a block."""
    raw = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    blocks = raw.select(F.posexplode("l").alias("n", "line"), "l").where("n % 5 = 0").select(F.slice("l", F.col("n") + 1, 5).alias("b"))
    line = lambda k: F.get("b", F.lit(k))
    # The columns of the public format.
    number = lambda k, at, n: F.trim(F.substring(line(k), at, n)).try_cast("double")
    power = F.trim(F.substring(line(3), 1, 2)).try_cast("int")
    # The scalar moment is in dyne centimetres.
    moment = number(4, 50, 7) * F.pow(F.lit(10.0), power.cast("double") - 7)
    planes = F.split(F.trim(F.substring(line(4), 57, 60)), r"\s+")
    plane = lambda k: F.get(planes, F.lit(k)).try_cast("double")
    return blocks.select(
        F.lit("gcmt").alias("source_catalog"),
        F.trim(F.substring(line(1), 1, 16)).alias("native_event_id"),
        F.try_to_timestamp(F.concat_ws(" ", F.replace(F.substring(line(0), 6, 10), F.lit("/"), F.lit("-")), F.trim(F.substring(line(0), 17, 10)))).alias("origin_time"),
        F.coalesce(number(0, 28, 6), number(2, 23, 7)).alias("latitude"),
        F.coalesce(number(0, 35, 7), number(2, 35, 8)).alias("longitude"),
        F.coalesce(number(0, 43, 5), number(2, 48, 6)).alias("depth_km"),
        F.coalesce(F.element_at(F.split(F.trim(line(0)), r"\s+"), -1).try_cast("double"), F.round((F.log10(moment) - 9.1) / 1.5, 2)).alias("original_magnitude"),
        moment.alias("moment_nm"),
        plane(0).alias("strike"),
        plane(1).alias("dip"),
        plane(2).alias("rake"),
        F.lit("gcmt").alias("magnitude_type"),
        F.lit("reviewed").alias("quality_flag"),
    ).where("origin_time IS NOT NULL")


def quality_flag(status):
    known = F.lower(F.trim(status))
    return F.when(known.isin("reviewed", "automatic", "deleted", "preliminary"), known).otherwise("unknown")


def write_by_config(results: DataFrame, path: str) -> None:
    """One folder per threshold and horizon."""
    results.write.mode("overwrite").partitionBy("threshold", "horizon").parquet(path)
