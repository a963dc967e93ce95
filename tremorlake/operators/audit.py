"""Catalog audits: ranges, facets, magnitude floors, provenance, mechanisms, faults and comparisons of catalogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake import constants as C
from tremorlake.functions.seismo import derive_mw, magnitude_bin, missing_mw_reason

# Allowed ranges, both ends included.
RANGES = {"latitude": (-90.0, 90.0), "longitude": (-180.0, 180.0), "depth_km": (0.0, 800.0), "m": (-2.0, 10.5), "strike": (0.0, 360.0), "dip": (0.0, 90.0), "rake": (-180.0, 180.0)}
# Preference among agencies' mechanisms, lower first.
MECHANISM_RANK = {"gcmt": 0, "usgs": 1, "isc-gem": 2, "isc": 3}


def _facet(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(value.cast("string"), F.lit("none")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")


def facets(obs: DataFrame) -> DataFrame:
    """facet, value, n of observations: by source, magnitude type, quality, year, 0.1 magnitude bin, reason of a missing Mw."""
    m = F.col("original_magnitude")
    parts = {"source": F.col("source_catalog"), "magnitude_type": F.col("magnitude_type"), "quality": F.col("quality_flag"), "year": F.year("origin_time"), "magnitude_bin": magnitude_bin(m), "mw": missing_mw_reason(m, F.col("magnitude_type"))}
    return reduce(DataFrame.unionByName, [_facet(obs, name, value) for name, value in parts.items()])


def quality_summary(obs: DataFrame) -> DataFrame:
    """One row: observations, ranges, mean and median depth, shares with an Mw and reviewed."""
    m, depth = F.col("original_magnitude"), F.col("depth_km")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return obs.agg(
        F.count("*").alias("n"),
        F.min("origin_time").alias("first_time"),
        F.max("origin_time").alias("last_time"),
        F.min(m).alias("min_m"),
        F.max(m).alias("max_m"),
        F.round(F.avg(depth), 6).alias("mean_depth"),
        F.round(F.percentile(depth, F.lit(0.5)), 6).alias("median_depth"),
        share(derive_mw(m, F.col("magnitude_type"))["mw"].isNotNull()).alias("mw_share"),
        share(F.col("quality_flag") == "reviewed").alias("reviewed_share"),
    )


def range_faults(rows: DataFrame, ranges: dict[str, tuple[float, float]] = RANGES) -> DataFrame:
    """Adds ``faults``: names of the columns of ``rows`` whose value is out of its range, sorted; null values are none."""
    checks = [F.when(~F.col(c).between(low, high) | F.isnan(F.col(c).cast("double")), c) for c, (low, high) in sorted(ranges.items()) if c in rows.columns]
    return rows.withColumn("faults", F.array_compact(F.array(*checks)).cast("array<string>"))


def magnitude_floor(events: DataFrame, column: str = "m") -> DataFrame:
    """One row: events, those below 4, 3.5, 3 and 2.5, smallest and largest magnitude, fullest 0.1 bin (half-even rounding)."""
    m = F.col(column)
    bins = events.groupBy(F.bround(m * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    top = bins.agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("x")).select((-F.col("x.b") / 10).alias("fullest_bin"), F.col("x.n").alias("n_fullest"))
    below = {f"n_below_{name}": F.count_if(m < x) for name, x in (("40", 4.0), ("35", 3.5), ("30", 3.0), ("25", 2.5))}
    one = events.agg(F.count("*").alias("n"), F.min(m).alias("min_m"), F.max(m).alias("max_m"), *[c.alias(n) for n, c in below.items()])
    return one.join(F.broadcast(top))


def compared(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two tables side by side: key, value of either (null where it lacks the key), difference."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    return left.join(right, key, "full").select(key, "a", "b", (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("difference"))


def best_mechanisms(mechanisms: DataFrame) -> DataFrame:
    """One row per event_id: the mechanism of the preferred agency, then of the smallest observation id."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in MECHANISM_RANK.items() for x in p])[F.col("source_catalog")], F.lit(len(MECHANISM_RANK)))
    best = F.min_by(F.struct("source_catalog", "native_event_id", "strike", "dip", "rake"), F.struct(rank, "native_event_id"))
    return mechanisms.where("strike IS NOT NULL AND dip IS NOT NULL AND rake IS NOT NULL").groupBy("event_id").agg(best.alias("b")).select("event_id", "b.*")


def fault_uses(faults: DataFrame) -> DataFrame:
    """Adds for_coulomb (a dip and no placeholder) and for_hazard (a slip rate or recurrence and no placeholder)."""
    real = F.col("confidence") != "placeholder"
    rate = F.col("slip_rate").isNotNull() | F.col("recurrence_years").isNotNull()
    return faults.withColumns({"for_coulomb": real & F.col("dip").isNotNull(), "for_hazard": real & rate})


def require_for_coulomb(faults: DataFrame) -> DataFrame:
    """``faults``, whose rows fail the query where one is not fit for stress calculation."""
    fit = fault_uses(faults)
    message = F.concat(F.lit("fault without usable geometry: "), F.coalesce(F.col("fault_id").cast("string"), F.lit("none")))
    # The check is part of a column that is returned, so no plan leaves it out.
    return fit.withColumn("fault_id", F.when(F.col("for_coulomb"), F.col("fault_id")).otherwise(F.raise_error(message).cast(faults.schema["fault_id"].dataType))).select(*faults.columns)


def near_region(faults: DataFrame) -> DataFrame:
    """Faults of which any vertex of the trace lies in the region."""
    inside = F.exists("trace", lambda v: v["lat"].between(C.MIN_LAT, C.MAX_LAT) & v["lon"].between(C.MIN_LON, C.MAX_LON))
    return faults.where(inside)


def provenance(canonical: DataFrame) -> DataFrame:
    """Adds ``steps``: what was done to make each canonical event, the match first."""
    step = lambda name, detail: F.struct(F.lit(name).alias("step"), detail.cast("string").alias("detail"))
    steps = F.array(
        step("origin", F.col("origin_from")),
        step("magnitude", F.col("magnitude_from")),
    )
    converted = derive_mw(F.col("original_magnitude"), F.col("magnitude_type"))
    relation = F.when(converted["relation"].isNotNull(), F.array(step("convert", converted["relation"]))).otherwise(F.array().cast("array<struct<step:string,detail:string>>"))
    whole = F.concat(steps, relation)
    return canonical.withColumn("steps", F.array_prepend(whole, step("match", F.concat(F.col("n_observations").cast("string"), F.lit(" observations")))))


def missing_mw_text(magnitude: Column, kind: Column) -> Column:
    """Why a magnitude has no Mw, as a sentence; null where it has one."""
    reason = missing_mw_reason(magnitude, kind)
    spans = {of: ", ".join(f"{low} to {high}" for _, k, _, _, _, low, high in C.MAG_RELATIONS if k == of) for of in sorted({r[1] for r in C.MAG_RELATIONS})}
    span = F.create_map(*[F.lit(x) for p in spans.items() for x in p])[F.lower(F.trim(kind))]
    return (
        F.when(reason == "out_of_range", F.format_string("%s %.4f is outside %s", F.lower(F.trim(kind)), magnitude, span))
        .when(reason == "no_relation", F.format_string("no relation for %s", F.lower(F.trim(kind))))
        .when(reason == "unrecognised", F.lit("unrecognised magnitude type"))
    )


def event_kind(text: Column) -> Column:
    known = F.lower(F.trim(text))
    return F.when(known.isin("earthquake", "explosion", "quarry blast", "ice quake"), known).otherwise("unknown")


def flattened(frame: DataFrame, separator: str = "_") -> DataFrame:
    """Struct fields as columns named by their path, at any depth; arrays and maps as JSON."""

    def leaves(schema, at: Column | None, prefix: str) -> list[Column]:
        out = []
        for f in schema.fields:
            column = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            kind = f.dataType.typeName()
            if kind == "struct":
                out += leaves(f.dataType, column, f"{prefix}{f.name}{separator}")
            else:
                out.append((F.to_json(column) if kind in ("array", "map") else column).alias(f"{prefix}{f.name}"))
        return out

    return frame.select(*leaves(frame.schema, None, ""))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns: all columns in order of name, null where a table lacks one."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*sorted(rows.columns))


def sampled(rows: DataFrame, key: str, by: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group, in an order by hash that every engine draws alike. ``key``: a unique number."""
    from pyspark.sql import Window

    from tremorlake.functions.seismo import lcg

    mark = lcg(F.lit(0), F.col(key), 2147483647, seed)
    # Each group is cut per bucket of keys first, so that no task ranks a whole group.
    near = rows.withColumns({"_mark": mark, "_part": F.pmod(F.xxhash64(key), F.lit(64))})
    few = near.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_mark", key))).where(F.col("_k") <= n)
    return few.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("_mark", key))).where(F.col("_k") <= n).drop("_mark", "_part", "_k")
