"""Static stress: rate factors by class of stress change, and point-source stress changes in a half space."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.seismo import moment_nm, stress_rate_factor

Vector = list[Column]


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _slip_and_normal(strike: Column, dip: Column, rake: Column) -> tuple[Vector, Vector]:
    """Slip direction and fault normal in east, north, up; rake turns from strike towards down-dip."""
    s, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    along = [F.sin(s), F.cos(s), F.lit(0.0)]
    down = [F.cos(s) * F.cos(d), -F.sin(s) * F.cos(d), -F.sin(d)]
    slip = [F.cos(r) * a + F.sin(r) * b for a, b in zip(along, down, strict=True)]
    return slip, [-F.cos(s) * F.sin(d), F.sin(s) * F.sin(d), -F.cos(d)]


def point_source_dcfs(sources: DataFrame, receivers: DataFrame, friction: float = 0.4, poisson: float = 0.25) -> DataFrame:
    """receiver_id, dcfs_pa: summed stress change at receivers (a bounded grid) from double couples and their images.

    ``sources``: latitude, longitude, depth_km, mw, strike, dip, rake; ``receivers``: receiver_id, r_lat, r_lon,
    r_depth_km, r_strike, r_dip, r_rake. A pair less than a metre apart and a source or receiver without a mechanism
    give null, which the sum leaves out.
    """
    met = sources.join(F.broadcast(receivers))
    east = (F.col("r_lon") - F.col("longitude")) * 111320.0 * F.cos(F.radians("latitude"))
    north = (F.col("r_lat") - F.col("latitude")) * 111320.0
    up = (F.col("depth_km") - F.col("r_depth_km")) * 1000.0
    u, v = _slip_and_normal(F.col("strike"), F.col("dip"), F.col("rake"))
    rs, rn = _slip_and_normal(F.col("r_strike"), F.col("r_dip"), F.col("r_rake"))
    named = {f"{n}{k}": x for n, vector in (("u", u), ("v", v), ("s", rs), ("n", rn)) for k, x in enumerate(vector)}
    met = met.withColumns(named | {"x": east, "y": north, "z": up, "image_z": up + 2000.0 * F.col("depth_km")})
    u, v, rs, rn = ([F.col(f"{n}{k}") for k in range(3)] for n in "uvsn")

    def resolved(z: Column, a: Vector, b: Vector) -> Column:
        """a . stress . b of a unit moment at the place (x, y, z) of the receiver."""
        r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + z**2)
        g = [F.col("x") / r, F.col("y") / r, z / r]
        gu, gv = _dot(g, u), _dot(g, v)
        mg = [x * gv + y * gu for x, y in zip(u, v, strict=True)]
        couple = _dot(u, a) * _dot(v, b) + _dot(v, a) * _dot(u, b)
        terms = 3 * (_dot(g, a) * _dot(mg, b) + _dot(mg, a) * _dot(g, b)) - couple - 30 * gu * gv * _dot(g, a) * _dot(g, b)
        return F.when(r > 1.0, terms / (8 * math.pi * (1 - poisson) * r)).otherwise(0.0)

    both = lambda a: resolved(F.col("z"), a, rn) + resolved(F.col("image_z"), a, rn)
    apart = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) >= 1.0
    change = moment_nm(F.col("mw")) * (both(rs) + friction * both(rn))
    return met.select("receiver_id", F.when(apart, change).alias("c")).groupBy("receiver_id").agg(F.sum("c").alias("dcfs_pa"))


def modulated_forecast(rates: DataFrame, stress: DataFrame, years: float, form: str = "rate_and_state") -> DataFrame:
    """Receivers' background rate (0 where none) times the factor of their stress change, as P of at least one event."""
    factor = stress_rate_factor(F.coalesce("dcfs_pa", F.lit(0.0)), form)
    joined = stress.join(rates, "receiver_id", "left").withColumns({"rate": F.coalesce("rate", F.lit(0.0)), "factor": factor})
    return joined.withColumn("p", 1 - F.exp(-F.col("rate") * F.col("factor") * years))


def rate_by_stress(cells: DataFrame, low: float, high: float, bins: int = 10) -> DataFrame:
    """bin, n_cells, n_events, ratio of a bin's events per cell to the overall ones; ``cells``: dcfs_pa, n."""
    width = (high - low) / bins
    k = F.least(F.greatest(F.floor((F.col("dcfs_pa") - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    total = cells.agg((F.sum("n") / F.count("*")).alias("base"))
    per = cells.groupBy(k.alias("bin")).agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_events"))
    return per.join(F.broadcast(total)).select("bin", "n_cells", "n_events", F.round(F.col("n_events") / F.col("n_cells") / F.col("base"), 6).alias("ratio"))


def sources(events: DataFrame, mechanisms: DataFrame, least_m: float) -> DataFrame:
    """Events from ``least_m`` on that have a mechanism: event_id, place, mw, strike, dip, rake."""
    big = events.where(F.col("m") >= least_m).select("event_id", "latitude", "longitude", "depth_km", F.col("m").alias("mw"))
    return big.join(mechanisms.select("event_id", "strike", "dip", "rake"), "event_id")


def receivers(cells: DataFrame, depth_km: float | Column, strike: float, dip: float, rake: float) -> DataFrame:
    """Receivers of one mechanism at the cells' centres, at one depth or at a column of ``cells``."""
    fixed = {"r_depth_km": depth_km, "r_strike": strike, "r_dip": dip, "r_rake": rake}
    return cells.select(F.col("cell_id").alias("receiver_id"), F.col("lat_center").alias("r_lat"), F.col("lon_center").alias("r_lon"), *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fixed.items()])


def audit(rows: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """field, needed, n, n_present, class, blocking: A where all rows have the field, B half or more, C some, D none.
    A needed field of class C or D blocks a stress forecast."""
    counts = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"k_{c}") for c in fields])
    each = counts.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(needed).alias("needed"), F.col(f"k_{c}").alias("n_present")) for c, needed in fields.items()])))
    share = F.col("n_present") / F.col("n")
    grade = F.when(share == 1, "A").when(share >= 0.5, "B").when(F.col("n_present") > 0, "C").otherwise("D")
    return each.select("field", "needed", "n", "n_present", grade.alias("class"), (F.col("needed") & grade.isin("C", "D")).alias("blocking"))


def disabled(spark) -> DataFrame:
    """The forecast of a disabled model: no rows, with a column for the note."""
    return spark.createDataFrame([], "receiver_id string, factor double, rate double, p double, note string")
