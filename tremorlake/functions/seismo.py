"""Magnitudes, kernels, probabilities and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorlake import constants as C


def is_mw_family(kind: Column) -> Column:
    return F.lower(F.trim(kind)).isin(C.MW_FAMILY)


def derive_mw(magnitude: Column, kind: Column) -> Column:
    """Struct (mw, status, relation, sigma): Mw types are kept, others converted inside a relation's range, else null."""
    kind = F.lower(F.trim(kind))
    empty = F.lit(None).cast("struct<mw:double,status:string,relation:string,sigma:double>")
    out = empty
    for name, of, slope, intercept, sigma, low, high in sorted(C.MAG_RELATIONS, key=lambda r: -r[5]):
        fits = (kind == of) & magnitude.between(low, high)
        made = F.struct((slope * magnitude + intercept).alias("mw"), F.lit("converted").alias("status"), F.lit(name).alias("relation"), F.lit(sigma).alias("sigma"))
        out = F.when(fits, made).otherwise(out)
    kept = F.struct(magnitude.alias("mw"), F.lit("authoritative").alias("status"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("sigma"))
    return F.when(is_mw_family(kind), kept).otherwise(out)


def missing_mw_reason(magnitude: Column, kind: Column) -> Column:
    """Class of reason why a magnitude has no Mw: available, out_of_range, no_relation or unrecognised."""
    kind = F.lower(F.trim(kind))
    return (
        F.when(derive_mw(magnitude, kind)["mw"].isNotNull(), "available")
        .when(kind.isin(sorted({r[1] for r in C.MAG_RELATIONS})), "out_of_range")
        .when(kind.isin("ml", "md"), "no_relation")
        .otherwise("unrecognised")
    )


def quadrature(a: Column, b: Column) -> Column:
    """sqrt(a^2 + b^2); one null counts as nothing, two give null."""
    zero = F.lit(0.0)
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.sqrt(F.pow(F.coalesce(a, zero), 2) + F.pow(F.coalesce(b, zero), 2)))


def p_at_least_one(rate: Column, years: Column | float) -> Column:
    return 1.0 - F.exp(-rate * years)


def omori_kernel(days: Column, c: float, p: float) -> Column:
    return F.when(days >= 0, (p - 1) * c ** (p - 1) * F.pow(days + c, F.lit(-p))).otherwise(0.0)


def omori_integral(a: Column, b: Column, c: float, p: float) -> Column:
    """Share of aftershocks between lags a and b (p > 1)."""
    low, high = F.greatest(a, F.lit(0.0)), F.greatest(b, F.lit(0.0))
    return F.when(high > low, c ** (p - 1) * (F.pow(low + c, F.lit(1 - p)) - F.pow(high + c, F.lit(1 - p)))).otherwise(0.0)


def exponential_kernel(days: Column, tau: float) -> Column:
    return F.when(days >= 0, F.exp(-days / tau) / tau).otherwise(0.0)


def productivity(m: Column, k: float, alpha: float, mc: float, base: float = 10.0) -> Column:
    return k * F.pow(F.lit(base), alpha * (m - mc))


def power_law_kernel(r: Column, sigma: Column | float, q: float, kernel: str = "reference") -> Column:
    """Density at distance r. ``reference`` keeps the literal factor q - 1, which is zero at q = 1; ``normalised``
    integrates to 1; ``half`` has the exponent -(1 + q) / 2 and integrates to 1 for q > 1."""
    s2 = sigma * sigma
    if kernel == "half":
        return (q - 1) / 2 / (3.141592653589793 * s2) * F.pow(1 + r * r / s2, F.lit(-(1 + q) / 2))
    factor = (q - 1 if kernel == "reference" else q) / (3.141592653589793 * s2)
    return factor * F.pow(1 + r * r / s2, F.lit(-(1 + q)))


def magnitude_length(m: Column, gamma: Column | float, mc: float) -> Column:
    """How much an event's kernel is widened by its magnitude."""
    return F.exp(gamma * (m - mc))


def depth_spread_km(depth: Column) -> Column:
    """Width of a depth group's vertical kernel."""
    # Fixed values by depth group.
    return F.when(depth < 25, 8.0).when(depth < 70, 15.0).otherwise(30.0)


def gaussian_kernel(r: Column, sigma: Column | float) -> Column:
    return F.exp(-r * r / (2 * sigma * sigma)) / (2 * 3.141592653589793 * sigma * sigma)


def epanechnikov_kernel(r: Column, h: Column | float) -> Column:
    u = r / h
    return F.when(u <= 1, 2 / (3.141592653589793 * h * h) * (1 - u * u)).otherwise(0.0)


def stress_rate_factor(dcfs_pa: Column, form: str = "rate_and_state", a_sigma_mpa: float = 0.05, beta: float = 2.0, up: float = 1.0, down: float = 0.5) -> Column:
    mpa = dcfs_pa / 1e6
    forms = {
        "rate_and_state": F.exp(F.least(mpa / a_sigma_mpa, F.lit(700.0))),
        "exponential": F.exp(F.least(beta * mpa, F.lit(700.0))),
        "step": F.when(mpa > 0, 1.0 + up).otherwise(1.0 - down),
    }
    return F.least(F.greatest(forms[form], F.lit(0.01)), F.lit(100.0))


def moment_nm(mw: Column) -> Column:
    return F.pow(F.lit(10.0), 1.5 * mw + 9.1)


def moment_from_slip(mw: Column, area_km2: Column, slip_m: Column, rigidity_pa: float = 3.0e10) -> Column:
    """Rigidity times area times slip where both are given, else the moment of the magnitude."""
    return F.coalesce(rigidity_pa * area_km2 * 1e6 * slip_m, moment_nm(mw))


def gk_radius_km(m: Column) -> Column:
    return (0.1238 * m + 0.983) * 111.0


def gk_days(m: Column) -> Column:
    return F.pow(F.lit(10.0), 0.5 * m - 0.052)


def rupture_length_km(m: Column) -> Column:
    return F.when(m < 4, 1.0).otherwise(F.greatest(F.pow(F.lit(10.0), -3.22 + 0.69 * m), F.lit(1.0)))


def depth_group(depth: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in C.DEPTH_GROUPS:
        out = F.when((depth >= low) & (depth < high), name).otherwise(out)
    return out


def count_category(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").otherwise(">=20")


def branching_label(ratio: Column) -> Column:
    """Class of a branching ratio: from 1 on every event begins an endless cascade."""
    return F.when(ratio >= 1, "explosive").when(ratio >= 0.5, "high").when(ratio >= 0.2, "moderate").when(ratio >= 0, "low")


def evidence_level(n_forecasts: Column, n_evaluated: Column) -> Column:
    out = F.lit(0)
    for level, forecasts, evaluated in C.EVIDENCE_LEVELS:
        out = F.when((n_forecasts >= forecasts) & (n_evaluated >= evaluated), level).otherwise(out)
    return out


def magnitude_bin(m: Column, per_unit: int = 10) -> Column:
    """Integer bin; the nudge keeps 4.3 stored as 4.2999 in its own bin."""
    return F.floor(m * per_unit + 1e-9).cast("int")


def lcg(replicate: Column, i: Column, n: Column | int, seed: int = 42) -> Column:
    """A number from 0 to n - 1 that every SQL engine draws alike, for bootstrap replicates."""
    x = F.pmod(replicate.cast("long") * 1103515 + i.cast("long") * 12345 + seed, F.lit(2147483647))
    return F.pmod(F.pmod(x * 48271, F.lit(2147483647)), n if isinstance(n, Column) else F.lit(n))
