"""Values that can be worked out by hand, and properties of kernels and probabilities."""

import math

import pytest
from pyspark.sql import functions as F

from tremorlake.functions import geo, seismo
from tremorlake.functions.quantiles import garwood, jeffreys, negative_binomial_quantile


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_exact_intervals():
    assert garwood(3) == pytest.approx((0.618672, 8.767273), abs=1e-5)
    assert jeffreys(0) == pytest.approx((0.000491, 2.511943), abs=1e-5)
    assert garwood(0)[0] == 0 and garwood(0)[1] == pytest.approx(-math.log(0.05), abs=1e-6)


def test_negative_binomial_quantile_matches_geometric():
    # Shape 1 is geometric: P(N <= k) = 1 - (1 - p)^(k + 1).
    assert negative_binomial_quantile(1.0, 0.25, 0.9) == math.ceil(math.log(0.1) / math.log(0.75) - 1)


def test_probability_of_an_event(spark):
    assert value(spark, seismo.p_at_least_one(F.lit(37.52449), 7 / 365.25)) == pytest.approx(0.512836, abs=1e-5)
    assert value(spark, seismo.p_at_least_one(F.lit(37.52449), 30 / 365.25)) == pytest.approx(0.954137, abs=1e-5)


@pytest.mark.parametrize(("m", "kind", "mw"), [(5.0, "mb", 5.28), (6.0, "ms", 6.09), (7.0, "ms", 7.13), (6.3, "mb", None), (5.0, "ml", None), (5.5, "MWW ", 5.5)])
def test_magnitude_conversion(spark, m, kind, mw):
    got = value(spark, seismo.derive_mw(F.lit(m), F.lit(kind))["mw"])
    assert got is None if mw is None else got == pytest.approx(mw)


def test_omori_integral_is_additive_and_complete(spark):
    g = lambda a, b: value(spark, seismo.omori_integral(F.lit(a), F.lit(b), 0.01, 1.3))
    assert g(0.0, 2.0) + g(2.0, 9.0) == pytest.approx(g(0.0, 9.0))
    assert g(0.0, 1e12) == pytest.approx(1.0, abs=1e-3)
    assert g(3.0, 2.0) == 0


def test_kernel_of_the_reference_is_zero_at_one(spark):
    assert value(spark, seismo.power_law_kernel(F.lit(5.0), 20.0, 1.0)) == 0
    assert value(spark, seismo.power_law_kernel(F.lit(5.0), 20.0, 1.0, "normalised")) > 0


def test_distances_agree_nearby(spark):
    a = [F.lit(x) for x in (24.0, 91.0, 24.3, 91.4)]
    h, e, k = (value(spark, f(*a)) for f in (geo.haversine_km, geo.equirect_km, geo.local_km))
    assert e == pytest.approx(h, rel=1e-4) and k == pytest.approx(h, rel=1e-2)


@pytest.mark.parametrize(("x", "drop", "clamp", "halfopen"), [(20.0, 0, 0, 0), (27.99, 7, 7, 7), (28.0, 7, 7, None), (28.1, None, 7, None), (19.9, None, 0, None)])
def test_cell_edges(spark, x, drop, clamp, halfopen):
    got = [value(spark, geo.cell_axis(F.lit(x), 20.0, 28.0, 1.0, rule)) for rule in ("drop", "clamp", "halfopen")]
    assert got == [drop, clamp, halfopen]


def test_rate_factors_are_clamped(spark):
    assert value(spark, seismo.stress_rate_factor(F.lit(1e9))) == 100.0
    assert value(spark, seismo.stress_rate_factor(F.lit(-1e9))) == 0.01
    assert value(spark, seismo.stress_rate_factor(F.lit(0.0), "exponential")) == 1.0


def test_negative_binomial_quantiles_of_any_size():
    def plain(r, p, q):
        k = total = 0
        log = r * math.log(p)
        while True:
            total += math.exp(log)
            if total >= q:
                return k
            k += 1
            log += math.log((r + k - 1) / k) + math.log1p(-p)

    for r, p in ((0.5, 0.3), (3.0, 0.01), (12.5, 0.5), (2000.0, 0.5), (150.0, 0.0015), (5000.0, 0.9)):
        for q in (0.0, 0.025, 0.5, 0.975):
            assert negative_binomial_quantile(r, p, q) == plain(r, p, q)
    assert negative_binomial_quantile(2000, 0.5, 0.5) == 1999
    # A mean of a million, and shapes whose probability of none is no longer a number.
    assert negative_binomial_quantile(2e3, 2e3 / (1e6 + 2e3), 0.5) == pytest.approx(1e6, rel=1e-3)
    assert negative_binomial_quantile(1e6, 0.5, 0.5) == pytest.approx(1e6, abs=2)
    assert negative_binomial_quantile(0, 0.5, 0.9) == negative_binomial_quantile(4, 1.0, 0.9) == 0
