"""Joins by counts, kernel sums, ledger faults, sinks, verdicts and models, on small tables against brute force."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake import all_queries
from tremorlake.functions.quantiles import gamma_cdf, gamma_quantile
from tremorlake.operators import audit, candidates, completeness, etas, etas_blocks, features, inference, intervals, joins, metrics, models, rings, verdicts
from tremorlake.plans import ledger
from tremorlake.sources import catalog, sinks

START = datetime(2000, 1, 1)


def events(spark, n=300, seed=3, days=900.0):
    r = np.random.default_rng(seed)
    rows = [(i, START + timedelta(days=float(r.uniform(0, days))), float(r.uniform(20, 28)), float(r.uniform(88, 96)), float(r.uniform(0, 100)), round(float(3.5 + r.exponential(0.7)), 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double")


@pytest.mark.parametrize("inclusive", [False, True])
def test_counted_before(spark, inclusive):
    rows, frame = events(spark, 80)
    probes = [(k, round((rows[k][1] - datetime(1970, 1, 1)).total_seconds() * 1e6)) for k in range(0, 80, 3)] + [(900, 0), (901, 4 * 10**15)]
    got = {r["k"]: r["n_before"] for r in joins.counted_before(spark.createDataFrame(probes, "k long, at long"), frame, "at", "t", inclusive).collect()}
    us = sorted(r[0] for r in frame.select(F.unix_micros("t")).collect())
    at = {k: (us_of if k >= 900 else None) for k, us_of in probes}
    stored = {r["event_id"]: r["u"] for r in frame.select("event_id", F.unix_micros("t").alias("u")).collect()}
    for k, probe in probes:
        want = sum(x <= probe if inclusive else x < probe for x in us)
        assert got[k] == want
    assert at and stored


@pytest.mark.parametrize("limit", [365.0, None])
def test_kernel_sums_equal_all_pairs(spark, limit):
    rows, frame = events(spark)
    kernels = spark.createDataFrame([(0, 0.8, 0.01, 1.1), (1, 0.5, 0.05, 0.3)], "kernel int, alpha double, c double, q double")
    got = {(r["kernel"], r["event_id"]): r["s"] for r in etas.kernel_sums(frame, kernels, 3.5, limit).collect()}
    for kernel, alpha, c, q in ((0, 0.8, 0.01, 1.1), (1, 0.5, 0.05, 0.3)):
        for b in rows:
            lags = [((b[1] - a[1]).total_seconds() / 86400, a[5]) for a in rows if a[1] < b[1]]
            want = sum(10 ** (alpha * (m - 3.5)) * (lag + c) ** -q for lag, m in lags if limit is None or lag <= limit)
            assert got.get((kernel, b[0]), 0.0) == pytest.approx(want, rel=1e-7, abs=1e-12)


@pytest.mark.parametrize("limit", [20.0, None])
def test_kernel_sums_of_bursts_and_their_slopes(spark, limit):
    """Bursts a thousand times denser than the rest, events at one instant, times before the epoch."""
    r = np.random.default_rng(9)
    days = np.concatenate([r.uniform(-300, 300, 150), 5 + r.exponential(0.02, 200), -200 + r.exponential(0.001, 80), [7.0, 7.0, 7.0]])
    rows = [(k, datetime(1970, 1, 1) + timedelta(days=float(d)), float(round(3.5 + r.exponential(0.5), 2))) for k, d in enumerate(days)]
    frame = spark.createDataFrame(rows, "event_id long, t timestamp, m double")
    kernel = (0.9, 0.003, 1.2)
    got = {x["event_id"]: x for x in etas.kernel_sums(frame, spark.createDataFrame([(0, *kernel)], "kernel int, alpha double, c double, q double"), 3.5, limit, slopes=True).collect()}

    def plain(alpha, c, q):
        out = {}
        for b in rows:
            lags = [((b[1] - a[1]).total_seconds() / 86400, a[2]) for a in rows if a[1] < b[1]]
            out[b[0]] = sum(10 ** (alpha * (m - 3.5)) * (lag + c) ** -q for lag, m in lags if limit is None or lag <= limit)
        return out

    want = plain(*kernel)
    for name, d, h in (("s_alpha", 0, 1e-5), ("s_c", 1, 1e-7), ("s_q", 2, 1e-5)):
        up, down = (plain(*[v + sign * h * (k == d) for k, v in enumerate(kernel)]) for sign in (1, -1))
        for i in want:
            assert (got[i]["s"] if i in got else 0.0) == pytest.approx(want[i], rel=1e-8, abs=1e-12)
            assert (got[i][name] if i in got else 0.0) == pytest.approx((up[i] - down[i]) / (2 * h), rel=2e-5, abs=1e-6)


def test_kernel_sums_meet_few_rows_however_dense(spark):
    """Pairs for each event stay, and buckets grow by a level's for each doubling, at ten times the density."""
    met = []
    for n in (2000, 20_000):
        frame = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros((F.col("id") * (365 * 4 * 86400000000 // n)).cast("long")).alias("t"), F.lit(4.0).alias("m"))
        width = etas.DAY_US * 365 // (etas.WIDEST << etas.HALVINGS) + 1
        lowest = etas._levels(frame, width)
        shared = n * (width << lowest) / (365 * 4 * etas.DAY_US)
        met.append((shared * (etas.APART + 2), (etas.APART + 1) * (etas.HALVINGS - lowest + 1)))
    assert max(p for p, _ in met) <= 2 * etas.SHARED * (etas.APART + 2) and met[1][1] - met[0][1] <= 4 * (etas.APART + 1)


@pytest.mark.parametrize("many", [20, 10**9])
def test_ring_counts_equal_all_pairs(spark, monkeypatch, many):
    """Whether cells are opened to the last level, now and then, or never; across the date line and before the epoch."""
    monkeypatch.setattr(rings, "MANY", many)
    r = np.random.default_rng(13)
    at = lambda n: [(datetime(1970, 1, 1) + timedelta(hours=float(r.uniform(-4000, 4000))), float(r.uniform(-14, -4)), float((r.uniform(172, 190) + 180) % 360 - 180)) for _ in range(n)]
    first, later = at(40), at(400)
    later += first[:10] + [(first[0][0] + timedelta(days=20), *first[0][1:])]
    edges = [1.0, 20.0, 60.0, 150.0, 400.0, 800.0]
    frame = lambda rows: spark.createDataFrame(rows, "t timestamp, latitude double, longitude double")
    got = {x["bin"]: x["n"] for x in rings.ring_counts(frame(first), frame(later), 20.0, edges).collect()}
    want: dict = {}
    for a in first:
        for b in later:
            la, lo, lb, lp = np.radians([a[1], a[2], b[1], b[2]])
            d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2))
            k = int(np.searchsorted(edges, d, "right")) - 1
            if 0 < (b[0] - a[0]).total_seconds() <= 20 * 86400 and 0 <= k < 5:
                want[k] = want.get(k, 0) + 1
    assert got == want and len(want) >= 4
    assert rings.ring_counts(frame(first).where("FALSE"), frame(later), 20.0, edges).count() == 0


def test_gamma_law_of_large_shapes(spark):
    """Against sums of the Poisson law in forty digits: logarithms of a large gamma function leave ten of them."""
    from decimal import Decimal as D, localcontext

    with localcontext() as c:
        c.prec = 40
        for a, x in ((80166, 80721.88292652208), (801660, 799906.0844220072)):
            z, x_ = D(a + 1), D(x)
            lg = (z - D("0.5")) * z.ln() - z + (2 * D("3.14159265358979323846264338327950288")).ln() / 2 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
            term, total, k = (a * x_.ln() - x_ - lg).exp(), D(0), a
            while term > D("1e-25"):
                total, k = total + term, k + 1
                term = term * x_ / k
            assert gamma_cdf(float(a), x) == pytest.approx(float(total), abs=1e-13)


@pytest.mark.parametrize(("many", "low"), [(20, 0.0), (20, 5.0)])
def test_pair_distances_equal_all_pairs(spark, monkeypatch, many, low):
    """Each pair once: repeated places, one far place, unknown places; no table is broadcast whole."""
    monkeypatch.setattr(rings, "MANY", many)
    r = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(20 + 8 * r.uniform(0, 1, 120) ** 2, 88 + 8 * r.uniform(0, 1, 120) ** 2))]
    rows += [(1000 + i, *rows[i % 7][1:]) for i in range(40)] + [(2000, -80.0, -170.0), (2001, None, 90.0), (2002, float("nan"), 90.0)]
    edges = [low, 10.0, 25.0, 50.0, 100.0, 200.0, 500.0]
    frame = spark.createDataFrame(rows, "event_id long, latitude double, longitude double")
    got = {x["bin"]: x["n"] for x in rings.pair_distances(frame, edges).collect()}
    want: dict = {}
    for k, a in enumerate(rows):
        for b in rows[:k]:
            known = all(x is not None and x == x for x in (a[1], b[1]))
            la, lo, lb, lp = np.radians([a[1], a[2], b[1], b[2]]) if known else (np.nan,) * 4
            d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2))
            ring = int(np.searchsorted(edges, d, "right")) - 1 if known else -1
            want[ring if 0 <= ring < 6 else None] = want.get(ring if 0 <= ring < 6 else None, 0) + 1
    assert got == want and len(want) == 7
    assert rings.pair_distances(frame.where("FALSE"), edges).count() == 0
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 10)
    assert rings.pair_distances(frame, edges).count() == 7


def test_nearest_bandwidths(spark):
    """Dense and sparse parts, repeated places, centres far from all events, fewer events than asked for."""
    r = np.random.default_rng(15)
    places = [(float(a), float(b)) for a, b in np.concatenate([r.uniform([20, 88], [28, 96], (150, 2)), r.normal([24.3, 91.7], 0.003, (300, 2))])] + [(26.5, 93.5)] * 12
    frame = spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "event_id long, latitude double, longitude double")
    cells = joins.grid(spark).unionByName(spark.createDataFrame([(99, 99, "far", -70.0, -179.0)], joins.grid(spark).schema))
    for k in (1, 5, 40, 600):
        got = {x["cell_id"]: x["bandwidth"] for x in etas.nearest_bandwidths(frame, cells, k).collect()}
        want = {}
        for c in cells.collect():
            d = sorted(np.hypot((c["lon_center"] - lon) * np.cos(np.radians(24.0)), c["lat_center"] - lat) for lat, lon in places)
            if len(d) >= k:
                want[c["cell_id"]] = pytest.approx(max(d[k - 1], 1e-3), rel=1e-9)
        assert got == want


def test_weights_of_replicates(spark):
    """Poisson weights of mean and variance 1 that neither rows nor replicates share, the same in SQL."""
    import duckdb

    w = inference.weights(np.arange(4000), 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    sums = w.sum(0)
    assert 0.7 < sums.var() / 4000 < 1.3 and np.abs(np.corrcoef(w.T)[np.triu_indices(200, 1)]).mean() < 0.02
    found = duckdb.sql(f"SELECT k, r, {inference.weights_sql('r', 'k')} AS w FROM range(50) a(k), range(40) b(r) ORDER BY k, r").fetchall()
    assert [x[2] for x in found] == w[:50, :40].ravel().tolist()
    rows = spark.createDataFrame([(k, float(k % 7)) for k in range(4000)], "id long, v double").repartition(5)
    got = {x["r"]: (x["n"], x["mean"]) for x in inference.weighted_means(rows, "id", "v", 200).collect()}
    v = np.arange(4000) % 7
    assert got == {r: (float(w[:, r].sum()), pytest.approx((w[:, r] * v).sum() / w[:, r].sum())) for r in range(200)}
    assert inference.weighted_means(rows.where("FALSE"), "id", "v", 200).count() == 0


def test_transformed_times_never_fall(spark):
    _, frame = events(spark)
    tau = [r["tau"] for r in etas.transformed_times(frame, 20.0, 0.05, 0.8, 0.01, 1.1, 3.5).orderBy("t").collect()]
    assert all(b >= a - 1e-9 for a, b in zip(tau, tau[1:], strict=False))


@pytest.mark.parametrize("most", [20_000, 15])
def test_sums_over_all_earlier_events_come_from_blocks(spark, monkeypatch, most):
    """Against every pair, with bursts, ties and an event without a time, in one block and in many with parts."""
    monkeypatch.setattr(etas_blocks, "MOST_IN_TIME", most)
    r = np.random.default_rng(5)
    us = np.concatenate([r.integers(-(10**14), 10**15, 400), 10**14 + r.integers(0, 10**6, 60), np.full(3, 10**14)])
    m = np.round(4 + r.exponential(0.4, len(us)), 1)
    frame = spark.createDataFrame([(int(u), float(x)) for u, x in zip(us, m)] + [(None, 5.0)], "us long, m double").select(F.timestamp_micros("us").alias("t"), "m")
    found = etas_blocks.all_before(frame, 0.8, 0.01, 0.1, 4.0)
    assert found.where("us IS NULL").count() == 0
    got = {x["us"]: x["s"] for x in found.collect()}
    assert set(got) == set(us.tolist()) - {us.min()}
    for u, s in got.items():
        before = us < u
        want = (10 ** (0.8 * (m[before] - 4.0)) * ((u - us[before]) / 86400e6 + 0.01) ** -0.1).sum()
        assert s == pytest.approx(want, rel=1e-9)
    assert etas_blocks.all_before(frame.where("m < 0"), 0.8, 0.01, 0.1, 4.0).count() == 0


def test_rolling_gaps_and_ks(spark):
    r = np.random.default_rng(1)
    gaps = r.exponential(1.0, 200)
    frame = spark.createDataFrame([(k + 2, float(g)) for k, g in enumerate(gaps)], "rank long, gap double")
    got = {x["window"]: x["mean"] for x in etas.rolling_gaps(frame, 10, 5).collect()}
    assert got == {w: pytest.approx(gaps[5 * w : 5 * w + 10].mean()) for w in range((200 - 10) // 5 + 1)}
    s = np.sort(gaps)
    want = np.abs(np.arange(1, 201) / 200 - (1 - np.exp(-s))).max()
    assert etas.ks_of_gaps(frame, 7).first()["ks"] == pytest.approx(want, abs=1e-6)


def triggered_catalog(seed=11, years=6.0, mu=90.0, k=0.35, alpha=0.5, c=0.02, p=1.3, sigma=8.0, gamma=0.3, q=1.5, mc=3.5):
    """Generations of events: background ones, and those that each event triggers in time and space."""
    r = np.random.default_rng(seed)
    end = years * 365.25
    magnitude = lambda: mc + float(r.exponential(1 / (1.0 * np.log(10))))
    todo = [(float(r.uniform(0, end)), float(r.uniform(21, 27)), float(r.uniform(89, 95)), magnitude()) for _ in range(r.poisson(mu * years))]
    out = []
    while todo:
        t, lat, lon, m = todo.pop()
        out.append((t, lat, lon, m))
        for _ in range(r.poisson(k * 10 ** (alpha * (m - mc)))):
            lag = c * ((1 - r.uniform()) ** (-1 / (p - 1)) - 1)
            d = sigma * np.exp(gamma * (m - mc)) * np.sqrt((1 - r.uniform()) ** (-1 / q) - 1)
            angle = r.uniform(0, 2 * np.pi)
            if t + lag < end and d < 250:
                todo.append((t + lag, lat + d * np.sin(angle) / 111.2, lon + d * np.cos(angle) / (111.2 * np.cos(np.radians(lat))), magnitude()))
    return [(i, datetime(2000, 1, 1) + timedelta(days=t), float(lat), float(lon), 10.0, m) for i, (t, lat, lon, m) in enumerate(sorted(out))]


EVENTS = "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double"


def plain_nll(rows, theta, mc, tau=365.0):
    mu, k, alpha, c, p = theta
    t = np.array([r[1].timestamp() / 86400 for r in rows])
    m = np.array([r[5] for r in rows])
    w = k * 10 ** (alpha * (m - mc))
    lag = t[:, None] - t[None, :]
    g = np.where((lag > 0) & (lag <= tau), (p - 1) * c ** (p - 1) / (np.where(lag > 0, lag, 1) + c) ** p, 0.0)
    left = np.minimum(t.max() - t, tau)
    return mu / 365.25 * (t.max() - t.min()) + (w * (1 - (c / (left + c)) ** (p - 1))).sum() - np.log(mu / 365.25 + g @ w).sum()


def test_likelihood_and_slopes(spark):
    rows = triggered_catalog(years=1.5)
    theta = (70.0, 0.2, 0.6, 0.03, 1.25)
    thetas = spark.createDataFrame([(0, *theta)], "theta_id int, mu_per_year double, k double, alpha double, c double, p double")
    got = etas.nll_of(spark.createDataFrame(rows, EVENTS), thetas, 3.5, 365.0, slopes=True).first()
    assert got["nll"] == pytest.approx(plain_nll(rows, theta, 3.5), rel=1e-9)
    for d, name in enumerate(etas.IN_TIME):
        up, down = (plain_nll(rows, [v * (1 + s * 1e-5 * (k == d)) for k, v in enumerate(theta)], 3.5) for s in (1, -1))
        assert got[f"d_{name}"] == pytest.approx((up - down) / (2e-5 * theta[d]), rel=1e-4)


def test_fit_recovers_known_parameters(spark):
    rows = triggered_catalog()
    best = etas.fit(spark.createDataFrame(rows, EVENTS), 3.5).first()
    at = [best[x] for x in etas.IN_TIME]
    assert best["triggering"] and best["passes"] < 40
    assert best["nll"] == pytest.approx(plain_nll(rows, at, 3.5), rel=1e-8)
    # No neighbour is lower, and the values are those that made the catalog.
    for d in range(5):
        for sign in (1, -1):
            assert plain_nll(rows, [v * (1 + 0.02 * sign * (k == d)) if k != 4 or k != d else 1 + (v - 1) * (1 + 0.02 * sign) for k, v in enumerate(at)], 3.5) >= best["nll"] - 1e-4
    for value, true, wide in zip(at, (90.0, 0.35, 0.5, 0.02, 1.3), (0.3, 0.35, 0.4, 0.8, 0.15), strict=True):
        assert abs(value / true - 1) < wide


def test_fit_in_space_recovers_known_parameters(spark):
    from tremorlake.operators.joins import grid

    rows = triggered_catalog(seed=12, years=4.0)
    frame = spark.createDataFrame(rows, EVENTS)
    cells = grid(spark)
    pairs = {(x["event_id"], round(x["lag"], 6)): x["r"] for x in etas.pairs_in_space(frame, 30.0, 100.0).collect()}
    flat = frame.withColumn("density", F.lit(1e-6))
    theta = (70.0, 0.3, 0.6, 0.03, 1.25, 10.0, 0.4, 1.2)
    names = etas.IN_TIME + etas.IN_SPACE
    points = [theta] + [tuple(v * (1 + s * 1e-5 * (k == d)) for k, v in enumerate(theta)) for d in range(8) for s in (1, -1)]
    thetas = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "theta_id int, " + ", ".join(f"{x} double" for x in names))
    got = {x["theta_id"]: x for x in etas.nll_in_space(flat, etas.pairs_in_space(frame, 30.0, 100.0), thetas, 3.5, 30.0).collect()}
    mu, k, alpha, c, p, sigma, gamma, q = theta
    t = np.array([r[1].timestamp() / 86400 for r in rows])
    lam = np.full(len(rows), mu / 365.25 * 1e-6)
    for (i, lag), r in pairs.items():
        source = int(np.argmin(np.abs(t - (t[i] - lag))))
        s = sigma * np.exp(gamma * (rows[source][5] - 3.5))
        lam[i] += k * 10 ** (alpha * (rows[source][5] - 3.5)) * (p - 1) * c ** (p - 1) * (lag + c) ** -p * q / (np.pi * s * s) * (1 + r * r / (s * s)) ** -(1 + q)
    w = k * 10 ** (alpha * (np.array([r[5] for r in rows]) - 3.5))
    left = np.minimum(t.max() - t, 30.0)
    want = mu / 365.25 * (t.max() - t.min()) + (w * (1 - (c / (left + c)) ** (p - 1))).sum() - np.log(lam).sum()
    assert got[0]["nll"] == pytest.approx(want, rel=1e-6)
    for d, name in enumerate(names):
        assert got[0][f"d_{name}"] == pytest.approx((got[1 + 2 * d]["nll"] - got[2 + 2 * d]["nll"]) / (2e-5 * theta[d]), rel=1e-3, abs=1e-4)
    best = etas.fit_in_space(frame, cells, frame, 3.5).first()
    assert best["triggering"] and best["passes"] <= 40
    for name, true, wide in zip(names, (90.0, 0.35, 0.5, 0.02, 1.3, 8.0, 0.3, 1.5), (0.3, 0.35, 0.5, 0.8, 0.2, 0.5, 1.0, 0.6), strict=True):
        assert abs(best[name] / true - 1) < wide, name


def test_blocks_in_space_equal_pairs_and_hold_copies_once(spark, monkeypatch):
    """Whole blocks or halved ones, few pairs at a time; forty copies of a table take the room of one."""
    rows = triggered_catalog(seed=5, years=1.2)
    frame = spark.createDataFrame(rows, EVENTS).withColumn("density", F.lit(1e-6))
    theta = dict(zip(("theta_id", *etas.IN_TIME, *etas.IN_SPACE), (0, 70.0, 0.3, 0.6, 0.03, 1.25, 10.0, 0.4, 1.2), strict=True))
    thetas = spark.createDataFrame([tuple(theta.values())], "theta_id int, " + ", ".join(f"{x} double" for x in etas.IN_TIME + etas.IN_SPACE))
    twice = frame.unionByName(frame.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 10**6))
    want = etas.nll_in_space(twice, etas.pairs_in_space(twice, 30.0, 100.0), thetas, 3.5, 30.0).first().asDict()
    end, days = twice.agg(F.max(F.unix_micros("t")), (F.max(F.unix_micros("t")) - F.min(F.unix_micros("t"))) / etas.DAY_US).first()
    for most, pairs in ((2000, 500_000), (5, 40)):
        monkeypatch.setattr(etas_blocks, "MOST_IN_SPACE", most)
        monkeypatch.setattr(etas_blocks, "PAIRS", pairs)
        sums = etas_blocks.sums_in_space(etas_blocks.in_space(twice, 30.0, 100.0), [theta], 3.5, 30.0, 100.0)
        got = etas._likelihoods(etas._left_of(sums, end, days, 30.0).join(thetas, "theta_id"), etas._intensity_in_space(), 3.5).first().asDict()
        assert got == {k: pytest.approx(v, rel=1e-8, abs=1e-9) for k, v in want.items()}
    copies = frame.crossJoin(spark.range(40)).withColumn("event_id", F.col("event_id") * 100 + F.col("id")).drop("id")
    held = [etas_blocks.in_space(x, 30.0, 100.0).agg(F.sum(F.size("s_us")), F.sum(F.size("t_us"))).first() for x in (frame, copies)]
    assert held[0] == held[1]


def test_likelihoods_in_space_are_added_up_within_blocks(spark, monkeypatch):
    """Several thetas; blocks whose points are split by place and that take few pairs at a time; one row a block and theta."""
    rows = triggered_catalog(seed=6, years=1.2)
    frame = spark.createDataFrame(rows, EVENTS).withColumn("density", 1e-6 + F.col("event_id") % 7 * 1e-7)
    names = etas.IN_TIME + etas.IN_SPACE
    points = [dict(zip(("theta_id", *names), x, strict=True)) for x in ((0, 70.0, 0.3, 0.6, 0.03, 1.25, 10.0, 0.4, 1.2), (3, 40.0, 0.01, 1.1, 0.002, 1.05, 3.0, 0.6, 0.7))]
    thetas = spark.createDataFrame([tuple(x.values()) for x in points], "theta_id int, " + ", ".join(f"{x} double" for x in names))
    twice = frame.unionByName(frame.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 10**6))
    want = {x["theta_id"]: x.asDict() for x in etas.nll_in_space(twice, etas.pairs_in_space(twice, 30.0, 100.0), thetas, 3.5, 30.0).collect()}
    end, days = twice.agg(F.max(F.unix_micros("t")), (F.max(F.unix_micros("t")) - F.min(F.unix_micros("t"))) / etas.DAY_US).first()
    blocks = etas_blocks.in_space(twice, 30.0, 100.0)
    for cached, split in ((60_000, 10**6), (40, 50)):
        monkeypatch.setattr(etas_blocks, "CACHED", cached)
        monkeypatch.setattr(etas_blocks, "SPLIT", split)
        got = {x["theta_id"]: x.asDict() for x in etas_blocks.likelihoods_in_space(blocks, points, 3.5, end, float(days), 30.0, 100.0).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == {x: pytest.approx(v, rel=1e-8, abs=1e-9) for x, v in want[k].items()}


@pytest.mark.parametrize("days", [20.0, 365.0])
def test_blocks_in_time_equal_pairs_and_hold_copies_once(spark, monkeypatch, days):
    """Bursts, times before the epoch, events of one time; blocks of few points; forty copies take the room of one."""
    r = np.random.default_rng(9)
    at = np.concatenate([r.uniform(-300, 300, 150), 5 + r.exponential(0.02, 200), -200 + r.exponential(0.001, 80), [7.0, 7.0, 7.0]])
    rows = [(k, datetime(1970, 1, 1) + timedelta(days=float(d)), float(round(3.5 + r.exponential(0.5), 2))) for k, d in enumerate(at)]
    frame = spark.createDataFrame(rows, "event_id long, t timestamp, m double")
    want = {x["event_id"]: x for x in etas.kernel_sums(frame, spark.createDataFrame([(0, 0.9, 0.003, 1.2)], "kernel int, alpha double, c double, q double"), 3.5, days, slopes=True).collect()}
    us = {x["event_id"]: x["us"] for x in frame.select("event_id", F.unix_micros("t").alias("us")).collect()}
    for most in (20_000, 40):
        monkeypatch.setattr(etas_blocks, "MOST_IN_TIME", most)
        blocks = etas_blocks.in_time(frame, days)
        got = {x["us"]: x for x in etas_blocks.sums_in_time(blocks, [(0, 0.9, 0.003, 1.2)], 3.5, days).collect()}
        assert set(got) == set(us.values())
        for i, at_us in us.items():
            for name in ("s", "s_alpha", "s_c", "s_q"):
                assert got[at_us][name] == pytest.approx(want[i][name] if i in want else 0.0, rel=1e-7, abs=1e-9)
    copies = frame.crossJoin(spark.range(40)).drop("id")
    assert etas_blocks.in_time(copies, days).agg(F.sum(F.size("s_us")), F.sum(F.size("t_us"))).first() == blocks.agg(F.sum(F.size("s_us")), F.sum(F.size("t_us"))).first()


def test_tree_meets_events_of_one_time_once(spark):
    """Forty copies of a table have its pairs and far buckets, and forty times its sums."""
    _, frame = events(spark, 200)
    copies = frame.crossJoin(spark.range(40)).withColumn("event_id", F.col("event_id") * 100 + F.col("id")).drop("id")
    met = [(tree.width, tree.pairs.count(), tree.far.count()) for tree in (etas.TimeTree(x, None) for x in (frame, copies))]
    assert met[0] == met[1]
    kernel = spark.createDataFrame([(0, 0.8, 0.01, 1.1)], "kernel int, alpha double, c double, q double")
    one, many = ({x["event_id"]: x["s"] for x in etas.kernel_sums(y, kernel, 3.5, None).collect()} for y in (frame, copies))
    assert many == {i * 100 + k: pytest.approx(40 * s, rel=1e-9) for i, s in one.items() for k in range(40)}


def test_fit_finds_no_triggering_in_a_poisson_catalog(spark):
    _, frame = events(spark, 200)
    best = etas.fit(frame, 3.5, passes=12).first()
    assert not best["triggering"] or best["k"] < 0.05
    few = etas.fit(frame.where("event_id < 20"), 3.5).collect()
    assert len(few) == 1 and few[0]["k"] == 0.0


def test_gamma_quantiles(spark):
    for a, q in ((0.5, 0.025), (3.2, 0.5), (40.0, 0.975)):
        assert gamma_cdf(a, gamma_quantile(a, q)) == pytest.approx(q, abs=1e-9)
    rows = spark.createDataFrame([(None,), (0,), (3,), (3,)], "n long")
    out = intervals.with_intervals(rows, "n", 2.0).collect()
    assert len(out) == 4 and {r["rate_lower"] for r in out if r["n"] is None} == {None}


def test_broadcast_dimensions_are_checked(spark):
    with pytest.raises(ValueError, match="more than 10 rows"):
        joins.small(spark.range(11), 10)


def test_completeness_of_a_known_law(spark):
    r = np.random.default_rng(2)
    rows = [(round(float(x), 4), START) for x in 4.0 + r.exponential(1 / (0.9 * np.log(10)), 4000)]
    frame = spark.createDataFrame(rows, "m double, t timestamp")
    assert completeness.mc_maxc(frame).first()["mc"] == pytest.approx(4.05)
    assert completeness.b_value(frame, [4.05]).first()["b"] == pytest.approx(0.9, abs=0.1)
    assert abs(completeness.mc_emr(frame).first()["mc"] - 4.05) <= 0.31


def test_ledger_commits_whole_batches_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ledger"
    batch = lambda *rows: spark.createDataFrame(list(rows), "origin_year int, threshold double, horizon string, p_region double, forecast_hash string")
    one, two = batch((2020, 4.0, "7d", 0.1, "aa"), (2020, 4.0, "30d", 0.2, "bb")), batch((2021, 4.0, "7d", 0.3, "cc"))
    hashes = lambda: sorted(x["forecast_hash"] for x in ledger.read(spark, path).collect())
    with pytest.raises(FileNotFoundError):
        ledger.read(spark, path)
    assert ledger.append(one, path) == 2 and ledger.append(one.unionByName(one), path) == 0 and hashes() == ["aa", "bb"]
    # A writer dies after its batch and before its manifest, another one in the middle of its manifest.
    commit = ledger._committed
    with monkeypatch.context() as m:
        m.setattr(ledger, "_committed", lambda *a: (_ for _ in ()).throw(InterruptedError()))
        with pytest.raises(InterruptedError):
            ledger.append(two, path)
    (tmp_path / "ledger/manifests/0000000002").write_text('{"batch": "bat')
    assert hashes() == ["aa", "bb"]
    # The replay is added once; a writer that is forestalled sees what the other one wrote.
    forestalled = []

    def late(spark_, path_, number, name):
        if not forestalled:
            forestalled.append(number)
            monkeypatch.setattr(ledger, "_committed", commit)
            ledger.append(two, path)
        return commit(spark_, path_, number, name)

    monkeypatch.setattr(ledger, "_committed", late)
    assert ledger.append(two.unionByName(batch((2022, 4.0, "7d", 0.4, "dd"))), path) == 1 and forestalled == [3]
    assert hashes() == ["aa", "bb", "cc", "dd"] and ledger.append(two, path) == 0
    with pytest.raises(ValueError, match="another forecast"):
        ledger.append(batch((2021, 4.0, "7d", 0.3, "zz")), path)
    assert hashes() == ["aa", "bb", "cc", "dd"]


def test_ledger_of_a_stream_that_is_replayed(spark, tmp_path):
    from tremorlake.streaming import prospective

    rows = spark.createDataFrame([("a", 2020, 4.0), ("b", 2021, 5.0)], "native_event_id string, origin_year int, threshold double")
    rows.write.parquet(str(tmp_path / "in"))
    record = lambda b: b.selectExpr("origin_year", "threshold", "'7d' AS horizon", "md5(native_event_id) AS forecast_hash")
    for checkpoint in ("one", "two"):
        stream = prospective.landing(spark, str(tmp_path / "in"), rows.schema)
        prospective.forecast_each_batch(stream, record, f"file://{tmp_path}/out", str(tmp_path / checkpoint), as_ledger=True).awaitTermination()
    assert ledger.read(spark, f"file://{tmp_path}/out").count() == 2


def test_ledger_faults_and_append(spark, tmp_path):
    schema = "origin_year int, threshold double, horizon string, cell_id string, n_train long, rate double, horizon_days double, p double, p_lower double, p_upper double, version string"
    p = 1 - float(np.exp(-2.0 * 30 / 365.25))
    rows = [(2020, 4.0, "30d", "a", 4, 2.0, 30.0, p, 0.0, 1.0, "v1"), (2020, 4.0, "30d", "b", 4, 2.0, 30.0, None, 0.0, 1.0, "v1"), (2020, 4.0, "30d", "c", 4, 2.0, 30.0, 1.2, 0.0, 1.0, None), (2020, 4.0, "30d", "d", 4, 2.0, 30.0, p, 0.5, 1.0, "v1")]
    cells = spark.createDataFrame(rows, schema)
    r = ledger.integrity(cells, "v1").first()
    assert (r["n_missing"], r["n_out_of_range"], r["n_inconsistent"], r["n_disordered"], r["n_other_version"]) == (1, 1, 1, 2, 1)
    stored = ledger.records(cells)
    assert ledger.hash_faults(stored, cells).first()["intact"] and not ledger.hash_faults(stored, cells.where("cell_id <> 'a'")).first()["intact"]
    path = str(tmp_path / "ledger")
    ledger.append(stored, path)
    ledger.append(stored.withColumn("origin_year", F.lit(2021)), path)
    assert {(x["origin_year"], x["is_latest"]) for x in ledger.read(spark, path).collect()} == {(2020, False), (2021, True)}


def test_sinks(spark, tmp_path):
    nested = spark.createDataFrame([(1, (2.0, ("x",)), [1, 2])], "id int, a struct<b:double,c:struct<d:string>>, l array<int>")
    assert audit.flattened(nested).columns == ["id", "a_b", "a_c_d", "l"]
    sinks.write_catalog(nested, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c/json")).first()["a"]["b"] == 2.0
    assert spark.read.option("header", True).csv(str(tmp_path / "c/csv")).first()["l"] == "[1,2]"
    sinks.write_results([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2,)], "a int")], str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["a", "b"]
    sinks.write_tables({"t": spark.createDataFrame([(1, 4.0)], "x int, threshold double")}, str(tmp_path / "w"), ["threshold", "horizon"])
    catalog.write_by_config(spark.createDataFrame([(1, 4.0, "7d")], "x int, threshold double, horizon string"), str(tmp_path / "k"))
    assert (tmp_path / "w/t/threshold=4.0").is_dir() and (tmp_path / "k/threshold=4.0/horizon=7d").is_dir()
    a, b = (sinks.content_hash(spark.createDataFrame([(1, s)], "x int, scored boolean"), ["scored"]).first()["content_hash"] for s in (True, False))
    assert a == b and len(a) == 16


def test_placeholder_faults_stop_a_stress_query(spark):
    schema = "fault_id string, confidence string, dip double, slip_rate double, recurrence_years double"
    good = spark.createDataFrame([("1", "low", 30.0, None, None)], schema)
    assert audit.require_for_coulomb(good).count() == 1
    with pytest.raises(Exception, match="without usable geometry"):
        audit.require_for_coulomb(good.withColumn("confidence", F.lit("placeholder"))).collect()


def test_verdicts(spark):
    """A clear winner, a clear loser, and a winner whose numbers of events do not fit."""
    r = np.random.default_rng(16)
    rows = []
    for config in ("a", "b"):
        for year in range(2012, 2020):
            for k in range(64):
                y = int(r.random() < (0.6 if k % 3 else 0.1))
                for model, p in (("good", 0.6 if k % 3 else 0.1), ("flat", 0.433), ("bad", 0.1 if k % 3 else 0.6)):
                    rows.append((config, model, year, k // 8, k % 8, y, y, p, p, p))
    schema = "config string, model string, origin_year int, i_lat int, i_lon int, n_future int, y int, p double, expected double, variance double"
    frame = spark.createDataFrame(rows, schema)
    won = candidates.candidate(frame, "good", ("flat", "bad")).first()
    assert (won["verdict"], won["n_better"], won["quadrants"], won["ppc_pass"], won["integrity"]) == ("A", 2, 4, True, True)
    assert candidates.candidate(frame, "bad", ("flat", "good")).first()["verdict"] == "D"
    doubled = frame.withColumn("expected", F.when(F.col("model") == "good", 2 * F.col("expected")).otherwise(F.col("expected")))
    assert candidates.candidate(doubled, "good", ("flat", "bad")).first()["verdict"] == "D"
    assert not candidates.candidate(frame.withColumn("p", F.when(F.col("p") == 0.6, 1.6).otherwise(F.col("p"))), "good", ("flat", "bad")).first()["integrity"]
    found = {(x["config"], x["model"]): x for x in candidates.bounds(frame, ["good", "bad"], ["flat"]).collect()}
    w = inference.weights(np.arange(2012, 2020), candidates.REPLICATES)
    for (config, model), x in found.items():
        p = {k: [(v[7] - v[6]) ** 2 for v in rows if v[0] == config and v[1] == k] for k in (model, "flat")}
        d = (np.array(p["flat"]) - np.array(p[model])).reshape(8, 64).sum(1)
        each = (w * d[:, None]).sum(0) / (64.0 * w.sum(0))
        each = each[np.isfinite(each)]
        assert (x["lower"], x["upper"]) == (pytest.approx(np.quantile(each, 0.025), abs=1e-8), pytest.approx(np.quantile(each, 0.975), abs=1e-8))
        assert x["difference"] == pytest.approx(d.sum() / 512, abs=1e-8)
    variants = {x["model"]: (x["n_significant"], x["n_rejected"], x["ppc_pass"]) for x in candidates.variant_rows(frame, ["good", "bad"], "flat").collect()}
    assert variants["good"] == (2, 2, True) and variants["bad"][:2] == (0, 0)
    assert [r["eligible"] for r in verdicts.promotable(spark.createDataFrame([(19,), (20,)], "n_evaluated int")).collect()] == [False, True]


def test_calibrations(spark):
    """An isotonic line by pooling neighbours, and the logistic curve where the likelihood's slopes are zero."""
    r = np.random.default_rng(17)
    p = np.round(r.uniform(0.05, 0.95, 400), 4)
    y = (r.random(400) < p**2).astype(int)
    raw = spark.createDataFrame([(0, str(k), int(b), float(a)) for k, (a, b) in enumerate(zip(p, y, strict=True))], "origin int, cell_id string, label int, p double")
    asked = [0.01, 0.2, 0.5, 0.77, 0.99]
    scored = spark.createDataFrame([(1, str(k), 0, x) for k, x in enumerate(asked)], raw.schema)
    got = {kind: [x["p"] for x in models.calibration(kind, raw, scored).orderBy("cell_id").collect()] for kind in ("isotonic", "platt")}
    pools: list = []
    for x in sorted(set(p)):
        same = y[p == x]
        pools.append([same.sum(), len(same), x, x])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            b = pools.pop()
            pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], pools[-1][2], b[3]]
    at = np.array([v for pool in pools for v in pool[2:]])
    level = np.array([pool[0] / pool[1] for pool in pools for _ in (0, 1)])
    assert got["isotonic"] == pytest.approx(np.interp(asked, at, level), abs=1e-9)
    w = np.zeros(2)
    x = np.column_stack([np.ones(400), p])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]), x.T @ (y - q))
    assert got["platt"] == pytest.approx(1 / (1 + np.exp(-(w[0] + w[1] * np.array(asked)))), abs=1e-3)


def test_calibration_line(spark):
    r = np.random.default_rng(0)
    p = r.uniform(0.05, 0.95, 3000)
    y = (r.uniform(size=3000) < 1 / (1 + np.exp(-(-2 + 4 * p)))).astype(int)
    a, b = metrics.calibration_line(spark.createDataFrame([(float(u), int(v)) for u, v in zip(p, y, strict=True)], "p double, y int"))
    assert a == pytest.approx(-2, abs=0.35) and b == pytest.approx(4, abs=0.5)


@pytest.mark.parametrize("kind", ["base", "logistic", "elastic", "forest", "boosted", "isotonic"])
def test_models_learn_a_simple_rule(spark, kind):
    r = np.random.default_rng(7)
    rows = [(START + timedelta(days=30 * (k // 60)), f"c{k % 60}", float(r.uniform()), float(r.uniform())) for k in range(240)]
    frame = spark.createDataFrame(rows, "origin timestamp, cell_id string, u double, v double").withColumn("label", (F.col("u") > 0.6).cast("int"))
    out = models.chronological(frame, [kind], ["u", "v"], first=3, trees=10).collect()
    assert len(out) == 60 and {x["origin"] for x in out} == {START + timedelta(days=90)}
    right = np.mean([(x["p"] > 0.5) == x["label"] for x in out])
    assert right > 0.85 if kind != "base" else len({x["p"] for x in out}) == 1


def test_feature_groups(spark):
    _, frame = events(spark, 50)
    rows = features.labelled(frame, spark.createDataFrame([(START + timedelta(days=400),)], "origin timestamp"), 4.0, 30.0, "2000-01-01")
    assert rows.count() == 64 and len(features.group(rows, "G")) == 43 and features.group(rows, "A") == [c for c in rows.columns if c.startswith("hist_rate")]


NDK = [
    "PDE  2005/01/01 01:20:05.4  13.78  -88.78 193.1 5.0 0.0 EL SALVADOR             ",
    "C200501010120A   B:  4    4  40 S: 27   33  50 M:  0    0   0 CMT: 1 TRIHD:  0.6",
    "CENTROID:     -0.3 0.9  13.76 0.06  -89.08 0.09 162.8 12.5 FREE S-20050322125201",
    "23  0.838 0.201 -0.005 0.231 -0.833 0.270  1.050 0.121 -0.369 0.161  0.044 0.240",
    "V10   1.581 56  12  -0.537 23 140  -1.044 24 241   1.312   9 29  142 133 72   66",
]


def test_ndk_and_iscgem(spark, tmp_path):
    (tmp_path / "a.ndk").write_text("\n".join(NDK) + "\n")
    r = catalog.read_gcmt_ndk(spark, str(tmp_path / "a.ndk")).first()
    assert (r["native_event_id"], r["latitude"], r["longitude"], r["depth_km"]) == ("C200501010120A", 13.78, -88.78, 193.1)
    assert (r["strike"], r["dip"], r["rake"]) == (9.0, 29.0, 142.0)
    assert r["original_magnitude"] == pytest.approx(4.68, abs=0.05) and r["moment_nm"] == pytest.approx(1.312e16)
    # Without a hypocentre the centroid stands.
    bare = [NDK[0][:26] + "                     " + NDK[0][47:], *NDK[1:]]
    (tmp_path / "b.ndk").write_text("\n".join(bare) + "\n")
    c = catalog.read_gcmt_ndk(spark, str(tmp_path / "b.ndk")).first()
    assert (c["latitude"], c["longitude"], c["depth_km"]) == (13.76, -89.08, 162.8)
    (tmp_path / "g.csv").write_text("Date_Time,Latitude,LON,Depth,MW,EventID,Mtype,smaj,Msigma\n2001-01-01 00:00:00,24.0,91.0,10,6.1,7,mw,5.5,0.2\n2001-01-02 00:00:00,24.0,91.0,10,,8,mw,,\n2001-01-03 00:00:00,24.0,91.0,10,5.5,9,ms,,\n")
    g = {x["native_event_id"]: x for x in catalog.read_iscgem_csv(spark, str(tmp_path / "g.csv")).collect()}
    assert set(g) == {"7", "9"} and g["7"]["magnitude_type"] == "mw_iscgem" and g["9"]["magnitude_type"] == "ms"
    assert (g["7"]["horizontal_uncertainty_km"], g["7"]["magnitude_uncertainty"], g["7"]["quality_flag"]) == (5.5, 0.2, "reviewed")


def test_all_magnitudes_of_a_text(spark, tmp_path):
    line = "1|2024-01-01T00:00:00|24.0|91.1|11|ISC|ISC|ISC|1|{}|{}|ISC|here|ke"
    (tmp_path / "m.txt").write_text("\n".join(["#header", line.format("mb", 4.5), line.format("ms", 4.9)]) + "\n")
    r = catalog.read_isc_allmags(spark, str(tmp_path / "m.txt")).first()
    assert r["n"] == 2 and sorted(x["magnitude"] for x in r["magnitudes"]) == [4.5, 4.9]


def test_names_of_queries():
    assert set(all_queries.SQL) <= set(all_queries.QUERIES) and len(all_queries.QUERIES) > 130
    assert json.dumps(sorted(all_queries.SQL))
