"""Operators on small catalogs, against brute force."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import coulomb, decluster, inference, metrics, rates, reconcile, settling
from tremorlake.operators.joins import interval_join

START = datetime(2000, 1, 1)


def catalog(spark, n=120, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, START + timedelta(hours=float(r.uniform(0, 3000))), float(r.uniform(20, 28)), float(r.uniform(88, 96)), float(r.uniform(0, 100)), round(float(3 + r.exponential(0.7)), 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double")


def km(a, b):
    la, lo, lb, lp = np.radians([a[2], a[3], b[2], b[3]])
    return 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2))


@pytest.mark.parametrize("forward", [True, False])
def test_interval_join(spark, forward):
    rows, frame = catalog(spark)
    a = frame.select(F.col("event_id").alias("a"), F.col("t").alias("ta"))
    b = frame.select(F.col("event_id").alias("b"), F.col("t").alias("tb"))
    got = {(r["a"], r["b"]) for r in interval_join(a, b, "ta", "tb", 36000, forward).collect()}
    gap = lambda x, y: (y[1] - x[1]).total_seconds()
    want = {(x[0], y[0]) for x in rows for y in rows if (0 < gap(x, y) <= 36000 if forward else abs(gap(x, y)) <= 36000)}
    assert got == want


def matched(rows, window, radius):
    """The plain loop over (id, time, latitude, longitude)."""
    want, order = {}, sorted(rows, key=lambda r: (r[1], str(r[0])))
    for i, x in enumerate(order):
        if str(x[0]) in want:
            continue
        want[str(x[0])] = str(x[0])
        for y in order[i + 1 :]:
            if (y[1] - x[1]).total_seconds() > window:
                break
            if str(y[0]) not in want and km(x, y) <= radius:
                want[str(y[0])] = str(x[0])
    return want


def observed(spark, rows):
    return spark.createDataFrame([(str(r[0]), *r[1:4]) for r in rows], "native_event_id string, origin_time timestamp, latitude double, longitude double")


def anchors(frame, *args, **kw):
    return {r["native_event_id"]: r["anchor_id"] for r in reconcile.match_observations(frame, *args, **kw).collect()}


@pytest.mark.parametrize("window", [1800.0, 90000.0])
@pytest.mark.parametrize("block_links", [40, 100_000])
def test_match_observations(spark, window, block_links):
    rows, _ = catalog(spark)
    assert anchors(observed(spark, rows), window, 400.0, block_links) == matched(rows, window, 400.0)


def test_matching_of_long_chains(spark, monkeypatch):
    """5,000 observations a minute apart: two passes over the blocks, however long the chain is."""
    r = np.random.default_rng(5)
    chain = [(k, START + timedelta(minutes=k), 20.0, 90.0) for k in range(5000)]
    # A second chain at another place and of another pace, both broken now and then, and reports that repeat.
    other = [(10_000 + k, START + timedelta(seconds=47 * k + (300 if k > 900 else 0)), 25.0 + float(r.uniform(0, 0.3)), 95.0) for k in range(1500)]
    rows = [*chain, *other, *[(20_000 + k, *chain[77][1:]) for k in range(30)]]
    passes = []
    monkeypatch.setattr(settling, "written", lambda frame, name, keep=settling.written: passes.append(name) or keep(frame, name))
    assert anchors(observed(spark, rows), 120.0, 50.0, 400) == matched(rows, 120.0, 50.0)
    assert passes.count("blocks") == 2


def test_matching_of_dense_hours(spark):
    """Hundreds of open anchors at a block's start, more sets of them than are followed."""
    r = np.random.default_rng(6)
    rows = [(k, START + timedelta(seconds=float(r.uniform(0, 900))), float(r.uniform(20, 24)), float(r.uniform(88, 92))) for k in range(900)]
    rows += [(5000 + k, START + timedelta(seconds=int(r.integers(0, 60)) * 20), 30.0, 90.0) for k in range(300)]
    assert anchors(observed(spark, rows), 120.0, 50.0, 500) == matched(rows, 120.0, 50.0)


def test_points_touch_few_cells_and_miss_none(spark):
    """Rows of the matching's join grow with the cells an observation is dealt to; also at the date line and the poles."""
    from tremorlake.operators import joins

    r = np.random.default_rng(9)
    for top in (30.0, 89.9):
        at = [(float(r.uniform(-top, top)), float(r.uniform(-180, 180))) for _ in range(400)]
        near = [(max(-top, min(top, la + float(r.uniform(-0.6, 0.6)))), (lo + float(r.uniform(-0.6, 0.6)) + 180) % 360 - 180) for la, lo in at]
        frame = spark.createDataFrame([(*a, *b) for a, b in zip(at, near)], "x double, y double, u double, v double")
        around, own = joins.touched_cells(F.col("x"), F.col("y"), 50.0, top)[1], joins.touched_cells(F.col("u"), F.col("v"), 50.0, top)[0]
        d = decluster.haversine_km(F.col("x"), F.col("y"), F.col("u"), F.col("v"))
        got = frame.agg(F.count_if((d <= 50) & ~F.array_contains(around, own)).alias("missed"), F.count_if(d <= 50).alias("near"), F.avg(F.size(around)).alias("cells")).first()
        assert got["missed"] == 0 and got["near"] > 50 and got["cells"] < 3


def test_matching_without_time_or_place(spark):
    frame = spark.createDataFrame([("a", START, 1.0, 2.0), ("b", START, 1.0, 2.0), ("c", None, 1.0, 2.0), ("d", None, 1.0, 2.0), ("e", START, None, 2.0), ("f", START, 1.0, None)], "native_event_id string, origin_time timestamp, latitude double, longitude double")
    assert anchors(frame) == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f"}
    assert anchors(frame.where("FALSE")) == {}


@pytest.mark.parametrize("rest_links", [0, 50, 100_000])
def test_settled_in_any_order(spark, rest_links):
    r = np.random.default_rng(7)
    rank = [int(x) for x in r.permutation(80)]
    links = {tuple(sorted(map(int, r.choice(80, 2, False)), key=lambda x: rank[x])) for _ in range(160)}
    seeds: set = set()
    for x in sorted(range(80), key=lambda x: rank[x]):
        if not any((s, x) in links for s in seeds):
            seeds.add(x)
    got = {x["a"]: x["seed"] for x in settling.settled(spark.createDataFrame(sorted(links), "a long, b long"), rest_links).collect()}
    assert got == {x: x in seeds for link in links for x in link}


def test_gardner_knopoff(spark):
    rows, frame = catalog(spark, 60)
    got = {r["event_id"]: (r["seed_id"], r["role"]) for r in decluster.gardner_knopoff(frame).collect()}
    want: dict = {}
    for x in sorted(rows, key=lambda r: (-r[5], r[1], r[0])):
        if x[0] in want:
            continue
        want[x[0]] = (x[0], "main")
        for y in rows:
            near = abs((y[1] - x[1]).total_seconds()) / 86400 <= 10 ** (0.5 * x[5] - 0.052) and km(x, y) <= (0.1238 * x[5] + 0.983) * 111
            if y[0] not in want and near:
                want[y[0]] = (x[0], "foreshock" if y[1] < x[1] else "aftershock")
    assert got == want


def test_gardner_knopoff_in_chunks_with_repeated_events(spark, monkeypatch):
    """Magnitudes come in many chunks; points of many events, and links, do not grow with the copies of a catalog."""
    rows, _ = catalog(spark, 60)
    rows += [(1000 + x[0], *x[1:5], x[5] + (0.4 if x[0] % 5 == 0 else 0.0)) for x in rows] + [(2000 + x[0], *x[1:]) for x in rows[:20]]
    linked = []
    monkeypatch.setattr(decluster, "settled", lambda links: linked.append(links.count()) or settling.settled(links))
    frame = spark.createDataFrame(rows + [(3000, None, 24.0, 92.0, 0.0, 8.0), (3001, START, 24.0, 92.0, 0.0, None)], "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double")
    got = {r["event_id"]: (r["seed_id"], r["role"]) for r in decluster.gardner_knopoff(frame, 15).collect()}
    want: dict = {3000: (3000, "main"), 3001: (3001, "main")}
    n_links = 0
    for x in sorted(rows, key=lambda r: (-r[5], r[1], r[0])):
        near = [y for y in rows if abs((y[1] - x[1]).total_seconds()) / 86400 <= 10 ** (0.5 * x[5] - 0.052) and km(x, y) <= (0.1238 * x[5] + 0.983) * 111]
        n_links += sum((-y[5], y[1], y[0]) > (-x[5], x[1], x[0]) for y in near)
        if x[0] in want:
            continue
        want[x[0]] = (x[0], "main")
        for y in near:
            if y[0] not in want:
                want[y[0]] = (x[0], "foreshock" if y[1] < x[1] else "aftershock")
    assert got == want and len(linked) >= 2 and sum(linked) < n_links / 4


def test_gardner_knopoff_across_the_date_line(spark):
    rows = [(1, START, 10.0, 179.6, 0.0, 5.0), (2, START + timedelta(days=1), 10.0, -179.6, 0.0, 4.0), (3, START + timedelta(days=1), 10.0, -176.0, 0.0, 3.0)]
    frame = spark.createDataFrame(rows, "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double")
    got = {r["event_id"]: r["seed_id"] for r in decluster.gardner_knopoff(frame).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def grown(rows, days):
    """The plain loop: a cluster grows to a fixpoint, links from any member, before or after it."""
    length = lambda m: 1.0 if m < 4 else max(1.0, 10 ** (-3.22 + 0.69 * m))
    order, want = sorted(rows, key=lambda r: (r[1], r[0])), {}
    for seed in order:
        if seed[0] in want:
            continue
        members, want[seed[0]], changed = [seed], seed[0], True
        while changed:
            changed = False
            for y in order:
                if y[0] not in want and any(abs((y[1] - x[1]).total_seconds()) <= days * 86400 and km(x, y) <= 10 * (length(seed[5]) + length(x[5])) for x in members):
                    members.append(y)
                    want[y[0]], changed = seed[0], True
        main = max(members, key=lambda r: (r[5], -r[1].timestamp(), -r[0]))[0]
        want |= {x[0]: main for x in members}
    return want


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("block_events", [25, 1000])
def test_reasenberg(spark, seed, block_events):
    rows, _ = catalog(spark, 300, seed)
    rows = [(*x[:2], 20 + (x[2] - 20) / 2, 88 + (x[3] - 88) / 2, *x[4:]) for x in rows]
    frame = spark.createDataFrame(rows, "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double")
    got = {r["event_id"]: r["main_id"] for r in decluster.reasenberg(frame, 3.0, block_events=block_events).collect()}
    want = grown(rows, 3.0)
    assert 10 < len(set(want.values())) < 290
    assert got == want


def test_reasenberg_grows_points_once(spark, monkeypatch):
    """Copies of other sizes at one time and place; blocks are cut by points, not by events; unknown places stay alone."""
    rows, _ = catalog(spark, 100, 5)
    rows = [(*x[:2], 20 + (x[2] - 20) / 2, 88 + (x[3] - 88) / 2, *x[4:]) for x in rows]
    rows += [(1000 + x[0], *x[1:5], x[5] + (x[0] % 3 - 1) * 0.8) for x in rows[::2]] + [(-1 - x[0], *x[1:5], 3.0) for x in rows[:20]]
    frame = spark.createDataFrame([*rows, (5000, None, 24.0, 92.0, 0.0, 8.0), (5001, rows[0][1], None, 92.0, 0.0, 5.0)], "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double")
    tables = {}
    plain = decluster.written
    monkeypatch.setattr(decluster, "written", lambda frame, name: tables.setdefault(name, plain(frame, name)) if name == "points" else plain(frame, name))
    got = {r["event_id"]: r["main_id"] for r in decluster.reasenberg(frame, 3.0, block_events=25).collect()}
    want = grown(rows, 3.0) | {5000: 5000, 5001: 5001}
    assert 10 < len(set(want.values())) < 90 and tables["points"].count() == 100
    assert got == want


def test_reasenberg_writes_little_in_a_round(spark, monkeypatch):
    """Many rounds over blocks of a few days: only labels near the blocks' ends go from one to the next."""
    rows, _ = catalog(spark, 300, 3)
    rows = [(*x[:2], 20 + (x[2] - 20) / 2, 88 + (x[3] - 88) / 2, *x[4:]) for x in rows]
    frame = spark.createDataFrame(rows, "event_id long, t timestamp, latitude double, longitude double, depth_km double, m double")
    sizes = []
    plain = decluster.written
    monkeypatch.setattr(decluster, "written", lambda frame, name: (out := plain(frame, name), sizes.append(out.count()))[0])
    got = {r["event_id"]: r["main_id"] for r in decluster.reasenberg(frame, 3.0, block_events=25).collect()}
    assert got == grown(rows, 3.0)
    # Points, groups and clusters alone hold all events.
    assert len(sizes) > 8 and sum(n >= len(rows) for n in sizes) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_points(seed):
    """Against all pairs: sparse and dense points, some on both sides of the date line and near a pole."""
    rng = np.random.default_rng(seed)
    n = 400
    us = rng.integers(0, 5_000_000, n)
    lat = np.where(np.arange(n) % 5 == 0, 89.9, rng.uniform(10, 11, n)) + rng.uniform(-0.1, 0.1, n) * (np.arange(n) % 5 == 0)
    lon = np.where(rng.random(n) < 0.5, 180 - rng.uniform(0, 0.6, n), -180 + rng.uniform(0, 0.6, n))
    got = decluster._groups(us, lat, lon, 300_000, 20.0)
    y, x = np.radians(lat), np.radians(lon)
    d = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y)[:, None] * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    near = (2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(d, 1))) <= 20.0) & (np.abs(us[:, None] - us) <= 300_000)
    want = np.arange(n)
    for _ in range(n):
        want = np.where(near, want, n).min(axis=1)
    assert 20 < len(set(want)) < 350
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_declustering_queries_take_all_events(spark):
    from tremorlake import queries

    folder = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{folder}/events.parquet").count()
    for name in ("gardner_knopoff", "reasenberg"):
        assert queries.QUERIES[name](spark, folder).count() == n


def test_scores_by_hand(spark):
    frame = spark.createDataFrame([(0.1, 0), (0.8, 1), (0.4, 0)], "p double, y int").withColumn("g", F.lit(1))
    assert metrics.scores(frame, ["g"]).first()["brier"] == pytest.approx(0.07)
    assert metrics.roc_pr(frame, ["g"]).first()["roc_auc"] == 1.0
    one = frame.where("y = 0")
    assert metrics.roc_pr(one, ["g"]).first()["roc_auc"] is None


def test_step_up(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "test string, p_value double")
    got = {r["test"]: (r["bonferroni"], r["bh"]) for r in inference.benjamini_hochberg(tests, 0.05).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (False, False), "d": (False, False)}


def test_forecasts_see_only_the_past(spark):
    rows, frame = catalog(spark)
    later = spark.createDataFrame([(9999, datetime(2030, 1, 1), 24.5, 92.5, 1.0, 8.0)], frame.schema)
    run = lambda f: sorted(map(tuple, rates.expanding_rates(f, 3.0, 2001, 2003, 1999).collect()))
    assert run(frame) == run(frame.unionByName(later))


def test_empty_catalog_gives_rates_of_zero(spark):
    _, frame = catalog(spark, 1)
    out = rates.expanding_rates(frame.where("FALSE"), 3.0, 2001, 2002, 1999)
    assert out.count() == 128 and out.agg(F.max("rate")).first()[0] == 0


def test_stress_superposes_and_turns_with_slip(spark):
    schema = "latitude double, longitude double, depth_km double, mw double, strike double, dip double, rake double"
    source = (24.0, 92.0, 10.0, 6.5, 30.0, 60.0, 90.0)
    receivers = spark.createDataFrame([("r", 24.4, 92.3, 12.0, 40.0, 50.0, 80.0)], "receiver_id string, r_lat double, r_lon double, r_depth_km double, r_strike double, r_dip double, r_rake double")
    run = lambda *rows: coulomb.point_source_dcfs(spark.createDataFrame(list(rows), schema), receivers).first()["dcfs_pa"]
    one = run(source)
    assert run(source, source) == pytest.approx(2 * one)
    assert run((*source[:6], -90.0)) == pytest.approx(-one)
    assert run((*source[:4], None, 60.0, 90.0)) is None
    far = spark.createDataFrame([("r", 27.9, 95.9, 12.0, 40.0, 50.0, 80.0)], receivers.schema)
    assert abs(coulomb.point_source_dcfs(spark.createDataFrame([source], schema), far).first()["dcfs_pa"]) < abs(one)
