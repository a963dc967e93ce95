"""Embedding near-dedup: all pairs by cosine, in tiles, with dimensions ordered by PCA.

Vectors are rotated so that leading dimensions carry the most variance. Tiles are ranges of the leading coordinate:
where two tiles are farther apart there than vectors above the threshold can be, no pair of theirs is compared. A pair
of tiles accumulates products of leading dimensions first; what the rest can add is bounded by the product of the
suffix norms, and only pairs that can still reach the threshold go on. Pairs that remain are measured exactly, in
double precision, before rotation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import gapless, materialised, salted_join
from tremorlake.llm.components import components, local_roots

THRESHOLD = 0.9
#: Vectors in a tile, those of it that are compared at a time, and dimensions after which the bound is tested.
TILE, STEP = 8192, 1024
STEPS = (16, 32)
#: The rotation only orders dimensions, any orthogonal matrix gives the same links; so a sample may fit it.
PCA_ROWS = 20_000
#: Ranges of the leading coordinate at most; where they hold more than TILE vectors they are cut by rank.
RANGES = 256
#: Slack of the bounds against rounding.
SLACK = 1e-7


def _usable(embedding: str = "embedding"):
    """Non-empty, without null or non-finite components, not zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def units(vectors: list) -> np.ndarray:
    """Unit vectors; each is divided by its largest component first, so that squares neither overflow nor vanish."""
    x = np.vstack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(vectors: DataFrame, rows: int = PCA_ROWS) -> np.ndarray:
    """Principal axes of at most ``rows`` vectors of one length (those with the smallest hashes), by falling variance."""
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("v").toPandas()["v"]
    x = units(sample.to_list())
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1]


def _leading(axes: np.ndarray):
    """Adds the leading coordinate of the unit vector; 0 for vectors of another length than the axes'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").to_pylist()
            lead = np.zeros(len(rows))
            mine = [k for k, v in enumerate(rows) if len(v) == len(axes)]
            if mine:
                lead[mine] = units([rows[k] for k in mine]) @ axes[:, 0]
            yield pa.record_batch([*batch.columns, pa.array(lead)], names=[*batch.schema.names, "lead"])

    return run


def _links(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of unit vectors a x b with cosine >= threshold; ra, rb: the same vectors rotated."""
    at = [0, *[s for s in STEPS if s < a.shape[1]]]
    tail = lambda r, s: np.sqrt(np.maximum(0, 1 - (r[:, :s] ** 2).sum(1)))
    first = at[1] if len(at) > 1 else a.shape[1]
    part = ra[:, :first] @ rb[:, :first].T
    bound = part + np.outer(tail(ra, first), tail(rb, first))
    i, j = np.nonzero(bound >= threshold - SLACK)
    dots = part[i, j]
    for low, high in zip(at[1:], at[2:], strict=False):
        dots = np.concatenate([d for d in _chunked(lambda p, q: (ra[p, low:high] * rb[q, low:high]).sum(1), i, j)]) + dots
        keep = dots + tail(ra, high)[i] * tail(rb, high)[j] >= threshold - SLACK
        i, j, dots = i[keep], j[keep], dots[keep]
    exact = np.concatenate(_chunked(lambda p, q: (a[p] * b[q]).sum(1), i, j))
    keep = exact >= threshold
    return i[keep], j[keep]


def _chunked(f, i: np.ndarray, j: np.ndarray, most: int = 1 << 17) -> list[np.ndarray]:
    return [f(i[k : k + most], j[k : k + most]) for k in range(0, len(i), most)] or [np.zeros(0)]


def _compare(axes: np.ndarray, threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = (rows[rows["side"] == k].sort_values("lead") for k in (0, 1))
        same = len(rows) and rows["low"].iloc[0] == rows["high"].iloc[0]
        if left.empty or right.empty and not same:
            return pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
        both = left if same else pd.concat([left, right])
        x = units(both["v"].to_list())
        # Vectors of another length than the axes' are compared as they are.
        r = x @ axes if x.shape[1] == len(axes) else x
        ids, copies, lead = both["rep"].to_numpy(), both["copies"].to_numpy(), both["lead"].to_numpy()
        reach = math.sqrt(2 * (1 - threshold)) + SLACK
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a in range(0, len(left), STEP):
            p = slice(a, min(a + STEP, len(left)))
            for b in range(a if same else len(left), len(ids), STEP):
                q = slice(b, min(b + STEP, len(ids)))
                # Unit vectors of this cosine are no farther apart than ``reach`` in any coordinate.
                if lead[q.start] - lead[p.stop - 1] > reach or lead[p.start] - lead[q.stop - 1] > reach:
                    continue
                i, j = _links(x[p], x[q], r[p], r[q], threshold)
                if same and a == b:
                    i, j = i[i < j], j[i < j]
                found.append((i + a, j + b))
        i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1))
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        linked = n > 0
        roots = ids[local_roots(len(ids), i, j, ids)]
        return pd.DataFrame({"rep": ids[linked], "n": n[linked].astype("int64"), "root": roots[linked]})

    return run


def _tiled(groups: DataFrame, tile: int, reach: float) -> DataFrame:
    """Adds range, tile, and the first and last tile that a vector is compared with, among those of its length.

    Ranges of the leading coordinate are cut at quantiles, and by rank where they hold more than a tile. What is known of
    ranges has at most RANGES rows a length, however many tiles there are.
    """
    cuts = groups.agg(F.percentile_approx("lead", [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    ranged = groups.withColumn("range", F.size(F.filter(bounds, lambda c: c <= F.col("lead"))))
    # Small ranges in a row make up a tile; the rank within all of a length's ranges is their running size.
    sizes = ranged.groupBy("dim", "range").agg(F.count("*").alias("n")).collect()
    before: dict[int, int] = {}
    rows = []
    for x in sorted(sizes):
        start = before.get(x["dim"], 0)
        rows.append((x["dim"], x["range"], start))
        before[x["dim"]] = start + x["n"]
    starts = groups.sparkSession.createDataFrame(rows, "dim int, range int, start long")
    # At most RANGES rows a length of vectors.
    ranked = gapless(ranged, ["dim", "range"], ["rep"], "rank").join(F.broadcast(starts), ["dim", "range"])
    placed = materialised(ranked.withColumn("tile", F.floor((F.col("start") + F.col("rank")) / tile).cast("int")).drop("start", "rank"), "tiles")
    # A vector goes to the tiles of the ranges that are near its own range; at most RANGES rows a length, too.
    spans = placed.groupBy("dim", "range").agg(F.min("lead").alias("low"), F.max("lead").alias("high"), F.min("tile").alias("first"), F.max("tile").alias("last"))
    other = spans.select("dim", *[F.col(c).alias(f"k_{c}") for c in ("low", "high", "first", "last")])
    near = (F.col("k_low") - F.col("high") <= reach) & (F.col("low") - F.col("k_high") <= reach)
    met = spans.select("dim", "range", "low", "high").join(F.broadcast(other), "dim").where(near).groupBy("dim", "range").agg(F.min("k_first").alias("first"), F.max("k_last").alias("last"))
    return placed.join(F.broadcast(met), ["dim", "range"])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Links of every row of ``vectors`` (vec_id, embedding; other columns, labels included, are ignored).

    n_links counts the other vectors with cosine >= threshold, equal ones included; component_id is the smallest
    vec_id that links reach. Null, empty, zero and non-finite vectors link with nothing; finite ones of any magnitude
    do; vectors link only with those of their own length. Repeated rows are vectors of their own with one vec_id; a
    null vec_id links with nothing, and its component_id and kept are null. An empty table gives an empty result.
    """
    spark: SparkSession = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(_usable() & F.col("vec_id").isNotNull(), v).alias("v"))
    rows = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), F.reverse("v"))})
    # Equal vectors are compared once: their group's smallest vec_id stands for them. Rows find it by two hashes.
    groups = rows.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    groups = materialised(groups.withColumn("dim", F.size("v")), "vectors")
    members = salted_join(rows.where("v IS NOT NULL").drop("v"), groups.select("h1", "h2", "rep", "copies"), ["h1", "h2"], F.col("vec_id"), salts=8).select("vec_id", "rep", "copies")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    if groups.isEmpty():
        return alone
    common = groups.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()["dim"]
    axes = rotation(groups.where(F.col("dim") == common))
    led = groups.select("dim", "rep", "copies", "v").mapInArrow(_leading(axes), "dim int, rep long, copies long, v array<double>, lead double")
    numbered = _tiled(materialised(led, "led"), tile, math.sqrt(2 * (1 - threshold)) + SLACK)
    # Each tile meets every other that is near enough once: it goes to the pairs (tile, k) and (k, tile).
    pairs = numbered.withColumn("k", F.explode(F.sequence("first", "last"))).select(
        "dim",
        "rep",
        "copies",
        "lead",
        "v",
        F.least("tile", "k").alias("low"),
        F.greatest("tile", "k").alias("high"),
        F.when(F.col("tile") <= F.col("k"), 0).otherwise(1).alias("side"),
    )
    found = pairs.groupBy("dim", "low", "high").applyInPandas(_compare(axes, threshold), "rep long, n long, root long")
    found = materialised(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    edges = found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))
    labels = components(edges).withColumnsRenamed({"node": "rep"})
    linked = salted_join(members, counts.join(labels, "rep", "left"), ["rep"], F.col("vec_id"), how="left")
    return linked.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "rep")).alias("kept"),
    ).unionByName(alone)
