"""Connected components of a graph of links, in Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import materialised, removed, salted_join

MAX_ROUNDS = 60


def local_roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of n nodes with the links i-j: for each the index of the node with the smallest id in its component."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    if len(i):
        while True:
            old = label.copy()
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            # A label is the rank of a node of the component, whose own label may be smaller by now.
            label = np.minimum(label, label[order[label]])
            if (label == old).all():
                break
    return order[label]


def _toward_minimum(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's neighbours (the larger, or the smaller ones) are linked to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if larger else edges
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    met = salted_join(both, least, ["src"], F.col("dst"))
    if larger:
        out = met.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        moved = met.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        out = moved.unionByName(least.select("src", F.col("m").alias("dst")))
    return out.where("src <> dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that links reach, for every node of ``edges`` (src, dst).

    Alternating large-star and small-star steps: a node's links move to its smallest neighbour until each component
    is a star around its smallest node. A node with very many links is spread over partitions.
    """
    down = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = materialised(down, "edges")
    seen = _mark(now)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        old, now = now, materialised(_toward_minimum(_toward_minimum(now, True), False), "edges")
        removed(old)
        last, seen = seen, _mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number of links and an order-free hash of them, to see when a step changes nothing."""
    h = F.xxhash64("src", "dst")
    r = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF)))).first()
    return tuple(r)
