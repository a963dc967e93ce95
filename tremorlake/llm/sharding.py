"""Sharding by longest-processing-time scheduling: equal texts stay together, sizes end up near equal.

Groups of one size are interchangeable, so the schedule is made on the histogram of group sizes: all groups of a size
are dealt at once, just as the heap would deal them one by one. Groups then find their shard by their rank among the
groups of their size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import gapless, materialised, salted_join

SHARDS = 24
#: Sizes whose cuts are broadcast; more are joined. Distinct sizes are fewer than the square root of twice the bytes.
MAX_BROADCAST_SIZES = 200_000


def dealt(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard takes when each goes to the least-loaded shard, the first
    of equal ones; ``loads`` are those before.

    The heap takes the ``count`` smallest of the loads load, load + size, load + 2 size, ...: whole rounds below the
    level that they reach are counted, the few groups that are left go through the heap.
    """
    taken = [0] * len(loads)
    if count > 4 * len(loads):
        low, high = min(loads), max(loads) + size * count
        fit = lambda level: sum(max(0, -(-(level - x) // size)) for x in loads)
        while high - low > 1:
            level = (low + high) // 2
            low, high = (level, high) if fit(level) <= count else (low, level)
        taken = [max(0, -(-(low - x) // size)) for x in loads]
    heap = [(x + size * k, shard) for shard, (x, k) in enumerate(zip(loads, taken, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        taken[shard] += 1
    return taken


def scheduled(sizes: Iterable[int], counts: Iterable[int], shards: int) -> Iterator[list[int]]:
    """Longest processing time first over sizes that fall: the groups of each size that each shard takes."""
    loads = [0] * shards
    for size, count in zip(sizes, counts, strict=True):
        taken = dealt(loads, size, count)
        loads = [x + size * k for x, k in zip(loads, taken, strict=True)]
        yield taken


def schedule(histogram: dict[int, int], shards: int) -> tuple[dict[int, list[int]], list[int]]:
    """``scheduled`` over {size: groups}: per size the groups of each shard, and the final loads."""
    sizes = sorted(histogram, reverse=True)
    out = dict(zip(sizes, scheduled(sizes, [histogram[s] for s in sizes], shards), strict=True))
    return out, [sum(s * taken[k] for s, taken in out.items()) for k in range(shards)]


def cuts_of(sizes: np.ndarray, counts: np.ndarray, shards: int) -> tuple[pa.Table, pa.Table]:
    """bytes, shard of the sizes that one group has; bytes, cuts of the others: shard k takes the groups with numbers
    from cuts[k - 1] on and below cuts[k]. Numbers are held in arrays, as sizes may be millions."""
    order = np.argsort(-sizes)
    sizes, counts = sizes[order], counts[order]
    single = counts == 1
    alone, cuts = np.zeros(int(single.sum()), np.int32), np.zeros((int((~single).sum()), shards), np.int64)
    i = j = 0
    for one, taken in zip(single.tolist(), scheduled(map(int, sizes), map(int, counts), shards), strict=True):
        if one:
            alone[i] = taken.index(1)
            i += 1
        else:
            cuts[j] = np.cumsum(taken)
            j += 1
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cuts.size + 1, shards, dtype=np.int32)), pa.array(cuts.ravel()))
    return pa.table({"bytes": sizes[single], "home": alone}), pa.table({"bytes": sizes[~single], "cuts": lists})


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row of ``docs`` (doc_id, text; other columns are ignored), law ``bytes``.

    Size: UTF-8 bytes of the text (null: none) plus 8. Equal texts share a shard; loads differ by no more than the
    largest group. Slots of a shard run from 0 without gaps. Repeated rows are rows of their own, null doc_ids too;
    an empty table gives an empty result. A very long text is one large group. The driver sees the histogram of group
    sizes alone: s different sizes sum to s * s / 2 bytes at least, so 100 TB have 14 million sizes at most, which take
    some 200 MB there, and 200 more bytes for each size that several groups have.
    """
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
        F.monotonically_increasing_id().alias("_row"),
    )
    sized = materialised(sized, "shard-sizes")
    groups = materialised(sized.groupBy("_text").agg(F.sum("size").alias("bytes")), "shard-groups")
    histogram = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()
    alone, shared = cuts_of(histogram["bytes"].to_numpy(), histogram["n"].to_numpy(), shards)
    small = lambda t: F.broadcast(spark.createDataFrame(t)) if t.num_rows <= MAX_BROADCAST_SIZES else spark.createDataFrame(t)
    ranked = gapless(groups.join(small(shared), "bytes"), ["bytes"], ["_text"], "rank")
    homes = ranked.select("_text", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))).cast("int").alias("shard"))
    homes = homes.unionByName(groups.join(small(alone), "bytes").select("_text", F.col("home").alias("shard")))
    # A hot text is one key of one row, so its rows are spread.
    sharded = salted_join(sized, homes, ["_text"], F.col("_row"), salts=8).select("doc_id", "size", "text_crc32", "shard", "_row")
    slotted = gapless(sharded, ["shard"], ["_row"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
