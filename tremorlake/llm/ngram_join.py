"""N-gram Jaccard join by MinHash banding.

Texts with equal sets of word n-grams form a class; one text of a class is signed and compared. Band hashes are
shuffled; the texts of a bucket join the group of the bucket's smallest text, so a group holds texts that share a band
with one text, and every pair that shares a band meets in a group. All pairs of a group are verified on the full sets,
tile by tile; a pair that meets in several groups counts in the first one.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import gapless, materialised, salted_join
from tremorlake.llm.components import components, local_roots
from tremorlake.llm.tokens import ragged, slices

WORDS = 5
SIMILARITY = 0.8
#: At a Jaccard similarity of 0.8, 30 bands of 7 rows share a band with probability 0.9992; at 0.3 with 0.007.
BANDS, ROWS = 30, 7
#: n-grams that one task compares with each other or with as many others; a text counts as TEXT_GRAMS at least, so
#: a tile holds 512 texts or fewer. A text of more n-grams is a tile of its own.
TILE_GRAMS, TEXT_GRAMS = 1 << 18, 1 << 9


def band_recall(similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> float:
    return 1 - (1 - similarity**rows) ** bands


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _word_points() -> np.ndarray:
    """For every code point: is it a letter or a digit (categories L and N)?"""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters and digits) of all texts in a row, and each text's number of words.

    A word's hash is the sum of its characters times a multiplier per position, mixed.
    """
    lowered = ["" if t is None else t.lower() for t in texts.to_pylist()]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le"), np.uint32)
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = _word_points()[points]
    turns = np.diff(inside)
    starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(lowered), np.int64)
    sizes = stops - starts
    places = ragged(np.zeros(len(starts), np.int64), sizes)
    factors = mix(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    letters = points[inside[1:-1].view(bool)].astype(np.uint64) * factors[places]
    hashes = mix(np.add.reduceat(letters, np.cumsum(sizes) - sizes))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _chained(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(31) + words[k : len(words) - n + 1 + k])
    return out


def gram_sets(words: np.ndarray, counts: np.ndarray, n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; a shorter text has one gram of all its words.

    ``words``: the words' hashes of all texts in a row, ``counts`` of each text.
    """
    chained = _chained(words, n) if len(words) >= n else np.zeros(0, np.uint64)
    out, start = [], 0
    for count in counts.tolist():
        if count >= n:
            out.append(_distinct(chained[start : start + count - n + 1]))
        else:
            out.append(_chained(words[start : start + count], count) if count else np.zeros(0, np.uint64))
        start += count
    return out


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text", 2 << 20):
        yield batch, gram_sets(*word_hashes(batch.column("text")))


@cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240501).integers(0, 2**32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The BANDS band hashes of each set of grams, a row per set; sets are not empty.

    Each of BANDS * ROWS orders of the grams (an odd multiplier over 32 bits of their hashes) gives its smallest value.
    """
    mins = np.full((len(sets), BANDS * ROWS), np.uint32(2**32 - 1))
    step = 512
    work = np.empty((BANDS * ROWS, step), np.uint32)
    for least, grams in zip(mins, sets, strict=True):
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(short), step):
            part = short[k : k + step]
            product = np.multiply(part, _multipliers(), out=work[:, : len(part)])
            np.minimum(least, product.min(1), out=least)
    bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), 1))
    for r in range(ROWS):
        bands = mix(bands * np.uint64(31) + mins[:, r::ROWS])
    return bands.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document two hashes of its set of n-grams, their number and its band hashes; null where it has no words."""
    for batch, sets in _text_grams(batches):
        full = [g for g in sets if len(g)]
        some = pa.array([len(g) > 0 for g in sets], pa.bool_())
        at = pc.if_else(some, pc.subtract(pc.cumulative_sum(some.cast(pa.int64())), 1), None)
        sums = np.fromiter((g.sum(dtype=np.uint64) for g in full), np.uint64, len(full))
        mixed = np.fromiter((np.bitwise_xor.reduce(mix(g)) for g in full), np.uint64, len(full))
        bands = pa.ListArray.from_arrays(np.arange(len(full) + 1, dtype=np.int32) * BANDS, signatures(full).reshape(-1)) if full else pa.array([], pa.list_(pa.int64()))
        columns = [pa.array(sums.view(np.int64)), pa.array(mixed.view(np.int64)), pa.array([len(g) for g in full], pa.int64()), bands]
        yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "h1", "h2")], *[c.take(at) for c in columns]], names=["doc_id", "h1", "h2", "a", "b", "n", "bands"])


def _grams_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _text_grams(batches):
        names = [n for n in batch.schema.names if n != "text"]
        grams = pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))
        yield pa.record_batch([*[batch.column(n) for n in names], grams], names=[*names, "grams"])


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with Jaccard >= threshold: i < j within ``left``, or of left x right.

    Shared grams are counted by products of incidence matrices, over blocks of the grams that two texts share.
    """
    sets = left if right is None else [*left, *right]
    sizes = np.array([len(g) for g in sets], np.float64)
    values = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), [len(g) for g in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    column, owners = column[keep], owners[keep]
    _, column = np.unique(column, return_inverse=True)
    n, m = len(left), len(sets)
    shared = np.zeros((n, n if right is None else m - n), np.float32)
    order = np.argsort(column, kind="stable")
    column, owners = column[order], owners[order]
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        block = np.zeros((m, width), np.float32)
        block[owners[a:b], column[a:b] - low] = 1
        shared += block[:n] @ (block[:n] if right is None else block[n:]).T
    total = sizes[:n, None] + (sizes[:n] if right is None else sizes[n:])[None, :]
    hit = shared >= threshold * (total - shared) - 1e-6
    if right is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def _met_before(left: list[np.ndarray], right: list[np.ndarray], group: int) -> np.ndarray:
    """For each pair of left x right: do both belong to a group before ``group``? By incidence of these groups."""
    earlier = [[int(g) for g in groups if g < group] for groups in [*left, *right]]
    column = {g: k for k, g in enumerate(sorted({g for gs in earlier for g in gs}))}
    x = np.zeros((len(earlier), len(column)), np.float32)
    for row, gs in zip(x, earlier, strict=True):
        row[[column[g] for g in gs]] = 1
    return x[: len(left)] @ x[len(left) :].T > 0


def _verify(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        empty = pd.DataFrame({"rep": [], "n": [], "root": []}).astype("int64")
        if left.empty or (len(left) < 2 and right.empty):
            return empty
        grams = lambda part: [np.asarray(g, np.int64).view(np.uint64) for g in part["grams"]]
        i, j = similar(grams(left), None if right.empty else grams(right), threshold)
        other = left if right.empty else right
        fresh = ~_met_before(list(left["groups"]), list(other["groups"]), key[0])[i, j]
        i, j = i[fresh], j[fresh]
        both = left if right.empty else pd.concat([left, right])
        j = j if right.empty else j + len(left)
        ids, copies = both["rep"].to_numpy(), both["copies"].to_numpy()
        n = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        linked = n > 0
        roots = ids[local_roots(len(ids), i, j, ids)]
        return pd.DataFrame({"rep": ids[linked], "n": n[linked].astype("int64"), "root": roots[linked]})

    return run


def _identity() -> list[Column]:
    """Two hashes of doc_id and text, by which a row's text is found again."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [F.xxhash64(doc_id, doc_id.isNull(), text).alias("h1"), F.xxhash64(F.lit(1), text, doc_id.isNull(), doc_id).alias("h2")]


def classes(docs: DataFrame) -> DataFrame:
    """row, doc_id, h1, h2, rep, first_id, copies, n, bands: rows with equal sets of n-grams share ``rep``, the row number of one
    of them, which alone keeps its band hashes; first_id is their smallest doc_id. Null rep without words. Texts are read and
    signed once."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_identity())
    signed = keyed.mapInArrow(_signed, "doc_id long, h1 long, h2 long, a long, b long, n long, bands array<long>")
    signed = materialised(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    sets = signed.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    known = salted_join(signed, sets.where("copies > 1"), ["a", "b"], F.col("row"), salts=16, how="left")
    single, rep = F.col("copies").isNull(), F.coalesce("rep", F.when(F.col("a").isNotNull(), F.col("row")))
    found = known.select("row", "doc_id", "h1", "h2", rep.alias("rep"), F.when(single, F.col("doc_id")).otherwise(F.col("first_id")).alias("first_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n", F.when(rep == F.col("row"), F.col("bands")).alias("bands"))
    return materialised(found, "classes")


def candidates(signed: DataFrame) -> DataFrame:
    """rep, group: a text (rep, bands) belongs to the group of the smallest text of each of its buckets that it shares."""
    spread = signed.select("rep", F.explode("bands").alias("h"))
    shared = spread.groupBy("h").agg(F.min("rep").alias("group"), F.count("*").alias("n")).where("n > 1").drop("n")
    return salted_join(spread, shared, ["h"], F.col("rep"), salts=4).select("rep", "group").distinct()


def placed(groups: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, groups, places: for each text its groups, and in each of these its tile and how many tiles there are."""
    weighed = groups.join(reps.select("rep", F.greatest("n", F.lit(TEXT_GRAMS)).alias("w")), "rep")
    weighed = materialised(weighed, "groups")
    at = gapless(weighed, ["group"], ["rep"], "at", weight="w").withColumn("tile", F.floor(F.col("at") / TILE_GRAMS).cast("int"))
    large = at.groupBy("group").agg((F.max("tile") + 1).alias("tiles")).where("tiles > 1")
    tiled = salted_join(at, large, ["group"], F.col("rep"), salts=8, how="left")
    place = F.struct("group", "tile", F.coalesce("tiles", F.lit(1)).alias("tiles"))
    return tiled.groupBy("rep").agg(F.collect_list("group").alias("groups"), F.collect_list(place).alias("places"))


def verified(docs: DataFrame, wanted: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """rep, n, root per comparison: linked documents (copies included) and a text that the links reach.

    ``wanted``: rep, h1, h2, copies, groups, places. A group is cut into tiles, each pair of its tiles is one task's
    work, so no task holds a large group and no pair becomes a row.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), *_identity())
    # Rows that repeat doc_id and text are one class; one of them is enough.
    chosen = salted_join(texts, wanted, ["h1", "h2"], F.monotonically_increasing_id(), salts=4).dropDuplicates(["rep"])
    grams = chosen.select("rep", "copies", "groups", "places", "text").mapInArrow(_grams_out, "rep long, copies long, groups array<long>, places array<struct<group:long,tile:int,tiles:int>>, grams array<long>")
    dealt = grams.select("rep", "copies", "groups", "grams", F.inline("places")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "rep",
        "copies",
        "groups",
        "grams",
        "group",
        F.least("tile", "k").alias("low"),
        F.greatest("tile", "k").alias("high"),
        F.when(F.col("tile") <= F.col("k"), 0).otherwise(1).alias("side"),
    )
    return dealt.groupBy("group", "low", "high").applyInPandas(_verify(threshold), "rep long, n long, root long")


def _joined(docs: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``classes`` with component (null where no link leads), class_id and n_links."""
    members = classes(docs)
    reps = members.where("rep = row").select("rep", "h1", "h2", "first_id", "copies", "n", "bands")
    wanted = placed(candidates(reps.select("rep", "bands")), reps).join(reps.select("rep", "h1", "h2", "copies"), "rep")
    links = materialised(verified(docs, wanted, threshold), "text-links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("links"))
    labels = components(links.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    # The smallest doc_id of each component, nulls last.
    least = labels.join(reps.select("rep", "first_id"), "rep").groupBy("component").agg(F.min("first_id").alias("least"))
    found = salted_join(labels, least, ["component"], F.col("rep"), salts=8).join(counts, "rep", "left")
    out = salted_join(members.drop("bands", "n"), found, ["rep"], F.col("row"), how="left")
    return out.withColumns(
        {
            "class_id": F.coalesce("least", "first_id", "doc_id"),
            "n_links": (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long"),
        }
    )


def jaccard_join(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``docs`` (doc_id, text; other columns are ignored).

    n_links: other rows whose word 5-gram sets have a Jaccard similarity of at least ``threshold``, copies included.
    class_id: the smallest doc_id that links reach, null where only null ones are reached. Documents without words
    (null and empty texts too) link with nothing; texts of fewer than five words have one gram. Rows that repeat a
    doc_id, and rows with a null one, are documents of their own, whether their texts are equal or not. A very long
    text is signed and compared whole. An empty table gives an empty result.
    """
    return _joined(docs, threshold).select("doc_id", "class_id", "n_links")


def deduplicate(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each group of linked rows: that with the smallest doc_id (nulls last), one of equal rows.

    Rows without words stay, all of them. The columns of ``docs``, whatever their names. An empty table gives an
    empty result.
    """
    members = _joined(docs, threshold)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("b")
    kept = members.where("rep IS NOT NULL").groupBy(F.coalesce("component", "rep").alias("component")).agg(best, F.max(F.col("copies") > 1).alias("repeated"))
    wordless = members.where("rep IS NULL").select("h1", "h2", F.lit(False).alias("repeated")).distinct()
    keys = materialised(kept.select("b.h1", "b.h2", "repeated").unionByName(wordless), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *_identity())
    found = salted_join(rows, keys, ["h1", "h2"], F.monotonically_increasing_id(), salts=4)
    # Only classes of several rows may hold a row twice.
    once = found.where("repeated").dropDuplicates(["h1", "h2"])
    return found.where("NOT repeated").unionByName(once).select("doc.*")
