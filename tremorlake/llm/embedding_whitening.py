"""Embedding whitening: covariance by Chan's merging of partitions, eigenvectors on the driver, a second pass as proof.

Every partition computes the number of its vectors, their mean and their centred scatter; a tree merges them pair by
pair, so that no sum of squares of the large offsets is ever taken. What reaches the driver are a mean and a matrix of
the dimension's size for each length of vectors, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import materialised, removed

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries beyond this size of the scaled grid are set to it, so that they stay exact as doubles.
LARGEST = 1 << 52
#: Components whose eigenvalue is below this part of the largest one have no variance.
SMALLEST = 1e-13
#: For each length of vectors: count, mean, centred scatter, and exact sums where entries are whole numbers.
Moments = dict[int, tuple[int, np.ndarray, np.ndarray, list[int]]]


def usable(embedding: str = "embedding") -> Column:
    """Not null nor empty, all entries finite."""
    finite = F.forall(F.col(embedding), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & (F.size(embedding) > 0), F.lit(False))


def gridded(embedding: str = "embedding") -> Column:
    """Entries c as floor(64 c) + 1000000."""
    held = lambda c: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * SCALE))
    return F.transform(F.col(embedding), lambda c: (F.floor(held(c)) + OFFSET).cast("long"))


def own(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, list[int]]:
    """Moments of the rows of ``x``."""
    y = x.astype(np.float64)
    mean = y.mean(0)
    centred = y - mean
    # The mean is rounded; what it lacks is added to it and taken out of the scatter.
    rest = centred.mean(0)
    # Halves of 26 bits: sums of many large whole numbers do not overflow.
    total = [] if x.dtype.kind == "f" else [(int(a) << 26) + int(b) for a, b in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0), strict=True)]
    return len(x), mean + rest, centred.T @ centred - len(x) * np.outer(rest, rest), total


def merged(a: Moments, b: Moments) -> Moments:
    """Moments of both sides together."""
    out = dict(a)
    for dim, (n_b, mean_b, scatter_b, total_b) in b.items():
        if dim not in out:
            out[dim] = b[dim]
            continue
        n_a, mean_a, scatter_a, total_a = out[dim]
        n, apart = n_a + n_b, mean_b - mean_a
        scatter = scatter_a + scatter_b + np.outer(apart, apart) * (n_a * (n_b / n))
        out[dim] = (n, mean_a + apart * (n_b / n), scatter, [p + q for p, q in zip(total_a, total_b, strict=True)])
    return out


def by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row indices and matrix of the vectors of each length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def moments(vectors: DataFrame, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> Moments:
    """Moments of ``vectors`` (x), or those of ``transform`` of them, by the vectors' length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Moments = {}
        for batch in batches:
            for _, x in by_length(batch.column("x")):
                mine = merged(mine, {x.shape[1]: own(x if transform is None else transform(x))})
        rows = [{"dim": dim, "n": n, "mean": mean.tolist(), "scatter": scatter.ravel().tolist(), "total": list(map(str, total))} for dim, (n, mean, scatter, total) in mine.items()]
        types = {"dim": pa.int32(), "n": pa.int64(), "mean": pa.list_(pa.float64()), "scatter": pa.list_(pa.float64()), "total": pa.list_(pa.string())}
        yield pa.RecordBatch.from_pylist(rows, pa.schema(types))

    parts = vectors.select("x").mapInArrow(run, "dim int, n long, mean array<double>, scatter array<double>, total array<string>").rdd
    each = parts.map(lambda r: {r["dim"]: (r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1), list(map(int, r["total"])))})
    return {} if each.isEmpty() else each.treeReduce(merged, depth=3)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; null where a long does not hold it."""
    ends = [(int(a) * n, int(b) * n, s) for a, b, s in zip(x.min(0), x.max(0), total, strict=True)]
    most = max(max(abs(a - s), abs(b - s)) for a, b, s in ends)
    if most * most * len(ends) < 2**63 and max(max(map(abs, e)) for e in ends) < 2**63:
        d = n * x - np.array(total, np.int64)
        return (d * d).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


class Fit:
    """Principal components of the vectors of one length, at most ``most``, by falling eigenvalue."""

    def __init__(self, n: int, scatter: np.ndarray, total: list[int], most: int):
        self.n, self.total = n, total
        values, axes = np.linalg.eigh(scatter / n)
        values = np.maximum(values[::-1][:most], 0.0)
        self.axes = axes[:, ::-1][:, :most]
        # Subtracting the mean's whole part first loses no digits.
        self.whole, self.part = np.array([s // n for s in total], np.float64), np.array([s % n / n for s in total])
        trace = float(np.trace(scatter)) / n
        self.explained = values / trace if trace > 0 else np.zeros(len(values))
        self.varies = values > SMALLEST * values[0]
        self.scale = 1 / np.sqrt(np.where(self.varies, values, np.inf))
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """0 along components without variance."""
        return ((x.astype(np.float64) - self.whole - self.part) @ self.axes) * self.scale


def fits(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length of ``vectors`` (x); a second pass measures how far their whitened covariance is from the
    identity (on components that vary)."""
    found = {dim: Fit(n, scatter, total, most) for dim, (n, _, scatter, total) in moments(vectors).items()}
    for dim, (n, _, scatter, _) in moments(vectors, lambda x: found[x.shape[1]].whitened(x)).items():
        found[dim].error = float(np.abs(scatter / n - np.diag(found[dim].varies.astype(float))).max())
    return found


def _projected(found: dict[int, Fit]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in by_length(batch.column("x")):
                fit = found[x.shape[1]]
                k = len(fit.explained)
                y = fit.whitened(x)
                rows = len(at)
                yield pa.record_batch(
                    [
                        ids.take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, fit.n)),
                        pa.array(deviations(x, fit.n, fit.total), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(y.ravel()),
                        pa.array(np.tile(fit.explained, rows)),
                        pa.array(np.full(rows * k, fit.error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of ``vectors`` (vec_id, embedding; other
    columns are ignored), a row for each vector and component up to ``most``.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Entries are put on a grid of
    64ths; those beyond 2^46 are set to it. The fit takes each different vector once; vectors of several lengths are
    fitted by length. Null vec_ids and repeated rows are rows like others. Components without variance (of equal
    vectors, or of fewer vectors than dimensions) have whitened 0 and are left out of identity_error. deviation is null
    where a long does not hold it. An empty table gives an empty result.
    """
    rows = vectors.where(usable()).select("vec_id", gridded().alias("x"))
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    # Copies are dropped before the shuffle, so a vector that most rows hold stays one row for each task.
    listed = materialised(rows.select("x").distinct(), "fit-list")
    found = fits(listed, most)
    removed(listed)
    return rows.mapInArrow(_projected(found), schema)
