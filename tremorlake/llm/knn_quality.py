"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are hashed words, word pairs and n-grams of collapsed character classes, weighted by TF-IDF over all documents.
A truncated SVD of a bounded labelled sample gives latent-semantic axes; its vectors, with their labels, are
broadcast, and every document takes exact cosines with all of them, block by block. Its nearest neighbours vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.ngram_join import mix, word_hashes
from tremorlake.llm.tokens import slices

#: Labelled documents that are fitted and broadcast at most: those with the smallest hashes of their doc_id.
MAX_LABELLED = 2500
DIMENSIONS = 48
NEIGHBOURS = 25
#: Votes weigh cosine ** POWER; PRIOR votes of the mean label are added.
POWER, PRIOR = 8, 0.05
THRESHOLD = 0.3
#: Cosines are compared to so many places, so that the order in which products are summed decides nothing.
PLACES = 9
#: Buckets of class n-grams, words and word pairs, and two counts of repetition; each kind has unit length times its weight.
GRAM_TERMS, WORD_TERMS, PAIR_TERMS, GRAM = 4096, 4096, 4096, 5
KINDS = np.repeat(np.arange(4), [GRAM_TERMS, WORD_TERMS, PAIR_TERMS, 2])
WEIGHTS = np.array([1.0, 0.5, 0.5, 0.5])
TERMS = len(KINDS)
BLOCK = 256
#: Characters of a text that are counted at a time; a longer one is cut at white space, and no pair or n-gram spans a cut.
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Class of each byte: lower case, upper case, digit, space, line break, or the punctuation mark itself."""
    out = np.full(256, 1, np.uint64)  # bytes of letters beyond ASCII count as lower case
    out[:32], out[10], out[32], out[127] = 4, 5, 4, 4
    out[65:91], out[48:58] = 2, 3
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[marks] = np.arange(6, 6 + len(marks))
    return out


CLASSES = _classes()


def _grams(texts: pa.Array, owner: np.ndarray) -> np.ndarray:
    """owner * TERMS + term of each class n-gram; runs of a class are one symbol."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    whose = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    kinds = CLASSES[data]
    new = np.ones(len(kinds), bool)
    new[1:] = (kinds[1:] != kinds[:-1]) | (whose[1:] != whose[:-1])
    kinds, whose = kinds[new], whose[new]
    m = max(0, len(kinds) - GRAM + 1)
    code = np.zeros(m, np.uint64)
    for k in range(GRAM):
        code = code * np.uint64(64) + kinds[k : k + m]
    whole = whose[:m] == whose[GRAM - 1 :][:m]
    term = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)
    return (owner[whose[:m]] * TERMS + term)[whole]


def _counts(texts: pa.Array, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes owner * TERMS + term, counts) of the texts, whose rows are ``owner``."""
    hashes, n_words = word_hashes(texts)
    local = np.repeat(np.arange(len(texts)), n_words)
    whose = owner[local]
    bucket = lambda h, size: (h % np.uint64(size)).astype(np.int64)
    near = local[1:] == local[:-1]
    pairs = mix(hashes[:-1] * np.uint64(31) + hashes[1:])[near]
    codes = np.concatenate([_grams(texts, owner), whose * TERMS + GRAM_TERMS + bucket(hashes, WORD_TERMS), whose[1:][near] * TERMS + GRAM_TERMS + WORD_TERMS + bucket(pairs, PAIR_TERMS)])
    found = np.unique(codes, return_counts=True)
    # Words beyond the distinct ones, and words that repeat the one before.
    distinct = np.unique(mix(hashes) ^ mix(local.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    rows = np.arange(len(texts))
    again = np.bincount(local, minlength=len(rows)) - np.bincount(local[distinct], minlength=len(rows))
    twins = np.bincount(local[1:][near & (hashes[1:] == hashes[:-1])], minlength=len(rows))
    return [found, (owner * TERMS + TERMS - 2, again), (owner * TERMS + TERMS - 1, twins)]


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all terms of the texts, by row and term; null counts as empty."""
    pieces, owner = [], []
    for row, text in enumerate(pc.fill_null(texts, "").to_pylist()):
        while len(text) > PIECE:
            cut = max(text.rfind(" ", 0, PIECE), text.rfind("\n", 0, PIECE)) + 1 or PIECE
            pieces.append(text[:cut])
            owner.append(row)
            text = text[cut:]
        pieces.append(text)
        owner.append(row)
    parts, start, owners = [], 0, np.array(owner, np.int64)
    sizes = np.cumsum([len(p) for p in pieces])
    while start < len(pieces):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + PIECE, "right")))
        parts += _counts(pa.array(pieces[start:stop], pa.string()), owners[start:stop])
        start = stop
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    n = np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
    codes, n = codes[n > 0], n[n > 0]
    return codes // TERMS, codes % TERMS, n


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    for part in slices(batches, "_text", 4 << 20):
        for at in range(0, part.num_rows, BLOCK):
            block = part.slice(at, BLOCK)
            yield block, term_counts(block.column("_text"))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(TERMS + 1, np.int64)
    for block, (_, terms, _) in _blocks(batches):
        total[:TERMS] += np.bincount(terms, minlength=TERMS)
        total[TERMS] += block.num_rows
    yield pa.record_batch([pa.array(np.arange(TERMS + 1), pa.int32()), pa.array(total)], names=["term", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, (rows, terms, counts) in _blocks(batches):
        ends = pa.array(np.searchsorted(rows, np.arange(block.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (terms, counts)]
        yield pa.record_batch([*[block.column(c) for c in ("doc_id", "hash", "quality")], *lists], names=["doc_id", "hash", "quality", "terms", "counts"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def _projected(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, axes: np.ndarray, n: int) -> np.ndarray:
    """Row sums of values * axes[terms], in order of terms; rows ascend."""
    out = np.zeros((n, axes.shape[1]))
    step = 1 << 14
    starts = np.searchsorted(rows, np.arange(n + 1))
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + step, "right")) - 1)
        a, b = starts[first], starts[last]
        if b > a:
            some = first + np.flatnonzero(np.diff(starts[first : last + 1]))
            out[some] = np.add.reduceat(values[a:b, None] * axes[terms[a:b]], starts[some] - a)
        first = last
    return out


class Model:
    """IDF over all documents, latent axes, and the labelled vectors."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        """``docs``: doc_id, _text; ``labels``: doc_id, quality."""
        found = docs.select("_text").mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect()
        df = np.zeros(TERMS + 1)
        for term, n in found:
            df[term] = n
        self.idf = np.log((1 + df[TERMS]) / (1 + df[:TERMS])) + 1
        known = labels.select("doc_id", F.col("quality").cast("int")).where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
        known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
        # At most MAX_LABELLED rows, so the sample may be broadcast.
        texts = docs.join(F.broadcast(sample), "doc_id").withColumn("hash", F.xxhash64("_text"))
        # Rows that repeat a doc_id may be many: those with the smallest hashes of their texts are enough.
        chosen = texts.select("doc_id", "hash").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(MAX_LABELLED)
        rows = texts.join(F.broadcast(chosen), ["doc_id", "hash"]).select("doc_id", "hash", "quality", "_text").dropDuplicates(["doc_id", "hash"]).mapInArrow(_sparse, "doc_id long, hash long, quality int, terms array<int>, counts array<int>")
        rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "hash").toPandas()
        self.labels = rows["quality"].to_numpy(np.float64)
        self.axes, self.vectors = np.zeros((TERMS, 1)), np.zeros((len(rows), 1))
        if len(rows):
            owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t in rows["terms"]])
            terms, counts = (np.concatenate(list(rows.pop(c))) for c in ("terms", "counts"))
            values = self._weighted(owner, terms, counts, len(rows))
            self.axes = _leading_axes(owner, terms, values, len(rows), min(DIMENSIONS, len(rows)))
            self.vectors = _unit(_projected(owner, terms, values, self.axes, len(rows)))

    def _weighted(self, rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        values = np.log1p(counts) * self.idf[terms]
        kind = rows * len(WEIGHTS) + KINDS[terms]
        norms = np.sqrt(np.bincount(kind, values * values, n * len(WEIGHTS)))
        return values / norms[kind] * WEIGHTS[KINDS[terms]]

    def scores(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors; the mean label for texts without
        terms; without labels 0.5. All that are as near as the last of the neighbours vote."""
        if len(self.labels) == 0:
            return np.full(n, 0.5)
        rows, terms, counts = found
        weighted = np.zeros((n, TERMS))
        weighted[rows, terms] = self._weighted(rows, terms, counts, n)
        cosines = np.round(_unit(weighted @ self.axes) @ self.vectors.T, PLACES)
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(cosines, -k, axis=1)[:, -k]
        votes = np.where(cosines >= least[:, None], np.maximum(cosines, 0), 0) ** POWER
        prior = self.labels.mean()
        score = np.clip(((votes * self.labels).sum(1) + PRIOR * prior) / (votes.sum(1) + PRIOR), 0, 1)
        return np.round(np.where(np.bincount(rows, minlength=n) > 0, score, prior), PLACES)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _leading_axes(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    basis = np.random.default_rng(1).standard_normal((TERMS, dimensions))
    order = np.argsort(terms, kind="stable")
    by_term = terms[order], rows[order], values[order]
    for _ in range(8):
        left = _projected(rows, terms, values, basis, n)
        basis, _ = np.linalg.qr(_projected(*by_term, left, TERMS))
    return basis


def _carried(docs: DataFrame) -> DataFrame:
    """The rows as one column, so that their names cannot clash, with doc_id and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), F.struct(*docs.columns).alias("row"))


def _scored(docs: DataFrame, labels: DataFrame, keep: bool) -> DataFrame:
    rows = _carried(docs)
    model = Model(rows.select("doc_id", "_text"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in _blocks(batches):
            score = model.scores(found, block.num_rows)
            if keep:
                yield pa.record_batch([block.column("row").filter(pa.array(score >= THRESHOLD))], names=["row"])
            else:
                yield pa.record_batch([block.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    if keep:
        schema = rows.select("row").schema
        return rows.select("_text", "row").mapInArrow(run, schema).select("row.*")
    return rows.select("doc_id", "_text").mapInArrow(run, "doc_id long, score double, predicted int")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts to be good, with all their columns, whatever their names."""
    return _scored(docs, labels, True)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are not used).

    Labels (doc_id, quality 0 or 1) of rows that are not held out are learned, at most MAX_LABELLED; null labels and
    ids are left out, of repeated ones the larger label counts. Null and empty texts, and others without words or
    marks, have the mean label as score. Repeated rows repeat the score, null doc_ids are not held out. Neighbours of
    equal cosine all vote. A very long text is counted in pieces. An empty table gives an empty result, and without
    labels every score is 0.5.
    """
    return _scored(docs, labels, False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
