"""Spelling variant grouping: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times. One inserted or deleted letter
flips one bit, one replaced letter two at most, so of three bands of the mask at least one stays equal. Letters are
dealt to the bands by how evenly their parity splits the words. Words meet by an equal band and their lengths. The
words of a band's value are many, so they also agree in their letters around the edit: a word of length L is cut into
pieces of some three letters, and one edit leaves all pieces but one as they are. However many words there are, those
that meet differ in one piece only. Pairs that meet are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import materialised, removed

RUN = "[A-Za-zÀ-ÿ]+"
#: One of this many runs loses a letter, by its checksum.
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
BANDS, BAND_BITS = 3, 21
#: Letters of a piece, and pieces at most; longer words have longer pieces.
PIECE, MOST_PIECES = 3, 16
#: Words that a task counts before it hands their counts on.
WORDS_HELD = 400_000


def _counted(least_length: int, damaged: int):
    """word, n: counts of the words of each task's texts, a word once for each ``WORDS_HELD`` different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(RUN)
        held: Counter[str] = Counter()

        def batch_of(counts: Counter[str]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                # Lower-casing bytes changes A-Z only.
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % damaged == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > WORDS_HELD:
                    yield batch_of(held)
                    held = Counter()
        yield batch_of(held)

    return run


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word, n: the words of at least ``least_length`` code points and ``least_count`` occurrences in whole texts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").where("text IS NOT NULL")
    counts = rows.mapInArrow(_counted(least_length, damaged), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """letter, odd: in how many words of a task the letter occurs an odd number of times."""
    odd: Counter[str] = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            odd.update(c for c, k in Counter(word).items() if k % 2)
    yield pa.record_batch([pa.array(list(odd), pa.string()), pa.array(list(odd.values()), pa.int64())], names=["letter", "odd"])


def letter_bits(words: DataFrame) -> dict[str, int]:
    """The bit of each letter. Letters whose parity splits the words most evenly go round the bands first; letters beyond
    ``BANDS * BAND_BITS`` share bits. The letters of the words are those of ``RUN``, fewer than a hundred."""
    n = words.count()
    odd = words.select("word").mapInArrow(_odd, "letter string, odd long").groupBy("letter").agg(F.sum("odd").alias("odd")).collect()
    ranked = sorted(odd, key=lambda r: (abs(2 * r["odd"] - n), r["letter"]))
    return {r["letter"]: k % BANDS * BAND_BITS + k // BANDS % BAND_BITS for k, r in enumerate(ranked)}


def _masked(bits: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = {c: 1 << b for c, b in bits.items()}
        for batch in batches:
            masks = []
            for word in batch.column("word").to_pylist():
                mask = 0
                for c in word:
                    # A letter that is odd in no word needs no bit.
                    mask ^= flip.get(c, 0)
                masks.append(mask)
            yield pa.record_batch([*batch.columns, pa.array(masks, pa.int64())], names=[*batch.schema.names, "mask"])

    return run


def _band(mask: str, band: str) -> Column:
    return F.expr(f"shiftrightunsigned({mask}, {band} * {BAND_BITS}) & {(1 << BAND_BITS) - 1}")


def _meeting(words: DataFrame, longer: bool) -> DataFrame:
    """key, word, mask, n, band: a row for each band and piece of a word, cut as the shorter word of a pair is.

    ``longer``: the word is one letter longer than the one it is to meet, and has one letter more in the edited piece.
    """
    extra = 1 if longer else 0
    cut = words.withColumn("l", F.length("word") - extra).where(F.col("l") >= LEAST_LENGTH)
    cut = cut.withColumn("pieces", F.least(F.lit(MOST_PIECES), F.greatest(F.lit(2), F.ceil(F.col("l") / PIECE))).cast("int"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    low, high = (F.floor(F.col("l") * k / F.col("pieces")).cast("int") for k in (F.col("piece"), F.col("piece") + 1))
    before, after = F.substring("word", F.lit(1), low), F.substring("word", high + 1 + extra, F.col("l"))
    cut = cut.withColumn("rest", F.xxhash64("l", "piece", before, after)).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    return cut.select(F.xxhash64("rest", "band", _band("mask", "band")).alias("key"), "word", "mask", "n", "band")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: the pairs of ``words`` (word, n, mask) that one inserted, deleted or replaced letter separates, once."""
    short = _meeting(words, False)
    same, longer = (side.withColumnsRenamed({"word": "b", "n": "n_b", "mask": "mask_b"}).drop("band").withColumn("longer", F.lit(k)) for side, k in ((short, False), (_meeting(words, True), True)))
    met = short.withColumnsRenamed({"word": "a", "n": "n_a", "mask": "mask_a"}).join(same.unionByName(longer), "key")
    x = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    differs = lambda band: x.bitwiseAND(F.lit(((1 << BAND_BITS) - 1) << band * BAND_BITS)) != 0
    # In the first of the bands that are equal.
    first = (F.col("band") == 0) | differs(0) & ((F.col("band") == 1) | differs(1))
    found = met.where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.bit_count(x) <= F.when(F.col("longer"), 1).otherwise(2)) & first)
    return found.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b").dropDuplicates(["a", "b"])


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form; form null at the end of a chain).

    Every round doubles the steps that a word has gone. A form occurs at least twice as often as its word, so a chain is
    no longer than the logarithm of the largest count, and rounds are few.
    """
    now = materialised(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        old, now = now, materialised(step, "roots")
        removed(old)
        moved = not now.where("moved").isEmpty()
        now = now.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of Latin letters, A-Z lower-cased, of at least five code points and three occurrences; a run that
    97 divides the checksum of loses a letter. n_near counts the words one edit away. form is the most frequent of
    them, the first in code-point order of equal ones, if it is at least twice as frequent as the word. root is where
    forms lead, the word itself without one. Null and empty texts hold no words; a null doc_id counts as empty text in
    the checksum; repeated rows count again; texts and words of any length are taken whole; an empty table gives an
    empty result.
    """
    counted = materialised(words_of(docs), "words")
    bits = letter_bits(counted)
    words = materialised(counted.mapInArrow(_masked(bits), "word string, n long, mask long"), "masks")
    removed(counted)
    pairs = near_pairs(words)
    ends = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    # A word has few near words: those of one edit, and each once.
    best = pairs.select(F.inline(ends)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.select("word", "n").join(best, "word", "left")
    has = -F.col("best.m") >= 2 * F.col("n")
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"))
    formed = materialised(formed, "forms")
    removed(words)
    return formed.join(rooted(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")
