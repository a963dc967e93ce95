"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most CAPACITY tokens in one distributed pass. Which lengths share a sequence is
decided on the histogram of piece lengths, at most CAPACITY numbers however large the corpus is, by branch and bound:
a node takes the largest length left and branches over the undominated fillings around it, those of least waste first;
each is repeated as often as the histogram allows. A branch is pruned when its waste leaves no way below the incumbent,
which begins as the best-fit packing. Pieces then find their sequence by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm.common import gapless, materialised
from tremorlake.llm.tokens import WordTable, ragged, slices

CAPACITY = 2048
END_ID = 0
#: Words that are encoded together, with a special token between them.
CHUNK_WORDS = 2000
#: Distinct words of each worker whose shortcut ids are compared with the plain tokenizer's before any are used.
CHECKED_WORDS = 2000
#: Fillings, dominated ones too, that the search tries besides each node's first; None searches until no branch is left.
SEARCH_FILLINGS = 2_000
#: Nodes, the deepest ones, that such a bounded search goes back to; each holds a copy of the histogram and its sums.
SEARCH_DEPTH = 64
#: Runs of letters that are encoded together, with spaces between them.
CHUNK_LETTERS = 100
#: Latin characters without the apostrophe (it begins contractions) and without those that change under NFC or whose
#: lower case is not a letter.
LATIN = r"^[!-&(-~\x{A1}-\x{12F}\x{131}-\x{24F}]+$"
NOTHING = (np.zeros(0, np.int64), np.zeros(0, np.int64))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def word_encoder(path: str):
    """Encodes single words by the tokenizer in ``path``, whose tokens never span white space."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    gap = max(special, key=special.get)

    def together(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Another operator of a reused worker may want threads; here one task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        chunks = [gap.join(words[i : i + CHUNK_WORDS]) for i in range(0, len(words), CHUNK_WORDS)]
        found = tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        ids = np.concatenate([np.array([*x.ids, special[gap]], np.int64) for x in found])
        cuts = np.flatnonzero(ids == special[gap])
        return np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1

    # A run of Latin letters is one unit to the model, whatever the normaliser and the splitting pattern do otherwise.
    bare = Tokenizer.from_file(path)
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ending = np.zeros(tokenizer.get_vocab_size(), bool)
    ending[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def letters(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters, joined by spaces; a run ends where a token does that closes a word."""
        low = [w.lower() for w in runs]
        chunks = [" ".join(low[i : i + CHUNK_LETTERS]) for i in range(0, len(low), CHUNK_LETTERS)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in bare.encode_batch_fast(chunks, add_special_tokens=False)), np.int64)
        lengths = np.diff(np.flatnonzero(ending[ids]), prepend=-1)
        return (ids, lengths) if len(lengths) == len(runs) else together(runs)

    def merged(mask: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and starts and lengths of items: ``a`` where ``mask`` holds, ``b`` elsewhere."""
        lengths, starts = np.empty(len(mask), np.int64), np.empty(len(mask), np.int64)
        lengths[mask], lengths[~mask] = a[1], b[1]
        starts[mask], starts[~mask] = np.cumsum(a[1]) - a[1], len(a[0]) + np.cumsum(b[1]) - b[1]
        return np.concatenate([a[0], b[0]]), starts, lengths

    def latin(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of LATIN characters: each distinct run of letters, or of others, is encoded once."""
        parts = _without_empty(pc.ascii_split_whitespace(pc.replace_substring_regex(words, r"(\p{L}+)", r" \1 ")))
        coded = parts.flatten().dictionary_encode()
        units = coded.dictionary
        is_run = pc.match_substring_regex(units, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        a, b = units.filter(pa.array(is_run)).to_pylist(), units.filter(pa.array(~is_run)).to_pylist()
        ids, starts, lengths = merged(is_run, letters(a) if a else NOTHING, together(b) if b else NOTHING)
        at = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], np.cumsum(lengths[at])])
        return ids[ragged(starts[at], lengths[at])], np.diff(before[ends], prepend=0)

    checked = 0

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row and how many each has; a worker's first words are encoded both ways."""
        nonlocal checked
        ids, lengths = quick(words)
        if checked < CHECKED_WORDS and words:
            some = words[: CHECKED_WORDS - checked]
            checked += len(some)
            plain, plain_lengths = others(some)
            if not (np.array_equal(plain_lengths, lengths[: len(some)]) and np.array_equal(plain, ids[: len(plain)])):
                raise ValueError("the tokenizer does not encode runs of letters by themselves")
        return ids, lengths

    def quick(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(words, pa.string())
        simple = pc.and_(pc.match_substring_regex(column, LATIN), pc.invert(pc.match_substring(column, "<|"))).to_numpy(zero_copy_only=False)
        rest = column.filter(pa.array(~simple)).to_pylist()
        ids, starts, lengths = merged(simple, latin(column.filter(pa.array(simple))) if simple.any() else NOTHING, others(rest) if rest else NOTHING)
        return ids[ragged(starts, lengths)], lengths

    def others(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(x in "\0".join(words) for x in special):
            return together(words)
        # A word that holds a special token's string is encoded by itself.
        parts: list[np.ndarray] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if not any(x in w for x in special)]
        if plain:
            ids, lengths = together([words[i] for i in plain])
            for i, part in zip(plain, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                parts[i] = part
        for i in set(range(len(words))) - set(plain):
            parts[i] = np.array(tokenizer.encode(words[i], add_special_tokens=False).ids, np.int64)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    return encode


@lru_cache(1)
def _table(path: str) -> WordTable:
    """One table for all tasks of a worker."""
    return WordTable(word_encoder(path))


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(path)
        for batch in slices(batches, "text"):
            words = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            words = _without_empty(words)
            ids, ends = table.texts(words)
            ids = np.ascontiguousarray(ids, "<u4")
            rows: list[tuple] = []
            start = 0
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                whole = np.append(ids[start:end], np.uint32(END_ID)).astype("<u4")
                for piece, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    rows.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
                start = end
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _without_empty(words: pa.ListArray) -> pa.ListArray:
    """Without the empty strings that splitting leaves at the ends of a text."""
    flat, lengths = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    mask = keep.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(mask)])
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), flat.filter(keep))


def _sums(room: int, lengths: list[int], counts: dict[int, int]) -> list[int]:
    """For each tail of ``lengths`` the sums up to ``room`` that it reaches within its counts, as bits."""
    within = (1 << (room + 1)) - 1
    sums = [1]
    for n in reversed(lengths):
        reached, rest, step = sums[-1], min(counts[n], room // n), 1
        while rest:
            step = min(step, rest)
            reached |= (reached << (n * step)) & within
            rest -= step
            step *= 2
        sums.append(reached)
    return sums[::-1]


def dominated(filling: list[int], waste: int, spare: int) -> bool:
    """May a length that is left go into the waste too, or replace one or several shorter ones of ``filling``?

    ``spare``: bits of the lengths that are left besides the filling. What such a replacement frees is shorter and
    goes wherever the longer one would have gone, so the filling with the longer length is at least as good.
    """
    if spare & ((1 << (waste + 1)) - 1):
        return True
    one, more = 0, 0
    for n in filling:
        more |= (more | one) << n
        one |= 1 << n
    for _ in range(waste):
        more |= more << 1
    # A single length is replaced by a strictly longer one only.
    single = 0
    for n in set(filling):
        single |= ((1 << (waste + 1)) - 1) << n & ~(1 << n)
    return bool((more | single) & spare)


def fillings(room: int, counts: dict[int, int], most_waste: int) -> Iterator[list[int] | None]:
    """Undominated fillings of ``room`` (lengths falling) with at most ``most_waste`` left, the fullest first; of
    equally full ones, those with longer lengths first. A table of sums keeps to lengths that can be completed. None
    stands for a dominated filling."""
    lengths = sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True)
    sums = _sums(room, lengths, counts)
    first = True
    for total in range(room, max(-1, room - most_waste - 1), -1):
        if not sums[0] >> total & 1:
            continue
        stack: list[tuple[int, int, list[int]]] = [(0, total, [])]
        while stack:
            k, left, used = stack.pop()
            if left == 0:
                left_over = dict(counts)
                for n in used:
                    left_over[n] -= 1
                spare = sum(1 << n for n in lengths if left_over[n] > 0)
                yield used if first or not dominated(used, room - total, spare) else None
                first = False
                continue
            if k == len(lengths):
                continue
            n = lengths[k]
            # Pushed with few of this length first, so that many are tried first.
            stack += [(k + 1, left - n * c, used + [n] * c) for c in range(min(counts[n], left // n) + 1) if sums[k + 1] >> (left - n * c) & 1]


Packing = list[tuple[int, list[int]]]


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Packing:
    """Best-fit decreasing: each length goes to the fullest sequence that has room. Equal sequences are one group."""
    groups: dict[int, list[tuple[int, list[int]]]] = {}
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left > 0:
            room = min((r for r in groups if r >= n), default=None)
            if room is None:
                k = min(capacity // n, left)
                times = left // k
                groups.setdefault(capacity - n * k, []).append((times, [n] * k))
                left -= times * k
                continue
            times, pattern = groups[room].pop()
            if not groups[room]:
                del groups[room]
            k = min(room // n, max(1, left // times))
            taken = min(times, left // k)
            groups.setdefault(room - n * k, []).append((taken, pattern + [n] * k))
            if times > taken:
                groups.setdefault(room, []).append((times - taken, pattern))
            left -= taken * k
    return [g for room in sorted(groups) for g in groups[room]]


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: by tokens, and by lengths that cannot share one with another of them.

    For each t: lengths above capacity - t and above half stand alone; what the latter leave may hold lengths of t to half.
    """
    best = -(-sum(n * c for n, c in histogram.items()) // capacity)
    for t in {0, *(n for n in histogram if 2 * n <= capacity)}:
        alone = sum(c for n, c in histogram.items() if n > capacity - t)
        half = [(n, c) for n, c in histogram.items() if 2 * n > capacity and n <= capacity - t]
        small = sum(n * c for n, c in histogram.items() if t <= n and 2 * n <= capacity)
        room = sum((capacity - n) * c for n, c in half)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(small - room) // capacity)))
    return best


def size_of(packing: Packing) -> int:
    return sum(times for times, _ in packing)


def completion(histogram: dict[int, int], capacity: int = CAPACITY, search: int | None = SEARCH_FILLINGS) -> Packing:
    """(times, lengths) of the sequences: every length of ``histogram`` as often as it is counted.

    Bin completion by depth-first branch and bound, as the module says. The search ends at the lower bound, when no
    branch is left, or after ``search`` fillings beyond the first descent, with the incumbent as it is then.
    """
    histogram = {n: c for n, c in histogram.items() if c > 0}
    total, least = sum(n * c for n, c in histogram.items()), lower_bound(histogram, capacity)
    incumbent = best_fit(histogram, capacity)
    best, tried = size_of(incumbent), 0

    def branches(counts: dict[int, int], waste: int) -> Iterator[tuple[int, list[int], dict[int, int], int]]:
        """(times, lengths, counts left, waste) of the node's children that may still beat the incumbent."""
        nonlocal tried
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        allowed = (best - 1) * capacity - total - waste
        for nth, filling in enumerate(fillings(capacity - largest, rest, min(capacity - largest, max(0, allowed)))):
            tried += nth > 0
            if search is not None and tried > search:
                return
            if filling is None:
                continue
            pattern = [largest, *filling]
            uses = {n: pattern.count(n) for n in pattern}
            most = min(counts[n] // k for n, k in uses.items())
            # As often as it goes; else once, and the child chooses anew.
            for times in dict.fromkeys((most, 1)):
                lost = waste + (capacity - sum(pattern)) * times
                if total + lost <= (best - 1) * capacity:
                    left = {n: c - uses.get(n, 0) * times for n, c in counts.items()}
                    yield times, pattern, {n: c for n, c in left.items() if c}, lost

    # A bounded search never gets far up again, so it does not hold the nodes there.
    stack: deque = deque([branches(histogram, 0)] if best > least else [], None if search is None else SEARCH_DEPTH)
    chosen: Packing = []
    while stack and best > least and (search is None or tried <= search):
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        times, pattern, counts, waste = child
        chosen.append((times, pattern))
        if counts:
            stack.append(branches(counts, waste))
            continue
        incumbent, best = list(chosen), size_of(chosen)
        chosen.pop()
    return incumbent


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): ids of the text and END_ID, cut after ``capacity`` ids."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(tokenizer, capacity), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, search: int | None = SEARCH_FILLINGS) -> DataFrame:
    """Sequence and offset of every piece of ``docs`` (doc_id, text; other columns are ignored).

    Null texts count as empty and give one piece of the end id. Repeated rows and null doc_ids are packed each. A very
    long text is one row's work and gives as many pieces as it needs. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    pieces = materialised(token_pieces(docs, tokenizer, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places: dict[int, list[tuple]] = {n: [] for n in histogram}
    sequence, ranks = 0, dict.fromkeys(histogram, 0)
    for times, pattern in completion(histogram, capacity, search):
        offset, uses = 0, {n: pattern.count(n) for n in pattern}
        for n, k in uses.items():
            places[n].append((ranks[n], k, sequence, offset))
            ranks[n] += k * times
            offset += n * k
        sequence += times
    # A row per length with its patterns in order of rank: at most as many rows as the capacity.
    by_length = spark.createDataFrame([(n, x, [y[0] for y in x]) for n, x in places.items()], "length long, places array<struct<first:long,uses:long,base:long,shift:long>>, firsts array<long>")
    ranked = gapless(pieces, ["length"], ["row"], "rank")
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("at", F.element_at("places", F.size(F.filter("firsts", lambda x: x <= F.col("rank")))))
    nth = F.col("rank") - F.col("at.first")
    # Other pieces of the same length in the sequence come before this one.
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("at.base") + F.floor(nth / F.col("at.uses"))).cast("long").alias("sequence_id"),
        (F.col("at.shift") + F.pmod(nth, F.col("at.uses")) * F.col("length")).cast("long").alias("offset"),
    )
