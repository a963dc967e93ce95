"""Token ids of many texts at once: words are encoded once and looked up after that.

For tokenizers in which no token spans the gap between two words, a text's ids are its words' ids in a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words held in a worker's table before it starts anew, and bytes of text encoded at a time.
MAX_WORDS = 400_000
BATCH_BYTES = 8 << 20


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each length, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class WordTable:
    """Ids of words, encoded by ``encode`` (ids of all words in a row, and how many each has) when first seen."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, "<u4")
        self.used = 0
        self.starts = np.zeros(MAX_WORDS, np.int64)
        self.lengths = np.zeros(MAX_WORDS, np.int64)

    def _add(self, fresh: list[str]) -> None:
        if not fresh:
            return
        ids, lengths = self.encode(fresh)
        at, past = len(self.index), len(self.index) + len(fresh)
        for name in ("starts", "lengths"):
            if past > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(past, np.int64)]))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at:past] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at:past] = lengths
        self.used += len(ids)
        self.index.update(zip(fresh, range(at, past), strict=True))

    def texts(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text ends. ``words``: a list of words for each text."""
        coded = pc.dictionary_encode(words.flatten())
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        seen = coded.dictionary.to_pylist()
        if len(self.index) + len(seen) > MAX_WORDS:
            self.clear()
        self._add([w for w in seen if w not in self.index])
        places = np.fromiter((self.index[w] for w in seen), np.int64, len(seen))
        at = places[coded.indices.to_numpy(zero_copy_only=False)] if len(seen) else np.zeros(0, np.int64)
        lengths = self.lengths[at]
        ids = self.ids[ragged(self.starts[at], lengths)]
        word_ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, before[word_ends]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where the texts of ``column`` exceed ``most`` bytes together; a longer text comes alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
