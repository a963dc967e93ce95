"""SentencePiece models on the tokenizers library: encoding, decoding and parity with the original library.

The model's protobuf gives pieces, scores and normaliser. Unigram models become Unigram with their scores; BPE models
become merges ranked by the scores of what they make. Byte fallback and the metaspace marker are kept. Ids are the
backend's; where the original library's differ, the text is reported without parity.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.tokens import WordTable, slices

SPACE = "▁"
#: Threads that encode a batch of words.
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Score of pieces that a text never gives: any way around them is better.
NEVER = -1e9


def _proto(path: str):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def as_unigram(path: str) -> bytes:
    """The vocabulary of a BPE model file as a unigram model: the same pieces and normaliser, a piece of rank r with
    the log-probability of a Zipf law, 1 / (r + 2.7), in steps of 1 / 16. Nothing is trained.

    In such steps the sums of a hundred thousand pieces are exact in the original library's single precision too, so ways of equal score are ties for
    both libraries; with other scores its rounding decides between them, and parity is lost there."""
    model = _proto(path)
    model.trainer_spec.model_type = UNIGRAM
    rank = 0
    for piece in model.pieces:
        if piece.type in (NORMAL, USER_DEFINED):
            piece.score = -round(math.log(rank + 2.7) * 16) / 16
            rank += 1
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one model: a file's path, or a serialised model."""

    def __init__(self, model: str | bytes, threads: int = THREADS):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        if isinstance(model, bytes):
            from sentencepiece import sentencepiece_model_pb2

            self.model = sentencepiece_model_pb2.ModelProto()
            self.model.ParseFromString(model)
        else:
            self.model = _proto(model)
        spec = self.model.normalizer_spec
        if self.model.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("the marker must stand before a word")
        self.threads = threads
        self.original = sentencepiece.SentencePieceProcessor(model_proto=self.model.SerializeToString())
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.normalizer = self._normalizer()
        self.tokenizer = self._tokenizer()
        #: No piece goes on after a word, so words can be encoded by themselves.
        self.by_word = not any(SPACE in p.piece.lstrip(SPACE) for p in self.model.pieces)
        self.table = WordTable(self._words)
        self.mismatched: set[str] = set()
        #: Words whose ids the backend does not decode to the word.
        self.broken: set[str] = set()
        self.silent = np.array([i for i, p in enumerate(self.model.pieces) if p.type == CONTROL], np.int64)

    def _normalizer(self):
        """What the model does to a text before spaces become markers; None where it is the identity."""
        from tokenizers import Regex, normalizers

        spec = self.model.normalizer_spec
        steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence(steps) if steps else None

    def _tokenizer(self):
        from tokenizers import Tokenizer, decoders, models

        pieces, trainer = self.model.pieces, self.model.trainer_spec
        unknown = next(i for i, p in enumerate(pieces) if p.type == UNKNOWN)
        # Control and unused pieces keep their ids under names that no text holds.
        name = lambda i, p: f"\0{i}\0" if p.type in (CONTROL, UNUSED) else p.piece
        if trainer.model_type == UNIGRAM:
            vocabulary = [(name(i, p), p.score if p.type in (NORMAL, USER_DEFINED) else NEVER) for i, p in enumerate(pieces)]
            out = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=trainer.byte_fallback))
        elif trainer.model_type == BPE:
            if any(p.type == UNUSED for p in pieces):
                raise ValueError("a BPE model with unused pieces has no counterpart")
            ids = {name(i, p): i for i, p in enumerate(pieces)}
            merging = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER_DEFINED)}
            merges = []
            for piece, score in merging.items():
                halves = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
                merges += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in halves if a in merging and b in merging]
            merges.sort()
            out = Tokenizer(models.BPE(ids, [m[-2:] for m in merges], unk_token=pieces[unknown].piece, fuse_unk=True, byte_fallback=trainer.byte_fallback))
        else:
            raise ValueError(f"model type {trainer.model_type} has no counterpart")
        steps = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if self.prefix else steps)
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of marked words; each word is compared with the original library, and remembered where they differ."""
        # Another operator of a reused worker may have turned threads off.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        # A marker alone ends a text; as a text of its own it would be empty, so it has no counterpart to compare.
        plain = [w[len(self.prefix) :].replace(SPACE, " ") if w.startswith(self.prefix) and w != self.prefix else None for w in words]
        expected = iter(self.original.encode([w for w in plain if w is not None], num_threads=self.threads))
        self.mismatched.update(word for k, (word, w) in enumerate(zip(words, plain, strict=True)) if w is not None and found[k] != next(expected))
        # No id stands for parts of two words, so a text comes back if each of its words does.
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        spaced = [w.replace(SPACE, " ") for w in words]
        self.broken.update(word for word, w, b in zip(words, spaced, back, strict=True) if b != (w[1:] if self.prefix and w.startswith(" ") else w))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(lengths.sum())), lengths

    def _split(self, texts: pa.Array) -> pa.ListArray:
        """Marked words of each text: runs of markers with what follows them."""
        if self.normalizer is not None:
            texts = pa.array([self.normalizer.normalize_str(t) for t in texts.to_pylist()], pa.string())
        marked = pc.replace_substring(texts, " ", SPACE)
        empty = pc.equal(pc.binary_length(texts), 0)
        marked = pc.if_else(empty, "", pc.binary_join_element_wise(pa.scalar(self.prefix), marked, ""))
        if not self.by_word:
            lists = [[t] if t else [] for t in marked.to_pylist()]
            return pa.array(lists, pa.list_(pa.string()))
        free = [c for c in map(chr, range(1, 9)) if not pc.any(pc.match_substring(marked, c)).as_py()]
        if not free:
            import re

            cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
            return pa.array([cut.findall(t) for t in marked.to_pylist()], pa.list_(pa.string()))
        gapped = pc.replace_substring_regex(marked, f"([^{SPACE}]){SPACE}", rf"\1{free[0]}{SPACE}")
        lists = pc.split_pattern(gapped, free[0])
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = np.where(empty.to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        flat = flat.filter(pc.not_equal(pc.binary_length(flat), 0))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, where each ends, and whether every word had parity, and came back from its ids."""
        words = self._split(pc.fill_null(texts, ""))
        ids, ends = self.table.texts(words)
        return ids, ends, self._without(words, self.mismatched), self._without(words, self.broken)

    @staticmethod
    def _without(words: pa.ListArray, bad: set[str]) -> np.ndarray:
        """Whether each text has no word of ``bad``."""
        out = np.ones(len(words), bool)
        if bad:
            found = pc.is_in(words.flatten(), pa.array(sorted(bad))).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
            out[owner[found]] = False
        return out

    def unchanged(self, texts: list[str]) -> np.ndarray:
        """Whether the model's normaliser leaves each text as it is."""
        if self.normalizer is None:
            return np.ones(len(texts), bool)
        return np.array([self.normalizer.normalize_str(t) == t for t in texts], bool)

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The texts of rows of ids, by the backend; control ids are left out, and the space that encoding put first."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        spoken = [np.asarray(r, np.int64) for r in rows]
        return self.tokenizer.decode_batch([r[~np.isin(r, self.silent)].tolist() for r in spoken], skip_special_tokens=False)


def encode(docs: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id, ids, parity of every row of ``docs`` (doc_id, text); null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in slices(batches, "text"):
            ids, ends, parity, _ = codec.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), lists, pa.array(parity)], names=["doc_id", "ids", "parity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, parity boolean")


def decode(encoded: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            rows = batch.column("ids").to_pylist()
            texts = iter(codec.decode([r for r in rows if r is not None]))
            yield pa.record_batch([batch.column("doc_id"), pa.array([None if r is None else next(texts) for r in rows], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str | bytes) -> DataFrame:
    """n_tokens, ids_crc32 (little-endian 32-bit ids), parity and round_trip of every row of ``docs``.

    parity: every word has the original library's ids. round_trip: decoding the ids gives the text (the backend decodes
    each word once, and words in a row are the text). Null and empty
    texts have no ids and round-trip to the empty text. Whole texts are encoded; a text of any length is one row's
    work. Repeated rows repeat the result; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in slices(batches, "text"):
            ids, ends, parity, back = codec.encode(batch.column("text"))
            ids = np.ascontiguousarray(ids, "<u4")
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            parts = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
            same = back if codec.normalizer is None else back & codec.unchanged([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()), pa.array(parity), pa.array(same)],
                names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
