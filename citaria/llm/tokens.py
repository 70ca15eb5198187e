"""Problem 6: token ids of whole texts by a public byte-level BPE, without special tokens.

Method: pair occurrence index. The distinct pre-tokens of a partition are laid out
as one array of byte symbols; an index maps each adjacent pair to all its positions;
the ranks of pairs that occur ("active" ranks) are taken in ascending order, every
position of the pair is merged left to right, and the position lists of the
neighbouring pairs are extended. Pre-tokens don't interact, so the result is that of
merging each one alone, but a pair that occurs in thousands of words is looked up once.

Defined results: null and empty text give an empty list of ids; strings that look like
special tokens are ordinary text; repeated rows are encoded each; other columns are
ignored and not returned.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citaria.session import is_local

#: Fixed value: the public pattern that splits text before the merges.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Folder of the vocabulary files; a parameter of every operator here.
TOKENIZERS = os.environ.get("CITARIA_TOKENIZERS", "/opt/tokenizers")
#: Words kept between batches of a partition, and code points handled at once: bounds on
#: a worker's memory only, they don't change results.
CACHED_WORDS, SLICE_CHARS = 400_000, 2_000_000


def printable_bytes() -> dict[str, int]:
    """The usual one-character names of the 256 bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairIndexBPE:
    """Encoder for a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, names = model["vocab"], printable_bytes()
        self.base = [0] * 256
        for name, byte in names.items():
            self.base[byte] = vocab[name]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[left] << 32 | vocab[right]] = (rank, vocab[left + right])
        self.split = regex.compile(PRETOKEN).findall
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.starts, self.lens = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The ids of all words, one after the other, and how many each has."""
        base, pairs = self.base, self.pairs
        sym: list[int] = []
        ends: list[int] = []
        for w in words:
            sym += [base[b] for b in w.encode("utf-8")]
            ends.append(len(sym))
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends:
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        where: dict[int, list[int]] = {}
        for i in range(n):
            if (j := after[i]) >= 0 and (key := sym[i] << 32 | sym[j]) in pairs:
                where.setdefault(key, []).append(i)
        active = [(pairs[k][0], k) for k in where]
        heapq.heapify(active)
        while active:
            _, key = heapq.heappop(active)
            spots = where.pop(key, None)
            if not spots:
                continue
            spots.sort()
            left, right, made = key >> 32, key & 0xFFFFFFFF, pairs[key][1]
            for i in spots:
                if sym[i] != left or (j := after[i]) < 0 or sym[j] != right:
                    continue
                sym[i], sym[j] = made, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (new := made << 32 | sym[k]) in pairs:
                        if new not in where:
                            where[new] = []
                            heapq.heappush(active, (pairs[new][0], new))
                        where[new].append(i)
                if (h := before[i]) >= 0 and (new := sym[h] << 32 | made) in pairs:
                    if new not in where:
                        where[new] = []
                        heapq.heappush(active, (pairs[new][0], new))
                    where[new].append(h)
        ids, lens, at = [], [], 0
        for e in ends:
            kept = [s for s in sym[at:e] if s >= 0]
            ids += kept
            lens.append(len(kept))
            at = e
        return ids, lens

    def learn(self, words: list[str]) -> None:
        ids, lens = self.merge_words(words)
        first = len(self.slot)
        self.slot.update((w, first + k) for k, w in enumerate(words))
        lens_ = np.asarray(lens, np.int64)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens_) - lens_])
        self.lens = np.concatenate([self.lens, lens_])
        self.flat = np.concatenate([self.flat, np.asarray(ids, np.int32)])

    def encode(self, texts: list[str | None], count_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each text has, all ids one after the other)."""
        words = [self.split(t) if t else [] for t in texts]
        each = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        seen = set(flat)
        if len(self.slot) + len(seen) > CACHED_WORDS:
            self.reset()
        if new := seen.difference(self.slot):
            self.learn(sorted(new))
        at = np.fromiter(map(self.slot.__getitem__, flat), np.int64, len(flat))
        lens = self.lens[at]
        total = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        edges = np.zeros(len(words) + 1, np.int64)
        np.cumsum(each, out=edges[1:])
        counts = total[edges[1:]] - total[edges[:-1]]
        if count_only:
            return counts, np.empty(0, np.int32)
        return counts, self.flat[np.repeat(self.starts[at] - total[:-1], lens) + np.arange(total[-1])]


@lru_cache(maxsize=4)
def encoder(path: str) -> PairIndexBPE:
    """The encoder of a vocabulary file, made once a worker; a machine without it has the copy that `shipped` sent."""
    return PairIndexBPE(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def shipped(df: DataFrame, path: str) -> str:
    """The path, after the driver's file was given to the executors of a cluster."""
    sc = df.sparkSession.sparkContext
    if not is_local(sc.master) and os.path.exists(path) and path not in getattr(sc, "_citaria_files", ()):
        sc.addFile(path)
        sc._citaria_files = {*getattr(sc, "_citaria_files", ()), path}
    return path


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cut a batch where its texts pass SLICE_CHARS, at least one row each."""
    size, at = 0, 0
    for k, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        if size and size + n > SLICE_CHARS:
            yield at, k
            size, at = 0, k
        size += n
    if len(texts) > at:
        yield at, len(texts)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids ARRAY<INT>), one row for each row of df. No shuffle."""
    path = shipped(df, f"{folder}/{tokenizer}.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                counts, ids = own.encode(part.column(1).to_pylist())
                edges = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=edges[1:])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(keep..., n_tokens BIGINT), one row for each row of df; 0 for null and empty text."""
    path = shipped(df, f"{folder}/{tokenizer}.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            last = batch.num_columns - 1
            for a, b in slices(batch.column(last)):
                part = batch.slice(a, b - a)
                counts, _ = own.encode(part.column(last).to_pylist(), count_only=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, n_tokens bigint")
