"""Encoding texts with a public byte-level BPE vocabulary: whole pre-tokens by a minimal perfect hash, the rest by merges."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

#: Fixed value: the pattern that splits texts before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one base64 token and its id a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, hash_key="perfect-hash-key", categorize=False)


def _slots(h: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """The slot of hashes under a displacement."""
    x = h + (shift + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype("i8")


class PerfectHash:
    """A minimal perfect hash of strings (hash and displace): n keys on n slots, looked up for arrays at once."""

    def __init__(self, keys: list[str]):
        n = self.size = len(keys)
        self.buckets = max(1, n // 4)
        words = np.array(keys, dtype=object)
        h = _hashes(words)
        bucket = (h % np.uint64(self.buckets)).astype("i8")
        order = np.argsort(bucket, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=self.buckets))])
        self.shift = np.zeros(self.buckets, "i8")
        taken = np.zeros(n, bool)
        self.slot_of_key = np.zeros(n, "i8")
        free = 0
        for b in sorted(range(self.buckets), key=lambda i: ends[i] - ends[i + 1]):
            own = order[ends[b] : ends[b + 1]]
            if not len(own):
                break
            if len(own) == 1:  # any free slot will do: it is stored itself
                while taken[free]:
                    free += 1
                self.shift[b], slots = -1 - free, np.array([free])
            else:
                first, trials = np.uint64(0), np.arange(32, dtype="u8")
                while True:
                    found = _slots(h[own][None], (first + trials)[:, None], n)
                    fits = ~taken[found].any(1)
                    s = np.sort(found, 1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(1)
                    if fits.any():
                        at = int(fits.argmax())
                        self.shift[b], slots = int(first) + at, found[at]
                        break
                    first += np.uint64(len(trials))
                    trials = np.arange(min(2 * len(trials), 8192), dtype="u8")
                    if first > 1 << 24:
                        raise ValueError("no displacement found")
            taken[slots] = True
            self.slot_of_key[own] = slots
        self.words = np.empty(n, dtype=object)
        self.words[self.slot_of_key] = words

    def find(self, words: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 for words that are no keys."""
        if not len(words) or not self.size:
            return np.full(len(words), -1)
        h = _hashes(words)
        shift = self.shift[(h % np.uint64(self.buckets)).astype("i8")]
        slot = np.where(shift < 0, -1 - shift, _slots(h, np.maximum(shift, 0).astype("u8"), self.size))
        return np.where(self.words[slot] == words, slot, -1)


class ByteBPE:
    """A byte-level BPE encoder made from the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, pattern
        keys, ids = [], []
        for token, rank in ranks.items():
            try:
                keys.append(token.decode())
                ids.append(rank)
            except UnicodeDecodeError:
                pass
        self.perfect = PerfectHash(keys)
        self.ids = np.zeros(len(keys), "i4")
        self.ids[self.perfect.slot_of_key] = ids
        self.split = regex.compile(pattern)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a piece that is no token: merges in the order of their ranks, by a heap over linked bytes."""
        n, ranks = len(piece), self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            left = parts[i]
            if left is None or (j := after[i]) >= n or ranks.get(joined := left + parts[j]) != rank:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(joined + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (r, h))
        return [ranks[p] for p in parts if p is not None]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, flat, and each text's offsets; null and empty texts have none."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                pieces += self.split.findall(text)
            ends.append(len(pieces))
        if not pieces:
            return np.empty(0, "i4"), np.zeros(len(texts) + 1, "i8")
        codes, unique = pd.factorize(np.array(pieces, dtype=object))
        slots = self.perfect.find(unique)
        size = np.ones(len(unique), "i8")
        missing = np.flatnonzero(slots < 0)
        merged = [self.merge(unique[i].encode("utf-8", "surrogatepass")) for i in missing]
        size[missing] = [len(m) for m in merged]
        start = np.concatenate([[0], np.cumsum(size)])
        values = np.zeros(start[-1], "i4")
        values[start[:-1][slots >= 0]] = self.ids[slots[slots >= 0]]
        for i, m in zip(missing, merged):
            values[start[i] : start[i + 1]] = m
        length = size[codes]
        out = np.concatenate([[0], np.cumsum(length)])
        flat = values[np.repeat(start[:-1][codes] - out[:-1], length) + np.arange(out[-1])]
        return flat, out[np.array(ends)]


def encode_corpus(df: DataFrame, id_col: str, text_col: str, ranks_path: str, batch_rows: int = 500) -> DataFrame:
    """``(id_col, ids)``: the token ids of every text, without special tokens; one row for each row of ``df``.

    A null or empty text has an empty list; a null id stays. Strings that look like special tokens are
    ordinary text. The vocabulary (some 50,000 tokens) is read on the driver and broadcast; texts never leave their
    partition, so nothing is shuffled.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ByteBPE(read_ranks(ranks_path)))
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                flat, ends = encoder.encode_batch(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    return spread(rows).mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, ids array<int>")
