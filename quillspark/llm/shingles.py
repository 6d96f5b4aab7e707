"""Word shingles of whole texts as 64-bit hashes, computed for a batch of texts at once."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd

WORD = re.compile(r"[^\W_]+")
_KEY = "quillspark-words"  # 16 characters, the key of the word hash
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (maximal runs of letters and digits, lower-cased) and each text's offsets."""
    words: list[str] = []
    ends = [0]
    for text in texts:
        if text:
            words += WORD.findall(text.lower())
        ends.append(len(words))
    if not words:
        return np.empty(0, "u8"), np.array(ends)
    return pd.util.hash_array(np.array(words, dtype=object), hash_key=_KEY), np.array(ends)


def grams(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` words and the number of the text each is in."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, "u8"), np.empty(0, "i8")
    out = np.full(n, np.uint64(width))
    for j in range(width):
        out = mix(out * _MUL + hashes[j : j + n])
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    inside = doc[:n] == doc[width - 1 :]
    return out[inside], doc[:n][inside]


def distinct(values: np.ndarray, doc: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, flat, and their offsets."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=count))])


def set_hash(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's set of values."""
    both = []
    for salt in (0x1234567, 0x7654321):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(salt)), dtype="u8")])
        both.append((total[ends[1:]] - total[ends[:-1]]).astype("i8"))
    return both[0], both[1]
