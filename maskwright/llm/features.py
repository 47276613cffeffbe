"""Features of whole texts for the classifiers: hashed distinct words and statistics of structure.

A document is a sparse vector. Words, without punctuation at their end, and stems if wanted, have the value
1 / sqrt(how many differ); each statistic is one of LEVELS levels, one-hot. Only the text is read: no label, language, source or
identifier. The one piece of metadata that may count, the number of characters, is a level too, counted in the text itself, so
that a missing or wrong column can't mislead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from maskwright.llm import textkit

WORD_BITS, LEVELS = 16, 32
_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "digit": (_B >= 48) & (_B <= 57),
    "symbol": np.isin(_B, np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~", np.uint8)),
    "mark": np.isin(_B, np.frombuffer(b"!\"'(),-.:;?[]", np.uint8)),
    "other": _B >= 128,
    "line": _B == 10,
}
STATISTICS = (*_CLASSES, "words", "distinct", "again", "length", "characters")
SIZE = (1 << WORD_BITS) + len(STATISTICS) * LEVELS


@dataclass
class Sparse:
    """Rows of (index, value): row d has the entries bound[d] .. bound[d + 1]; no row is empty. words: words of each row."""

    bound: np.ndarray
    index: np.ndarray
    value: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.bound) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        n = np.diff(self.bound)[rows]
        bound = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(self.bound[rows] - bound[:-1], n) + np.arange(bound[-1])
        return Sparse(bound, self.index[at], self.value[at], self.words[rows])

    def sums(self, entries: np.ndarray) -> np.ndarray:
        return np.add.reduceat(entries, self.bound[:-1], axis=0)


def _level(ratio: np.ndarray) -> np.ndarray:
    """0 to 1 as a level, finer near 0."""
    return np.minimum((np.sqrt(np.clip(ratio, 0, 1)) * LEVELS).astype(np.int64), LEVELS - 1)


def _slice(w: textkit.Words) -> Sparse:
    n, size = len(w), np.maximum(np.diff(w.offset), 1)
    count = np.diff(w.bound)
    doc = np.repeat(np.arange(n), count)
    levels = []
    for members in _CLASSES.values():
        before = np.concatenate([[0], np.cumsum(members[w.data])])
        levels.append(_level((before[w.offset[1:]] - before[w.offset[:-1]]) / size))
    mask, owners = np.uint64((1 << WORD_BITS) - 1), doc.astype(np.uint64) << np.uint64(32)
    keys = np.unique(owners | (w.hash & mask))
    known = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=n)
    keys = np.unique(np.concatenate([keys, *(owners | (stem & mask) for stem in w.stems)]))
    owner, bucket = (keys >> np.uint64(32)).astype(np.int64), (keys & mask).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    again = np.zeros(n)
    if len(w.hash) > 1:
        same = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[1:][same], minlength=n)
    some = np.maximum(count, 1)
    begun = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    characters = begun[w.offset[1:]] - begun[w.offset[:-1]]
    levels += [
        np.minimum((2 * np.log2(count + 1)).astype(np.int64), LEVELS - 1),
        _level(known / some),
        _level(again / some),
        np.minimum((2 * size / some).astype(np.int64), LEVELS - 1),
        np.minimum((1.5 * np.log2(characters + 1)).astype(np.int64), LEVELS - 1),
    ]
    k = len(levels)
    bound = np.concatenate([[0], np.cumsum(distinct + k)])
    index, value = np.empty(bound[-1], np.int64), np.ones(bound[-1], np.float32)
    for j, level in enumerate(levels):
        index[bound[:-1] + j] = (1 << WORD_BITS) + j * LEVELS + level
    at = np.arange(len(keys)) + k * (owner + 1)
    index[at] = bucket
    value[at] = (1 / np.sqrt(np.maximum(distinct, 1)))[owner]
    return Sparse(bound, index, value, count)


def features(texts: pa.Array, stems: tuple[int, ...] = ()) -> Iterator[Sparse]:
    """Rows for each text of a column, in order, in slices. stems: also the words' first so many bytes."""
    for w in textkit.words(texts, values=textkit.BARE, stems=stems):
        yield _slice(w)


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
    """Rows from lists of (index, value)."""
    bound = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
    index = np.concatenate([i for i, _ in rows]).astype(np.int32, copy=False)
    value = np.concatenate([v for _, v in rows]).astype(np.float32, copy=False)
    return Sparse(bound, index, value, np.zeros(len(rows), np.int64))


class Adam:
    """Steps for a list of arrays, in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m = [np.zeros_like(a) for a in arrays]
        self.v = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= (scale * m / (np.sqrt(v) + 1e-8)).astype(a.dtype)


def batches_of(n: int, size: int, epochs: int, seed: int = 11, least_steps: int = 200) -> Iterator[np.ndarray]:
    """Shuffled batches of 0 .. n - 1, in so many epochs, or more if that makes few steps."""
    if not n:
        return
    order = np.random.default_rng(seed)
    for _ in range(max(epochs, -(-least_steps // -(-n // size)))):
        shuffled = order.permutation(n)
        for a in range(0, n, size):
            yield np.sort(shuffled[a : a + size])
