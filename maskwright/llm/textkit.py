"""Words and word shingles of a whole Arrow batch of texts, with numpy only.

A word is a run of bytes other than [\\x20\\x09-\\x0D]; A-Z count as a-z. Words and shingles are
64-bit hashes. No Python object is made for a word, so a batch costs a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _values(seed: int) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[SPACE] = 0
    return values


_VALUE = _values(7)
_VALUE[65:91] = _VALUE[97:123]
#: Values by which a word hashes alike with and without punctuation at its end.
BARE = _VALUE.copy()
BARE[np.frombuffer(b"!\"'),.:;?]", np.uint8)] = 0


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Words:
    """Words of the documents first .. first + n of a batch.

    hash, start, end: for each word; start and end are byte offsets into data. bound[d] .. bound[d + 1]
    are the words of document d, offset[d] .. offset[d + 1] its bytes in data.
    """

    first: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bound: np.ndarray
    offset: np.ndarray
    data: np.ndarray
    stems: tuple[np.ndarray, ...] = ()

    def __len__(self) -> int:
        return len(self.bound) - 1


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def words(texts: pa.Array, slice_bytes: int = SLICE_BYTES, values: np.ndarray = _VALUE, stems: tuple[int, ...] = ()) -> Iterator[Words]:
    """The words of every text, in slices of whole texts of about slice_bytes. stems: also hash the first so many bytes."""
    offsets, data = text_buffers(texts)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + slice_bytes, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield _words(a, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], values, stems)
        a = b


def _words(first: int, offset: np.ndarray, data: np.ndarray, values: np.ndarray, stems: tuple[int, ...] = ()) -> Words:
    n = len(data)
    inner = offset[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    solid = np.zeros(n + 1, bool)
    np.logical_not(SPACE[data], out=solid[:n])
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:-1]
    before[inner] = False
    start = np.flatnonzero(solid[:n] & ~before[:n])
    after = solid[1:].copy()
    after[inner - 1] = False
    end = np.flatnonzero(solid[:n] & ~after) + 1
    if not len(start):
        none = np.zeros(0, np.uint64)
        return Words(first, none, start, end, np.zeros(len(offset), np.int64), offset, data, (none,) * len(stems))
    position = np.arange(n, dtype=np.int64)
    position[start[0] :] -= np.repeat(start, np.diff(np.append(start, n)))
    power = _powers(int((end - start).max()))
    value = values[data]
    value *= power[np.minimum(position, len(power) - 1)]
    hashed = mix(np.add.reduceat(value, start))
    cut = []
    for n_bytes in sorted(stems, reverse=True):
        value[position >= n_bytes] = 0
        cut.append(mix(np.add.reduceat(value, start) + np.uint64(n_bytes)))
    return Words(first, hashed, start, end, np.searchsorted(start, offset), offset, data, tuple(cut[::-1]))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the shingles of document d, in order of place, are hashes[bounds[d]:bounds[d + 1]].

    A document of fewer than ``size`` words, but at least one, has its whole sequence as one shingle.
    """
    count = np.diff(w.bound)
    each = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(each)])
    weight = _powers(size + 1)[1:] * np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(bounds[-1], np.uint64)
    if len(w.hash) >= size:
        total = len(w.hash) - size + 1
        rolled = np.zeros(total, np.uint64)
        for j in range(size):
            rolled += w.hash[j : j + total] * weight[j]
        rolled = mix(rolled)
        at = np.repeat(w.bound[:-1] - bounds[:-1], each) + np.arange(bounds[-1])
        full = np.repeat(count >= size, each)
        out[full] = rolled[at[full]]
    for d in np.flatnonzero((count > 0) & (count < size)):
        h = w.hash[w.bound[d] : w.bound[d + 1]]
        out[bounds[d]] = mix(np.array([(h * weight[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))]))[0]
    return out, bounds
