"""Token-id output: documents as packed rows of ``length`` token ids.

Each task encodes its documents, splits those of more than ``length`` tokens into pieces that lose nothing, and packs
blocks of pieces best-fit-decreasing: pieces by falling length, each into the open row with the least room that
still holds it. A segment tree over the room left finds that row in O(log length). Blocks hold at most
``block_tokens`` tokens, so memory is bounded; there is no shuffle, and a lost task repeats its own partition only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.shared import text_of
from maskwright.llm.token_counts import spliced_ids
from maskwright.llm.tokenizers_io import encoder

LENGTH, BLOCK_TOKENS = 2048, 1 << 22
SCHEMA = "row_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, token_starts array<long>"


class RoomTree:
    """Open rows by the room they have left; ``best(n)`` takes out a row with the least room >= n."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def best(self, n: int) -> tuple[int, int] | None:
        """(room, row), or None if no open row holds n."""
        i, count = n + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; the pieces of a row sum to at most ``length``. Ties keep the order of the input."""
    rows: list[list[int]] = []
    tree = RoomTree(length)
    for piece in np.argsort(-lengths, kind="stable"):
        n = int(lengths[piece])
        found = tree.best(n)
        room, row = found or (length, len(rows))
        if found is None:
            rows.append([])
        rows[row].append(int(piece))
        if room > n:
            tree.add(room - n, row)
    return rows


def _packed(pieces: list[tuple[int, int, int, np.ndarray]], length: int, pad: int, dtype, base: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing(np.array([len(p[3]) for p in pieces]), length)
    for a in range(0, len(rows), 512):
        some = rows[a : a + 512]
        matrix = np.full((len(some), length), pad, dtype)
        out = []
        for k, row in enumerate(some):
            cu = np.concatenate([[0], np.cumsum([len(pieces[p][3]) for p in row])])
            matrix[k, : cu[-1]] = np.concatenate([pieces[p][3] for p in row])
            out.append({"row_id": base + a + k, "n_tokens": int(cu[-1]), "n_segments": len(row), "ids": matrix[k].tobytes(), "cu_seqlens": cu, "position_resets": cu[:-1], "doc_ids": [pieces[p][0] for p in row], "pieces": [pieces[p][1] for p in row], "token_starts": [pieces[p][2] for p in row]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _pack(path: str, length: int, block: int, pad: int):
    schema = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("n_segments", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("token_starts", pa.list_(pa.int64()))])

    def run(batches):
        enc = encoder(path)
        dtype = np.dtype("<u2" if enc.size <= 1 << 16 else "<u4")
        base = TaskContext.get().partitionId() << 40
        held, tokens = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = spliced_ids(enc, text.as_buffer().to_pybytes()).astype(dtype)
                for k, a in enumerate(range(0, len(ids), length)):
                    held.append((doc, k, a, ids[a : a + length].copy()))
                tokens += len(ids)
                if tokens >= block:
                    for out in _packed(held, length, pad, dtype, base, schema):
                        base += out.num_rows
                        yield out
                    held, tokens = [], 0
        if held:
            yield from _packed(held, length, pad, dtype, base, schema)

    return run


def pack_tokens(docs: DataFrame, tokenizer: str, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, pad_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows: the id matrix row by row, its segments, and where positions start again.

    ``ids`` has ``length`` little-endian ids (two bytes each up to 65,536 ids, else four) of which the first
    ``n_tokens`` are in use. ``cu_seqlens`` are the cumulative lengths of the row's segments from 0 to n_tokens;
    ``position_resets`` the places where position ids begin again at 0. Segment s is piece ``pieces[s]`` of document
    ``doc_ids[s]``, which begins at its token ``token_starts[s]``. Documents without tokens (null or empty texts) have no
    segment; null ids are kept as null; repeated rows are packed as often as they occur; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long"), text_of(text).cast("binary"))
    return rows.mapInArrow(_pack(tokenizer, length, block_tokens, pad_id), SCHEMA)


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Position ids of one packed row: each segment counts from 0, padding is 0."""
    out = np.zeros(length, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        out[a:b] = np.arange(b - a)
    return out
