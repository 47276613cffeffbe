"""Exact deduplication by Patricia-trie owners.

Texts are equal when they are identical after each run of [\\x20\\x09-\\x0D] is replaced by one space.

1. Each input partition inserts its texts into a compressed radix trie. A terminal node holds the smallest
   identifier and the number of rows seen. Copies of one text, however many, leave a partition as one row.
2. The rows are dealt by (length, SHA-256) and sorted by it, and each task inserts them into a trie of its own;
   full byte strings are compared along the edges.
3. A trie that outgrows ``budget_bytes`` spills its heaviest subtree. In step 1 the spilled terminals go on as
   partial owners. In step 2 equal strings are adjacent in the sorted input, so a spill between two of them is final.

Each row is then joined to its owner by (length, SHA-256). That join's large groups are split by adaptive
execution; the shuffle of texts holds each text at most once per input partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.shared import text_of

BUDGET_BYTES = 48 << 20
_NODE_BYTES = 300
_OUT_ROWS, _OUT_BYTES = 4096, 4 << 20


class _Node:
    __slots__ = ("children", "edge", "payload")

    def __init__(self, edge: bytes, payload=None):
        self.edge, self.payload, self.children = edge, payload, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings with (smallest id, rows, tag) at their terminal nodes."""

    def __init__(self):
        self.root = _Node(b"")
        self.weight: dict[int, int] = {}  # bytes below each child of the root

    @property
    def bytes(self) -> int:
        return sum(self.weight.values())

    def insert(self, key: bytes, smallest, rows: int, tag) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.payload is None:
                    node.payload = [smallest, rows, tag]
                else:
                    p = node.payload
                    if p[0] is None or smallest is not None and smallest < p[0]:
                        p[0] = smallest
                    p[1] += rows
                return
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], [smallest, rows, tag])
                self._grow(key, len(key) - at)
                return
            if key.startswith(child.edge, at):
                node, at = child, at + len(child.edge)
                continue
            k = _common(child.edge, key, at)
            fork = _Node(child.edge[:k])
            child.edge = child.edge[k:]
            fork.children = {child.edge[0]: child}
            node.children[key[at]] = fork
            self._grow(key, 0)
            node, at = fork, at + k

    def _grow(self, key: bytes, n: int) -> None:
        self.weight[key[0]] = self.weight.get(key[0], 0) + n + _NODE_BYTES

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Remove the heaviest subtree below the root and yield its strings."""
        top = max(self.weight, key=self.weight.get)
        del self.weight[top]
        yield from self._strings(self.root.children.pop(top), b"")

    def drain(self) -> Iterator[tuple[bytes, list]]:
        if self.root.payload is not None:
            yield b"", self.root.payload
        for child in (self.root.children or {}).values():
            yield from self._strings(child, b"")
        self.__init__()

    @staticmethod
    def _strings(top: _Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            whole = before + node.edge
            if node.payload is not None:
                yield whole, node.payload
            stack.extend((c, whole) for c in (node.children or {}).values())


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 64
        if len(held) >= _OUT_ROWS or size >= _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def _partial(budget: int, schema: pa.Schema):
    def run(batches):
        def rows():
            trie = PatriciaTrie()
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    key = text.as_buffer().to_pybytes()
                    trie.insert(key, i, 1, None)
                while trie.weight and trie.bytes > budget:
                    yield from trie.spill()
            yield from trie.drain()

        yield from _emit(((len(k), hashlib.sha256(k).digest(), p[0], p[1], k) for k, p in rows()), schema)

    return run


def _final(budget: int, schema: pa.Schema):
    def run(batches):
        def rows():
            trie, last = PatriciaTrie(), None
            for batch in batches:
                length, digest, smallest, count = (batch.column(c).to_pylist() for c in range(4))
                for n, d, i, c, text in zip(length, digest, smallest, count, batch.column(4)):
                    if (n, d) != last:
                        while trie.weight and trie.bytes > budget:
                            yield from trie.spill()
                        last = (n, d)
                    trie.insert(text.as_buffer().to_pybytes(), i, c, d)
            yield from trie.drain()

        yield from _emit(((len(k), p[2], p[0], p[1]) for k, p in rows()), schema)

    return run


def normalised(text: str = "text"):
    """The text with each run of [\\x20\\x09-\\x0D] as one space; null is empty."""
    return F.regexp_replace(text_of(text), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", budget_bytes: int = BUDGET_BYTES) -> DataFrame:
    """Each row of docs with the owner of its text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too. Of equal texts
    the row with the smallest id stays; a null id is larger than any other, and a group of only null ids keeps
    null. Rows that repeat both id and text count in group_size and are all marked as kept. A null text equals
    an empty one. Other columns of docs are not read, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("t"))
    partial = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("smallest", pa.int64()), ("many", pa.int64()), ("t", pa.binary())])
    final = pa.schema([("n", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
    owners = (
        rows.select("doc_id", F.col("t").cast("binary"))
        .mapInArrow(_partial(budget_bytes, partial), "n long, digest binary, smallest long, many long, t binary")
        .repartition("n", "digest")
        .sortWithinPartitions("n", "digest")
        .mapInArrow(_final(budget_bytes, final), "n long, digest binary, keep_id long, group_size long")
    )
    keyed = rows.select("doc_id", F.octet_length("t").cast("long").alias("n"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"))
    return keyed.join(owners, ["n", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
