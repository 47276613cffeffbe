"""Token counts and ids with overlap resynchronisation.

A document of more than ``chunk`` bytes is encoded in overlapping chunks, each with the byte offsets of its
tokens. Two neighbours are spliced at a byte offset p in their overlap where both have a token boundary and
which is proven stable: an ASCII non-space before p, an ASCII space at p. A byte-level splitter has a space only at
the start of a piece or in a piece of white space alone, so it always cuts there, whatever the context; no added
token holds white space; and a token never crosses a cut. What follows p is therefore encoded alike from either
chunk and from the whole text. If an overlap has no such offset, it is doubled until it has one or ends with the text.

Chunks of one document are dealt over tasks (``count_tokens``). Files whose splitter gives no such proof
(sentencepiece models, normalising tokenizers) are encoded text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.shared import cut, text_of
from maskwright.llm.tokenizers_io import Encoder, encoder

CHUNK_BYTES, OVERLAP_BYTES = 32768, 1024


def _char_start(data: bytes, at: int) -> int:
    """The nearest start of a character at or before ``at``."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return min(at, len(data))


def stable(data: bytes, start: int, low: int, high: int) -> np.ndarray:
    """Offsets p, low <= p < high, with an ASCII non-space before and an ASCII space at p; data begins at offset start."""
    b = np.frombuffer(data, np.uint8)[max(0, low - start - 1) : max(0, high - start)]
    if len(b) < 2:
        return np.zeros(0, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    ok = space[1:] & ~space[:-1] & (b[:-1] > 32) & (b[:-1] < 127)
    return np.flatnonzero(ok) + max(0, low - start - 1) + 1 + start


def encoded(enc: Encoder, data: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends): the ids of a chunk that begins at offset start, and the offset at which each token ends."""
    ids = enc.encode(data.decode("utf-8", "replace"))
    return ids, start + np.cumsum(enc.lengths[ids])


def spliced_ids(enc: Encoder, data: bytes, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> np.ndarray:
    """All ids of one text, from overlapping chunks."""
    if not enc.boundaries or len(data) <= chunk:
        return enc.encode(data.decode("utf-8", "replace"))
    out, begin, start = [], 0, 0  # tokens from offset ``begin`` on are still to be taken; the chunk starts at ``start``
    while True:
        following, wide = _char_start(data, start + chunk), overlap
        while True:
            stop = _char_start(data, min(len(data), following + wide))
            ids, ends = encoded(enc, data[start:stop], start)
            first = int(np.searchsorted(ends, begin, side="right")) if begin > start else 0
            if stop == len(data):
                out.append(ids[first:])
                return np.concatenate(out)
            after, after_ends = encoded(enc, data[following:stop], following)
            common = np.intersect1d(ends, after_ends)
            common = np.intersect1d(common[common < stop], stable(data[start:stop], start, following, stop))
            if len(common):
                break
            wide *= 2
        p = int(common[0])
        out.append(ids[first : int(np.searchsorted(ends, p, side="right"))])
        begin, start = p, following


def _split(chunk: int, overlap: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_buffer().to_pybytes()
                starts = [_char_start(data, a) for a in range(0, len(data), chunk)]
                for i, a in enumerate(starts):
                    last = i + 1 == len(starts)
                    following = len(data) if last else starts[i + 1]
                    body = data[a : _char_start(data, min(len(data), following + overlap))]
                    yield pa.RecordBatch.from_pylist([{"key": key, "doc_id": doc, "n_bytes": len(data), "i": i, "start": a, "following": following, "last": last, "body": body}], schema=schema)

    return run


def _measure(path: str, overlap: int, schema: pa.Schema):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, ends = encoded(enc, r["body"], r["start"])
                stop = r["start"] + len(r["body"])

                def cuts(low, high):
                    p = np.intersect1d(ends, stable(r["body"], r["start"], low, high))
                    p = p[p < stop]
                    return p, np.searchsorted(ends, p, side="right")

                left, left_n = cuts(r["start"], r["start"] + overlap) if r["i"] else ([], [])
                right, right_n = ([], []) if r["last"] else cuts(r["following"], stop)
                rows.append({k: r[k] for k in ("key", "doc_id", "n_bytes", "i", "last")} | {"n": len(ids), "l": left, "ln": left_n, "r": right, "rn": right_n})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _widened(path: str, chunk: int, overlap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        data = b"".join(bytes(b)[: f - a] for b, a, f in zip(pdf["body"], pdf["start"], pdf["following"]))
        n = len(spliced_ids(encoder(path), data, chunk, 2 * overlap))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "n_bytes": [len(data)], "n_tokens": [n]})

    return run


def _count_whole(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([enc.count(t) for t in texts], pa.int64())], schema=schema)

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of docs, in whole texts.

    tokenizer: path of a public tokenizer's file, readable on every executor. Null texts count as empty (0 tokens),
    null ids stay null, repeated rows are counted one by one; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    out = "doc_id long, n_bytes long, n_tokens long"
    splits = encoder(tokenizer).boundaries
    small = rows.filter(F.octet_length("text") <= chunk) if splits else rows
    counts = small.mapInArrow(_count_whole(tokenizer), out)
    if splits:
        long, many, i = pa.int64(), pa.list_(pa.int64()), pa.int32()
        parts = pa.schema([("key", long), ("doc_id", long), ("n_bytes", long), ("i", i), ("start", long), ("following", long), ("last", pa.bool_()), ("body", pa.binary())])
        sizes = pa.schema([("key", long), ("doc_id", long), ("n_bytes", long), ("i", i), ("last", pa.bool_()), ("n", long), ("l", many), ("ln", many), ("r", many), ("rn", many)])
        large = rows.filter(F.octet_length("text") > chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
        # written once: the keys of the rows stay as they are, and the chunks of one document go to many tasks
        chunks = cut(large.mapInArrow(_split(chunk, overlap, parts), "key long, doc_id long, n_bytes long, i int, start long, following long, last boolean, body binary").repartition("key", "i"), "chunks")
        measured = chunks.mapInArrow(_measure(tokenizer, overlap, sizes), "key long, doc_id long, n_bytes long, i int, last boolean, n long, l array<long>, ln array<long>, r array<long>, rn array<long>")
        by_place = Window.partitionBy("key").orderBy("i")
        p = F.array_min(F.array_intersect("r", F.lead("l").over(by_place)))
        joint = measured.select("*", p.alias("p")).select("*", F.lag("p").over(by_place).alias("q"))
        at = lambda names, values, x: F.element_at(values, F.array_position(names, x).cast("int"))
        begin = F.when(F.col("i") == 0, 0).otherwise(at("l", "ln", F.col("q")))
        end = F.when(F.col("last"), F.col("n")).otherwise(at("r", "rn", F.col("p")))
        docs_n = joint.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum(end - begin).alias("n_tokens"), F.bool_and((end - begin).isNotNull()).alias("ok"))
        spliced = docs_n.filter("ok").select("doc_id", "n_bytes", "n_tokens")
        wider = chunks.join(docs_n.filter("not ok").select("key"), "key", "left_semi").groupBy("key").applyInPandas(_widened(tokenizer, chunk, overlap), out)
        counts = counts.unionByName(spliced).unionByName(wider)
    return counts.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
