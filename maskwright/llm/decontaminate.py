"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are the query set, the corpus is all rows. 1. One pass counts, over the whole corpus, in how many
documents each word n-gram of the items occurs. 2. The rarer 70 % of each item's own n-grams become its seeds, so that
an item that leaks into very many documents keeps its seeds; a short item (below SHORT words), of which edits leave few
n-grams, keeps all. 3. A second pass looks the seeds up in each document, and aligns the item with the passage around every
cluster of two seeds (of one, for short items) by local alignment over words: a match counts 2, a mismatch or gap -1. A
passage whose score is at least ``least`` of a full copy's is a leak. Of 15 words any 4 may be replaced (a score of 0.6);
of an item of fewer than 8 words, ``gram`` in a row must be whole.

Items are sent to the tasks in blocks of at most ``block_items`` items and ``block_bytes`` of text, one pass for each
block, so what is broadcast is bounded however large the benchmark is. There is no shuffle of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import textkit
from maskwright.llm.shared import free_name, row_key, text_of

GRAM, LEAST, RARE_SHARE, SHORT = 3, 0.5, 0.7, 40
MATCH, OTHER = 2, -1
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_FILTER_BITS = 22


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local score, end of it in the passage)."""
    fall = np.arange(len(passage) + 1) * -OTHER
    above = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == w, MATCH, OTHER), above[1:] + OTHER)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + fall) - fall  # gaps along the passage
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def aligned(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment, in words of the passage."""
    score, end = align(item, passage)
    if not score:
        return 0, 0, 0
    _, back = align(item[::-1], passage[:end][::-1])
    return score, end - back, end


@dataclass
class Items:
    """Test items by number, their word hashes, and their n-grams: code -> the items and places that have it."""

    ids: list[int]
    words: list[np.ndarray]
    codes: np.ndarray  # sorted, distinct
    at: np.ndarray  # code k has the entries at[k] .. at[k + 1]
    item: np.ndarray
    place: np.ndarray
    short: np.ndarray  # codes of items of fewer words than a gram: the whole item is its only seed

    @staticmethod
    def of(ids: list[int], texts: list[str], gram: int) -> Items:
        words: list[np.ndarray] = []
        for w in textkit.words(pa.array(texts, pa.large_string())):
            words += [w.hash[w.bound[d] : w.bound[d + 1]] for d in range(len(w))]
        code, item, place = [], [], []
        for i, w in enumerate(words):
            g = grams(w, min(gram, max(1, len(w))))
            code.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        code, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (code, item, place))
        order = np.lexsort((place, item, code))
        code, item, place = code[order].astype(np.uint64), item[order], place[order]
        codes, first = np.unique(code, return_index=True)
        lengths = np.array([len(w) for w in words])
        short = np.unique([l for l in lengths if 0 < l < gram]).astype(np.int64)
        return Items(ids, words, codes, np.append(first, len(code)), item, place, short)

    def rare(self, counts: dict[int, int], share: float) -> Items:
        """Only the rarer part of each item's grams, by the number of documents that have them; all of a short item."""
        n = np.array([counts.get(int(c), 0) for c in self.codes.view(np.int64)], np.int64)
        each = np.repeat(n, np.diff(self.at))
        keep = np.zeros(len(self.item), bool)
        order = np.lexsort((self.place, each, self.item))
        bounds = np.searchsorted(self.item[order], np.arange(len(self.words) + 1))
        for i in range(len(self.words)):
            own = order[bounds[i] : bounds[i + 1]]
            keep[own if len(self.words[i]) < SHORT else own[: int(np.ceil(share * len(own)))]] = True
        code = np.repeat(self.codes, np.diff(self.at))[keep]
        codes, first = np.unique(code, return_index=True)
        return Items(self.ids, self.words, codes, np.append(first, len(code)), self.item[keep], self.place[keep], self.short)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row at each place."""
    total = len(words) - n + 1
    if total < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(total, np.uint64)
    for j, weight in enumerate(textkit._powers(n + 1)[1:]):
        out += words[j : j + total] * (weight + np.uint64(2 * n))
    return textkit.mix(out)


class _Finder:
    """Places of an Items' codes among the words of a slice; most words are passed over by a bitmap."""

    def __init__(self, items: Items, gram: int):
        self.items, self.mask = items, np.uint64((1 << _FILTER_BITS) - 1)
        self.sizes = [gram, *items.short.tolist()]
        self.bitmap = np.zeros(1 << _FILTER_BITS, bool)
        self.bitmap[items.codes & self.mask] = True

    def hits(self, w: textkit.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word place in the slice, code number), by place."""
        doc, place, code = [], [], []
        codes = self.items.codes
        for n in self.sizes:
            g = grams(w.hash, n)
            some = np.flatnonzero(self.bitmap[g & self.mask])
            k = np.searchsorted(codes, g[some])
            real = (k < len(codes)) & (codes[np.minimum(k, len(codes) - 1)] == g[some])
            some, k = some[real], k[real]
            d = np.searchsorted(w.bound, some, side="right") - 1
            inside = some + n <= w.bound[d + 1]
            doc.append(d[inside])
            place.append(some[inside])
            code.append(k[inside])
        doc, place, code = map(np.concatenate, (doc, place, code))
        order = np.argsort(place, kind="stable")
        return doc[order], place[order], code[order]


def _count(sent, gram: int, schema: pa.Schema):
    def run(batches):
        finder = _Finder(sent.value, gram)
        total = np.zeros(len(finder.items.codes), np.int64)
        for batch in batches:
            for w in textkit.words(batch.column(0)):
                doc, _, code = finder.hits(w)
                pair = np.unique(doc * len(total) + code) if len(doc) else np.zeros(0, np.int64)
                total += np.bincount(pair % max(1, len(total)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(finder.items.codes[some].view(np.int64)), pa.array(total[some])], schema=schema)

    return run


def leaks_in(words: np.ndarray, places: np.ndarray, codes: np.ndarray, items: Items, least: float) -> list[tuple[int, float, int, int]]:
    """(item number, score, start, end in words) for a document, from the places of its seeds."""
    spread = np.diff(items.at)[codes]
    entry = np.repeat(items.at[codes] - np.concatenate([[0], np.cumsum(spread)[:-1]]), spread) + np.arange(spread.sum())
    item, place, at = items.item[entry], items.place[entry], np.repeat(places, spread)
    out = []
    order = np.lexsort((at, item))
    item, diagonal = item[order], (at - place)[order]
    for i, a, b in zip(*_runs(item)):
        query = items.words[i]
        starts = np.sort(diagonal[a:b])
        need = 1 if len(query) < SHORT else 2
        # seeds of one copy lie on near diagonals; clusters of them are aligned, each once
        for c, d in _clusters(starts, max(8, len(query) // 2)):
            if d - c < need:
                continue
            low = max(0, int(starts[c]) - len(query) // 2)
            high = min(len(words), int(starts[d - 1]) + len(query) + len(query) // 2 + 1)
            score, s, e = aligned(query, words[low:high])
            if score >= least * MATCH * len(query):
                out.append((int(i), score / (MATCH * len(query)), low + s, low + e))
    return out


def _runs(x: np.ndarray):
    cuts = np.flatnonzero(np.diff(x)) + 1
    first = np.concatenate([[0], cuts]) if len(x) else np.zeros(0, np.int64)
    return x[first], first, np.append(cuts, len(x)) if len(x) else first


def _clusters(sorted_values: np.ndarray, gap: int):
    cuts = np.flatnonzero(np.diff(sorted_values) > gap) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)]))


def _match(sent, gram: int, least: float, schema: pa.Schema):
    def run(batches):
        finder = _Finder(sent.value, gram)
        items = finder.items
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for w in textkit.words(batch.column(1)):
                doc, place, code = finder.hits(w)
                for d, a, b in zip(*_runs(doc)):
                    low, high = w.bound[d], w.bound[d + 1]
                    best: dict[int, tuple] = {}
                    for i, score, s, e in leaks_in(w.hash[low:high], place[a:b] - low, code[a:b], items, least):
                        if e > s and (i not in best or score > best[i][0]):
                            text = bytes(w.data[w.offset[d] : w.offset[d + 1]])
                            at = [len(text[: int(x)].decode("utf-8", "replace")) for x in (w.start[low + s] - w.offset[d], w.end[low + e - 1] - w.offset[d])]
                            best[i] = (score, *at)
                    rows += [{"doc_id": ids[w.first + d], "item_id": items.ids[i], "score": s, "start": x, "end": y} for i, (s, x, y) in best.items()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _blocks(benchmark: DataFrame, block_items: int, block_bytes: int):
    """Items (id, text) in blocks, streamed through the driver one block at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.toLocalIterator():
        if len(ids) >= block_items or size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least: float = LEAST, rare_share: float = RARE_SHARE, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, score, start, end``: the best alignment of each item found in each row of docs.

    score: alignment score over that of a full copy, ``least`` at least; start and end are code points, end
    exclusive. Null or empty texts on either side leak nothing; an item of fewer than ``gram`` words is its own seed;
    null ids are reported as null; repeated rows of docs give a row each, repeated items are separate items; other
    columns are not read; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    tests = benchmark.select(F.col(item_id).cast("long").alias("item_id"), text_of(item_text).alias("text"))
    counted = pa.schema([("code", pa.int64()), ("docs", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    out = None
    for ids, texts in _blocks(tests, block_items, block_bytes):
        items = Items.of(ids, texts, gram)
        if not len(items.codes):
            continue
        sent = spark.sparkContext.broadcast(items)
        counts = rows.select("text").mapInArrow(_count(sent, gram, counted), "code long, docs long").groupBy("code").agg(F.sum("docs").alias("docs"))
        rare = spark.sparkContext.broadcast(items.rare({r["code"]: r["docs"] for r in counts.collect()}, rare_share))
        found = rows.mapInArrow(_match(rare, gram, least, schema), "doc_id long, item_id long, score double, start int, end int")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, score double, start int, end int")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no item (see leaks). Rows without an id are told by their
    text; rows that repeat an id go together."""
    key = free_name(docs, "leak_key")
    rows = docs.withColumn(key, row_key(doc_id, text))
    found = leaks(rows, benchmark, doc_id=key, text=text).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").select(docs.columns)
