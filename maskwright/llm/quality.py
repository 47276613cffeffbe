"""Quality classifier: a factorisation machine over hashed words, statistics of structure and the length as metadata.

    score = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2])

The identity in brackets gives all pairwise interactions in time linear in the entries. The machine is fitted on the
driver on at most ``max_labelled`` labelled rows (those with the smallest hash of their id), whose features alone
reach the driver; scoring is one pass over the corpus without a shuffle.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.features import SIZE, Adam, Sparse, batches_of, features, stacked
from maskwright.llm.shared import text_of

FACTORS, MAX_LABELLED, THRESHOLD = 8, 12_000, 0.3


class FactorisationMachine:
    def __init__(self, factors: int = FACTORS, seed: int = 3):
        random = np.random.default_rng(seed)
        self.bias = np.zeros(1)
        self.weight = np.zeros(SIZE, np.float32)
        self.factor = random.normal(0, 0.02, (SIZE, factors)).astype(np.float32)

    def raw(self, x: Sparse) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factor[x.index] * x.value[:, None]
        total = x.sums(vx)
        pairs = 0.5 * (total**2 - x.sums(vx**2)).sum(axis=1)
        return self.bias[0] + x.sums(self.weight[x.index] * x.value) + pairs, vx, total

    def score(self, x: Sparse) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[0].astype(np.float64), -30, 30)))

    def fit(self, x: Sparse, y: np.ndarray, epochs: int = 10, size: int = 512, rate: float = 0.02, decay: float = 1e-4) -> FactorisationMachine:
        if len(y):
            share = np.clip(y.mean(), 0.01, 0.99)
            self.bias[0] = np.log(share / (1 - share))
        adam = Adam([self.bias, self.weight, self.factor], rate)
        for rows in batches_of(len(y), size, epochs):
            b = x.take(rows)
            raw, vx, total = self.raw(b)
            error = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            each = np.repeat(error, np.diff(b.bound)) * b.value
            at, own = np.unique(b.index, return_inverse=True)
            weight, factor = np.zeros_like(self.weight), np.zeros_like(self.factor)
            weight[at] = np.bincount(own, each) + decay * self.weight[at]
            spread = np.repeat(total, np.diff(b.bound), axis=0) - vx
            for f in range(self.factor.shape[1]):
                factor[at, f] = np.bincount(own, each * spread[:, f]) + decay * self.factor[at, f]
            adam.step([np.array([error.sum()]), weight, factor])
        return self


def held_out(doc_id):
    """Rows that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def sample_features(docs: DataFrame, marks: DataFrame, limit: int, stems: tuple[int, ...] = ()) -> list:
    """(label, index, value) of at most ``limit`` labelled documents, those with the smallest hash of their id.

    marks: (doc_id, label), one row for each id. The chosen ids are at most ``limit`` longs, so they may be broadcast.
    """
    schema = pa.schema([("label", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            labels, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for x in features(batch.column(1), stems):
                rows = [{"label": int(labels[at + d]), "index": x.index[x.bound[d] : x.bound[d + 1]], "value": x.value[x.bound[d] : x.bound[d + 1]]} for d in range(len(x))]
                at += len(x)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.join(F.broadcast(chosen), "doc_id").select("label", "text", "doc_id")
    found = found.select(F.col("label").cast("int"), "text")
    return found.mapInArrow(run, "label int, index array<int>, value array<float>").toArrow().to_batches()


def read_sample(batches: list) -> tuple[Sparse, np.ndarray]:
    """The sample's rows and labels. Empties the list: the driver holds each batch once."""
    rows, labels = [], []
    while batches:
        b = batches.pop()
        labels.append(b.column(0).to_numpy(zero_copy_only=False))
        for i, v in zip(b.column(1), b.column(2)):
            rows.append((i.values.to_numpy(zero_copy_only=False).astype(np.int32), v.values.to_numpy(zero_copy_only=False).astype(np.float32)))
    if not rows:
        return Sparse(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64)), np.zeros(0)
    # in an order of their own, so that the fit doesn't depend on the order in which partitions arrive
    order = sorted(range(len(rows)), key=lambda k: (len(rows[k][0]), zlib.crc32(rows[k][0])))
    x = stacked([rows[k] for k in order])
    rows.clear()
    pa.default_memory_pool().release_unused()
    return x, np.concatenate(labels)[order]


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> FactorisationMachine:
    """Fit on labelled rows that are not held out. Null labels are no labels; of repeated ones the lowest counts."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    x, y = read_sample(sample_features(docs, marks, max_labelled))
    return FactorisationMachine().fit(x, y.astype(np.float32))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of docs, from whole texts.

    Null texts count as empty; empty texts are scored by their statistics; null ids stay null and count as not held
    out; repeated rows get equal scores; other columns are not read; without labels every text has a score of 0.5.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    sent = _sent(rows, labels, max_labelled)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        own = _received(sent)
        for batch in batches:
            scores = [own.score(x) for x in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], schema=schema)

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _sent(rows: DataFrame, labels: DataFrame, max_labelled: int):
    """The fitted machine as a broadcast; without labels, one that scores 0.5."""
    model = fit_quality(rows, labels, max_labelled)
    if not model.weight.any():
        model.factor[:] = 0
    return rows.sparkSession.sparkContext.broadcast((model.bias, model.weight, model.factor))


def _received(sent) -> FactorisationMachine:
    own = FactorisationMachine(1)
    own.bias, own.weight, own.factor = sent.value
    return own


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score ``threshold`` or more (see quality_scores)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    sent = _sent(rows, labels, max_labelled)

    def run(batches):
        own = _received(sent)
        for batch in batches:
            scores = [own.score(x) for x in features(batch.column(text))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(run, docs.schema)
