"""Mixing to target weights with soft membership.

1. A softmax classifier over hashed words, their first bytes and structure (see features), fitted on a bounded sample of the labelled
   table, gives each document a posterior over the domains.
2. Document rates r >= 0 are fitted by projected-gradient least squares: they minimise the squared distance of the
   expected domain totals sum_d r_d n_d p_dk from the targets, plus ``pull`` times the token-weighted squared distance
   from a rate of 1. The optimum has the form r = max(0, 1 - P g) with K numbers g; a step changes g along the gradient,
   scaled by the inverse normal matrix over documents whose rate isn't 0 (a handful of passes in place of hundreds), and
   projects the rates. It needs K + K^2 sums, gathered by one distributed pass over (tokens, posterior). The only state
   is g, so a lost task is repeated alike. Steps are shortened if they don't settle, and a fit that never does raises.
3. A rate is rounded up or down by a hash of the row's key, up with the probability of its fraction, so that the copies
   follow the rates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from maskwright.llm.features import SIZE, Adam, Sparse, batches_of, features
from maskwright.llm.quality import MAX_LABELLED, read_sample, sample_features
from maskwright.llm.shared import cut, free_name, row_key, text_of

#: Domains by (quality, toxic) of the labelled table, and the shares of tokens aimed at.
DOMAINS = ("clean", "toxic", "junk")
TARGETS = {"clean": 0.95, "toxic": 0.02, "junk": 0.03}
MAX_STEPS, TOLERANCE, PULL, STEMS = 60, 1e-5, 0.002, (4, 5)


class Softmax:
    """Softmax over the presence of words and levels; only the ``keep`` features most bound to a domain count (chi-square)."""

    def __init__(self, domains: int, keep: int = 3000):
        self.weight = np.zeros((SIZE, domains), np.float32)
        self.bias = np.zeros(domains)
        self.keep = keep

    def posteriors(self, x: Sparse) -> np.ndarray:
        z = self.bias + x.sums(self.weight[x.index])
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _bound(self, x: Sparse, y: np.ndarray) -> np.ndarray:
        """The features kept. Chi-square of presence against each domain."""
        n, with_it = len(y), np.bincount(x.index, minlength=SIZE).astype(float)
        best = np.zeros(SIZE)
        for j in range(len(self.bias)):
            own = y == j
            both = np.bincount(x.index, np.repeat(own, np.diff(x.bound)).astype(float), SIZE)
            off = both * n - with_it * own.sum()
            spread = with_it * (n - with_it) * own.sum() * (n - own.sum())
            best = np.maximum(best, np.divide(off**2 * n, spread, out=np.zeros(SIZE), where=spread > 0))
        return np.argsort(-best, kind="stable")[: self.keep]

    def fit(self, x: Sparse, y: np.ndarray, epochs: int = 10, size: int = 512, rate: float = 0.05, decay: float = 1e-4) -> Softmax:
        if not len(y):
            return self
        k = len(self.bias)
        chosen = np.zeros(SIZE, bool)
        chosen[self._bound(x, y)] = True
        adam = Adam([self.bias, self.weight], rate)
        for rows in batches_of(len(y), size, epochs):
            b = x.take(rows)
            error = (self.posteriors(b) - np.eye(k)[y[rows]]) / len(rows)
            used = chosen[b.index]
            at, own = np.unique(b.index[used], return_inverse=True)
            each = np.repeat(error, np.diff(b.bound), axis=0)[used]
            gradient = np.zeros_like(self.weight)
            for j in range(k):
                gradient[at, j] = np.bincount(own, each[:, j], len(at)) + decay * self.weight[at, j]
            adam.step([error.sum(axis=0), gradient])
        return self


def domain_of():
    """Domain number by the labelled table: clean 0, toxic 1, junk 2."""
    return F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when(F.col("quality") == 1, 0)


def fit_domains(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Softmax:
    marks = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), domain_of().alias("label")).filter("label is not null")
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    x, y = read_sample(sample_features(docs, marks, max_labelled, STEMS))
    return Softmax(len(DOMAINS)).fit(x, y.astype(np.int64))


def domain_posteriors(docs: DataFrame, model: Softmax, text: str = "text", names: tuple[str, str] = ("n_words", "posterior")) -> DataFrame:
    """docs with a word count and ``posterior array<double>`` added (under ``names``), in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weight))
    n, posterior = names

    def run(batches):
        own = Softmax(1)
        own.bias, own.weight = sent.value
        for batch in batches:
            at = 0
            for x in features(batch.column(text), STEMS):
                part = batch.slice(at, len(x))
                p = own.posteriors(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                added = [pa.array(x.words, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*batch.schema.names, n, posterior])
                at += len(x)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(n, LongType()), StructField(posterior, ArrayType(DoubleType()))]))


def _rates(p: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - p @ g)


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.column("n_words").to_numpy(zero_copy_only=False).astype(float)
    p = batch.column("posterior")
    return n, p.flatten().to_numpy(zero_copy_only=False).reshape(len(n), k)


def _sums(known: DataFrame, g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(domain totals at the current rates, P'NP over documents whose rate isn't 0)."""
    schema = pa.schema([("total", pa.list_(pa.float64()))])

    def run(batches):
        total = np.zeros(k + k * k)
        for batch in batches:
            n, p = _arrays(batch, k)
            r = _rates(p, g)
            total[:k] += p.T @ (n * r)
            total[k:] += ((p * (n * (r > 0))[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_pylist([{"total": total}], schema=schema)

    sums = known.select("n_words", "posterior").mapInArrow(run, "total array<double>")
    row = sums.agg(*[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(k + k * k)]).first()
    s = np.array([x or 0.0 for x in row])
    return s[:k], s[k:].reshape(k, k)


def fit_rates(known: DataFrame, targets: list[float], anchor: int | None = 0, pull: float = PULL, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The numbers g. The token budget is such that the anchor domain keeps its expected tokens (None: that the total
    stays). Stops when no step of g is above ``tolerance``, so the totals are off by ``pull`` * g of the budget."""
    k = len(targets)
    share, g, goal = np.array(targets, float) / sum(targets), np.zeros(k), None
    for k_th in range(max_steps):
        total, normal = _sums(known, g, k)
        if goal is None:
            goal = share * (total.sum() if anchor is None or not share[anchor] else total[anchor] / share[anchor])
            budget = max(goal.sum(), 1.0)
        step = np.linalg.solve(normal / budget + pull * np.eye(k), (total - goal) / budget - pull * g)
        if np.abs(step).max() <= tolerance:
            return g + step
        g = g + step / (1 if k_th < 10 else 2 if k_th < 25 else 4)
    raise ArithmeticError(f"rates not fitted in {max_steps} steps: the last one changed them by {np.abs(step).max():.2g}")


def _copies(rate, key):
    """Whole copies for a rate: its fraction is the chance of one more, drawn by a hash of the row's key."""
    drawn = F.xxhash64(key, F.lit("copies")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    return F.floor(rate + drawn).cast("int")


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float], max_labelled: int, doc_id: str, text: str, keep: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of docs with four more, and their names: words, posterior, rate, copies."""
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    model = fit_domains(plain, labels, max_labelled)
    names = {x: free_name(docs, f"mixing_{x}") for x in ("key", "words", "posterior", "rate", "copies")}
    known = domain_posteriors(docs.withColumn(names["key"], row_key(doc_id, text)), model, text, (names["words"], names["posterior"]))
    known = cut(known.select(*keep, names["key"], names["words"], names["posterior"]), "posteriors", batch_rows=1000)
    sums = known.select(F.col(names["words"]).alias("n_words"), F.col(names["posterior"]).alias("posterior"))
    g = fit_rates(sums, [targets[d] for d in DOMAINS])
    pull = sum((F.col(names["posterior"])[i] * F.lit(float(x)) for i, x in enumerate(g)), F.lit(0.0))
    rated = known.withColumn(names["rate"], F.greatest(F.lit(0.0), 1 - pull))
    return rated.withColumn(names["copies"], _copies(F.col(names["rate"]), F.col(names["key"]))), names


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, p_clean, p_toxic, p_junk, rate, copies`` for every row of docs.

    Tokens are words. Null texts count as empty: they have posteriors and a rate but no tokens; rows with a null id are
    rounded by their text; repeated rows weigh as often as they occur and are rounded alike; other columns are not read;
    an empty table gives no rows; without labels all domains are equally likely. Targets that can't be met are met as
    nearly as possible.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rated, by = _rated(rows, labels, targets, max_labelled, "doc_id", "text", ["doc_id"])
    shares = [F.col(by["posterior"])[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return rated.select("doc_id", F.col(by["words"]).alias("n_words"), *shares, F.col(by["rate"]).alias("rate"), F.col(by["copies"]).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, each as often as its rate says (see mixing_rates). Texts are read by
    Python once: rows are written with their posteriors, from which the rates and copies follow natively."""
    rated, by = _rated(docs, labels, targets, max_labelled, doc_id, text, docs.columns)
    return rated.filter(F.col(by["copies"]) > 0).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(by["copies"]))).alias(by["words"])).select(docs.columns)
