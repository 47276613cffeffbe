"""Near-duplicate documents by SetSketch registers over word shingles.

A document is the set of its distinct five-word shingles. Register i of its sketch is
``floor(1 - log_b x_i)``, truncated to 0..Q, where x_i is the minimum over the set of exponential variables hashed from
the shingle: exponentially spaced truncated minima. Sketches of a union are the element-wise maximum. The base is near 1,
so that registers of unlike sets hardly ever agree, whatever the number of documents.

1. Sets that are equal (all copies) count once, under the smallest id. 2. Bands of ROWS registers deal them into buckets;
of buckets with the same members one is kept. 3. A bucket goes to one task in blocks (BLOCK_ROWS sets, BLOCK_SHINGLES
shingles), each with the bucket's centre. There the pairs whose sizes and joint likelihood of registers allow the
similarity are verified on their full sets: the block's sets are a sparse matrix, whose product with itself holds all
intersections. Only links that join components leave the task, so rows in and out are as many as members, not pairs.
4. Buckets of several blocks whose members are still in different components are completed: members outside the bucket's
largest component meet all others, block by block. Nothing is left out, and a group that its centres have joined costs
nothing more; one of very many texts of which none is near another still needs work that grows with its square, in rows
by n^2 / BLOCK_ROWS. 5. Components of the links are found by large-star and small-star steps, until nothing changes.

At similarity 0.75 a pair has no band in common with probability 5e-6, and is taken for unlikely by the registers (five
standard errors) with probability below 1e-5; at 0.85 both are below 1e-9. Shingles are 64-bit hashes, equal sets are told by 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import textkit
from maskwright.llm.shared import cut, forget, free_name, id_filter, passes, row_key, text_of

REGISTERS, ROWS, BASE, RATE, Q = 128, 4, 1.001, 20.0, 65534
SIZE, PERCENT = 5, 75
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19
PAIRS_AT_ONCE, SLIP = 1 << 14, 5
_RANDOM = np.random.default_rng(1)
_XOR = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_FACTOR = _RANDOM.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WIDTH = 2 * ROWS


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of each register's hash over a set of 64-bit hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    for a in range(0, len(x), 256):
        np.minimum(least, ((x[a : a + 256] ^ _XOR) * _FACTOR).min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Register values of minima: an exponential variable of rate RATE has its minimum where the uniform one has it."""
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likelihood(j, n_a, n_b, more, less, same) -> np.ndarray:
    """Log-likelihood of similarity j given the sizes and how many registers of a are more, less or the same as b's."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    up, down = _p(u - v * j), _p(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))


def estimate(n_a, n_b, more, less, same, steps: int = 40) -> np.ndarray:
    """The similarity of greatest joint likelihood, by golden section (the likelihood has one peak)."""
    low, high = np.zeros(len(n_a)), np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    g = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = high - g * (high - low), low + g * (high - low)
        left = likelihood(c, n_a, n_b, more, less, same) > likelihood(d, n_a, n_b, more, less, same)
        high, low = np.where(left, d, high), np.where(left, low, c)
    return (low + high) / 2


def reaches(j: float, n_a, n_b, more, less, same) -> np.ndarray:
    """Whether the similarity of greatest joint likelihood is j or more: the likelihood has one peak, so it is enough
    that it still rises at j. For sizes whose ratio is above j."""
    step = 1e-6
    return likelihood(j + step, n_a, n_b, more, less, same) >= likelihood(j, n_a, n_b, more, less, same)


def _sets(texts: pa.Array):
    for w in textkit.words(texts):
        values, bounds = textkit.shingles(w, SIZE)
        for d in range(len(w)):
            yield np.unique(values[bounds[d] : bounds[d + 1]])


def _key(s: np.ndarray) -> bytes | None:
    """128 bits that stand for a set of sorted hashes; none for the empty set."""
    if not len(s):
        return None
    at = np.arange(1, len(s) + 1, dtype=np.uint64)
    sums = [(textkit.mix(s + np.uint64(salt)) * (2 * at + np.uint64(1))).sum(dtype=np.uint64) for salt in (0, 0x51ED270B9F2A6E35)]
    return textkit.mix(np.array(sums, np.uint64)).tobytes()


def _sketch(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            n, key, sketch = [], [], []
            for s in _sets(batch.column(1)):
                n.append(len(s))
                key.append(_key(s))
                sketch.append(registers(minima(s)).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary())], schema=schema)

    return run


def _whole_sets(sent, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            near = passes(sent.value, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))
            batch = batch.filter(pa.array(near))
            sets = list(_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


@lru_cache(maxsize=64)
def _pairs(m: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.triu_indices(m, 1)
    return p.astype(np.int32), q.astype(np.int32)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of these sets have in common: shingles that many sets hold by matrix products, others pair by pair."""
    m = len(sets)
    values, at, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(m, dtype=np.int64), [len(s) for s in sets])
    out = np.zeros((m, m))
    often = max(2, m // 10)
    column = np.full(len(values), -1)
    many = np.flatnonzero(held >= often)
    column[many] = np.arange(len(many))
    inside = column[at] >= 0
    owner, place = own[inside], column[at[inside]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for a in range(0, len(many), 4096):
        x, y = np.searchsorted(place, [a, a + 4096])
        has = np.zeros((m, min(4096, len(many) - a)), np.float32)
        has[owner[x:y], place[x:y] - a] = 1
        out += has @ has.T
    order = np.argsort(at, kind="stable")
    owner, held_here = own[order], held[at[order]]
    for d in range(2, often):
        groups = owner[held_here == d].reshape(-1, d)
        p, q = _pairs(d)
        for a in range(0, len(groups), max(1, (1 << 20) // len(p))):
            part = groups[a : a + max(1, (1 << 20) // len(p))]
            both = np.bincount((part[:, p] * m + part[:, q]).ravel(), minlength=m * m).reshape(m, m)
            out += both + both.T
    return out


def unit_links(side: np.ndarray, component: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between the components of a unit's rows: enough of them to join all that are linked. Rows of side 0
    are compared with those of side 1, rows of side 2 with one another."""
    n = np.array([len(s) for s in sets])
    p, q = _pairs(len(n)) if len(n) <= 2 * BLOCK_ROWS else np.triu_indices(len(n), 1)
    wanted = (component[p] != component[q]) & ((side[p] != side[q]) | (side[p] == 2))
    wanted &= 100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])
    p, q = p[wanted], q[wanted]
    least = percent / 100 - SLIP * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    likely = np.zeros(len(p), bool)
    for a in range(0, len(p), PAIRS_AT_ONCE):
        i, j = p[a : a + PAIRS_AT_ONCE], q[a : a + PAIRS_AT_ONCE]
        x, y = sketch[i], sketch[j]
        more, less = np.count_nonzero(x > y, axis=1), np.count_nonzero(x < y, axis=1)
        likely[a : a + PAIRS_AT_ONCE] = reaches(least, n[i], n[j], more, less, REGISTERS - more - less)
    p, q = p[likely], q[likely]
    if not len(p):
        return []
    rows, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    both = shared_counts([sets[r] for r in rows])[at[: len(p)], at[len(p) :]]
    linked = 100 * both >= percent * (n[p] + n[q] - both)
    p, q = p[linked], q[linked]
    names, own = np.unique(component, return_inverse=True)
    least_name = np.arange(len(names))
    while True:
        new = least_name.copy()
        a, b = own[p], own[q]
        m = np.minimum(least_name[a], least_name[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        if (new == least_name).all():
            break
        least_name = new
    joined = np.flatnonzero(least_name != np.arange(len(names)))
    return [(int(names[least_name[c]]), int(names[c])) for c in joined]


def _unit_links(percent: int, schema: pa.Schema):
    """Over rows (unit, side, component, sketch, members) sorted by unit."""

    def found(rows):
        side, component, sketch, members = zip(*rows)
        return unit_links(np.array(side), np.array(component), np.frombuffer(b"".join(sketch), "<u2").reshape(-1, REGISTERS), [np.frombuffer(s, np.uint64) for s in members], percent)

    def run(batches):
        unit, rows = None, []
        for batch in batches:
            out = []
            for u, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if u != unit and rows:
                    out += found(rows) if len(rows) > 1 else []
                    rows = []
                unit = u
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)
        if len(rows) > 1:
            out = found(rows)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    return run


def _is_star(edges: DataFrame) -> bool:
    """Whether each node points to one other, which points to none: (a, b) reads "b points to a"."""
    ends = edges.select(F.col("a").alias("v"), F.lit(0).alias("points")).union(edges.select("b", F.lit(1)))
    return ends.groupBy("v").agg(F.min("points").alias("x"), F.sum("points").alias("n")).filter("n > 1 or (n = 1 and x = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each id in a link (a, b). Alternates large-star and small-star
    until every node points to its component; that takes about log(n)^2 rounds at most, and there is no other end."""
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _is_star(edges):
        # large-star: every node's greater neighbours point to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a and b <> m").select(F.col("m").alias("a"), "b").distinct()
        # small-star: a node and its lesser neighbours point to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        before, edges = edges, cut(small.unionByName(least.select(F.col("m").alias("a"), "b")).distinct(), "stars")
        forget(before)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component"))


def _blocks(rows: str, shingles: str) -> str:
    return f"cast(greatest(ceil({rows} / {BLOCK_ROWS}), ceil({shingles} / {BLOCK_SHINGLES})) as int)"


def _found(units: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (a, b) between components, from units (unit, side, key, component)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    dealt = units.join(sets, "key").select("unit", "side", "component", "sketch", "members").repartition("unit").sortWithinPartitions("unit")
    return cut(dealt.mapInArrow(_unit_links(percent, schema), "a long, b long"), name, batch_rows=500)


def _first_units(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each bucket in blocks, the centre in each of them."""
    block = F.when(F.col("id") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    rows = members.join(buckets, "bucket").select("bucket", "key", F.col("id").alias("component"), F.explode(block).alias("block"))
    return rows.select(F.xxhash64("bucket", "block").alias("unit"), F.lit(2).alias("side"), "key", "component")


def _second_units(members: DataFrame, buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Buckets of several blocks: members outside the largest component (side "rest") against one another and against it."""
    rows = members.join(buckets.filter("blocks > 1").select("bucket"), "bucket").join(label, "id", "left").select("bucket", "key", "n", F.coalesce("component", "id").alias("component"))
    parts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"))
    sides = parts.groupBy("bucket").agg(F.max(F.struct("many", "total", "component")).alias("main"), F.sum("many").alias("many"), F.sum("total").alias("total")).filter("many > main.many")
    sides = sides.select("bucket", F.col("main.component").alias("main"), F.expr(_blocks("main.many", "main.total")).alias("g"), F.expr(_blocks("(many - main.many)", "(total - main.total)")).alias("r"))
    rows = rows.join(sides, "bucket").withColumn("rest", F.col("component") != F.col("main"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.when(F.col("rest"), F.col("r")).otherwise(F.col("g"))).cast("int"))
    # a unit is (lower block, higher block) of the rest, or (block of the rest, r + block of the largest component)
    low = "array(least(own, o), greatest(own, o), if(own = o, 2, if(own < o, 0, 1)))"
    among, across = f"transform(sequence(0, r - 1), o -> {low})", "transform(sequence(0, g - 1), o -> array(own, r + o, 0))"
    rows = rows.select("*", F.explode(F.expr(f"if(rest, concat({among}, {across}), transform(sequence(0, r - 1), o -> array(o, r + own, 1)))")).alias("u"))
    return rows.select(F.xxhash64("bucket", F.lit(2), F.col("u")[0], F.col("u")[1]).alias("unit"), F.col("u")[2].alias("side"), "key", "component")


def near_groups(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of docs.

    Documents are linked when 100 * |intersection| >= percent * |union| of their full sets; component_id is the
    smallest id reachable by links. A document of fewer than five words has its whole sequence as one shingle; one
    without words (null, empty or white text) has none and is its own component. A null id is reported as its own
    component (null) and kept, its links unused; rows that repeat an id are joined in one component; other columns are
    not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sketch", pa.binary())])
    known = cut(rows.mapInArrow(_sketch(schema), "doc_id long, n long, key binary, sketch binary"), "sketches", batch_rows=1000)
    ids = known.filter("n > 0 and doc_id is not null")
    reps = cut(ids.groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "representatives")

    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda b: F.xxhash64(b, F.call_function("substring", F.col("sketch"), b * _WIDTH + 1, F.lit(_WIDTH))))
    banded = reps.select("key", "id", "n", F.explode(bands).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("bucket")
    members = cut(banded.join(shared, "bucket"), "members")
    # of buckets with the same members (told by 128 bits) one is kept
    content = [F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"), F.min("id").alias("centre"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]
    buckets = members.groupBy("bucket").agg(*content).groupBy("many", "total", "centre", "x", "y").agg(F.min("bucket").alias("bucket"))
    buckets = cut(buckets.select("bucket", "centre", F.expr(_blocks("many", "total")).alias("blocks")), "buckets")

    wanted = reps.join(members.select("key").distinct(), "key", "left_semi")
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("id")))
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("members", pa.binary())])
    whole = rows.mapInArrow(_whole_sets(sent, schema), "id long, key binary, members binary")
    # a row that repeats id and text holds the same set
    sets = cut(whole.join(wanted.select("id", "key", "sketch"), ["id", "key"]).dropDuplicates(["id", "key"]).select("key", "sketch", "members"), "sets", batch_rows=1000)

    # an id that is repeated with other texts ties their sets together
    owned = ids.select("doc_id", "key").join(reps.select("key", "id"), "key")
    several = owned.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z")
    tied = owned.join(several, "doc_id").select("a", F.col("id").alias("b")).filter("a <> b")
    label = components(_found(_first_units(members, buckets), sets, percent, "links").unionByName(tied))
    if not buckets.filter("blocks > 1").isEmpty():
        found = _found(_second_units(members, buckets, label), sets, percent, "links")
        label = components(found.unionByName(label.select(F.col("component").alias("a"), F.col("id").alias("b"))))
    forget(sets, members, buckets)

    owners = reps.select("key", "id").join(label, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    named = known.select("doc_id", "n", "key").join(owners, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but one document only of each group (see near_groups): that of the
    smallest id. Rows without an id are told by their text and come after all others; of rows that repeat an id, and of
    those without one that share a text, one stays if it has words. Rows without words all stay."""
    key = free_name(docs, "near_key")
    rows = docs.withColumn(key, row_key(doc_id, text))
    groups = near_groups(rows, percent, key, text)
    dropped = groups.filter("not kept").select(F.col("doc_id").alias(key)).distinct()
    repeated = cut(groups.filter("kept and n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key)), "repeated")
    kept = rows.join(dropped, key, "left_anti")
    if not repeated.isEmpty():
        first = F.min_by(F.struct(*docs.columns), F.struct(text_of(text) == "", F.xxhash64(*docs.columns))).alias("row")
        kept = kept.join(repeated, key, "left_anti").select(docs.columns).unionByName(kept.join(repeated, key, "left_semi").groupBy(key).agg(first).select("row.*"))
    return kept.select(docs.columns)
