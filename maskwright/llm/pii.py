"""Personal data: exact base patterns, widened by bootstrapped contextual extraction.

Base spans (fixed rules, see ``base_spans``) are seeds, and so are tokens in well-known forms of secrets (``_SECRET``).
Every identifier-like span, seed or not, is an occurrence of an instance (its value) under lexical patterns: the one, two
and three words before it or after it together with its rough shape, and its exact form (digits as 9, letters as a or
A). Brackets, quotes and marks beside a span are passed over, and numbers written in groups are spans as a whole. Spark
scores the graph of patterns and instances in rounds:

    confidence(pattern, kind) = sum of its instances' scores / (occurrences + 2) * specificity
    score(instance, kind)     = 1 - product over left, right and form of (1 - greatest confidence)   (seeds stay at 1)

where specificity is the share of the uses of a pattern's words in the whole corpus that stand beside an identifier: a word
such as "the" proves nothing, a label such as "tel:" does; a form is specific. Patterns count from ``min_seeds`` different
seeds on; occurrences of instances that reach ``accept`` become spans of that kind. Base spans always stay. What is written
like a card or an IPv4 address and fails its test counts against its patterns and is never learnt as one.

The corpus is read twice: once for the occurrences, once to count the words that stand beside them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import textkit
from maskwright.llm.shared import cut, text_of

#: Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_QUAD = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Seeds of secrets: hexadecimal digests of usual lengths and access keys with a known prefix.
_SECRET = re.compile(r"(?=[a-f]*[0-9])(?=[0-9]*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|AIza[0-9A-Za-z_-]{35}")
_SECRET_KIND, CONTEXT = 4, 3
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_REST = re.compile(r"[^\x20\x09-\x0D]*")
_EDGE = ".,;:!?\"'()[]{}<>"
_BETWEEN = frozenset(" ()/-")
_MOST_DIGITS = 19  # of a number in groups, as of a card
_WHITE = frozenset(" \t\n\v\f\r")
_BITS = 20  # the bitmap of words that stand beside an identifier has 2**20 bits, whatever the input


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind; code points, end exclusive. Matches that fail a test are dropped."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            out.append((start, done, 0))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
        out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def shape(value: str) -> str:
    """``@`` with an at sign, ``9`` for digits and punctuation only, ``a`` with letters."""
    return "@" if "@" in value else "a" if any(c.isalpha() for c in value) else "9"


_LETTERS = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})


def form(value: str) -> str:
    """The value with digits as 9, ASCII letters as a or A; all else stays."""
    return value.translate(_LETTERS)


def barred(value: str) -> int:
    """The base kind whose test the value fails, though it is written like one: it is never learnt as that. -1 for none."""
    if _QUAD.fullmatch(value):
        return -1 if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in value.split(".")) else 1
    digits = value.replace(" ", "").replace("-", "")
    return 2 if _CARD.fullmatch(value) and 12 <= len(digits) <= 19 and not _luhn(digits) else -1


def _words_before(text: str, at: int) -> list[str]:
    """Up to CONTEXT words, the nearest first; none if the span is glued to a word."""
    out: list[str] = []
    while at and text[at - 1] in _EDGE:
        at -= 1
    while len(out) < CONTEXT:
        end = at
        while end and text[end - 1] in _WHITE:
            end -= 1
        if not end or end == at:
            break
        at = end
        while at and text[at - 1] not in _WHITE:
            at -= 1
        out.append(text[at:end])
    return out


def _words_after(text: str, at: int) -> list[str]:
    out: list[str] = []
    while at < len(text) and text[at] in _EDGE:
        at += 1
    while len(out) < CONTEXT:
        n = at
        while n < len(text) and text[n] in _WHITE:
            n += 1
        if n == len(text) or n == at:
            break
        at = _REST.match(text, n).end()
        out.append(text[n:at])
    return out


def _grouped_numbers(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Numbers written in groups: spans of two or more neighbours of ``found`` that are digits and punctuation only."""
    out, start, end, groups, digits = [], 0, -1, 0, 0
    for a, b in [*found, (len(text), len(text))]:
        own = sum("0" <= c <= "9" for c in text[a:b]) if a < b and shape(text[a:b]) == "9" else 0
        between = text[end:a] if groups else ""
        if own and groups and len(between) <= 4 and _BETWEEN.issuperset(between) and digits + own <= _MOST_DIGITS:
            end, groups, digits = b, groups + 1, digits + own
            continue
        if groups > 1:
            out.append((start, end))
        start, end, groups, digits = a, b, int(own > 0), own
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list[str], list[str], str]]:
    """(start, end, kind or -1, words before, words after, shape) of base spans, of secrets and other tokens with a digit
    or an @, and of numbers in groups. The groups themselves have a shape of their own: a cue beside them is one of the
    whole number."""
    taken = base
    found = [(a, b, k) for a, b, k in base]
    m, i = _MARK.search(text), 0
    while m:
        start = m.start()
        while start and text[start - 1] not in _WHITE:
            start -= 1
        end = _REST.match(text, m.start()).end()
        a, b = start, end
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if a < b and not any(s < end and e > start for s, e, _ in taken[i : i + 8]):
            found.append((a, b, _SECRET_KIND if _SECRET.fullmatch(text, a, b) else -1))
        m = _MARK.search(text, end)
    numbers = _grouped_numbers(text, [(a, b) for a, b, k in found if k < 0])
    within = {(a, b) for s, e in numbers for a, b, k in found if k < 0 and s <= a and b <= e} if numbers else ()
    found += [(s, e, -1) for s, e in numbers]
    return [(a, b, k, _words_before(text, a), _words_after(text, b), "part" if k < 0 and (a, b) in within else shape(text[a:b])) for a, b, k in sorted(found)]


def _hashes(strings: list[str]) -> np.ndarray:
    """Hashes of single words, as textkit has them; 0 for an empty string."""
    out = np.zeros(len(strings), np.uint64)
    for w in textkit.words(pa.array(strings, pa.large_string())):
        some = np.flatnonzero(np.diff(w.bound))
        out[w.first + some] = w.hash[w.bound[some]]
    return out


def _in_a_row(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from one hash a word in the order of the text; n = 1 gives these."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        out = textkit.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(hashes) - n + 1 + j])
    return out


def _contexts(before: list[np.ndarray], after: list[np.ndarray]) -> tuple[list[list[int]], list[list[int]]]:
    """For each occurrence the hashes of the 1 .. CONTEXT words before it, and after it."""
    left = [[int(_in_a_row(w[:n][::-1], n)[0].view(np.int64)) for n in range(1, len(w) + 1)] for w in before]
    right = [[int(_in_a_row(w[:n], n)[0].view(np.int64)) for n in range(1, len(w) + 1)] for w in after]
    return left, right


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_FOUND = "array<struct<start:int,end:int,kind:int,barred:int,value:long,form:long,before:array<long>,after:array<long>,shape:string>>"


def _find(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            spans, found = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                some = occurrences(text, base)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                if not some:
                    found.append([])
                    continue
                words = _hashes([w for o in some for side in o[3:5] for w in side])
                cuts = np.split(words, np.cumsum([len(side) for o in some for side in o[3:5]])[:-1])
                left, right = _contexts(cuts[::2], cuts[1::2])
                found.append([{"start": a, "end": b, "kind": k, "barred": barred(text[a:b]), "value": _digest(text[a:b]), "form": _digest(form(text[a:b])), "before": left[i], "after": right[i], "shape": s} for i, (a, b, k, _, _, s) in enumerate(some)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, schema.field(1).type), pa.array(found, schema.field(2).type)], schema=schema)

    return run


_HELD = 1 << 18


def _count_words(bits: bytes, schema: pa.Schema):
    """(word, uses) of the words, and words in a row, whose bit is set: one row for each word and task, or a few if a task has very many."""

    def summed(parts):
        words, own = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return words, np.bincount(own, np.concatenate([n for _, n in parts]), len(words)).astype(np.int64)

    def rows(words, n):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], schema=schema)

    def run(batches):
        near = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        parts, size = [], 0
        for batch in batches:
            for w in textkit.words(batch.column(0)):
                # words in a row are not counted across texts
                rows_of = np.repeat(np.arange(len(w)), np.diff(w.bound))
                some = []
                for k in range(1, CONTEXT + 1):
                    h = _in_a_row(w.hash, k)
                    some.append(h[near[h & np.uint64((1 << _BITS) - 1)] & (rows_of[: len(h)] == rows_of[k - 1 : k - 1 + len(h)])])
                words, n = np.unique(np.concatenate(some), return_counts=True)
                parts.append((words, n))
                size += len(words)
                if size > _HELD:
                    parts = [summed(parts)]
                    size = len(parts[0][0])
                    if size > _HELD // 2:
                        yield rows(*parts[0])
                        parts, size = [], 0
        if size:
            yield rows(*summed(parts))

    return run


def _bitmap(words: DataFrame) -> bytes:
    """Bits of the hashes in column ``word``: at most 2**_BITS / 32768 rows reach the driver."""
    slot = F.col("word").bitwiseAND(F.lit((1 << _BITS) - 1))
    rows = words.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32768).cast("int").alias("b")).agg(F.expr("bitmap_construct_agg(cast(s % 32768 as long))").alias("bits")).collect()
    out = bytearray((1 << _BITS) // 8)
    for r in rows:
        out[r["b"] * 4096 : r["b"] * 4096 + len(r["bits"])] = r["bits"]
    return bytes(out)


def patterns_of(edges: DataFrame, scores: DataFrame, special: DataFrame, min_seeds: int, accept: float) -> DataFrame:
    """(side, word, shape, kind, confidence) of the patterns that enough seeds support, from edges (side, word, shape, value,
    kind, barred, n) and scores (value, kind, score)."""
    by = ["side", "word", "shape"]
    support = edges.drop("kind").join(scores, "value").groupBy(*by, "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"), F.count_if(F.col("score") >= accept).alias("seeds"))
    all_n = edges.groupBy(*by).agg(F.sum("n").alias("all_n"))
    known = support.filter(F.col("seeds") >= min_seeds).join(all_n, by).join(special, ["side", "word"], "left")
    return known.select(*by, "kind", (F.col("mass") / (F.col("all_n") + 2) * F.coalesce("special", F.lit(1.0))).alias("confidence")).filter("confidence >= 0.05")


def scores_of(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, kind, score) of the instances that aren't seeds: the greatest confidence of each side, joined as independent."""
    sides = edges.filter("kind < 0").drop("kind").join(patterns, ["side", "word", "shape"]).filter("kind <> barred")
    best = sides.groupBy("value", "kind", F.substring("side", 1, 1).alias("from")).agg(F.max("confidence").alias("confidence"))
    return best.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("score"))


def personal_data(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, accept: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256``, ``spans`` (all), ``n_spans``,
    ``n_secret`` (seeds of that kind) and ``n_learnt`` (spans that learnt patterns added, of any kind).

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind, joined by commas. Null texts
    count as empty and have no span; null ids stay null; repeated rows are reported one by one but count as evidence as
    often as they occur; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])
    longs = pa.list_(pa.int64())
    item = pa.struct([*span, pa.field("barred", pa.int32()), pa.field("value", pa.int64()), pa.field("form", pa.int64()), pa.field("before", longs), pa.field("after", longs), pa.field("shape", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("found", pa.list_(item))])
    seen = rows.mapInArrow(_find(schema), f"doc_id long, base array<struct<start:int,end:int,kind:int>>, found {_FOUND}")
    seen = cut(seen.withColumn("key", F.monotonically_increasing_id()), "occurrences", batch_rows=1000)

    one = seen.select("key", F.explode("found").alias("o")).select("key", "o.*")
    # sides are < or > with the number of words, and = for the form
    words = lambda c, s: F.transform(c, lambda w, i: F.struct(F.concat(F.lit(s), (i + 1).cast("string")).alias("side"), w.alias("word")))
    patterns = F.concat(words("before", "<"), words("after", ">"), F.array(F.struct(F.lit("=").alias("side"), F.col("form").alias("word"))))
    edges = one.select("kind", "barred", "value", "shape", F.explode(patterns).alias("c")).select("kind", "barred", "value", "shape", "c.*")
    edges = edges.groupBy("side", "word", "shape", "value").agg(F.max("kind").alias("kind"), F.max("barred").alias("barred"), F.count(F.lit(1)).alias("n"))
    edges = cut(edges, "edges")
    by = ["side", "word", "shape"]
    # a pattern needs so many different values, whatever their scores: the others can't count in any round
    edges = cut(edges.join(edges.groupBy(*by).count().filter(F.col("count") >= min_seeds).select(*by), by, "left_semi"), "patterns")
    total = pa.schema([("word", pa.int64()), ("uses", pa.int64())])
    beside = edges.filter("side <> '='")
    uses = rows.select("text").mapInArrow(_count_words(_bitmap(beside), total), "word long, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))
    special = beside.groupBy("side", "word").agg(F.sum("n").alias("near")).join(uses, "word").select("side", "word", F.least(F.lit(1.0), F.col("near") / F.col("uses")).alias("special"))
    special = cut(special, "words", batch_rows=1000)

    seeds = edges.filter("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    scores = seeds
    for _ in range(rounds):
        scores = cut(seeds.unionByName(scores_of(edges, patterns_of(edges, scores, special, min_seeds, accept))), "scores")
    # a value that is a seed in one place is known in all others
    best = scores.groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("new_kind"), F.max("score").alias("score")).filter(F.col("score") >= accept)
    more = one.filter("kind < 0").join(best, "value").groupBy("key").agg(F.collect_list(F.struct("start", "end", F.col("new_kind").alias("kind"))).alias("more"))

    # a group of a number that is marked as a whole is not marked again
    larger = lambda s, o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    more = more.withColumn("more", F.filter("more", lambda s: ~F.exists("more", lambda o: larger(s, o))))

    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))), lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    told = seen.join(more, "key", "left").withColumn("secret", plain(F.filter("found", lambda s: s["kind"] == _SECRET_KIND)))
    told = told.withColumn("added", F.coalesce("more", F.slice("base", 1, 0)))
    return told.select(
        "doc_id",
        *[number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "secret", "added")).alias("spans"),
        (F.size("base") + F.size("secret") + F.size("added")).cast("long").alias("n_spans"),
        F.size("secret").cast("long").alias("n_secret"),
        F.size("added").cast("long").alias("n_learnt"),
    )
