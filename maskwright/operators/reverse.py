"""Authorized reversal: tokens of a table back to originals, by a vault's records (field, original, token)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.keys import TOKEN_CHARS

MOST_LITERALS = 2000
_HEX = f"[0-9a-f]{{{TOKEN_CHARS}}}"


def ambiguous(records: DataFrame) -> DataFrame:
    """(field, token, originals) of tokens that more than one original has: they can't be reversed."""
    return records.groupBy("field", "token").agg(F.countDistinct("original").cast("bigint").alias("originals")).filter("originals > 1")


def _usable(records: DataFrame) -> DataFrame:
    return records.join(ambiguous(records).select("field", "token"), ["field", "token"], "left_anti")


def reverse(df: DataFrame, records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table with whole-cell tokens of any column, and tokens inside texts, replaced by their originals.

    Whole cells are matched against all fields; tokens inside a text against fields of content rules (``pattern:``).
    """
    columns = columns or [n for n, t in df.dtypes if t == "string"]
    usable = _usable(records)
    lookup = usable.groupBy("token").agg(F.min("original").alias("original"), F.countDistinct("original").alias("n")).filter("n = 1").select("token", "original")
    for c in columns:
        one = lookup.select(F.col("token").alias("§t"), F.col("original").alias("§o"))
        df = df.join(one, F.col(f"`{c}`") == F.col("§t"), "left").withColumn(c, F.coalesce("§o", F.col(f"`{c}`"))).drop("§t", "§o")
    inside = usable.filter(F.col("field").startswith("pattern:") | F.col("field").startswith("dicom:pattern:")).select("token", "original").distinct()
    df = _embedded(df, inside.filter(F.col("token").rlike(f"{_HEX}$")), columns)
    return _literal(df, inside.filter(~F.col("token").rlike(f"{_HEX}$")), columns)


def _texts(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]


def _content(columns: list[str]) -> Column:
    """What a row is told by: rows with the same texts have the same tokens in them."""
    return F.sha2(F.concat_ws("\x00", *_texts(columns)), 256)


def _any_match(columns: list[str], shape: str) -> Column:
    out = F.lit(False)
    for t in _texts(columns):
        out = out | t.rlike(shape)
    return out


def _put_back(text: Column, known: Column) -> Column:
    """The text with each token of an array of (token, original) replaced in one pass, the longest first at a place."""
    shape = F.array_join(F.transform(known, lambda k: F.regexp_replace(k["token"], "([^A-Za-z0-9])", "\\\\$1")), "|")
    table = F.map_from_entries(known)
    back = F.transform(F.regexp_extract_all(text, shape, F.lit(0)), lambda t: F.element_at(table, t))
    return F.array_join(F.zip_with(F.split(text, shape, -1), F.concat(back, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _embedded(df: DataFrame, inside: DataFrame, columns: list[str]) -> DataFrame:
    """Tokens inside texts, whatever their prefixes: all runs of TOKEN_CHARS hex digits, also within longer runs, are
    looked up by a join, and the tokens that end in them are replaced. Rows without such a run are not touched."""
    some = _any_match(columns, _HEX)
    hit, rest = df.filter(some), df.filter(~some)
    runs = F.concat(*[F.regexp_extract_all(t, F.lit(f"(?=({_HEX}))"), F.lit(1)) for t in _texts(columns)])
    one = inside.groupBy("token").agg(F.min("original").alias("original")).withColumn("hex", F.expr(f"right(token, {TOKEN_CHARS})"))
    found = hit.select(_content(columns).alias("§c"), F.explode(F.array_distinct(runs)).alias("hex")).distinct().join(one, "hex")
    longest = lambda a, b: F.when(F.length(a["token"]) > F.length(b["token"]), -1).when(F.length(a["token"]) < F.length(b["token"]), 1).otherwise(0)
    known = found.groupBy("§c").agg(F.array_sort(F.collect_set(F.struct("token", "original")), longest).alias("§k"))
    hit = hit.withColumn("§c", _content(columns)).join(known, "§c", "left")
    hit = hit.withColumns({c: F.when(F.col("§k").isNull() | F.col(f"`{c}`").isNull(), F.col(f"`{c}`")).otherwise(_put_back(F.col(f"`{c}`"), F.col("§k"))) for c in columns})
    return hit.select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(rest)


def _literal(df: DataFrame, inside: DataFrame, columns: list[str]) -> DataFrame:
    """Mocks inside texts have no shape of their own: they are replaced as literals, the longest first."""
    pairs = inside.limit(MOST_LITERALS + 1).collect()
    if len(pairs) > MOST_LITERALS:
        return _stitched(df, inside, columns)
    if not pairs:
        return df
    known = dict(sorted(((r["token"], r["original"]) for r in pairs), key=lambda p: -len(p[0])))
    shape = "|".join(re.escape(t) for t in known)
    table = F.create_map(*[F.lit(x) for p in known.items() for x in p])
    for c in columns:
        text = F.col(f"`{c}`")
        back = F.transform(F.regexp_extract_all(text, F.lit(shape), F.lit(0)), lambda t: F.element_at(table, t))
        joined = F.array_join(F.zip_with(F.split(text, shape, -1), F.concat(back, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        df = df.withColumn(c, F.when(text.rlike(shape), joined).otherwise(text))
    return df


_BLOCK = 100_000


def _substrings(sizes: list[int]):
    """(key, place from 1, size, substring) of all substrings of these sizes: cut in Python, as a text is not copied for each."""

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for size in sizes:
                    for low in range(0, len(text) - size + 1, _BLOCK):
                        at = range(low, min(low + _BLOCK, len(text) - size + 1))
                        columns = [pa.array([key] * len(at), pa.string()), pa.array([i + 1 for i in at], pa.int32()), pa.array([size] * len(at), pa.int32()), pa.array([text[i : i + size] for i in at], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["§c", "at", "size", "token"])

    return run


def _stitched(df: DataFrame, inside: DataFrame, columns: list[str]) -> DataFrame:
    """Any number of literals: all substrings as long as one of them are looked up by a join; from the left, the longest
    that begins at a place is replaced."""
    one = inside.filter("token <> ''").groupBy("token").agg(F.min("original").alias("original"))
    sizes = [r[0] for r in one.select(F.length("token")).distinct().collect()]
    if not sizes:
        return df
    for c in columns:
        text = F.col(f"`{c}`")
        rows = df.withColumn("§c", F.sha2(F.coalesce(text, F.lit("")), 256))
        texts = rows.filter(F.length(text) >= min(sizes)).select("§c", text.alias("text")).dropDuplicates(["§c"])
        hits = texts.mapInArrow(_substrings(sorted(sizes)), "`§c` string, at int, size int, token string").join(one, "token")
        hits = hits.groupBy("§c").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("size")).alias("less"), "original"))).alias("§h"))
        none = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
        put = lambda s, h: F.when(h["at"] < s["at"], s).otherwise(F.struct((h["at"] - h["less"]).alias("at"), F.concat(s["out"], F.substring(text, s["at"], h["at"] - s["at"]), h["original"]).alias("out")))
        back = F.aggregate("§h", none, put, lambda s: F.concat(s["out"], F.substring(text, s["at"], F.length(text))))
        df = rows.join(hits, "§c", "left").withColumn(c, F.when(F.col("§h").isNull(), text).otherwise(back)).drop("§h", "§c")
    return df


def export(records: DataFrame) -> DataFrame:
    """The vault as a table: domain, token, original."""
    return records.select(F.col("field").alias("domain"), "token", "original")
