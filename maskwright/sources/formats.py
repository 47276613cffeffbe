
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.errors import FormatError

#: Fixed values.
EXTENSIONS = {"csv": "csv", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet"}
SHOWN = 48
#: Rows of one task, where rows are dealt out.
ROWS_A_TASK = 32_768


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by key, ROWS_A_TASK or so a task: for rows that are much work or become many, since a Parquet
    file of one row group is one task, whatever its length. Rows are counted by the files' footers."""
    tasks = -(-df.count() // ROWS_A_TASK)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def infer_format(path: str) -> str:
    """csv, jsonl or parquet by the extension, in any letter case."""
    extension = os.path.splitext(path.rstrip("/"))[1][1:].lower()
    if extension not in EXTENSIONS:
        raise FormatError(f"{label(path)}: the format can't be told from the extension {extension!r}")
    return EXTENSIONS[extension]


def label(text: str) -> str:
    """A text that is safe in a message: control characters replaced, long ones cut with a note of their length."""
    clean = "".join("�" if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in text)
    return clean if len(clean) <= SHOWN else f"{clean[:SHOWN]}… ({len(clean)} characters)"


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    kind = kind or infer_format(path)
    return {"csv": read_csv, "jsonl": read_jsonl, "parquet": lambda s, p: s.read.parquet(p)}[kind](spark, path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Texts only. A row with more or fewer cells than the header is an error when it is read."""
    return spark.read.csv(path, header=True, escape='"', multiLine=True, mode="FAILFAST", inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=False)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Texts only; the first object gives the columns and their order. Later keys, nested values and lines that aren't
    objects are errors when they are read; missing keys and nulls are missing values. Blank lines are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\\x{FEFF}", "").alias("line")).filter(F.trim("line") != "")
    first = lines.select(F.json_object_keys("line").alias("keys"), "line").first()
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    if first["keys"] is None:
        raise FormatError(f"{label(path)}: the first line isn't an object: {label(first['line'])}")
    names = list(first["keys"])
    if len(set(names)) != len(names):
        raise FormatError(f"{label(path)}: the first object has a key twice")
    keys = F.json_object_keys("line")
    known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    cells = F.from_json("line", T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    kinds = F.from_json("line", T.MapType(T.StringType(), T.VariantType()))
    nested = F.exists(F.map_values("kinds"), lambda v: F.schema_of_variant(v).rlike("^(ARRAY|OBJECT|STRUCT)"))
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what}: "), F.substring("line", 1, SHOWN)))
    checked = (
        F.when(keys.isNull(), wrong("a line isn't an object"))
        .when(F.size(F.array_except(keys, known)) > 0, wrong("a line has a key that the first one has not"))
        .when(nested, wrong("a value is an array or object"))
        .otherwise(F.col("cells"))
    )
    rows = lines.select("line", cells.alias("cells"), kinds.alias("kinds")).select(checked.alias("cells"))
    return rows.select(*[F.col("cells").getItem(n).alias(n) for n in names])


def _json_value(c: Column) -> Column:
    """A cell as JSON: missing as null, numbers and booleans only if their text comes back the same, else a string."""
    whole = c.try_cast("bigint")
    real = c.try_cast("double")
    shape = r"^-?(?:0|[1-9][0-9]*)"
    is_whole = c.rlike(shape + "$") & (whole.cast("string") == c)
    is_real = c.rlike(shape + r"\.[0-9]+$") & (real.cast("string") == c)
    text = F.regexp_extract(F.to_json(F.struct(c.alias("c"))), r'(?s)^\{"c":(.*)\}$', 1)
    return F.when(c.isNull() | (c == ""), F.lit("null")).when(is_whole | is_real | c.isin("true", "false"), c).otherwise(text)


def json_lines(df: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object in the order of the columns."""
    pair = lambda n: F.concat(F.regexp_extract(F.to_json(F.struct(F.lit(n).alias("c"))), r'(?s)^\{"c":(.*)\}$', 1), F.lit(":"), _json_value(F.col(f"`{n}`").cast("string")))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *map(pair, df.columns)), F.lit("}")).alias("value"))


def text_kinds(df: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string for each text column, from all its values (one pass).

    A column is a number only if every text comes back the same from it: zero-padded, signed and long digit strings, as
    well as 1.10, stay texts.
    """
    checks = []
    for n in df.columns:
        c = F.col(f"`{n}`")
        held = c.isNotNull() & (c != "")
        whole = c.rlike("^-?(?:0|[1-9][0-9]*)$") & (c.try_cast("bigint").cast("string") == c)
        real = whole | c.rlike(r"^-?(?:0|[1-9][0-9]*)\.[0-9]+$") & (c.try_cast("double").cast("string") == c)
        every = lambda p: F.coalesce(F.bool_and(F.when(held, F.coalesce(p, F.lit(False)))), F.lit(False))  # noqa: B023, E731
        checks.append(F.struct(every(whole), every(real), every(c.isin("true", "false"))).alias(n))
    row = df.agg(*checks).first()
    return {n: next((k for k, ok in zip(("bigint", "double", "boolean"), row[n]) if ok), "string") for n in df.columns}


def typed(df: DataFrame) -> DataFrame:
    """Text columns cast to the kinds of ``text_kinds``; empty texts become missing; other columns stay."""
    texts = [n for n, t in df.dtypes if t == "string"]
    kinds = text_kinds(df.select(*[F.col(f"`{n}`") for n in texts])) if texts else {}
    return df.select(*[F.when(F.col(f"`{n}`") != "", F.col(f"`{n}`")).cast(kinds[n]).alias(n) if n in kinds else F.col(f"`{n}`") for n in df.columns])


def write(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Write a folder of part files. An empty table still has its header or schema."""
    kind = kind or infer_format(path)
    if kind == "csv":
        plain = df.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in df.columns])
        plain.write.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif kind == "jsonl":
        json_lines(df).write.text(path)
    else:
        df.write.parquet(path)
