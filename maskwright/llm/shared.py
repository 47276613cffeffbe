"""What several operators share: cutting lineage, and columns whose names can't clash."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    The cluster names a folder that the driver and all executors share. Only where the setting is
    absent and Spark runs in this process (tests) a temporary folder of this machine stands in for it; a cluster
    without the setting is refused, as each executor would write to a disk of its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="maskwright-")
        _ROOTS[app] = f"{base.rstrip('/')}/maskwright-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop(spark: SparkSession, root: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone when Python ends; the folder is only scratch space
        return


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: a lost executor loses none of it.

    batch_rows: Python gets batches of at most this many rows meanwhile (texts and sets are large, and a batch is held
    several times); the caller's setting is put back.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = spark.conf.get(_BATCH)
    try:
        if batch_rows:
            spark.conf.set(_BATCH, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (made := _MADE.get()) is not None:
        made.append(path)
    return out


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of all tables that ``cut`` writes within the block, for this thread only."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(before)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written and that nothing still to be computed reads."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)


def forget_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """For entry points (the registered queries, the pipeline): Python gets batches of at most this many rows for the rest of
    the session. Texts are large, and a batch is held several times, by the JVM as well. Operators leave the session alone."""
    spark.conf.set(_BATCH, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """The id of a row, or for a null id one of its text, above 2**62 (rows without an id that share a text share it)."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text_of(text)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def text_of(text: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


FILTER_BITS = 23


def id_filter(ids: DataFrame) -> bytes:
    """A bitmap of 2**FILTER_BITS bits (1 MB, whatever the input) with the low bits of column ``id`` set.

    An id whose bit isn't set is not in ``ids``. When there are many more ids than bits it lets most rows pass, which
    costs time and changes no result: what passes is still joined.
    """
    slot = F.col("id").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    parts = ids.filter("id is not null").select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32768).cast("int").alias("b")).agg(F.expr("bitmap_construct_agg(cast(s % 32768 as long))").alias("bits"))
    out = bytearray((1 << FILTER_BITS) // 8)
    for row in parts.collect():
        out[row["b"] * 4096 : row["b"] * 4096 + len(row["bits"])] = row["bits"]
    return bytes(out)


def passes(bits: bytes, ids):
    """Which of an array of ids may be in the set of a filter."""
    import numpy as np

    return (np.frombuffer(bits, np.uint8)[(ids & ((1 << FILTER_BITS) - 1)) >> 3] >> (ids & 7).astype(np.uint8)) & 1 == 1
