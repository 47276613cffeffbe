"""Publishing: a result appears whole under its name, or not at all. Any file system that Hadoop knows."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from maskwright.errors import PolicyError


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def resolved(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    full = fs.makeQualified(p)
    return fs.resolvePath(full).toString() if fs.exists(full) else full.toString()


def refuse_in_place(spark: SparkSession, source: str, target: str) -> None:
    """An output that is its input, by any spelling, would be destroyed before it is read."""
    if resolved(spark, source).rstrip("/") == resolved(spark, target).rstrip("/"):
        raise PolicyError(f"input and output are the same: {target}")


@contextmanager
def staged(spark: SparkSession, target: str, job: str):
    """Yields a path to write to; renamed to target on success (replacing what is there), deleted on failure."""
    final, fs = _path(spark, target)
    parent = final.getParent()
    name = f".{final.getName()}.{hashlib.sha256(job.encode()).hexdigest()[:8]}.part"
    beside = lambda n: spark._jvm.org.apache.hadoop.fs.Path(parent, n) if parent is not None else spark._jvm.org.apache.hadoop.fs.Path(n)
    part, old = beside(name), beside(f"{name[:-5]}.old")
    fs.delete(part, True)
    try:
        yield part.toString()
        if parent is not None:
            fs.mkdirs(parent)
        # what is there steps aside until the new one has its name, so that a crash never loses both
        aside = fs.exists(final)
        if aside:
            fs.delete(old, True)
            if not fs.rename(final, old):
                raise OSError(f"{final} could not be renamed to {old}")
        if not fs.rename(part, final):
            if aside:
                fs.rename(old, final)
            raise OSError(f"{part} could not be renamed to {final}")
        fs.delete(old, True)
    finally:
        fs.delete(part, True)


def folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share; where Spark runs in this process and the
    setting is absent, in a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskwright-")
    path = f"{base.rstrip('/')}/maskwright-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    atexit.register(_drop, spark, path)
    return f"{path}/{name}"


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p, fs = _path(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may be gone when Python ends; the folder is only scratch space
        return


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver, staged like a table."""
    with staged(spark, path, path) as part:
        p, fs = _path(spark, part)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8-sig")
    finally:
        stream.close()
