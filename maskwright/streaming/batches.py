"""Jobs over streams: each micro-batch is one job, so every batch is whole and repeatable. An extension of this library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.operators import job as jobs
from maskwright.operators import risk
from maskwright.plans.policy import Policy


def job_per_batch(policy: Policy, mode: str, sink: Callable[[DataFrame, int], None], key: bytes | None = None, on_report: Callable[[dict, int], None] | None = None):
    """A function for ``writeStream.foreachBatch``. sink(table, batch) must write the table; it may be called again for a batch."""

    def run(batch: DataFrame, number: int) -> None:
        made = jobs.build(batch, policy, mode, key)
        sink(made.output, number)
        if on_report:
            on_report(made.report(), number)

    return run


def narrow(stream: DataFrame, policy: Policy, mode: str, key: bytes | None = None) -> DataFrame:
    """The job's projection as a streaming frame (no counts, no report): appends straight to any sink."""
    return jobs.build(stream, policy, mode, key).output


def running_classes(stream: DataFrame, quasi: list[str], time: str | None = None, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """Equivalence classes of a stream. With ``time``: per window, and late rows beyond ``late`` are left out; without, for
    output mode ``complete``."""
    if time is None:
        return risk.classes(stream, quasi)
    keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in quasi]
    return stream.withWatermark(time, late).select(time, *keys).groupBy(F.window(time, window or "1 day"), *quasi).agg(F.count(F.lit(1)).alias("rows"))
