"""Residual risk: equivalence classes of the quasi-identifiers in the output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
K_LEVELS = (2, 5, 10)


def classes(df: DataFrame, quasi: list[str]) -> DataFrame:
    """A row for each class: the quasi-identifiers as texts (missing as empty) and ``rows``. One shuffle, of partial counts."""
    keys = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in quasi]
    return df.select(*keys).groupBy(*[F.col(f"`{c}`") for c in quasi]).agg(F.count(F.lit(1)).alias("rows"))


def summary(classes_df: DataFrame, levels: tuple[int, ...] = K_LEVELS) -> DataFrame:
    """One row: classes, rows, sizes, unique rows and rows in classes of at least k; sums are null if there are no rows."""
    n = F.col("rows")
    total = F.sum(n)
    at_least = []
    for k in levels:
        held = F.sum(F.when(n >= k, n).otherwise(0))
        at_least += [held.cast("bigint").alias(f"rows_k{k}"), (held.cast("double") / total).alias(f"ratio_k{k}")]
    unique = F.sum(F.when(n == 1, 1).otherwise(0))
    return classes_df.agg(
        F.count(F.lit(1)).alias("classes"),
        total.cast("bigint").alias("total_rows"),
        F.min(n).cast("bigint").alias("min_size"),
        F.max(n).cast("bigint").alias("max_size"),
        (total.cast("double") / F.count(F.lit(1))).alias("mean_size"),
        unique.cast("bigint").alias("unique_rows"),
        (unique.cast("double") / total).alias("unique_ratio"),
        *at_least,
    )


def summary_dict(df: DataFrame, quasi: list[str]) -> dict | None:
    """The summary as a report has it; None without quasi-identifiers or rows."""
    if not quasi:
        return None
    row = summary(classes(df, quasi)).first()
    if not row["classes"]:
        return None
    return {
        "quasi_identifiers": quasi,
        "classes": row["classes"],
        "min_class_size": row["min_size"],
        "max_class_size": row["max_size"],
        "mean_class_size": row["mean_size"],
        "unique_rows": row["unique_rows"],
        "unique_ratio": row["unique_ratio"],
        "k_anonymity": [{"k": k, "rows": row[f"rows_k{k}"], "ratio": row[f"ratio_k{k}"]} for k in K_LEVELS],
    }
