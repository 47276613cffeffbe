"""Mapping vaults: encrypted, reversible records (field, original, token) of one dataset.

A vault is a folder: ``header.json`` and ``entries`` (text, one encrypted record a line, ordered by nonce so that the order
tells nothing). AES-GCM with a key that serves vaults of this dataset only; the nonce is a keyed hash of the record, and
the dataset and version are authenticated with it. The header has the number of records, so lost lines are noticed.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.errors import VaultError
from maskwright.functions.keys import Keyed, dataset_key, secret_cells
from maskwright.sources import staging

VERSION = 1
_RECORD = "field string, original string, token string"


def _bound(dataset: str):
    return F.lit(f"maskwright-vault:{VERSION}:{dataset}".encode())


def sealed(mappings: DataFrame, secret: str, dataset: str) -> DataFrame:
    """Column ``value``: one line for each distinct (field, original)."""
    key = dataset_key(secret, dataset, "vault")
    (cell,) = secret_cells(mappings.sparkSession, key)
    rows, keyed = Keyed.on(mappings.dropDuplicates(["field", "original"]), key)
    rows = rows.withColumn("plain", F.to_json(F.struct("field", "original", "token")))
    nonce = F.unhex(F.substring(keyed.hex("vault", dataset, F.col("plain")), 1, 24))
    locked = F.aes_encrypt(F.col("plain").cast("binary"), cell, F.lit("GCM"), F.lit("DEFAULT"), nonce, _bound(dataset))
    return rows.select(F.regexp_replace(F.base64(locked), "[\r\n]", "").alias("value")).sort("value")


def opened(lines: DataFrame, secret: str, dataset: str) -> DataFrame:
    """(field, original, token) from sealed lines; a line that doesn't open is an error."""
    (cell,) = secret_cells(lines.sparkSession, dataset_key(secret, dataset, "vault"))
    plain = F.try_aes_decrypt(F.unbase64("value"), cell, F.lit("GCM"), F.lit("DEFAULT"), _bound(dataset)).cast("string")
    checked = F.coalesce(plain, F.raise_error(F.lit("a vault record doesn't open: wrong key, wrong dataset or changed file")))
    return lines.select(F.from_json(checked, _RECORD).alias("r")).select("r.*")


def write_vault(mappings: DataFrame, path: str, secret: str, dataset: str) -> int:
    """Write a vault; returns its number of records."""
    spark = mappings.sparkSession
    with staging.staged(spark, path, path) as part:
        sealed(mappings, secret, dataset).write.text(f"{part}/entries")
        n = spark.read.text(f"{part}/entries").count()
        staging.write_text(spark, f"{part}/header.json", json.dumps({"vault": VERSION, "dataset": dataset, "records": n}))
    return n


def read_vault(spark: SparkSession, path: str, secret: str, dataset: str) -> DataFrame:
    """(field, original, token). Errors are raised before any record is given out."""
    header = json.loads(staging.read_text(spark, f"{path}/header.json"))
    if header.get("vault") != VERSION or header.get("dataset") != dataset:
        raise VaultError(f"the vault is of dataset {header.get('dataset')!r}, version {header.get('vault')}")
    records = opened(spark.read.schema("value string").text(f"{path}/entries"), secret, dataset)
    try:
        n = records.agg(F.count("field")).first()[0]
    except Exception as e:
        raise VaultError("the vault doesn't open: wrong key, or it was changed") from e
    if n != header["records"]:
        raise VaultError(f"the vault has {n} records, its header says {header['records']}")
    return records
