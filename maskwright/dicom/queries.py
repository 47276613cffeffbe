"""Registered queries over attribute tables, which are made from the driver's tables: an instance for each customer or order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.dicom import actions, profile
from maskwright.dicom.policy import parse_dicom_policy
from maskwright.functions.keys import dataset_key, pads, prefix
from maskwright.sources import formats

KEY = dataset_key("a fixed secret for the driver's comparison, 0123456789", "driver-images")
POLICY = {"version": 1, "dataset": "driver-images", "tags": [{"tag": "OtherPatientIDs", "action": "remove"}]}


def _row(keyword: str, value, path: tuple[str, int] | None = None):
    tag, vr = profile.TAGS[keyword]
    spot = [F.struct(F.lit(profile.TAGS[path[0]][0]).alias("tag"), F.lit(path[1]).alias("item"))] if path else []
    where = (F.array(*spot) if spot else F.array()).cast("array<struct<tag:string,item:int>>")
    return F.struct(where.alias("seq_path"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), F.array(value.cast("string")).alias("values"), F.lit(None).cast("binary").alias("raw"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in several tasks, since each becomes many attributes."""
    return formats.dealt(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name", "c_nationkey"), "c_custkey")


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """An image for each customer: identity, a nested observer, modality, burned-in flag and pixels that depend on the key."""
    k = F.col("c_custkey")
    modality = F.element_at(F.array(F.lit("CT"), F.lit("US"), F.lit("MR")), (k % 3 + 1).cast("int"))
    rows = F.array(
        _row("PatientName", F.col("c_name")), _row("PatientID", k), _row("OtherPatientIDs", k), _row("StudyInstanceUID", F.concat(F.lit("1.2.840."), F.col("c_nationkey").cast("string"))),
        _row("Modality", modality), _row("PatientSex", F.lit("O")), _row("VerifyingObserverSequence", F.lit("")), _row("VerifyingObserverName", F.col("c_name"), ("VerifyingObserverSequence", 0)),
    )
    flag = F.when(k % 4 == 0, F.array(_row("BurnedInAnnotation", F.lit("YES")))).when(k % 4 == 1, F.array(_row("BurnedInAnnotation", F.lit("NO"))))
    pixels = F.when(k % 5 != 0, F.array(_row("PixelData", F.lit(""))))
    none = F.slice(rows, 1, 0)
    return _customers(spark, sf).select(k.cast("string").alias("instance"), F.explode(F.concat(rows, F.coalesce(flag, none), F.coalesce(pixels, none))).alias("a")).select("instance", "a.*")


def dicom_pixel_risk(spark: SparkSession, sf: str) -> DataFrame:
    return actions.pixel_risk(attributes(spark, sf)).select("instance", "has_pixels", "burned_in", "modality", "level")


def _result(spark: SparkSession, sf: str) -> DataFrame:
    return actions.deidentify(attributes(spark, sf), parse_dicom_policy(POLICY), KEY)


def dicom_findings(spark: SparkSession, sf: str) -> DataFrame:
    return actions.findings(_result(spark, sf))


def dicom_by_action(spark: SparkSession, sf: str) -> DataFrame:
    return actions.by_action(_result(spark, sf))


def dicom_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return actions.kept(_result(spark, sf)).filter(F.col("tag") == profile.TAGS["PatientID"][0]).select("instance", F.get("values", F.lit(0)).alias("patient"))


def dicom_uid_remap(spark: SparkSession, sf: str) -> DataFrame:
    """How many studies there are before and after: one new identifier for each old one, in every image."""
    rows = _result(spark, sf).filter(F.col("tag") == profile.TAGS["StudyInstanceUID"][0])
    old, new = F.get("original", F.lit(0)), F.get("values", F.lit(0))
    return rows.groupBy(old.alias("study")).agg(F.countDistinct(new).alias("new_ids"), F.min(new.startswith("2.25.") & (F.length(new) <= 64)).alias("sound"), F.count(F.lit(1)).alias("images"))


#: More actions, each on an attribute of its own, and structural rules for what isn't listed.
ACTIONS_POLICY = {
    "version": 1,
    "dataset": "driver-images",
    "profile": "none",
    "structural": {},
    "tags": [
        {"tag": "StudyDescription", "action": "clean_text"}, {"tag": "ImageComments", "action": "clean_text"}, {"tag": "PatientComments", "action": "replace", "value": "none"}, {"tag": "OtherPatientIDs", "action": "pseudonymize", "domain": "patient", "prefix": "o-"},
        {"tag": "StudyDate", "action": "date_shift", "domain": "patient", "max_days": 100}, {"tag": "SeriesDate", "action": "date_truncate", "granularity": "year"}, {"tag": "PatientSex", "action": "keep"}, {"tag": "PatientAge", "action": "empty"},
    ],
    "patterns": [{"name": "mail", "builtin": "email", "action": "redact", "validate": "none"}],
}


def action_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """An image for each customer with several values in an attribute, texts with an address, dates, and tags that no rule
    names: a private one, a curve, a person's name and an identifier."""
    k = F.col("c_custkey").cast("string")
    day = F.concat(F.lit("202401"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"))

    def row(tag: str, vr: str, *values):
        text = [v.cast("string") for v in values]
        return F.struct(F.array().cast("array<struct<tag:string,item:int>>").alias("seq_path"), F.lit(profile.TAGS[tag][0] if tag in profile.TAGS else tag).alias("tag"), F.lit(vr).alias("vr"), F.array(*text).alias("values"), F.lit(None).cast("binary").alias("raw"))

    rows = (
        row("StudyDescription", "LO", F.concat(F.lit("ask u"), k, F.lit("@b.co first"))), row("ImageComments", "LT", F.concat(F.lit("a\\b u"), k, F.lit("@b.co"))), row("PatientComments", "LT", k),
        row("OtherPatientIDs", "LO", k, F.concat(F.lit(" "), k, F.lit(" ")), F.lit("x")), row("StudyDate", "DA", day, day), row("SeriesDate", "DA", day), row("PatientSex", "CS", F.lit("O")), row("PatientAge", "AS", F.lit("030Y")),
        row("00091001", "LO", k), row("50001001", "LO", k), row("00080094", "SH", k), row("00101005", "PN", F.col("c_name")), row("StudyInstanceUID", "UI", k),
    )
    return _customers(spark, sf).select(k.alias("instance"), F.explode(F.array(*rows)).alias("a")).select("instance", "a.*")


def dicom_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What is written of each attribute: clean text, several values, replacements, dates, and structural rules."""
    made = actions.deidentify(action_attributes(spark, sf), parse_dicom_policy(ACTIONS_POLICY), KEY)
    return actions.kept(made).select("instance", "tag", F.array_join("values", "|").alias("values"))


def _dicom_actions_sql() -> str:
    inner, outer = pads(KEY)
    hexed = lambda label, domain, v: f"sha256(from_hex('{outer.hex()}') || from_hex(sha256(from_hex('{(inner + prefix(label, domain)).hex()}') || encode({v}))))"
    days = actions.shift_days(KEY, "patient", 100)
    token = lambda v: f"'o-' || substr({hexed('token', 'patient', v)}, 1, 32)"
    wide = lambda at: f"('0x' || substr(h, {at}, 16))::UBIGINT::UHUGEINT"
    uid = f"(SELECT '2.25.' || cast({wide(1)} * 18446744073709551616::UHUGEINT + {wide(17)} AS VARCHAR) FROM (SELECT {hexed('dicom-uid', 'uid', 'k')} AS h))"
    shifted = f"strftime(DATE '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 28 + {days}), '%Y%m%d')"
    rows = {
        "StudyDescription": "'ask [MAIL] first'", "ImageComments": "'a\\b [MAIL]'", "PatientComments": "'none'", "OtherPatientIDs": f"{token('k')} || '|' || {token('k')} || '|' || {token(chr(39) + 'x' + chr(39))}",
        "StudyDate": f"{shifted} || '|' || {shifted}", "SeriesDate": "'20240101'", "PatientSex": "'O'", "PatientAge": "''", "ReferringPhysicianTelephoneNumbers": "k", "PatientBirthName": "''", "StudyInstanceUID": uid,
    }
    each = " UNION ALL ".join(f"SELECT k AS instance, '{profile.TAGS[n][0]}' AS tag, {v} AS values FROM c" for n, v in rows.items())
    return f"WITH c AS (SELECT c_custkey, cast(c_custkey AS VARCHAR) AS k FROM customer) {each}"


def dicom_highest_risk(spark: SparkSession, sf: str) -> DataFrame:
    return actions.highest_risk(actions.pixel_risk(attributes(spark, sf)))


def dicom_date_shift(spark: SparkSession, sf: str) -> DataFrame:
    days = F.lit(actions.shift_days(KEY, profile.SHIFT_DOMAIN, profile.SHIFT_DAYS))
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select("o_orderkey", actions.shift_date(F.date_format("o_orderdate", "yyyyMMdd"), days).alias("shifted"), actions.truncate_date(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("year_month")).alias("month"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (dicom_pixel_risk, dicom_highest_risk, dicom_findings, dicom_by_action, dicom_pseudonyms, dicom_uid_remap, dicom_date_shift, dicom_actions)}


def oracle_sql() -> dict[str, str]:
    risk = """
        SELECT cast(c_custkey AS VARCHAR) AS instance, c_custkey % 5 <> 0 AS has_pixels, CASE c_custkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' END AS burned_in,
               CASE c_custkey % 3 WHEN 0 THEN 'CT' WHEN 1 THEN 'US' ELSE 'MR' END AS modality,
               CASE WHEN c_custkey % 5 = 0 THEN 'low' WHEN c_custkey % 4 = 0 THEN 'high' WHEN c_custkey % 4 = 1 THEN CASE WHEN c_custkey % 3 = 1 THEN 'elevated' ELSE 'low' END
                    WHEN c_custkey % 3 = 1 THEN 'high' ELSE 'unknown' END AS level
        FROM customer"""
    done = {"PatientName": "pseudonymize", "PatientID": "pseudonymize", "OtherPatientIDs": "remove", "StudyInstanceUID": "uid", "VerifyingObserverSequence": "remove"}
    found = " UNION ALL ".join(f"SELECT '{profile.TAGS[k][0]}' AS tag, '{a}' AS action, count(*) AS occurrences FROM customer" for k, a in done.items())
    inner, outer = pads(KEY)
    token = f"substr(sha256(from_hex('{outer.hex()}') || from_hex(sha256(from_hex('{(inner + prefix('token', 'patient')).hex()}') || encode(cast(c_custkey AS VARCHAR))))), 1, 32)"
    days = actions.shift_days(KEY, profile.SHIFT_DOMAIN, profile.SHIFT_DAYS)
    return {
        "dicom_actions": _dicom_actions_sql(),
        "dicom_pixel_risk": risk,
        "dicom_highest_risk": f"SELECT level FROM ({risk}) ORDER BY list_position(['low', 'unknown', 'elevated', 'high'], level) DESC LIMIT 1",
        "dicom_findings": found,
        "dicom_by_action": f"SELECT action, cast(sum(occurrences) AS BIGINT) AS occurrences FROM ({found}) GROUP BY action",
        "dicom_pseudonyms": f"SELECT cast(c_custkey AS VARCHAR) AS instance, 'PID-' || {token} AS patient FROM customer",
        "dicom_uid_remap": "SELECT '1.2.840.' || cast(c_nationkey AS VARCHAR) AS study, cast(1 AS BIGINT) AS new_ids, true AS sound, count(*) AS images FROM customer GROUP BY c_nationkey",
        "dicom_date_shift": f"SELECT o_orderkey, strftime(o_orderdate + INTERVAL ({days}) DAY, '%Y%m%d') AS shifted, strftime(o_orderdate, '%Y%m') || '01' AS month FROM orders",
    }
