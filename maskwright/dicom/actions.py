"""De-identification over an attribute table.

A row is an attribute: ``instance, seq_path array<struct<tag,item>>, tag (ggggeeee), vr, values array<string>, raw binary``.
Sequence items are rows of their own with the path to them, so recursion is flat. All actions are one projection over
the rows; rules come by a join with the policy's table, which has a few hundred rows at most.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from maskwright.dicom import profile
from maskwright.dicom.policy import DicomPolicy
from maskwright.functions import mocks
from maskwright.functions.keys import TOKEN_CHARS, Keyed, prefix
from maskwright.operators import cascade
from maskwright.plans.policy import Policy

SCHEMA = "instance string, seq_path array<struct<tag:string,item:int>>, tag string, vr string, values array<string>, raw binary"
# Representations without text values, and those whose backslash is text.
BINARY = ("OB", "OW", "OF", "OD", "OL", "OV", "UN", "US", "SS", "UL", "SL", "UV", "SV", "FL", "FD", "AT")
SINGLE = ("LT", "ST", "UT", "UR")
LEVELS = ("low", "unknown", "elevated", "high")
UID_ROOT = "2.25."


def shift_days(key: bytes, domain: str, most: int) -> int:
    """Days from -most to most: one offset for all values of a domain, so intervals stay."""
    n = int.from_bytes(hmac.new(key, prefix("date-shift", domain), hashlib.sha256).digest()[:8], "big")
    return n % (2 * most + 1) - most


def _rule_table(df: DataFrame, policy: DicomPolicy, key: bytes | None) -> DataFrame:
    rows = []
    for tag, r in policy.resolved().items():
        domain = r.get("domain") or ("uid" if r["action"] == "uid" else profile.KEYWORDS.get(tag, tag))
        days = shift_days(key, domain, r["max_days"]) if r["action"] == "date_shift" else None
        rows.append((tag, r["action"], r.get("value"), r.get("prefix") or "", domain, r.get("mock"), days, r.get("granularity")))
    return df.sparkSession.createDataFrame(rows, "tag string, rule string, value string, start string, domain string, mock string, days int, granularity string")


def _structural(policy: DicomPolicy) -> Column:
    s = policy.structural
    none = F.lit(None).cast("string")
    if not policy.structural_on:
        return none
    group = F.conv(F.substring("tag", 1, 4), 16, 10).cast("int")
    private = (group % 2 == 1) & (F.substring("tag", 5, 4) != "0000") & ~group.isin(1, 3, 5, 7, 0xFFFF)
    curves = group.between(0x5000, 0x50FF) | group.between(0x6000, 0x60FF)
    out = F.when(private, F.lit("remove") if s.private_tags and not s.retain_safe_private else none)
    if s.curves_and_overlays:
        out = out.when(curves, "remove")
    if s.person_names:
        out = out.when(F.col("vr") == "PN", "empty")
    if s.uids:
        out = out.when(F.col("tag").isin(*sorted(profile.UIDS)), "uid")
    return out


def _gone(policy: DicomPolicy) -> Column:
    """Whether an item stands in a sequence that is removed or emptied."""
    gone = [t for t, r in policy.resolved().items() if r["action"] in ("remove", "empty")]
    kept = [t for t, r in policy.resolved().items() if r["action"] not in ("remove", "empty")]
    listed = lambda t: t.isin(*gone) if gone else F.lit(False)
    out = F.exists("seq_path", lambda s: listed(s["tag"]))
    if policy.structural_on and policy.structural.private_tags and not policy.structural.retain_safe_private:
        odd = lambda t: F.substring(t, 4, 1).rlike("[13579BDFbdf]") & ~F.substring(t, 1, 4).isin("0001", "0003", "0005", "0007", "FFFF")
        own = lambda t: ~t.isin(*kept) if kept else F.lit(True)
        out = out | F.exists("seq_path", lambda s: odd(s["tag"]) & own(s["tag"]))
    return F.coalesce(out, F.lit(False))


def shift_date(text: Column, days: Column) -> Column:
    """``YYYYMMDD`` moved by days, the rest of the text kept. Days past the end of a month roll on; null if it is no date."""
    part = lambda at, n: F.substring(text, at, n).try_cast("int")
    sound = text.rlike("^[0-9]{8}") & part(5, 2).between(1, 12) & part(7, 2).between(1, 31) & (part(1, 4) >= 1)
    first = F.to_date(F.when(sound, F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-01"))))
    moved = F.date_add(first, (part(7, 2) - 1 + days).cast("int"))
    return F.when(F.year(moved).between(1, 9999), F.concat(F.date_format(moved, "yyyyMMdd"), F.substr(text, F.lit(9))))


def truncate_date(text: Column, granularity: Column) -> Column:
    sound = text.rlike("^[0-9]{4}(?:[0-9]{4}.*)?$")
    month = F.when(text.rlike("^[0-9]{6}"), F.concat(F.substring(text, 1, 6), F.lit("01")))
    return F.when(sound, F.when(granularity == "year", F.concat(F.substring(text, 1, 4), F.lit("0101"))).otherwise(month))


def _clean(rows: DataFrame, policy: DicomPolicy, keyed: Keyed | None) -> DataFrame:
    """``cleaned``: texts after the content rules; values are scanned one by one, with a separator that no value holds."""
    rules = Policy(policy.dataset, patterns=policy.patterns, presets=policy.presets).rules()
    rows = rows.withColumn("cleaned", F.when(F.col("action") == "clean_text", F.array_join("values", "\\")))
    rows, found = cascade.scan(rows, "cleaned", rules, keyed)
    return rows.drop(*[n for s in found for n in (s.matches, s.rejected)])


def deidentify(attributes: DataFrame, policy: DicomPolicy, key: bytes | None = None) -> DataFrame:
    """All attributes with ``action`` (null: kept), ``original`` values, ``refused`` (a value action on binary data or on a
    sequence, or a date that can't be read, which is dropped) and the new ``values``. ``action`` remove means the row goes."""
    rules = policy.resolved()
    keyed_actions = {"pseudonymize", "uid", "date_shift"}
    needs = any(r["action"] in keyed_actions for r in rules.values()) or policy.structural_on and policy.structural.uids or any(r.action in ("token", "mock") for r in policy.patterns + policy.presets)
    if needs and key is None:
        raise ValueError("this policy derives values from a key")
    rows, keyed = Keyed.on(attributes, key) if key is not None else (attributes, None)
    if keyed is None:
        rows = rows.withColumns({"§inner": F.lit(b""), "§outer": F.lit(b"")})
    rows = rows.filter(~_gone(policy)).join(F.broadcast(_rule_table(attributes, policy, key)), "tag", "left")
    rows = rows.withColumn("action", F.coalesce("rule", _structural(policy)))
    trimmed = F.transform("values", lambda v: F.regexp_replace(v, r"(?U)^[\s\x00]+|[\s\x00]+$", ""))
    rows = rows.withColumns({"original": F.col("values"), "values": trimmed, "domain": F.coalesce("domain", F.lit("uid"))})
    rows = _clean(rows, policy, keyed) if policy.patterns or policy.presets else rows.withColumn("cleaned", F.array_join("values", "\\"))

    def keyed_hex(label: str, v: Column) -> Column:
        message = F.concat(F.col("§inner"), F.encode(F.concat(F.lit(label + "\x1f"), F.octet_length("domain").cast("string"), F.lit(":"), F.col("domain"), F.lit("\x1f"), v), "UTF-8"))
        return F.sha2(F.concat(F.col("§outer"), F.unhex(F.sha2(message, 256))), 256)

    def pseudonym(v: Column) -> Column:
        hexed = keyed_hex("mock", v)
        letters = F.translate(F.substring(hexed, 1, 12), "0123456789", "ghijklmnop")
        name = F.concat(F.initcap(F.substring(letters, 1, 7)), F.lit("^"), F.initcap(F.substring(letters, 8, 5)))
        made = F.when(F.col("mock") == "person_name", name).when(F.col("mock") == "email", mocks.email(hexed, v)).when(F.col("mock") == "phone", mocks.phone(hexed, v))
        token = F.concat(F.coalesce("start", F.lit("")), F.substring(keyed_hex("token", v), 1, TOKEN_CHARS))
        return F.when(v == "", v).otherwise(F.coalesce(made, token))

    uid_hex = F.transform("values", lambda v: F.when(v == "", v).otherwise(keyed_hex("dicom-uid", v)))
    whole = (F.col("vr").isin(*SINGLE)) & (F.size("values") > 1)
    rows = rows.withColumn("values", F.when(whole, F.array(F.array_join("values", "\\"))).otherwise(F.col("values")))

    a = F.col("action")
    value_action = a.isin("pseudonymize", "uid", "date_shift", "date_truncate", "clean_text")
    refused = value_action & (F.col("vr").isin(*BINARY) | (F.col("vr") == "SQ")) | (a == "replace") & (F.col("vr").isin(*BINARY, "SQ"))
    dates = F.transform("values", lambda v: F.when(v == "", v).otherwise(F.when(a == "date_shift", shift_date(v, F.col("days"))).otherwise(truncate_date(v, F.col("granularity")))))
    unread = a.isin("date_shift", "date_truncate") & F.exists(dates, lambda v: v.isNull())
    new = (
        F.when(refused, F.col("values"))
        .when(a == "empty", F.array().cast("array<string>"))
        .when(a == "replace", F.array("value"))
        .when(a == "pseudonymize", F.transform("values", pseudonym))
        .when(a.isin("date_shift", "date_truncate"), F.filter(dates, lambda v: v.isNotNull()))
        .when(a == "clean_text", F.when(F.col("vr").isin(*SINGLE), F.array("cleaned")).otherwise(F.split("cleaned", r"\\", -1)))
        .otherwise(F.col("values"))
    )
    rows = rows.withColumns({"§new": new, "refused": F.coalesce(refused | unread, F.lit(False)), "§uid": F.when((a == "uid") & ~refused, F.array_join(uid_hex, ","))})
    rows = rows.withColumn("values", F.when(F.col("§uid").isNotNull(), F.split(_uid_list(F.col("§uid")), ",")).otherwise(F.col("§new")))
    raw = F.when(a.isin("remove", "empty"), F.lit(None).cast("binary")).otherwise(F.col("raw"))
    return rows.select("instance", "seq_path", "tag", "vr", "values", raw.alias("raw"), "action", "original", "refused")


@F.pandas_udf(StringType())
def _uid_list(hexed: pd.Series) -> pd.Series:
    """128 bits each as a decimal number: 39 digits, which no decimal type holds."""
    return hexed.map(lambda t: ",".join(UID_ROOT + str(int(h[:32], 16)) if h else "" for h in t.split(",")), na_action="ignore")


def kept(result: DataFrame) -> DataFrame:
    """The attribute table that is written."""
    return result.filter(F.col("action").isNull() | (F.col("action") != "remove") | F.col("refused")).select("instance", "seq_path", "tag", "vr", "values", "raw")


def findings(result: DataFrame) -> DataFrame:
    """(tag, action, occurrences) of attributes that were acted on; keep isn't an act."""
    return result.filter("action is not null and action <> 'keep'").groupBy("tag", "action").agg(F.count(F.lit(1)).alias("occurrences"))


def by_action(result: DataFrame) -> DataFrame:
    return findings(result).groupBy("action").agg(F.sum("occurrences").cast("bigint").alias("occurrences"))


def pixel_risk(attributes: DataFrame) -> DataFrame:
    """(instance, has_pixels, burned_in, modality, level): the risk of text burned into the image, without reading it. The
    rows that are sorted by instance hold a number and the value of one of two attributes, not what they come from."""
    tag = lambda k: F.col("tag") == profile.TAGS[k][0]
    top = F.size(F.coalesce("seq_path", F.array().cast("array<struct<tag:string,item:int>>"))) == 0
    kind = F.when(top & tag("PixelData"), 0).when(top & tag("BurnedInAnnotation"), 1).when(top & tag("Modality"), 2).when(~top | F.col("tag").isNotNull(), 3)
    text = F.when(top & F.coalesce(tag("BurnedInAnnotation") | tag("Modality"), F.lit(False)), F.trim(F.get("values", F.lit(0))))
    told = attributes.select("instance", kind.alias("kind"), text.alias("text"))
    value = lambda k: F.max(F.when(F.col("kind") == k, F.col("text")))
    seen = told.groupBy("instance").agg(F.bool_or(F.col("kind") == 0).alias("has_pixels"), value(1).alias("burned_in"), value(2).alias("modality"))
    risky = F.coalesce(F.col("modality").isin(*profile.RISKY_MODALITIES), F.lit(False))
    level = (
        F.when(~F.col("has_pixels"), "low")
        .when(F.col("burned_in") == "YES", "high")
        .when(F.col("burned_in") == "NO", F.when(risky, "elevated").otherwise("low"))
        .otherwise(F.when(risky, "high").otherwise("unknown"))
    )
    return seen.withColumn("level", level)


def highest_risk(risks: DataFrame) -> DataFrame:
    """One row: the highest level of all instances."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return risks.agg(F.max_by("level", rank).alias("level"))
