"""One run over a folder of images: attributes through a policy, files out, and a report."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright.dicom import actions, files, profile
from maskwright.dicom.policy import parse_dicom_policy
from maskwright.functions.keys import dataset_key, resolve_secret
from maskwright.operators.vault import write_vault
from maskwright.plans.report import DICOM_LIMITATIONS, VERSION
from maskwright.sources import staging


def mappings(result):
    """(field, original, token) of reversible values: pseudonyms and remapped identifiers."""
    rows = result.filter("action in ('pseudonymize', 'uid') and not refused")
    field = F.concat(F.lit("dicom:"), F.col("tag"))
    pairs = rows.select(field.alias("field"), F.explode(F.arrays_zip("original", "values")).alias("p"))
    clean = F.regexp_replace("p.original", r"(?U)^[\s\x00]+|[\s\x00]+$", "")
    return pairs.select("field", clean.alias("original"), F.col("p.values").alias("token")).filter("original <> ''").distinct()


def run(spark: SparkSession, policy_text: str | dict, source: str, target: str, vault: str | None = None) -> dict:
    """De-identify all files below source into target, which appears whole or not at all. Skipped files and pixel risks are
    reported by group, so that the report doesn't grow with the files; ``files.skipped`` names them."""
    staging.refuse_in_place(spark, source, target)
    policy = parse_dicom_policy(policy_text, spark)
    warnings, key, secret = [], None, None
    if policy.key:
        secret, warnings = resolve_secret(policy.key.env, policy.key.inline, policy.key.allow_inline_fallback)
        key = dataset_key(secret, policy.dataset)
    everything = files.read(spark, source).persist()
    try:
        attributes = files.readable(everything)
        result = actions.deidentify(attributes, policy, key)
        with staging.staged(spark, target, "images") as part:
            written = files.write(actions.kept(result), source, part).count()
            if not written:
                staging.folder(spark, part)
        skipped = [r.asDict() for r in files.skipped(everything).groupBy("reason").agg(F.count(F.lit(1)).alias("files"), F.min("instance").alias("first")).orderBy("reason").collect()]
        found = [{"tag": profile.KEYWORDS.get(r["tag"], profile.shown(r["tag"])), "numeric": profile.shown(r["tag"]), "action": r["action"], "occurrences": r["occurrences"]} for r in actions.findings(result).collect()]
        risks = actions.pixel_risk(attributes)
        risk = [r.asDict() for r in risks.groupBy("level", "burned_in", "modality").agg(F.count(F.lit(1)).alias("instances")).orderBy("level", "burned_in", "modality").collect()]
        highest = actions.highest_risk(risks).first()["level"]
        warnings += [f"{r['n']} values of {profile.shown(r['tag'])} were refused or unreadable for action {r['action']}" for r in result.filter("refused").groupBy("tag", "action").agg(F.count(F.lit(1)).alias("n")).collect()]
        if not written:
            warnings.append("no file was written")
        if skipped:
            warnings.append(f"{sum(r['files'] for r in skipped)} files could not be read and were skipped")
        if any(r["level"] in ("high", "elevated", "unknown") for r in risk):
            warnings.append("some images may have text burned into their pixels, which stays")
        if vault and secret:
            warnings.append(f"the vault reverses {write_vault(mappings(result), vault, secret, policy.dataset)} values")
    finally:
        everything.unpersist()
    return {"version": VERSION, "dataset": policy.dataset, "instances": written, "skipped": skipped, "findings": sorted(found, key=lambda f: f["numeric"]), "pixel_risk": risk, "highest_pixel_risk": highest, "warnings": warnings, "limitations": list(DICOM_LIMITATIONS)}
