"""Registered queries of whole runs: tables written and read as files, jobs from path to path, chains, vaults and texts with
mocks. Files go into the scratch folder."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright import oracles
from maskwright.functions.keys import dataset_key, pads, prefix
from maskwright.operators import cascade, job, runner
from maskwright.operators.vault import read_vault, write_vault
from maskwright.plans.policy import parse_policy
from maskwright.sources import formats, staging

SECRET = "a fixed secret for the driver's comparison, 0123456789"
KEY = dataset_key(SECRET, "driver-runs")
_KEY = {"inline": SECRET}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hmac_sql(label: str, domain: str, value: str) -> str:
    inner, outer = pads(KEY)
    return f"sha256(from_hex('{outer.hex()}') || from_hex(sha256(from_hex('{(inner + prefix(label, domain)).hex()}') || encode({value}))))"


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with separators, quotes, line breaks, leading zeros and missing values."""
    customer = _t(spark, sf, "customer")
    note = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"\n end '))
    return customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("padded"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("nation"), note.alias("note"))


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV and read again: texts only, an empty cell is missing."""
    path = staging.scratch(spark, "cells.csv")
    with staging.staged(spark, path, "csv") as part:
        formats.write(_cells(spark, sf), part, "csv")
    return formats.read(spark, path)


def jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON Lines and read again: texts only, whatever the kinds of the values were."""
    path = staging.scratch(spark, "cells.jsonl")
    with staging.staged(spark, path, "jsonl") as part:
        formats.write(_cells(spark, sf), part, "jsonl")
    return formats.read(spark, path)


def _done(outcome: runner.Outcome) -> dict:
    if outcome.status != "ok":
        raise RuntimeError(outcome.error)
    return outcome.report


def chain_link(spark: SparkSession, sf: str) -> DataFrame:
    """A chain of two jobs, one to CSV and one to JSON Lines, whose tokens join."""
    here = staging.scratch(spark, "")
    token = lambda name: {"name": name, "class": "direct_identifier", "pseudonymize": {"prefix": "cus_", "domain": "customer"}}
    policies = {
        "customer": {"version": 1, "dataset": "a", "on_unlisted": "remove", "key": _KEY, "fields": [token("c_custkey"), {"name": "c_mktsegment", "class": "utility"}]},
        "orders": {"version": 1, "dataset": "b", "on_unlisted": "remove", "key": _KEY, "fields": [token("o_custkey"), {"name": "o_orderkey", "class": "utility"}]},
    }
    jobs = [{"name": n, "policy": n, "input": f"{sf}/{n}.parquet", "output": f"{here}{n}.{kind}"} for n, kind in (("customer", "csv"), ("orders", "jsonl"))]
    got = runner.run_chain(spark, runner.parse_chain({"dataset": "driver-runs", "jobs": jobs}), "pseudonymize", policies.get)
    if not got["complete"]:
        raise RuntimeError(json.dumps(got["jobs"])[:300])
    customer, orders = (formats.read(spark, j["output"]) for j in jobs)
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers"))


def _scanned(spark: SparkSession, sf: str) -> dict:
    rules = [{"name": n, "builtin": n, "action": "detect"} for n in _REPORTED]
    policy = {"version": 1, "dataset": "driver-runs", "on_unlisted": "remove", "fields": [{"name": "doc_id", "class": "utility"}, {"name": "text", "class": "utility"}], "patterns": rules}
    return _done(runner.execute(spark, runner.Request("anonymize", policy, f"{sf}/documents.parquet", staging.scratch(spark, "texts.parquet"))))


_REPORTED = ("email", "credit_card", "ip_address", "date_of_birth")


def report_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of a run's report: matches and rejected ones of each rule, counted in the pass that writes."""
    found = _scanned(spark, sf)["pattern_findings"]
    return spark.createDataFrame([(f["rule"], f["column"], f["action"], f["matches"], f["rejected"]) for f in found], "rule string, column string, action string, matches long, rejected long")


def many_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs at a time, one of them of a missing input: rows and class statistics of each report, one run in seven parts."""
    fields = [{"name": "c_custkey", "class": "direct_identifier"}, {"name": "c_nationkey", "class": "quasi_identifier", "anonymize": {"strategy": "bucket", "width": 5}}, {"name": "c_mktsegment", "class": "quasi_identifier", "anonymize": {"strategy": "keep_prefix", "chars": 3}}]
    policy = {"version": 1, "dataset": "driver-runs", "on_unlisted": "remove", "fields": fields}
    here = staging.scratch(spark, "")
    one = lambda name, source, kind, parts=None: runner.Request("anonymize", policy, source, f"{here}{name}.{kind}", job=name, parts=parts)
    good = f"{sf}/customer.parquet"
    got = runner.run_many(spark, [one("whole", good, "csv"), one("parts", good, "parquet", 7), one("missing", f"{here}nothing.parquet", "csv")])
    rows = [(o.job, o.status, o.report["rows_written"], o.report["quasi_identifiers"]["classes"], o.report["quasi_identifiers"]["max_class_size"]) if o.report else (o.job, o.status, 0, 0, 0) for o in got]
    return spark.createDataFrame(rows, "job string, status string, rows long, classes long, largest long")


def vault_file(spark: SparkSession, sf: str) -> DataFrame:
    """A vault written to a folder and opened again."""
    policy = {"version": 1, "dataset": "driver-runs", "on_unlisted": "remove", "fields": [{"name": "c_custkey", "class": "direct_identifier", "pseudonymize": {"prefix": "cus_", "domain": "customer"}}]}
    maps = job.build(_t(spark, sf, "customer"), parse_policy(policy), "pseudonymize", KEY, mappings=True).mappings
    path = staging.scratch(spark, "vault")
    write_vault(maps, path, SECRET, "driver-runs")
    return read_vault(spark, path, SECRET, "driver-runs")


def mock_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses inside texts replaced by mocks."""
    policy = {"version": 1, "dataset": "driver-runs", "on_unlisted": "remove", "fields": [{"name": "doc_id", "class": "utility"}, {"name": "text", "class": "utility"}], "patterns": [{"name": "mail", "builtin": "email", "action": "mock", "validate": "none"}]}
    return job.build(_t(spark, sf, "documents"), parse_policy(policy), "pseudonymize", KEY).output


def _mock_in_text_sql() -> str:
    letters = " || ".join(f"chr(cast(97 + ('0x' || substr(h, {2 * i + 1}, 2))::INTEGER % 26 AS INTEGER))" for i in range(10))
    glue = f"list_transform(list_transform(hits, lambda m: {_hmac_sql('mock', 'pattern:mail', 'm')}), lambda h: {letters} || '@example.com')"
    found = f"SELECT doc_id, text, regexp_split_to_array(text, '{oracles.regex('email')}') AS parts, regexp_extract_all(text, '{oracles.regex('email')}') AS hits FROM documents"
    joined = "array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(glue[i], '')), '')"
    return f"SELECT cast(doc_id AS VARCHAR) AS doc_id, CASE WHEN n > 0 THEN {joined} ELSE text END AS text FROM (SELECT doc_id, text, parts, len(hits) AS n, {glue} AS glue FROM ({found}))"


def gated(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of documents that hold a match of a detector which its gate doesn't let through: none. Where a gate lets a text
    through nothing is lost, so that only the texts that it stops are searched."""
    from maskwright.functions import detectors

    text = F.coalesce(F.col("text"), F.lit(""))
    lost = [F.struct(F.lit(n).alias("detector"), F.when(text.rlike(g), 0).otherwise(F.size(cascade.matches_of(text, n, read=detectors.led))).alias("lost")) for n, g in detectors.GATES.items()]
    return _t(spark, sf, "documents").select("doc_id", F.explode(F.array(*lost)).alias("l")).select("doc_id", "l.*").filter("lost <> 0")


def bom_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A file with a byte order mark, quoted cells and an upper-case extension, read by the name of its kind."""
    path = staging.scratch(spark, "nation.CSV")
    rows = [f'{r["n_nationkey"]},"{r["n_name"]}, ""quoted"""' for r in _t(spark, sf, "nation").orderBy("n_nationkey").collect()]
    staging.write_text(spark, path, "\ufeffn_nationkey,name\n" + "\n".join(rows) + "\n")
    return formats.read(spark, path)


def staged_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that replace an output, that fail, and that are refused: what stands under the name afterwards."""
    here = staging.scratch(spark, "")
    policy = lambda column: {"version": 1, "dataset": "driver-runs", "on_unlisted": "remove", "fields": [{"name": column, "class": "utility"}]}
    out, nation, region = f"{here}out.parquet", f"{sf}/nation.parquet", f"{sf}/region.parquet"
    rows = []
    steps = (("first", nation, "n_name", out), ("replaced", region, "r_name", out), ("failed", nation, "missing", out), ("same", out, "r_name", out + "/"), ("unknown", nation, "n_name", f"{here}out.txt"))
    for name, source, column, target in steps:
        fields = policy(column) | ({"on_unlisted": "error"} if name == "failed" else {})
        outcome = runner.execute(spark, runner.Request("anonymize", fields, source, target, job=name))
        rows.append((name, outcome.status, spark.read.parquet(out).count()))
    return spark.createDataFrame(rows, "step string, status string, rows_under_the_name long")


def suppressed_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values that don't fit their strategy: the number that a run's report warns of, and the number in its output."""
    fields = [{"name": "c_mktsegment", "class": "quasi_identifier", "anonymize": {"strategy": "bucket", "width": 5}}, {"name": "c_name", "class": "quasi_identifier", "anonymize": {"strategy": "date_truncate", "granularity": "year"}}]
    path = staging.scratch(spark, "out.parquet")
    report = _done(runner.execute(spark, runner.Request("anonymize", {"version": 1, "dataset": "driver-runs", "on_unlisted": "remove", "fields": fields}, f"{sf}/customer.parquet", path)))
    warned = [int(w.split()[0]) for w in report["warnings"] if "did not fit" in w]
    found = spark.read.parquet(path).agg(F.count_if(F.col("c_mktsegment") == "*") + F.count_if(F.col("c_name") == "*")).first()[0]
    return spark.createDataFrame([(warned[0], found, report["rows_read"], report["rows_written"])], "warned long, found long, rows_read long, rows_written long")


def validator_choice(spark: SparkSession, sf: str) -> DataFrame:
    """One expression under three validators: its own, another and none."""
    from maskwright.plans.policy import Rule

    rules = tuple(Rule(v or "own", "detect", builtin="credit_card", validate=v) for v in (None, "luhn", "none"))
    rows, scans = cascade.scan(_t(spark, sf, "documents").select("doc_id", "text"), "text", rules)
    return rows.select("doc_id", *[F.col(f"`{s.matches}`").cast("long").alias(s.rule.name) for s in scans])


def vault_export(spark: SparkSession, sf: str) -> DataFrame:
    from maskwright.operators import reverse

    return reverse.export(vault_file(spark, sf))


def key_of_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of equal values: shared within a dataset and domain, and with no other."""
    tokens = []
    for dataset, domain in (("a", "d"), ("a", "d"), ("a", "e"), ("b", "d")):
        policy = {"version": 1, "dataset": dataset, "on_unlisted": "remove", "key": _KEY, "fields": [{"name": "c_custkey", "class": "direct_identifier", "pseudonymize": {"domain": domain}}]}
        tokens.append(job.build(_t(spark, sf, "customer"), parse_policy(policy), "pseudonymize").output.select(F.col("c_custkey").alias("token")))
    first = tokens[0].distinct()
    shared = [t.distinct().join(first, "token", "left_semi").agg(F.count(F.lit(1)).alias("shared")).withColumn("case", F.lit(n)) for n, t in zip(("itself", "again", "domain", "dataset"), tokens)]
    out = shared[0]
    for other in shared[1:]:
        out = out.unionByName(other)
    return out


def audit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The audit's records of a run that ends well and of one that doesn't. The log is the driver's own file."""
    import os
    import tempfile

    from maskwright.audit import audited

    policy = {"version": 1, "dataset": "driver-runs", "on_unlisted": "remove", "fields": [{"name": "n_name", "class": "utility"}]}
    here, log = staging.scratch(spark, ""), os.path.join(tempfile.mkdtemp(prefix="maskwright-"), "audit.jsonl")
    run = audited(log)
    for name, source in (("good", f"{sf}/nation.parquet"), ("bad", f"{here}nothing.parquet")):
        run(spark, runner.Request("anonymize", policy, source, f"{here}{name}.parquet", job=name))
    with open(log, encoding="utf-8") as f:
        lines = [json.loads(x) for x in f]
    os.remove(log)
    return spark.createDataFrame([(x["job"], x["mode"], x["status"], x["rows_written"] or 0, len(x["policy_hash"]), x["error"] is not None) for x in lines], "job string, mode string, status string, rows long, hash_length long, has_error boolean")


def image_files(spark: SparkSession, sf: str) -> DataFrame:
    """An image for each nation, written as files and read again; one file that is none is skipped."""
    from maskwright.dicom import files, profile
    from maskwright.dicom.actions import SCHEMA

    here = staging.scratch(spark, "images")
    nation = _t(spark, sf, "nation")
    path = F.array().cast("array<struct<tag:string,item:int>>")
    inner = F.array(F.struct(F.lit(profile.TAGS["VerifyingObserverSequence"][0]).alias("tag"), F.lit(0).alias("item")))

    def row(keyword: str, value, where=path):
        tag, vr = profile.TAGS[keyword]
        return F.struct(where.alias("seq_path"), F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), F.array(value.cast("string")).alias("values"), F.lit(None).cast("binary").alias("raw"))

    cells = (row("PatientName", F.col("n_name")), row("PatientID", F.col("n_nationkey")), row("VerifyingObserverSequence", F.lit("")), row("VerifyingObserverName", F.col("n_name"), inner))
    name = F.concat(F.lit("file:/source/n"), F.col("n_nationkey").cast("string"), F.lit(".dcm"))
    table = nation.select(name.alias("instance"), F.explode(F.array(*cells)).alias("a")).select("instance", "a.*")
    assert [f.name for f in table.schema] == [x.split()[0] for x in SCHEMA.split(", ")]
    with staging.staged(spark, here, "images") as part:
        files.write(table, "file:/source", part).count()
    staging.write_text(spark, f"{here}/none.dcm", "no image")
    back = files.read(spark, here)
    shown = F.when(F.col("vr") == "!", "skipped").otherwise(F.array_join("values", "|"))
    return back.filter("tag not like '0002%'").select(F.element_at(F.split("instance", "/"), -1).alias("file"), "tag", F.size("seq_path").cast("long").alias("depth"), shown.alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_ALL = (
    csv_roundtrip, jsonl_roundtrip, chain_link, report_findings, many_runs, vault_file, mock_in_text, gated, bom_csv, staged_outputs, suppressed_values,
    validator_choice, vault_export, key_of_dataset, audit_lines, image_files,
)


def oracle_sql() -> dict[str, str]:
    cells = """SELECT cast(c_custkey AS VARCHAR) AS c_custkey, lpad(cast(c_custkey AS VARCHAR), 9, '0') AS padded, CASE WHEN c_nationkey > 4 THEN cast(c_nationkey AS VARCHAR) END AS nation,
        c_name || ', "' || c_mktsegment || '"' || chr(10) || ' end ' AS note FROM customer"""
    report = oracles.report(_REPORTED, "documents")
    classes = "SELECT count(*) AS n FROM customer GROUP BY c_nationkey // 5, substr(c_mktsegment, 1, 3), length(c_mktsegment)"
    one = "SELECT '{}' AS job, 'ok' AS status, cast(sum(n) AS BIGINT) AS rows, count(*) AS classes, max(n) AS largest FROM ({})".format
    token = f"'cus_' || substr({_hmac_sql('token', 'customer', 'cast(c_custkey AS VARCHAR)')}, 1, 32)"
    cards = lambda ok: f"cast(len(list_filter(regexp_extract_all({oracles.folded('text')}, '{oracles.regex('credit_card')}'), lambda m: {ok})) AS BIGINT)"
    return {
        "bom_csv": "SELECT cast(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', \"quoted\"' AS name FROM nation",
        "staged_outputs": "SELECT * FROM (VALUES ('first', 'ok', (SELECT count(*) FROM nation)), ('replaced', 'ok', (SELECT count(*) FROM region)), ('failed', 'error', (SELECT count(*) FROM region)), ('same', 'error', (SELECT count(*) FROM region)), ('unknown', 'error', (SELECT count(*) FROM region))) v(step, status, rows_under_the_name)",
        "suppressed_values": "SELECT 2 * count(*) AS warned, 2 * count(*) AS found, count(*) AS rows_read, count(*) AS rows_written FROM customer",
        "validator_choice": f"SELECT doc_id, {cards(oracles.accepts('credit_card', 'm'))} AS own, {cards(oracles.luhn('m'))} AS luhn, {cards('true')} AS \"none\" FROM documents",
        "vault_export": f"SELECT 'customer' AS domain, {token} AS token, cast(c_custkey AS VARCHAR) AS original FROM customer",
        "key_of_dataset": "SELECT \"case\", shared FROM (SELECT count(*) AS n FROM customer), LATERAL (VALUES ('itself', n), ('again', n), ('domain', 0), ('dataset', 0)) v(\"case\", shared)",
        "audit_lines": "SELECT * FROM (VALUES ('good', 'anonymize', 'ok', (SELECT count(*) FROM nation), 64, false), ('bad', 'anonymize', 'error', 0, 64, true)) v(job, mode, status, rows, hash_length, has_error)",
        "image_files": """
            SELECT 'n' || cast(n_nationkey AS VARCHAR) || '.dcm' AS file, unnest(['00100010', '00100020', '0040A073', '0040A075']) AS tag, unnest([0::BIGINT, 0, 0, 1]) AS depth,
                   unnest([n_name, cast(n_nationkey AS VARCHAR), '', n_name]) AS value FROM nation
            UNION ALL SELECT 'none.dcm', '', 0, 'skipped'""",
        "csv_roundtrip": cells,
        "jsonl_roundtrip": cells,
        "chain_link": "SELECT c_mktsegment, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
        "report_findings": f"SELECT rule, 'text' AS column, 'detect' AS action, matches, rejected FROM ({report}) WHERE matches > 0",
        "many_runs": f"{one('whole', classes)} UNION ALL {one('parts', classes)} UNION ALL SELECT 'missing', 'error', 0, 0, 0",
        "vault_file": f"SELECT 'customer' AS field, cast(c_custkey AS VARCHAR) AS original, 'cus_' || substr({_hmac_sql('token', 'customer', 'cast(c_custkey AS VARCHAR)')}, 1, 32) AS token FROM customer",
        "mock_in_text": _mock_in_text_sql(),
        "gated": "SELECT doc_id, '' AS detector, cast(0 AS INTEGER) AS lost FROM documents WHERE false",
    }
