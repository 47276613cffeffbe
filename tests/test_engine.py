"""Policies, plans, keyed functions, cascades, formats, vaults, runs."""

import collections
import hashlib
import hmac
import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskwright.audit import audited, policy_hash
from maskwright.errors import FormatError, PolicyError, SecretError, VaultError
from maskwright.functions import detectors, mocks, transforms, validators
from maskwright.functions.keys import Keyed, dataset_key, hex_of, prefix, resolve_secret
from maskwright.operators import cascade, job, reverse, risk, runner, vault
from maskwright.plans.lint import IDS, lint
from maskwright.plans.policy import Rule, parse_policy
from maskwright.sources import formats, staging

SECRET = "n0t-a-real-secret/0123456789abcdefXYZ"
FLOW = {
    "version": 1,
    "dataset": "flow",
    "fields": [
        {"name": "id", "class": "direct_identifier", "pseudonymize": {"prefix": "p_"}},
        {"name": "age", "class": "quasi_identifier", "anonymize": {"strategy": "bucket", "width": 10}},
        {"name": "zip", "class": "quasi_identifier", "anonymize": {"strategy": "keep_prefix", "chars": 3}},
        {"name": "visit", "class": "quasi_identifier", "anonymize": {"strategy": "date_truncate", "granularity": "year"}},
        {"name": "diagnosis", "class": "sensitive"},
    ],
}
ROWS = [("a", "31", "81549", "2024-01-02", "flu"), ("b", "39", "81541", "2024-11-30", "flu"), ("c", "x", "01234", "2023-05-05", "cold"), ("d", "70", "99999", None, "")]


def flow(spark):
    return spark.createDataFrame(ROWS, "id string, age string, zip string, visit string, diagnosis string")


def with_(**more):
    return parse_policy(FLOW | more)


@pytest.mark.parametrize(
    "change",
    [
        {"version": 2},
        {"dataset": " "},
        {"extra": 1},
        {"fields": [{"name": "a", "class": "utility"}, {"name": "a", "class": "utility"}]},
        {"fields": [{"name": "a", "class": "quasi_identifier", "anonymize": {"strategy": "bucket", "width": 0}}]},
        {"fields": [{"name": "a", "class": "nobody"}]},
        {"fields": [{"name": "a", "class": "utility", "anonymize": {"strategy": "redact", "width": 3}}]},
        {"patterns": [{"name": "p", "action": "detect"}]},
        {"patterns": [{"name": "p", "action": "detect", "regex": "a", "builtin": "email"}]},
        {"patterns": [{"name": "p", "action": "detect", "regex": "a", "replacement": "x"}]},
        {"patterns": [{"name": "p", "action": "redact", "regex": "a", "prefix": "x"}]},
        {"patterns": [{"name": "p", "action": "mock", "builtin": "bic"}]},
        {"patterns": [{"name": "p", "action": "mock", "regex": "a"}]},
        {"presets": [{"preset": "all", "action": "mock"}]},
        {"presets": [{"preset": "all", "action": "detect", "replacement": "x"}]},
    ],
)
def test_wrong_policies(change):
    with pytest.raises(PolicyError):
        with_(**change)


@pytest.mark.parametrize("regex", ["(", "a*"])
def test_wrong_expressions(spark, regex):
    with pytest.raises(PolicyError):
        parse_policy(FLOW | {"patterns": [{"name": "p", "action": "detect", "regex": regex}]}, spark)


def test_rules_in_order():
    p = with_(presets=[{"preset": "precise", "action": "redact"}, {"preset": "all", "action": "detect"}], patterns=[{"name": "email", "builtin": "email", "action": "token"}])
    names = [r.name for r in p.rules()]
    assert names == [n for n in detectors.CATALOGUE if n != "email"] + ["email"]
    assert next(r for r in p.rules() if r.name == "iban").action == "redact" and next(r for r in p.rules() if r.name == "phone").action == "detect"


def test_anonymize_flow(spark):
    made = job.build(flow(spark), with_(), "anonymize")
    got = [tuple(r) for r in made.output.collect()]
    assert got == [("30-39", "815**", "2024", "flu"), ("30-39", "815**", "2024", "flu"), ("*", "012**", "2023", "cold"), ("70-79", "999**", None, "")]
    report = made.report()
    q = report["quasi_identifiers"]
    assert (q["classes"], q["min_class_size"], q["max_class_size"], q["unique_rows"]) == (3, 1, 2, 2)
    assert q["k_anonymity"][0] == {"k": 2, "rows": 2, "ratio": 0.5}
    assert report["rows_read"] == 4 and any("1 values did not fit" in w for w in report["warnings"])
    assert len(report["limitations"]) == 4


def test_pseudonymize_flow(spark):
    key = dataset_key(SECRET, "flow")
    made = job.build(flow(spark), with_(), "pseudonymize", key, mappings=True)
    rows = made.output.collect()
    assert rows[0]["id"] == "p_" + hex_of(key, "token", "id", "a")[:32] and rows[0]["age"] == "31"
    assert {tuple(r) for r in made.mappings.collect()} == {("id", r[0], "p_" + hex_of(key, "token", "id", r[0])[:32]) for r in ROWS}


def test_plan_shows_no_key(spark):
    key = dataset_key(SECRET, "flow")
    made = job.build(flow(spark), with_(), "pseudonymize", key)
    plan = made.output._jdf.queryExecution().toString()
    inner = bytes(b ^ 0x36 for b in key.ljust(64, b"\0"))
    assert key.hex() not in plan.lower() and inner.hex()[:24] not in plan.lower() and SECRET not in plan


def test_hmac_is_the_standard_one(spark):
    key = b"k" * 32
    df, keyed = Keyed.on(spark.createDataFrame([("v",), ("ü",)], "v string"), key)
    got = [r[0] for r in df.select(keyed.hex("token", "dom", F.col("v"))).collect()]
    assert got == [hmac.new(key, prefix("token", "dom") + v.encode(), hashlib.sha256).hexdigest() for v in ("v", "ü")]


def test_secrets(monkeypatch):
    monkeypatch.delenv("MW_TEST", raising=False)
    with pytest.raises(SecretError):
        resolve_secret("MW_TEST", SECRET, False)
    assert resolve_secret("MW_TEST", SECRET, True)[1]
    monkeypatch.setenv("MW_TEST", SECRET[::-1])
    assert resolve_secret("MW_TEST", SECRET, False)[0] == SECRET[::-1]
    with pytest.raises(SecretError):
        resolve_secret(None, "short", False)
    with pytest.raises(SecretError):
        resolve_secret(None, None, False)
    assert dataset_key(SECRET, "a") != dataset_key(SECRET, "b")


def test_columns_and_warnings(spark):
    df = flow(spark).withColumnRenamed("id", "ID").withColumn("more", F.lit(1))
    with pytest.raises(PolicyError):
        job.build(df, with_(), "anonymize")
    kept = job.build(df, with_(on_unlisted="keep"), "anonymize").plan
    assert any("differs in case" in w for w in kept.warnings) and [c.name for c in kept.columns if c.kind == "keep"] == ["ID", "diagnosis", "more"]
    gone = job.build(df, with_(on_unlisted="remove"), "anonymize")
    assert "more" not in gone.output.columns


def test_cascade(spark):
    df = spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 00 or a@b.co, $1"), (2, ""), (3, None), (4, "DE00 3704 0044 0532 0130 00 x@y.zz")], "id int, t string")
    rules = (Rule("iban", "redact", builtin="iban"), Rule("mail", "redact", builtin="email", replacement="$0\\"), Rule("label", "detect", regex=r"\[IBAN\]"))
    out, found = cascade.scan(df, "t", rules)
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["t"] == "[IBAN] or $0\\, $1" and rows[2]["t"] == "" and rows[3]["t"] is None
    assert rows[4]["t"] == "DE00 3704 0044 0532 0130 00 $0\\"
    assert [(rows[i][found[0].matches], rows[i][found[0].rejected]) for i in (1, 2, 3, 4)] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    assert rows[1][found[2].matches] == 1


def test_plan_grows_in_proportion(spark):
    df = spark.createDataFrame([("x",)], "t string")
    size = lambda n: len(cascade.scan(df, "t", tuple(Rule(f"r{i}", "redact", regex=f"q{i}") for i in range(n)))[0].select("t")._jdf.queryExecution().optimizedPlan().toString())
    assert size(18) < 4 * size(6)


@pytest.mark.parametrize("name", list(detectors.CATALOGUE))
def test_detector_matches_its_example(spark, name):
    d = detectors.CATALOGUE[name]
    row = spark.createDataFrame([(d.example,)], "t string").select(cascade.count_matches(F.col("t"), d.regex, d.validator), cascade.matches_of(F.col("t"), d.regex)[0]).first()
    assert row[0] == 1 and row[1] == d.example


def test_counts_take_the_words_of_their_sql(spark, tmp_path):
    """Counts equal their SQL where letters beyond ASCII stand beside a match, and jobs go on with Unicode's words."""
    import duckdb

    from maskwright import queries as registered

    texts = ["der 2043 alte st\u00fcrmt", "2043 alte st", "Bank\u00fcbung Klinik\u00e4 Bank", "hiv\u00e9 hiv", "\u00dcX7654321 X7654321", "\u00fcABCD0123456 ABCD0123456", "j\u00fcrgen@b.co \u00e4.a@b.co", "\u00fc4539578763621486", "12\u00a0x st 1\u000bst", "\u0663\u0664 st", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in registered._ASCII_COUNTS:
        query = f"detect_{name}_count"
        got = sorted(tuple(r) for r in registered.queries()[query](spark, str(tmp_path)).collect())
        assert got == sorted(duck.execute(registered.oracle_sql()[query]).fetchall()), name
    address = detectors.PATTERNS["address"]
    row = spark.createDataFrame([(texts[0],)], "t string").select(cascade.count_matches(F.col("t"), address), cascade.count_matches(F.col("t"), address, read=detectors.ascii_classes)).first()
    assert tuple(row) == (0, 1)


def test_mocks(spark):
    df, keyed = Keyed.on(spark.createDataFrame([("DE89 3704 0044 0532 0130 00", "4539-5787-6362-1486", "+49 (89) 1234-567", "001A.2b3C.4d5E", "a@b.co")], "iban string, credit_card string, phone string, mac_address string, email string"), b"k" * 32)
    row = df.select(*[mocks.mock(s, keyed.hex("mock", s, F.col(s)), F.col(s)).alias(s) for s in mocks.SHAPES]).first()
    checks = {"iban": "iban_mod97", "credit_card": "luhn", "phone": "phone_e164", "mac_address": "mac_address", "email": "email_syntax"}
    ok = spark.createDataFrame([tuple(row)], list(mocks.SHAPES)).select(*[validators.accepts(v, F.col(s)) for s, v in checks.items()]).first()
    assert all(ok) and row["credit_card"].startswith("999") and row["credit_card"][4] == "-" and row["mac_address"][4] == "." and row["iban"].startswith("DE") and len(row["iban"]) == 22


def test_mock_plans(spark):
    """A mock's plan holds the keyed hash once, bound outside of what is done for each digit."""
    given = {"iban": "DE89 3704 0044 0532 0130 00", "credit_card": "4539-5787-6362-1486", "phone": "+49 (89) 1234-567", "mac_address": "00-1a-2b-3c-4d-5e", "email": "a@b.co"}
    df, keyed = Keyed.on(spark.range(1), b"k" * 32)
    for shape, value in given.items():
        hexed = keyed.hex("mock", shape, F.concat(F.lit(value), F.col("id").cast("string")))
        plan = df.select(mocks.mock(shape, hexed, F.lit(value)).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sha2(") == 2 and plan.count("transform(array(sha2(") == 1, shape
    rows = spark.createDataFrame([("",), ("x",), ("7",), ("0 1",), (None,), ("ü1ä2€",)], "t string")
    made = rows.select("t", mocks.phone(F.lit("ff" * 32), F.col("t")).alias("p"), mocks.credit_card(F.lit("ff" * 32), F.col("t")).alias("c")).collect()
    assert [(r["p"], r["c"]) for r in made] == [("", ""), ("x", "x"), ("5", "7"), ("5 5", "9 1"), (None, None), ("ü5ä5€", "ü9ä1€")]


def test_rows_are_dealt_out(spark, tmp_path, monkeypatch):
    """One file of one row group becomes several tasks, and all its rows stay."""
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    table = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert formats.dealt(table, "id") is table
    monkeypatch.setattr(formats, "ROWS_A_TASK", 30)
    out = formats.dealt(table, "id")
    assert out.rdd.getNumPartitions() == 4 and sorted(r[0] for r in out.collect()) == list(range(100)) and formats.dealt(table.limit(0), "id").count() == 0


def test_collisions(spark):
    df = spark.createDataFrame([("f", "a", "1"), ("f", "b", "1"), ("f", "a", "1"), ("f", "c", "2"), ("g", "z", "1")], "field string, original string, token string")
    assert [tuple(r) for r in job.collisions(df).collect()] == [("f", 1)]


def test_partitions_change_nothing(spark):
    df = spark.createDataFrame([(f"p{i}", str(20 + i % 5 * 10), str(10000 + i % 4), "2024-01-01", f"mail u{i}@example.com") for i in range(40)], "id string, age string, zip string, visit string, diagnosis string")
    p = with_(patterns=[{"name": "m", "builtin": "email", "action": "token"}])
    got = []
    for n in (1, 2, 7, 40):
        made = job.build(df.repartition(n), p, "anonymize", dataset_key(SECRET, "flow"))
        rows = sorted(map(tuple, made.output.collect()))
        report = made.report()
        got.append((rows, report["quasi_identifiers"], report["pattern_findings"], sorted(report["warnings"])))
    assert all(g == got[0] for g in got)


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, 1.5, [1, 2])], "n bigint, x double, l array<int>")
    p = parse_policy({"version": 1, "dataset": "d", "fields": [{"name": c, "class": "utility"} for c in ("n", "x", "l")], "presets": [{"preset": "precise", "action": "detect"}]})
    made = job.build(df, p, "anonymize")
    assert made.output.dtypes == df.dtypes and any("nested" in w for w in made.plan.warnings)


# --- formats


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", '﻿a,b\n" x ","say ""hi"", you"\n007,\n"two\nlines",3\n')
    df = formats.read(spark, path)
    assert df.columns == ["a", "b"] and df.count() == 3
    assert [tuple(r) for r in df.collect()] == [(" x ", 'say "hi", you'), ("007", None), ("two\nlines", "3")]
    formats.write(df, str(tmp_path / "out.csv"))
    assert [tuple(r) for r in formats.read(spark, str(tmp_path / "out.csv")).collect()] == [tuple(r) for r in df.collect()]
    with pytest.raises((PySparkException, Py4JJavaError)):
        formats.read(spark, put(tmp_path / "r.csv", "a,b\n1,2\n3\n")).collect()


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '﻿{"id": "1", "age": 34, "ok": true, "note": null}\n\n{"id": "2", "note": "x"}\n')
    df = formats.read(spark, path)
    assert df.columns == ["id", "age", "ok", "note"]
    assert [tuple(r) for r in df.collect()] == [("1", "34", "true", None), ("2", None, None, "x")]
    formats.write(df, str(tmp_path / "o.jsonl"))
    lines = [json.loads(x) for f in sorted((tmp_path / "o.jsonl").glob("part*")) for x in f.read_text().splitlines()]
    assert lines[0] == {"id": 1, "age": 34, "ok": True, "note": None}
    for bad in ('{"a": 1}\n{"b": 2}\n', '{"a": [1]}\n', '{"a": 1}\n[1]\n', '{"a": {"b": 1}}\n'):
        with pytest.raises((PySparkException, Py4JJavaError)):
            formats.read(spark, put(tmp_path / "b.jsonl", bad)).collect()
    with pytest.raises(FormatError):
        formats.read(spark, put(tmp_path / "c.jsonl", "[1]\n"))


def test_kinds(spark):
    df = spark.createDataFrame([("1", "1", "true", "01", "1" * 20, "1.10", "+49", ""), ("-2", "2.5", "", "2", "2", "2", "5", "")], list("abcdefgh"))
    assert formats.text_kinds(df) == {"a": "bigint", "b": "double", "c": "boolean", "d": "string", "e": "string", "f": "string", "g": "string", "h": "string"}
    assert formats.typed(df).first()["a"] == 1


def test_names():
    assert formats.infer_format("x/Y.PQ") == "parquet" and formats.infer_format("a.ndjson") == "jsonl"
    with pytest.raises(FormatError):
        formats.infer_format("a.txt")
    assert formats.label("a\nb") == "a�b" and "(60 characters)" in formats.label("x" * 60)


# --- runs


def policy_text(**more):
    return json.dumps(FLOW | {"key": {"inline": SECRET}} | more)


def test_run_publishes_or_nothing(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    flow(spark).write.parquet(source)
    out, rep, vlt = (str(tmp_path / n) for n in ("out.parquet", "report.json", "vault"))
    good = runner.execute(spark, runner.Request("pseudonymize", policy_text(), source, out, rep, vlt))
    assert good.status == "ok", good.error
    assert spark.read.parquet(out).count() == 4 and json.load(open(rep))["rows_written"] == 4
    records = vault.read_vault(spark, vlt, SECRET, "flow")
    back = reverse.reverse(spark.read.parquet(out), records)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, flow(spark).collect()), key=str)
    same = runner.execute(spark, runner.Request("anonymize", policy_text(), source, source + "/"))
    assert same.status == "error" and spark.read.parquet(source).count() == 4
    bad = runner.execute(spark, runner.Request("anonymize", policy_text(fields=[]), source, str(tmp_path / "no.parquet")))
    assert bad.status == "error" and not os.path.exists(tmp_path / "no.parquet") and not list(tmp_path.glob(".*.part"))
    with pytest.raises(VaultError):
        vault.read_vault(spark, vlt, SECRET[::-1], "flow")
    entry = next(f for f in (tmp_path / "vault" / "entries").glob("part*") if f.read_text())
    crc = entry.parent / f".{entry.name}.crc"
    crc.unlink(missing_ok=True)
    lines = entry.read_text().splitlines()
    entry.write_text("\n".join(lines[1:]) + ("\n" if lines[1:] else ""))
    with pytest.raises(VaultError):
        vault.read_vault(spark, vlt, SECRET, "flow")


def test_many_and_audit(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    flow(spark).write.parquet(source)
    log = str(tmp_path / "audit.jsonl")
    requests = [runner.Request("anonymize", policy_text(), s, str(tmp_path / f"o{i}.csv"), job=f"j{i}") for i, s in enumerate((source, source + "x", source))]
    got = runner.run_many(spark, requests, 2, audited(log))
    assert [o.status for o in got] == ["ok", "error", "ok"]
    lines = [json.loads(x) for x in open(log)]
    assert {x["job"] for x in lines} == {"j0", "j1", "j2"} and SECRET not in open(log).read()
    assert policy_hash(policy_text()) == policy_hash(policy_text(key={"inline": "other"}))


def test_chain_links_tables(spark, tmp_path):
    spark.createDataFrame([("1", "x"), ("2", "y")], "patient_id string, v string").write.parquet(str(tmp_path / "p.parquet"))
    spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "visit string, patient_ref string").write.parquet(str(tmp_path / "v.parquet"))
    texts = {
        "p": json.dumps({"version": 1, "dataset": "p", "key": {"inline": SECRET}, "fields": [{"name": "patient_id", "class": "direct_identifier"}, {"name": "v", "class": "utility"}]}),
        "v": json.dumps({"version": 1, "dataset": "v", "key": {"inline": SECRET}, "fields": [{"name": "patient_ref", "class": "direct_identifier", "pseudonymize": {"domain": "patient_id"}}, {"name": "visit", "class": "utility"}]}),
    }
    jobs = [{"name": n, "policy": n, "input": str(tmp_path / f"{n}.parquet"), "output": str(tmp_path / f"{n}-out.parquet")} for n in "pv"]
    report = runner.run_chain(spark, runner.parse_chain({"dataset": "both", "jobs": jobs}), "pseudonymize", texts.get)
    assert report["complete"]
    p, v = (spark.read.parquet(str(tmp_path / f"{n}-out.parquet")) for n in "pv")
    assert p.join(v, p.patient_id == v.patient_ref).count() == 3
    warned = runner.run_chain(spark, runner.parse_chain({"jobs": [jobs[0] | {"input": "/nowhere.parquet"}, jobs[1]]}), "pseudonymize", texts.get)
    assert not warned["complete"] and len(warned["jobs"]) == 1 and len(warned["warnings"]) == 2
    for bad in ([], [jobs[0], jobs[0]], [jobs[0] | {"name": "../x"}], [jobs[0] | {"name": ".."}]):
        with pytest.raises(PolicyError):
            runner.parse_chain({"jobs": bad})


def test_bucket_plans(spark, capsys):
    """A text is parsed once, and a number never becomes text."""
    policy = parse_policy({"version": 1, "dataset": "d", "on_unlisted": "remove", "fields": [{"name": n, "class": "quasi_identifier", "anonymize": {"strategy": "bucket", "width": 10}} for n in ("t", "i", "d")]})
    df = spark.range(4).selectExpr("cast(id AS string) || '.5' AS t", "id AS i", "id + 0.5D AS d")
    made = job.build(df, policy, "anonymize").output
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") + plan.count("RLIKE") <= 4
    assert [tuple(r) for r in made.collect()] == [("0-9",) * 3] * 4
    odd = spark.createDataFrame([("1e30", 2**63 - 1, float("nan")), ("", None, None), ("-0.5", -(2**63) + 8, -0.5), ("x", -1, 1e19)], "t string, i long, d double")
    assert [tuple(r) for r in job.build(odd, policy, "anonymize").output.collect()] == [("*", "*", "*"), ("", None, None), ("-10--1", "-9223372036854775800--9223372036854775791", "-10--1"), ("*", "-10--1", "*")]


def test_gates(spark):
    """What a detector finds holds what its gate looks for: its example, and the examples of others around it."""
    every = " ; ".join(d.example for d in detectors.CATALOGUE.values())
    rows = spark.createDataFrame([(d.example,) for d in detectors.CATALOGUE.values()] + [(every,), (every.lower(),), (every.upper(),), ("٣٤٥-١٢-٣٤٥٦ ١٢/٠٣/١٩٩٠ +٤٩ ٨٩ ١٢٣٤٥ ١.٢.٣.٤",)], "t string")
    for name, gate in detectors.GATES.items():
        found = rows.select(F.size(cascade.matches_of(F.col("t"), detectors.PATTERNS[name])).alias("all"), F.size(cascade.matches_of(F.col("t"), detectors.PATTERNS[name], gate)).alias("gated")).collect()
        assert all(r["all"] == r["gated"] for r in found) and sum(r["all"] for r in found), name


def test_led_detectors(spark):
    """An expression that is tried only where its first character fits has the same matches, and a text that its gate lets
    through isn't searched for what the gate loses."""
    from maskwright import queries as registered

    every = " ; ".join(d.example for d in detectors.CATALOGUE.values())
    texts = [d.example for d in detectors.CATALOGUE.values()] + [every, every.lower(), every.upper(), "٣٤٥-١٢-٣٤٥٦ ١٢/٠٣/١٩٩٠ +٤٩ ٨٩ ١٢٣٤٥ ١.٢.٣.٤", "Universität Ärzte GmbH", "::ffff:1.2.3.4 ::1 \u017fep 3, 1991 3 \u017fep 1991", *(t for _, t in registered.PLANTED)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in detectors.GATES:
        found = rows.select(cascade.matches_of(F.col("t"), detectors.PATTERNS[name]).alias("plain"), cascade.matches_of(F.col("t"), name, read=detectors.led).alias("led")).collect()
        assert all(r["plain"] == r["led"] for r in found) and any(r["led"] for r in found), name
    plan = registered.queries()["gated"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= len(detectors.GATES)


def test_reverse_inside_texts(spark):
    key = dataset_key(SECRET, "d")
    p = parse_policy({"version": 1, "dataset": "d", "fields": [{"name": "t", "class": "utility"}], "patterns": [{"name": "m", "builtin": "email", "action": "token", "prefix": "em_"}, {"name": "ph", "builtin": "phone", "action": "mock"}]})
    df = spark.createDataFrame([("a@b.co, c@d.org and +49 89 1234567",), ("none",), (None,)], "t string")
    made = job.build(df, p, "pseudonymize", key, mappings=True)
    assert made.output.first()["t"] != df.first()["t"]
    assert sorted(map(repr, reverse.reverse(made.output, made.mappings).collect())) == sorted(map(repr, df.collect()))


def test_reverse_within_longer_runs_and_overlaps(spark):
    """A token beside other hex digits, one whose prefix is hex, one that holds another, and equal texts in many rows."""
    a, b = "0123456789abcdef" * 2, "f" * 32
    records = spark.createDataFrame([("pattern:m", "A", "em_" + a), ("pattern:m", "B", "fa" + b), ("pattern:n", "C", b)], "field string, original string, token string")
    rows = [(f"x em_{a}77 y", None), (f"fa{b}, {b}", f"em_{a}"), (f"em_{a}em_{a}", "no"), (None, "no")] * 3
    got = reverse.reverse(spark.createDataFrame(rows, "t string, u string"), records).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter([("x A77 y", None), ("B, C", "A"), ("AA", "no"), (None, "no")] * 3)


def test_reverse_many_mocks(spark):
    """More mocks than fit one expression, some of which begin alike, and more prefixes of tokens."""
    n = reverse.MOST_LITERALS + 500
    records = spark.createDataFrame([("pattern:m", f"old{i}", f"Mock {i}") for i in range(n)] + [("pattern:m", "Mock 7", "é mock")], "field string, original string, token string")
    rows = [("Mock 1, Mock 12 and Mock 1234xMock 9999",), ("none",), (None,), ("",), ("é mock Mock 2499",)]
    df = spark.createDataFrame(rows, "t string")
    want = ["old1, old12 and old1234xold9999", "none", None, "", "Mock 7 old2499"]
    assert collections.Counter(r[0] for r in reverse.reverse(df, records).collect()) == collections.Counter(want)
    prefixed = spark.createDataFrame([("pattern:m", f"o{i}", f"p{i}_" + f"{i:032x}") for i in range(n)], "field string, original string, token string")
    texts = [f"a p{i}_{i:032x}, b" for i in range(0, n, 50)]
    got = reverse.reverse(spark.createDataFrame([(" ".join(texts),)], "t string"), prefixed).first()[0]
    assert got == " ".join(f"a o{i}, b" for i in range(0, n, 50))


def test_lints():
    texts = parse_policy({"version": 1, "dataset": "d", "on_unlisted": "remove", "fields": [{"name": "remark", "class": "utility"}]})
    assert [x.id for x in lint(texts)] == ["missing-key-source", "unlisted-columns-removed", "no-direct-identifiers", "no-quasi-identifiers", "free-text-without-patterns"]
    assert "missing-key-source" not in [x.id for x in lint(texts, "anonymize")] and len(IDS) == 14


def test_risk_of_nothing(spark):
    df = spark.createDataFrame([], "a string")
    assert risk.summary_dict(df, ["a"]) is None and risk.summary_dict(df, []) is None
    assert transforms.SUPPRESSED == "*"


def test_staging_deletes_on_failure(spark, tmp_path):
    with pytest.raises(RuntimeError):
        with staging.staged(spark, str(tmp_path / "t"), "j") as part:
            spark.range(3).write.parquet(part)
            raise RuntimeError
    assert not list(tmp_path.iterdir())


def test_stream(spark, tmp_path):
    from maskwright.streaming import batches

    flow(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flow(spark).schema).parquet(str(tmp_path / "in"))
    reports = []
    run = batches.job_per_batch(with_(), "pseudonymize", lambda t, n: t.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}")), dataset_key(SECRET, "flow"), lambda r, n: reports.append(r))
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and reports[0]["rows_read"] == 4
    narrow = batches.narrow(stream, with_(), "anonymize").writeStream.format("memory").queryName("narrow").trigger(availableNow=True).start()
    narrow.awaitTermination()
    assert spark.table("narrow").count() == 4
    counted = batches.running_classes(stream, ["zip"]).writeStream.format("memory").queryName("classes").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.table("classes").count() == 4


def test_cli(tmp_path, capsys):
    from maskwright import cli

    text = put(tmp_path / "p.yaml", json.dumps(FLOW | {"key": {"inline": SECRET}}))
    assert cli.main(["lint", text]) == 0 and cli.main(["lint", text, "--deny"]) == 1
    assert cli.main(["detectors", "--class", "moderate"]) == 0 and "phone" in capsys.readouterr().out
    assert cli.main(["lint", str(tmp_path / "none.yaml")]) == 1


def test_cli_tables(spark, tmp_path):
    from maskwright import cli

    text = put(tmp_path / "p.yaml", json.dumps(FLOW | {"key": {"inline": SECRET}}))
    source = put(tmp_path / "in.csv", "id,age,zip,visit,diagnosis\na,31,81549,2024-01-02,flu\n")
    out, vlt = str(tmp_path / "o.csv"), str(tmp_path / "v")
    assert cli.main(["pseudonymize", source, "--policy", text, "--out", out, "--vault", vlt, "--deny-lints"]) == 1
    assert cli.main(["pseudonymize", source, "--policy", text, "--out", out, "--vault", vlt, "--no-lint", "--audit-log", str(tmp_path / "log")]) == 0
    assert cli.main(["reverse", out, "--vault", vlt, "--policy", text, "--out", str(tmp_path / "back.csv")]) == 0
    assert formats.read(spark, str(tmp_path / "back.csv")).first()["id"] == "a"
    assert cli.main(["vault-export", vlt, "--policy", text, "--out", str(tmp_path / "x.csv")]) == 0
