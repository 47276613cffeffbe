"""Command line: python -m maskwright.cli COMMAND. Exit code 0, or 1 if anything failed, was denied or is ambiguous."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from maskwright.audit import audited
from maskwright.functions.detectors import CATALOGUE
from maskwright.functions.keys import resolve_secret
from maskwright.operators import reverse, runner, vault
from maskwright.plans.lint import lint
from maskwright.plans.policy import MODES, Policy, parse_policy
from maskwright.plans.report import to_json
from maskwright.sources import formats, staging


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="maskwright", description="De-identify tables and image metadata on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    for mode in MODES:
        p = commands.add_parser(mode, help=f"{mode} one or more tables")
        p.add_argument("inputs", nargs="+")
        p.add_argument("--policy", required=True)
        p.add_argument("--out", required=True, help="a table, or a folder for several inputs")
        p.add_argument("--report")
        p.add_argument("--vault")
        p.add_argument("--split", type=int, help="number of partitions")
        p.add_argument("--jobs", type=int, default=runner.MOST_JOBS)
        _checks(p)
    p = commands.add_parser("chain", help="run the jobs of a manifest")
    p.add_argument("manifest")
    p.add_argument("--mode", choices=MODES, required=True)
    p.add_argument("--report")
    _checks(p)
    p = commands.add_parser("lint", help="risks of a policy")
    p.add_argument("policy")
    p.add_argument("--mode", choices=MODES)
    p.add_argument("--json", action="store_true")
    p.add_argument("--deny", action="store_true")
    p = commands.add_parser("detectors", help="the built-in detectors")
    p.add_argument("--class", dest="precision", choices=("precise", "moderate", "heuristic"))
    p.add_argument("--json", action="store_true")
    p = commands.add_parser("vault-export", help="a vault as a table")
    p.add_argument("vault")
    p.add_argument("--policy", required=True)
    p.add_argument("--out")
    p = commands.add_parser("reverse", help="tokens of a table back to originals")
    p.add_argument("input")
    p.add_argument("--vault", required=True)
    p.add_argument("--policy", required=True)
    p.add_argument("--out", required=True)
    p = commands.add_parser("dicom", help="a folder of images")
    p.add_argument("input")
    p.add_argument("--policy", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--report")
    p.add_argument("--vault")
    return top


def _checks(p: argparse.ArgumentParser) -> None:
    p.add_argument("--no-lint", action="store_true")
    p.add_argument("--deny-lints", action="store_true")
    p.add_argument("--audit-log")


def _session() -> SparkSession:
    return SparkSession.builder.appName("maskwright").config("spark.sql.caseSensitive", "true").config("spark.scheduler.mode", "FAIR").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _read(path: str) -> str:
    with open(path, encoding="utf-8-sig") as f:
        return f.read()


def _linted(args, policies: list[Policy], mode: str) -> bool:
    """Print warnings; False if they deny the run."""
    if args.no_lint:
        return True
    found = [x for p in policies for x in lint(p, mode) if x.level == "warning"]
    for x in found:
        print(f"{x.id}: {x.subject}: {x.message}", file=sys.stderr)
    return not (found and args.deny_lints)


def _secret(policy: Policy) -> str:
    k = policy.key
    return resolve_secret(k.env if k else None, k.inline if k else None, bool(k and k.allow_inline_fallback))[0]


def _tables(args) -> int:
    spark, text = _session(), _read(args.policy)
    if len(args.inputs) > 1 and (args.report or args.vault or args.split):
        print("--report, --vault and --split go with one input", file=sys.stderr)
        return 1
    policy = parse_policy(text, spark)
    if not _linted(args, [policy], args.command):
        return 1
    many = len(args.inputs) > 1
    if len({os.path.basename(i) for i in args.inputs}) < len(args.inputs):
        print("inputs of the same file name would be written to one output", file=sys.stderr)
        return 1
    requests = [runner.Request(args.command, policy, i, os.path.join(args.out, os.path.basename(i)) if many else args.out, args.report, args.vault, os.path.basename(i), args.split) for i in args.inputs]
    run = audited(args.audit_log) if args.audit_log else runner.execute
    outcomes = runner.run_many(spark, requests, args.jobs, run)
    for o in outcomes:
        print(json.dumps({"job": o.job, "status": o.status, "error": o.error, "rows": (o.report or {}).get("rows_written"), "warnings": (o.report or {}).get("warnings", [])}, ensure_ascii=False))
    return int(any(o.status != "ok" for o in outcomes))


def _chain(args) -> int:
    spark, base = _session(), os.path.dirname(os.path.abspath(args.manifest))
    chain = runner.parse_chain(_read(args.manifest))
    read = lambda p: _read(os.path.join(base, p))
    policies = [parse_policy(read(j.policy), spark).with_overrides(chain.dataset, chain.key) for j in chain.jobs]
    if not _linted(args, policies, args.mode):
        return 1
    report = runner.run_chain(spark, chain, args.mode, read, audited(args.audit_log) if args.audit_log else runner.execute)
    if args.report:
        staging.write_text(spark, args.report, to_json(report))
    print(to_json(report))
    return int(not report["complete"])


def _lint(args) -> int:
    found = lint(parse_policy(_read(args.policy)), args.mode)
    print(json.dumps([vars(x) for x in found], ensure_ascii=False) if args.json else "\n".join(f"{x.level}: {x.id}: {x.subject}: {x.message}" for x in found) or "nothing found")
    return int(bool(args.deny and any(x.level == "warning" for x in found)))


def _detectors(args) -> int:
    some = [d for d in CATALOGUE.values() if args.precision in (None, d.precision)]
    rows = [{"name": d.name, "class": d.precision, "description": d.description, "validated_by": d.validator, "mockable": d.mockable, "example": d.example} for d in some]
    print(json.dumps(rows, ensure_ascii=False) if args.json else "\n".join(f"{r['name']:15} {r['class']:10} {r['description']} (for example {r['example']})" for r in rows))
    return 0


def _vault_export(args) -> int:
    spark, policy = _session(), parse_policy(_read(args.policy))
    table = reverse.export(vault.read_vault(spark, args.vault, _secret(policy), policy.dataset))
    if args.out:
        with staging.staged(spark, args.out, args.out) as part:
            formats.write(table, part, "csv")
    else:
        print("domain,token,original")
        for r in table.toLocalIterator():
            print(f"{r['domain']},{r['token']},{r['original']}")
    return 0


def _reverse(args) -> int:
    spark, policy = _session(), parse_policy(_read(args.policy))
    staging.refuse_in_place(spark, args.input, args.out)
    records = vault.read_vault(spark, args.vault, _secret(policy), policy.dataset)
    unclear = reverse.ambiguous(records)
    n = unclear.count()
    with staging.staged(spark, args.out, args.out) as part:
        formats.write(reverse.reverse(formats.read(spark, args.input), records), part, formats.infer_format(args.out))
    for r in unclear.limit(5).collect():
        print(f"{r['field']}: token {r['token']} stands for {r['originals']} originals and was left", file=sys.stderr)
    return int(n > 0)


def _dicom(args) -> int:
    from maskwright.dicom import job

    report = job.run(_session(), _read(args.policy), args.input, args.out, args.vault)
    if args.report:
        staging.write_text(_session(), args.report, to_json(report))
    print(to_json({k: report[k] for k in ("instances", "highest_pixel_risk", "warnings")}))
    return int(not report["instances"] or bool(report["skipped"]))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    run = {"chain": _chain, "lint": _lint, "detectors": _detectors, "vault-export": _vault_export, "reverse": _reverse, "dicom": _dicom}.get(args.command, _tables)
    try:
        return run(args)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
