"""Requests and outcomes: whole jobs from a path to a path, several at a time, in chains, and in parts."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from maskwright.errors import PolicyError
from maskwright.functions.keys import dataset_key, resolve_secret
from maskwright.operators import job as jobs
from maskwright.operators.vault import write_vault
from maskwright.plans.policy import KeySource, Policy, _key, _strict, _text, each, load_yaml, parse_policy
from maskwright.plans.report import to_json
from maskwright.sources import formats, staging

#: Fixed values.
MOST_JOBS, JOB_NAME = 8, re.compile(r"[A-Za-z0-9._-]{1,64}")


@dataclass(frozen=True)
class Request:
    mode: str
    policy: str | dict | Policy
    input: str
    output: str
    report: str | None = None
    vault: str | None = None
    job: str = "job"
    parts: int | None = None


@dataclass
class Outcome:
    status: str  # ok or error
    job: str
    report: dict | None = None
    error: str | None = None
    request: Request | None = field(default=None, repr=False)

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "request" and v is not None}


def execute(spark: SparkSession, request: Request) -> Outcome:
    """Run one job. Errors become an outcome; an output is published whole or not at all, and before its vault."""
    try:
        return Outcome("ok", request.job, _run(spark, request), request=request)
    except Exception as e:  # noqa: BLE001  any failure of a job is its outcome
        return Outcome("error", request.job, error=" ".join(str(e).split())[:300] or type(e).__name__, request=request)


def _run(spark: SparkSession, request: Request) -> dict:
    policy = request.policy if isinstance(request.policy, Policy) else parse_policy(request.policy, spark)
    staging.refuse_in_place(spark, request.input, request.output)
    kind = formats.infer_format(request.output)
    df = formats.read(spark, request.input)
    if request.parts:
        df = df.repartition(request.parts)
    secret, key = None, None
    if policy.needs_key(request.mode):
        source = policy.key or KeySource()
        secret, warnings = resolve_secret(source.env, source.inline, source.allow_inline_fallback)
        key = dataset_key(secret, policy.dataset)
    else:
        warnings = []
    made = jobs.build(df, policy, request.mode, key, mappings=key is not None)
    made.input, made.written = request.input, request.output
    made.warnings += warnings
    with staging.staged(spark, request.output, request.job) as part:
        formats.write(made.output, part, kind)
    if made.mappings is not None:
        # collisions and the vault share one pass
        made.mappings = made.mappings.persist(StorageLevel.DISK_ONLY)
    try:
        report = _checked(spark, made, request.output, kind)
        if request.vault:
            _write_vault(made, request, report, secret, policy)
    finally:
        if made.mappings is not None:
            made.mappings.unpersist()
    if request.report:
        staging.write_text(spark, request.report, to_json(report))
    return report


def _checked(spark: SparkSession, made: jobs.Job, output: str, kind: str) -> dict:
    """The report, its class statistics from the table as written, whose rows are counted too."""
    wrote = made.observation.get.get("rows") or 0
    # a text file without rows has no schema, and the rows of one that has a single column may be blank lines
    blank = kind != "parquet" and (not wrote or kind == "csv" and len(made.output.columns) < 2)
    table = None if blank else formats.read(spark, output, kind)
    if table is not None and (found := table.count()) != wrote:
        raise OSError(f"the output has {found} rows, {wrote} were written")
    return made.report(table)


def _write_vault(made: jobs.Job, request: Request, report: dict, secret: str | None, policy: Policy) -> None:
    reversible = made.mappings is not None and policy.needs_key(request.mode)
    n = write_vault(made.mappings, request.vault, secret, policy.dataset) if reversible else 0
    report["warnings"].append(f"the vault {request.vault} reverses {n} values: guard it like the originals" if n else "a vault was asked for, but nothing in the output can be reversed")


def run_many(spark: SparkSession, requests: list[Request], workers: int = MOST_JOBS, run: Callable = execute) -> list[Outcome]:
    """Outcomes in the order of the requests; one that fails doesn't stop the others. Each has a scheduler pool of its
    own, so that with ``spark.scheduler.mode=FAIR`` a long job doesn't hold up the others."""

    def one(at: int) -> Outcome:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"maskwright-{at}")
        try:
            return run(spark, requests[at])
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, min(workers, MOST_JOBS, len(requests) or 1))) as pool:
        return list(pool.map(one, range(len(requests))))


@dataclass(frozen=True)
class ChainJob:
    name: str
    policy: str
    input: str
    output: str
    report: str | None = None
    vault: str | None = None


@dataclass(frozen=True)
class Chain:
    jobs: tuple[ChainJob, ...]
    dataset: str | None = None
    key: KeySource | None = None


def parse_chain(source: str | dict) -> Chain:
    """A manifest: ``jobs`` with name, policy (a path), input, output, report and vault; ``dataset`` and ``key`` override all policies'."""
    one = lambda where, v: ChainJob(**_strict(where, v, {k: _text for k in ("name", "policy", "input", "output", "report", "vault")}))
    got = _strict("chain", load_yaml(source) if isinstance(source, str) else source, {"version": lambda w, v: v, "dataset": _text, "key": _key, "jobs": each(one)})
    got.pop("version", None)
    chain = Chain(**{"jobs": (), **got})
    if not chain.jobs:
        raise PolicyError("the chain has no jobs")
    for j in chain.jobs:
        if not JOB_NAME.fullmatch(j.name) or set(j.name) == {"."}:
            raise PolicyError(f"job name {formats.label(j.name)!r}: 1 to 64 letters, digits, dots, dashes and underscores are wanted")
    for what in ("name", "output", "report", "vault"):
        given = [getattr(j, what) for j in chain.jobs if getattr(j, what)]
        if len(set(given)) != len(given):
            raise PolicyError(f"two jobs have the same {what}")
    return chain


def run_chain(spark: SparkSession, chain: Chain, mode: str, read_policy: Callable[[str], str], run: Callable = execute) -> dict:
    """Jobs one after the other; the first failure ends the chain. Tokens join across jobs of one dataset and secret."""
    policies = [parse_policy(read_policy(j.policy), spark).with_overrides(chain.dataset, chain.key) for j in chain.jobs]
    warnings = []
    if mode == "pseudonymize" and len({p.dataset for p in policies}) > 1:
        warnings.append("the jobs' datasets differ, so equal values have different tokens and don't join: set dataset in the chain")
    done = []
    for j, policy in zip(chain.jobs, policies):
        done.append(run(spark, Request(mode, policy, j.input, j.output, j.report, j.vault, j.name)))
        if done[-1].status == "error":
            if left := len(chain.jobs) - len(done):
                warnings.append(f"the chain ended at job {j.name!r}; {left} later ones did not run")
            break
    return {"mode": mode, "complete": len(done) == len(chain.jobs) and done[-1].status == "ok", "jobs": [o.as_dict() for o in done], "warnings": warnings}
