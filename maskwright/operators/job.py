"""One job: a table through a policy, in one pass, and its risk report.

The output is a lazy frame. Counts come from an observation in the same pass as the write; the class statistics are one
aggregate over the same expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.errors import PolicyError
from maskwright.functions import transforms
from maskwright.functions.keys import Keyed, dataset_key, resolve_secret
from maskwright.functions.validators import LABELS
from maskwright.operators import cascade, risk
from maskwright.operators.cascade import Scan
from maskwright.plans.planner import ColumnPlan, Plan, plan
from maskwright.plans.policy import MODES, Policy
from maskwright.plans.report import LIMITATIONS, VERSION

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def transformed(text: Column, t) -> Column:
    """A text column after a strategy other than remove."""
    if t.strategy == "redact":
        return transforms.redact(text, t.replacement)
    if t.strategy == "bucket":
        return transforms.bucket(text, t.width)
    if t.strategy == "date_truncate":
        return transforms.date_truncate(text, t.granularity)
    return transforms.keep_prefix(text, t.chars, t.pad)


def as_text(name: str, kind: T.DataType) -> Column:
    """The one text form of a value. Times have a space and no fraction of zero; the zone is the session's."""
    return F.col(f"`{name}`").cast("string")


@dataclass
class Job:
    """A planned job. ``output`` is the table; ``report()`` is complete once the output was written."""

    policy: Policy
    mode: str
    plan: Plan
    output: DataFrame
    mappings: DataFrame | None
    observation: Observation
    scans: list[Scan]
    warnings: list[str] = field(default_factory=list)
    input: str = ""
    written: str = ""

    def report(self, table: DataFrame | None = None) -> dict:
        """Counts, findings, class statistics and warnings. table: the output as written, else the plan runs again."""
        got = self.observation.get
        warnings = [*self.plan.warnings, *self.warnings]
        suppressed = sum(got.get(f"suppressed_{i}", 0) or 0 for i in range(len(self.plan.columns)))
        if suppressed:
            warnings.append(f"{suppressed} values did not fit their strategy and were replaced by {transforms.SUPPRESSED}")
        findings, hit = [], set()
        for i, s in enumerate(self.scans):
            n, rejected = got.get(f"matches_{i}") or 0, got.get(f"rejected_{i}") or 0
            if rejected:
                warnings.append(f"rule {s.rule.name!r}, column {s.column!r}: {rejected} matches were left as they are, since {LABELS[s.rule.validator]} rejected them")
            if n:
                hit.add(s.rule.name)
                findings.append({"rule": s.rule.name, "column": s.column, "action": s.rule.action, "matches": n, "rejected": rejected})
                warnings += self._said(s, n)
        warnings += [f"rule {r!r} matched nothing" for r in dict.fromkeys(s.rule.name for s in self.scans) if r not in hit]
        warnings += self._collisions()
        classes = risk.summary_dict(table if table is not None else self.output, self.plan.quasi)
        if classes and classes["unique_rows"] and self.mode == "anonymize":
            warnings.append(f"{classes['unique_rows']} rows are alone in their class")
        return {
            "version": VERSION,
            "mode": self.mode,
            "dataset": self.policy.dataset,
            "input": self.input,
            "output": self.written,
            "rows_read": got.get("rows") or 0,
            "rows_written": got.get("rows") or 0,
            "fields": [{"name": c.name, "class": c.field_class, "action": c.label} for c in self.plan.columns],
            "pattern_findings": findings,
            "quasi_identifiers": classes,
            "warnings": list(dict.fromkeys(warnings)),
            "limitations": list(LIMITATIONS),
        }

    def _said(self, s: Scan, n: int) -> list[str]:
        out = []
        if s.rule.precision == "heuristic":
            out.append(f"rule {s.rule.name!r} is a heuristic: expect wrong and missed matches in column {s.column!r}")
        if s.rule.action == "detect":
            out.append(f"{n} matches of rule {s.rule.name!r} remain in column {s.column!r}, as it only detects")
        if s.rule.action in ("token", "mock") and self.mode == "anonymize":
            out.append(f"rule {s.rule.name!r} leaves values that the key can reverse: column {s.column!r} is pseudonymous, not anonymous")
        return out

    def _collisions(self) -> list[str]:
        rules = [s.rule.name for s in self.scans if s.rule.action == "mock"]
        if not rules or self.mappings is None:
            return []
        found = collisions(self.mappings.filter(F.col("field").isin([f"pattern:{r}" for r in rules]))).collect()
        return [f"{r['colliding']} originals of {r['field'][8:]!r} share a mock with another one: it can't be reversed, and joins on it mix them" for r in found]


def collisions(mappings: DataFrame) -> DataFrame:
    """(field, colliding): originals whose mock another original has as well, beyond the first of each mock."""
    shared = mappings.select("field", "original", "token").distinct().groupBy("field", "token").agg(F.count(F.lit(1)).alias("n"))
    return shared.filter("n > 1").groupBy("field").agg(F.sum(F.col("n") - 1).cast("bigint").alias("colliding"))


def build(df: DataFrame, policy: Policy, mode: str, key: bytes | None = None, mappings: bool = False) -> Job:
    """Plan a job over a frame. key: the dataset key (else it is resolved from the policy, if the job needs one)."""
    if mode not in MODES:
        raise PolicyError(f"mode {mode!r} isn't one of {', '.join(MODES)}")
    warnings: list[str] = []
    nested = {f.name for f in df.schema if isinstance(f.dataType, _NESTED)}
    made = plan(policy, mode, df.columns, set(df.columns) - nested)
    if key is None and policy.needs_key(mode):
        source = policy.key
        secret, warnings = resolve_secret(source.env if source else None, source.inline if source else None, bool(source and source.allow_inline_fallback))
        key = dataset_key(secret, policy.dataset)
    rows, keyed = Keyed.on(df, key) if key is not None and policy.needs_key(mode) else (df, None)
    maps, metrics = [], [F.count(F.lit(1)).alias("rows")]
    hidden = cascade.INTERNAL
    for i, c in enumerate(made.columns):
        if c.kind == "token":
            text = as_text(c.name, df.schema[c.name].dataType)
            token = F.when(text != "", F.concat(F.lit(c.prefix), keyed.token(c.domain, text))).otherwise(text)
            rows = rows.withColumns({f"{hidden}o{i}": text, c.name: token})
            maps.append((c.domain, f"{hidden}o{i}", c.name))
        elif c.kind == "transform":
            kind = df.schema[c.name].dataType
            text = as_text(c.name, kind)
            if c.transform.strategy == "bucket" and isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType)):
                new, fresh = transforms.bucket_number(F.col(f"`{c.name}`"), kind, c.transform.width), F.lit(True)
            else:
                new, fresh = transformed(text, c.transform), (text != "") & (text != transforms.SUPPRESSED)
            # the value first, then whether it was suppressed: each is computed once
            rows = rows.withColumns({f"{hidden}u{i}": fresh, c.name: new}).withColumn(f"{hidden}u{i}", F.col(f"`{hidden}u{i}`") & (F.col(f"`{c.name}`") == transforms.SUPPRESSED))
            metrics.append(F.count_if(F.col(f"`{hidden}u{i}`")).alias(f"suppressed_{i}"))
    scans: list[Scan] = []
    for c in made.columns:
        if c.rules:
            if any(r.action != "detect" for r in c.rules) or dict(rows.dtypes)[c.name] == "string":
                rows = rows.withColumn(c.name, F.col(f"`{c.name}`").cast("string"))
                rows, some = cascade.scan(rows, c.name, c.rules, keyed, mappings)
            else:
                rows, some = _detect_only(rows, c, keyed)
            scans += some
    for i, s in enumerate(scans):
        metrics += [F.sum(f"`{s.matches}`").alias(f"matches_{i}"), F.sum(f"`{s.rejected}`").alias(f"rejected_{i}")]
    observation = Observation()
    kept = [c.name for c in made.columns if c.kind != "drop"]
    # a stream's counts are taken batch by batch (see streaming)
    output = (rows if df.isStreaming else rows.observe(observation, *metrics)).select(*[F.col(f"`{c}`") for c in kept])
    return Job(policy, mode, made, output, _mappings(rows, maps, scans) if mappings else None, observation, scans, warnings)


def _detect_only(rows: DataFrame, c: ColumnPlan, keyed: Keyed | None) -> tuple[DataFrame, list[Scan]]:
    """A column that isn't text and is only searched keeps its type: a copy of its text is scanned."""
    copy = f"{cascade.INTERNAL}{c.name}"
    rows, some = cascade.scan(rows.withColumn(copy, F.col(f"`{c.name}`").cast("string")), copy, c.rules, keyed)
    return rows, [Scan(s.rule, c.name, s.matches, s.rejected, None) for s in some]


def _records(s: Scan) -> Column:
    return F.transform(F.col(f"`{s.mappings}`"), lambda x: F.struct(F.lit(f"pattern:{s.rule.name}").alias("field"), x["o"].alias("original"), x["t"].alias("token")))


def _mappings(rows: DataFrame, maps: list[tuple[str, str, str]], scans: list[Scan]) -> DataFrame:
    """Distinct (field, original, token) of all reversible replacements, from one pass over the rows."""
    whole = [F.when(F.col(f"`{o}`") != "", F.array(F.struct(F.lit(d).alias("field"), F.col(f"`{o}`").alias("original"), F.col(f"`{t}`").alias("token")))).otherwise(F.array().cast("array<struct<field:string,original:string,token:string>>")) for d, o, t in maps]
    inside = [_records(s) for s in scans if s.mappings]
    if not whole and not inside:
        return rows.sparkSession.createDataFrame([], "field string, original string, token string")
    return rows.select(F.explode(F.concat(*whole, *inside)).alias("m")).select("m.*").dropDuplicates(["field", "original"])
