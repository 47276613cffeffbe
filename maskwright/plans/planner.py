"""From (mode, policy, columns) to one action for each column and the content rules that scan it."""

from __future__ import annotations

from dataclasses import dataclass, field

from maskwright.errors import PolicyError
from maskwright.plans.policy import Anonymize, Policy, Rule

#: Words of a report for each strategy.
DONE = {"remove": "removed", "redact": "redacted", "bucket": "bucketed", "date_truncate": "date-truncated", "keep_prefix": "prefix-truncated"}


@dataclass(frozen=True)
class ColumnPlan:
    name: str
    kind: str  # keep, drop, token or transform
    field_class: str
    label: str
    prefix: str = ""
    domain: str = ""
    transform: Anonymize | None = None
    rules: tuple[Rule, ...] = ()


@dataclass
class Plan:
    mode: str
    columns: list[ColumnPlan]
    warnings: list[str] = field(default_factory=list)

    @property
    def quasi(self) -> list[str]:
        """Quasi-identifiers that the output holds, in its order."""
        return [c.name for c in self.columns if c.field_class == "quasi_identifier" and c.kind != "drop"]


def _near(name: str, columns: list[str]) -> str | None:
    return next((c for c in columns if c.strip().lower() == name.strip().lower()), None)


def plan(policy: Policy, mode: str, columns: list[str], scannable: set[str] | None = None) -> Plan:
    """scannable: columns whose type has a text form (all if None); others are kept or dropped, never scanned."""
    out = Plan(mode, [])
    for f in policy.fields:
        if f.name in columns:
            continue
        if near := _near(f.name, columns):
            out.warnings.append(f"field {f.name!r} matches no column, but {near!r} differs in case or spaces only")
        elif f.field_class == "direct_identifier":
            out.warnings.append(f"direct identifier {f.name!r} matches no column: if the input holds it under another name it was copied unchanged")
        else:
            out.warnings.append(f"field {f.name!r} matches no column")
    listed = {f.name: f for f in policy.fields}
    unlisted = [c for c in columns if c not in listed]
    if unlisted and policy.on_unlisted == "error":
        raise PolicyError(f"columns that the policy doesn't list: {', '.join(unlisted)}")
    rules = policy.rules()
    for name in columns:
        column = _column(listed.get(name), name, mode, policy, out.warnings)
        if column.kind in ("keep", "transform"):
            own = tuple(r for r in rules if r.fields is None or name in r.fields)
            if own and scannable is not None and name not in scannable:
                out.warnings.append(f"column {name!r} has a nested or binary type and isn't scanned")
                own = ()
            column = ColumnPlan(**{**column.__dict__, "rules": own})
        out.columns.append(column)
    scanned = {r.name for c in out.columns for r in c.rules}
    out.warnings += [f"rule {r.name!r} scans no column" for r in rules if r.name not in scanned]
    return out


def _column(f, name: str, mode: str, policy: Policy, warnings: list[str]) -> ColumnPlan:
    if f is None:
        if policy.on_unlisted == "keep":
            warnings.append(f"column {name!r} isn't listed and was kept unchanged")
            return ColumnPlan(name, "keep", "unlisted", "kept")
        warnings.append(f"column {name!r} isn't listed and was removed")
        return ColumnPlan(name, "drop", "unlisted", "removed")
    if mode == "pseudonymize":
        if f.field_class == "direct_identifier":
            return ColumnPlan(name, "token", f.field_class, "tokenized", f.prefix or "", f.domain or name)
        return ColumnPlan(name, "keep", f.field_class, "kept")
    strategy = f.anonymize or (Anonymize("remove") if f.field_class == "direct_identifier" else None)
    if strategy is None:
        if f.field_class == "quasi_identifier":
            warnings.append(f"quasi-identifier {name!r} has no strategy and was kept unchanged")
        return ColumnPlan(name, "keep", f.field_class, "kept")
    kind = "drop" if strategy.strategy == "remove" else "transform"
    return ColumnPlan(name, kind, f.field_class, DONE[strategy.strategy], transform=strategy)
