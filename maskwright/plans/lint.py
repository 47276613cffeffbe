"""Lints: policies that are valid but risky. Each lint has an id, a level (warning or advice), a subject and a message."""

from __future__ import annotations

from dataclasses import dataclass

from maskwright.plans.policy import Policy

# Ids of the lints, and parts of column names that suggest free text.
IDS = (
    "inline-key", "missing-key-source", "unlisted-columns-kept", "unlisted-columns-removed", "no-direct-identifiers", "no-quasi-identifiers",
    "qi-without-strategy", "direct-identifier-partially-kept", "ineffective-bucket", "free-text-without-patterns", "duplicate-builtin-detector",
    "heuristic-pattern-modifies-data", "detect-only-pattern", "reversible-pattern-in-anonymize",
)
FREE_TEXT = ("note", "comment", "description", "text", "remark", "memo", "free", "message", "summary", "details", "subject", "kommentar", "notiz", "bemerkung", "anmerkung", "beschreibung")


@dataclass(frozen=True)
class Lint:
    id: str
    level: str
    subject: str
    message: str


def lint(policy: Policy, mode: str | None = None) -> list[Lint]:
    """Lints in the order of IDS. mode: only what concerns it; None: everything."""
    found: list[Lint] = []
    rules = policy.rules()
    by_class = lambda c: [f for f in policy.fields if f.field_class == c]
    anonymizes, pseudonymizes = mode in (None, "anonymize"), mode in (None, "pseudonymize")

    def add(i: str, level: str, subject: str, message: str) -> None:
        found.append(Lint(i, level, subject, message))

    if policy.key and policy.key.inline and policy.needs_key(mode or "pseudonymize"):
        more = "it is a fallback, but" if policy.key.env else "there is no environment variable, and"
        add("inline-key", "warning", "key", f"the secret stands in the policy: {more} whoever reads the policy can reverse the tokens")
    if policy.key is None and pseudonymizes:
        add("missing-key-source", "warning", "key", "pseudonymizing needs a secret, and the policy names no source")
    if policy.on_unlisted == "keep":
        add("unlisted-columns-kept", "warning", "on_unlisted", "new columns of the input reach the output unseen")
    if policy.on_unlisted == "remove":
        add("unlisted-columns-removed", "advice", "on_unlisted", "new columns of the input vanish without an error")
    if policy.fields and not by_class("direct_identifier"):
        add("no-direct-identifiers", "advice", "fields", "no column is a direct identifier")
    if policy.fields and not by_class("quasi_identifier"):
        add("no-quasi-identifiers", "advice", "fields", "no column is a quasi-identifier, so no risk is measured")
    if anonymizes:
        for f in by_class("quasi_identifier"):
            if f.anonymize is None:
                add("qi-without-strategy", "warning", f.name, "this quasi-identifier is kept unchanged")
        for f in by_class("direct_identifier"):
            if f.anonymize and f.anonymize.strategy == "keep_prefix" and f.anonymize.chars > 0:
                add("direct-identifier-partially-kept", "warning", f.name, "the beginning of a direct identifier is kept")
        for f in policy.fields:
            if f.anonymize and f.anonymize.strategy == "bucket" and f.anonymize.width == 1:
                add("ineffective-bucket", "warning", f.name, "buckets of width 1 hide nothing")
    for f in policy.fields:
        hinted = any(h in f.name.lower() for h in FREE_TEXT) and f.field_class in ("utility", "sensitive")
        removed = f.anonymize is not None and f.anonymize.strategy == "remove"
        covered = any(r.action != "detect" and (r.fields is None or f.name in r.fields) for r in rules)
        if hinted and not removed and not covered:
            add("free-text-without-patterns", "warning", f.name, "the name suggests free text, and no rule changes what it finds there")
    for builtin in dict.fromkeys(r.builtin for r in rules if r.builtin):
        same = [r.name for r in rules if r.builtin == builtin]
        if len(same) > 1:
            add("duplicate-builtin-detector", "warning", builtin, f"rules {', '.join(same)} use the same detector: the first one leaves nothing for the others")
    for r in rules:
        if r.precision == "heuristic" and r.action != "detect":
            add("heuristic-pattern-modifies-data", "warning", r.name, "a heuristic detector changes data, also where it is wrong")
    for r in policy.patterns:
        if r.action == "detect":
            add("detect-only-pattern", "advice", r.name, "what this rule finds stays in the output")
    for r in policy.patterns:
        if r.action in ("token", "mock") and mode == "anonymize":
            add("reversible-pattern-in-anonymize", "advice", r.name, "the key can reverse what this rule writes, so the output is pseudonymous")
    return found
