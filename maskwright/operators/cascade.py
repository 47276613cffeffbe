"""The cascade of content rules over one text column: each rule sees what the rule before it has left.

A rule searches the texts that hold what every match of it contains (its gate, a cheap expression), validates each match
once, and only texts with matches are split, their accepted matches replaced and the pieces joined again. All of it is
native: two projections a rule (matches, then text), so a plan grows in proportion to the rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions import detectors, mocks, validators
from maskwright.functions.keys import Keyed
from maskwright.plans.policy import Rule

#: Columns of this prefix carry pieces, counts and mappings until the end of a job.
INTERNAL = "§"


@dataclass(frozen=True)
class Scan:
    """What one rule found in one column: names of its count columns, and of its mappings' (or None)."""

    rule: Rule
    column: str
    matches: str
    rejected: str
    mappings: str | None


def matches_of(text: Column, regex: str, gate: str | None = None, read: Callable[[str], str] = detectors.java) -> Column:
    """All matches of an expression, left to right; none for a missing text or one without what ``gate`` finds. ``read``
    says how classes are meant."""
    found = F.regexp_extract_all(text, F.lit(read(regex)), F.lit(0))
    return F.coalesce(found if gate is None else F.when(text.rlike(gate), found), F.array().cast("array<string>"))


def count_matches(text: Column, regex: str, validator: str = "none", gate: str | None = None, read: Callable[[str], str] = detectors.java) -> Column:
    """Number of matches that the validator accepts; 0 for a missing text."""
    found = matches_of(text, regex, gate, read)
    return F.size(found if validator == "none" else F.filter(found, lambda m: validators.accepts(validator, m))).cast("bigint")


def replacement_of(rule: Rule, match: Column, keyed: Keyed | None) -> Column:
    """What stands for an accepted match. Labels are literal: no group references are expanded."""
    domain = f"pattern:{rule.name}"
    if rule.action == "redact":
        return F.lit(rule.label)
    if rule.action == "token":
        return F.concat(F.lit(rule.prefix or ""), keyed.token(domain, match))
    if rule.action == "mock":
        return mocks.mock(rule.shape, keyed.hex("mock", domain, match), match)
    return match


def _pair(rule: Rule, keyed: Keyed | None):
    """A match with its replacement, which is null if the validator rejects it."""
    return lambda m: F.struct(m.alias("o"), F.when(validators.accepts(rule.validator, m), replacement_of(rule, m, keyed)).alias("t"))


def scan(df: DataFrame, column: str, rules: tuple[Rule, ...], keyed: Keyed | None = None, mappings: bool = False) -> tuple[DataFrame, list[Scan]]:
    """The frame with the column rewritten by all rules, and count columns for each.

    Missing texts stay missing; empty ones match nothing. With ``mappings``, token and mock rules also leave an array of
    (original, replacement).
    """
    found: list[Scan] = []
    for i, rule in enumerate(rules):
        stem = f"{INTERNAL}{column}{INTERNAL}{i}"
        hits = f"{stem}m"
        text = F.col(f"`{column}`")
        reversible = mappings and rule.action in ("token", "mock")
        found.append(Scan(rule, column, f"{stem}n", f"{stem}r", f"{stem}k" if reversible else None))
        gate = detectors.GATES.get(rule.builtin) if rule.regex is None else None
        df = df.withColumn(hits, F.transform(matches_of(text, rule.source, gate), _pair(rule, keyed)))
        new = {f"{stem}n": F.size(F.filter(hits, lambda x: x["t"].isNotNull())), f"{stem}r": F.size(F.filter(hits, lambda x: x["t"].isNull()))}
        if rule.action != "detect":
            glue = F.concat(F.transform(hits, lambda x: F.coalesce(x["t"], x["o"])), F.array(F.lit("")))
            joined = F.array_join(F.zip_with(F.split(text, detectors.java(rule.source), -1), glue, lambda a, b: F.concat(a, b)), "")
            new[column] = F.when(F.size(hits) == 0, text).otherwise(joined)
        if reversible:
            new[f"{stem}k"] = F.filter(hits, lambda x: x["t"].isNotNull())
        df = df.withColumns(new).drop(hits)
    return df, found
