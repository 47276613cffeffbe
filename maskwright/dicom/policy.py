"""Policies for medical images: a profile, rules by tag, and structural rules for what neither names."""

from __future__ import annotations

from dataclasses import dataclass, field

from maskwright.dicom import profile
from maskwright.errors import PolicyError
from maskwright.plans.policy import GRANULARITIES, KeySource, Preset, Rule, _flag, _key, _number, _one_of, _strict, _text, check_rules, each, load_yaml, parse_preset, parse_rule

# Fixed values.
PROFILES = ("basic", "structural", "none")
ACTIONS = ("remove", "empty", "keep", "replace", "pseudonymize", "uid", "date_shift", "date_truncate", "clean_text")
MOCKS = ("person_name", "email", "phone")


@dataclass(frozen=True)
class Structural:
    private_tags: bool = True
    retain_safe_private: bool = False
    curves_and_overlays: bool = True
    person_names: bool = True
    uids: bool = True


@dataclass(frozen=True)
class DicomPolicy:
    dataset: str
    key: KeySource | None = None
    profile: str = "basic"
    rules: dict[str, dict] = field(default_factory=dict)  # explicit, by tag
    structural: Structural = Structural()
    structural_given: bool = False
    patterns: tuple[Rule, ...] = ()
    presets: tuple[Preset, ...] = ()

    def resolved(self) -> dict[str, dict]:
        """tag -> action: the profile's, then the policy's own."""
        return (profile.basic_rules() if self.profile == "basic" else {}) | self.rules

    @property
    def structural_on(self) -> bool:
        """``profile: none`` means no table; structural rules that are written out still count."""
        return self.profile != "none" or self.structural_given


_OPTIONS = {"replace": {"value"}, "pseudonymize": {"prefix", "domain", "mock"}, "uid": {"domain"}, "date_shift": {"max_days", "domain"}, "date_truncate": {"granularity"}}
_DEFAULTS = {"date_shift": {"max_days": profile.SHIFT_DAYS}, "date_truncate": {"granularity": "year"}, "replace": {"value": ""}}


def _rule(where, v) -> tuple[str, dict]:
    got = _strict(where, v, {"tag": _text, "action": _one_of(ACTIONS), "value": _text, "prefix": _text, "domain": _text, "mock": _one_of(MOCKS), "max_days": _number, "granularity": _one_of(GRANULARITIES)})
    if "tag" not in got or "action" not in got:
        raise PolicyError(f"{where}: tag and action are wanted")
    tag, action = profile.parse_tag(got.pop("tag")), got["action"]
    if extra := set(got) - {"action"} - _OPTIONS.get(action, set()):
        raise PolicyError(f"{where}: {extra.pop()} doesn't go with action {action}")
    if got.get("max_days", 1) < 1:
        raise PolicyError(f"{where}: max_days must be above 0")
    return tag, _DEFAULTS.get(action, {}) | got


def parse_dicom_policy(source: str | dict, spark=None) -> DicomPolicy:
    given = load_yaml(source) if isinstance(source, str) else source
    structural = lambda w, v: Structural(**_strict(w, v, {k: _flag for k in Structural.__dataclass_fields__}))
    got = _strict("policy", given, {"version": _number, "dataset": _text, "key": _key, "profile": _one_of(PROFILES), "tags": each(_rule), "structural": structural, "patterns": each(parse_rule), "presets": each(parse_preset)})
    if got.pop("version", None) != 1 or not got.get("dataset", "").strip():
        raise PolicyError("version 1 and a dataset are wanted")
    tags = got.pop("tags", ())
    if len({t for t, _ in tags}) < len(tags):
        raise PolicyError("a tag is listed more than once")
    policy = DicomPolicy(**got, rules=dict(tags), structural_given="structural" in given)
    check_rules(policy.patterns, policy.presets, spark)
    return policy


def is_private(tag: str) -> bool:
    group = int(tag[:4], 16)
    return group % 2 == 1 and tag[4:] != "0000" and group not in (1, 3, 5, 7, 0xFFFF)
