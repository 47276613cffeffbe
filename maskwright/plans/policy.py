"""Policies: what each column of a dataset is, and what a job does with it. Unknown keys are errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from maskwright.errors import PolicyError
from maskwright.functions import detectors, mocks, validators

# The words of a policy.
MODES = ("pseudonymize", "anonymize")
CLASSES = ("direct_identifier", "quasi_identifier", "sensitive", "utility")
UNLISTED = ("error", "keep", "remove")
STRATEGIES = ("remove", "redact", "bucket", "date_truncate", "keep_prefix")
GRANULARITIES = ("year", "year_month")
ACTIONS = ("detect", "redact", "token", "mock")
PRESETS = ("precise", "moderate", "heuristic", "all")


@dataclass(frozen=True)
class KeySource:
    env: str | None = None
    inline: str | None = None
    allow_inline_fallback: bool = False


@dataclass(frozen=True)
class Anonymize:
    strategy: str
    replacement: str = "REDACTED"
    width: int = 0
    granularity: str = "year"
    chars: int = 0
    pad: str = "*"


@dataclass(frozen=True)
class Field:
    name: str
    field_class: str
    prefix: str | None = None
    domain: str | None = None
    anonymize: Anonymize | None = None


@dataclass(frozen=True)
class Rule:
    """A content rule. ``preset`` marks one that a preset expanded to."""

    name: str
    action: str
    regex: str | None = None
    builtin: str | None = None
    fields: tuple[str, ...] | None = None
    replacement: str | None = None
    prefix: str | None = None
    mock: str | None = None
    validate: str | None = None
    preset: str | None = None

    @property
    def source(self) -> str:
        return self.regex if self.regex is not None else detectors.PATTERNS[self.builtin]

    @property
    def validator(self) -> str:
        return self.validate or (detectors.CATALOGUE[self.builtin].validator if self.builtin else "none")

    @property
    def shape(self) -> str | None:
        return self.mock or (self.builtin if self.builtin in detectors.MOCKABLE else None)

    @property
    def precision(self) -> str | None:
        return detectors.CATALOGUE[self.builtin].precision if self.builtin else None

    @property
    def label(self) -> str:
        return self.replacement if self.replacement is not None else f"[{self.name.upper()}]"


@dataclass(frozen=True)
class Preset:
    preset: str
    action: str
    fields: tuple[str, ...] | None = None
    replacement: str | None = None


@dataclass(frozen=True)
class Policy:
    dataset: str
    version: int = 1
    key: KeySource | None = None
    on_unlisted: str = "error"
    fields: tuple[Field, ...] = ()
    patterns: tuple[Rule, ...] = ()
    presets: tuple[Preset, ...] = ()
    source: dict = field(default_factory=dict, compare=False, repr=False)

    def rules(self) -> tuple[Rule, ...]:
        """Rules in execution order: presets' first, by the catalogue, then explicit ones. A name given explicitly, or by
        an earlier preset, isn't expanded again."""
        taken, out = {r.name for r in self.patterns}, []
        for p in self.presets:
            for name in detectors.preset_names(p.preset):
                if name not in taken:
                    taken.add(name)
                    out.append(Rule(name, p.action, builtin=name, fields=p.fields, replacement=p.replacement, preset=p.preset))
        order = list(detectors.CATALOGUE)
        return (*sorted(out, key=lambda r: order.index(r.builtin)), *self.patterns)

    def needs_key(self, mode: str) -> bool:
        return mode == "pseudonymize" or any(r.action in ("token", "mock") for r in self.rules())

    def with_overrides(self, dataset: str | None = None, key: KeySource | None = None) -> Policy:
        return replace(self, dataset=dataset or self.dataset, key=key or self.key)


def _strict(where: str, given, allowed: dict[str, Callable]) -> dict:
    if not isinstance(given, dict):
        raise PolicyError(f"{where}: a mapping is wanted")
    if unknown := [k for k in given if k not in allowed]:
        raise PolicyError(f"{where}: unknown key {unknown[0]!r}")
    return {k: allowed[k](f"{where}.{k}", v) for k, v in given.items() if v is not None}


def _kind(kind, what: str):
    def check(where, v):
        if not isinstance(v, kind) or isinstance(v, bool) and kind is not bool:
            raise PolicyError(f"{where}: {what} is wanted")
        return v

    return check


_text, _number, _flag = _kind(str, "a text"), _kind(int, "a whole number"), _kind(bool, "true or false")


def _one_of(words: tuple[str, ...]):
    def check(where, v):
        if v not in words:
            raise PolicyError(f"{where}: {v!r} isn't one of {', '.join(words)}")
        return v

    return check


def _names(where, v) -> tuple[str, ...]:
    if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
        raise PolicyError(f"{where}: a list of texts is wanted")
    return tuple(v)


def _key(where, v) -> KeySource:
    return KeySource(**_strict(where, v, {"env": _text, "inline": _text, "allow_inline_fallback": _flag}))


_OPTIONS = {"remove": (), "redact": ("replacement",), "bucket": ("width",), "date_truncate": ("granularity",), "keep_prefix": ("chars", "pad")}
_REQUIRED = {"bucket": "width", "date_truncate": "granularity", "keep_prefix": "chars"}


def _anonymize(where, v) -> Anonymize:
    got = _strict(where, v, {"strategy": _one_of(STRATEGIES), "replacement": _text, "width": _number, "granularity": _one_of(GRANULARITIES), "chars": _number, "pad": _text})
    strategy = got.get("strategy")
    if not strategy:
        raise PolicyError(f"{where}: strategy is missing")
    if extra := [k for k in got if k != "strategy" and k not in _OPTIONS[strategy]]:
        raise PolicyError(f"{where}: unknown key {extra[0]!r}")
    if _REQUIRED.get(strategy, "strategy") not in got:
        raise PolicyError(f"{where}: {_REQUIRED[strategy]} is missing")
    if got.get("chars", 0) < 0 or len(got.get("pad", "*")) != 1:
        raise PolicyError(f"{where}: chars must not be negative, and pad must be one character")
    return Anonymize(**got)


def _field(where, v) -> Field:
    options = lambda w, x: _strict(w, x, {"prefix": _text, "domain": _text})
    got = _strict(where, v, {"name": _text, "class": _one_of(CLASSES), "pseudonymize": options, "anonymize": _anonymize})
    if "name" not in got or "class" not in got:
        raise PolicyError(f"{where}: name and class are wanted")
    return Field(got["name"], got["class"], anonymize=got.get("anonymize"), **got.get("pseudonymize", {}))


def parse_rule(where, v) -> Rule:
    got = _strict(where, v, {"name": _text, "regex": _text, "builtin": _one_of(tuple(detectors.CATALOGUE)), "fields": _names, "action": _one_of(ACTIONS), "replacement": _text, "prefix": _text, "mock": _one_of(mocks.SHAPES), "validate": _one_of(validators.NAMES)})
    if "name" not in got or "action" not in got:
        raise PolicyError(f"{where}: name and action are wanted")
    return Rule(**got)


def parse_preset(where, v) -> Preset:
    got = _strict(where, v, {"preset": _one_of(PRESETS), "action": _one_of(ACTIONS), "fields": _names, "replacement": _text})
    if "preset" not in got or "action" not in got:
        raise PolicyError(f"{where}: preset and action are wanted")
    return Preset(**got)


def each(of):
    def check(where, v):
        if not isinstance(v, list):
            raise PolicyError(f"{where}: a list is wanted")
        return tuple(of(f"{where}[{i}]", x) for i, x in enumerate(v))

    return check


def load_yaml(text: str) -> dict:
    """A mapping from YAML (or JSON, which is YAML)."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    try:
        got = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise PolicyError(f"not YAML: {e}") from e
    if not isinstance(got, dict):
        raise PolicyError("a mapping is wanted")
    return got


def parse_policy(source: str | dict, spark: SparkSession | None = None) -> Policy:
    """A checked policy from YAML text or a mapping. With a session, expressions are compiled as the JVM will."""
    given = load_yaml(source) if isinstance(source, str) else source
    got = _strict("policy", given, {"version": _number, "dataset": _text, "key": _key, "on_unlisted": _one_of(UNLISTED), "fields": each(_field), "patterns": each(parse_rule), "presets": each(parse_preset)})
    for needed in ("version", "dataset", "fields"):
        if needed not in got:
            raise PolicyError(f"policy: {needed} is missing")
    policy = Policy(**got, source=given)
    validate(policy, spark)
    return policy


def _twice(names: list[str], what: str) -> None:
    for i, n in enumerate(names):
        if n in names[:i]:
            raise PolicyError(f"{what} {n!r} is listed more than once")


def check_rules(patterns: tuple[Rule, ...], presets: tuple[Preset, ...], spark: SparkSession | None) -> None:
    _twice([r.name for r in patterns], "pattern")
    for r in patterns:
        if (r.regex is None) == (r.builtin is None):
            raise PolicyError(f"pattern {r.name!r}: one of regex and builtin is wanted")
        for option, action in (("replacement", "redact"), ("prefix", "token"), ("mock", "mock")):
            if getattr(r, option) is not None and r.action != action:
                raise PolicyError(f"pattern {r.name!r}: {option} goes with action {action} only")
        if r.action == "mock" and r.shape is None:
            raise PolicyError(f"pattern {r.name!r}: action mock needs a shape; set mock, or use a builtin that has one")
        if spark is not None:
            _compiles(r, spark)
    for p in presets:
        if p.replacement is not None and p.action != "redact":
            raise PolicyError("preset: replacement goes with action redact only")
        if p.action == "mock":
            raise PolicyError("preset: action mock isn't possible, as most detectors have no mock shape")


def _compiles(rule: Rule, spark: SparkSession) -> None:
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        compiled = spark._jvm.java.util.regex.Pattern.compile(detectors.java(rule.source))
    except (Py4JJavaError, PySparkException) as e:
        raise PolicyError(f"pattern {rule.name!r}: not a regular expression: {' '.join(str(e).split())[:200]}") from e
    if compiled.matcher("").find():
        raise PolicyError(f"pattern {rule.name!r}: the expression matches the empty text")


def validate(policy: Policy, spark: SparkSession | None = None) -> None:
    if policy.version != 1:
        raise PolicyError(f"version {policy.version} isn't supported; 1 is")
    if not policy.dataset.strip():
        raise PolicyError("the dataset has no name")
    _twice([f.name for f in policy.fields], "field")
    for f in policy.fields:
        if f.anonymize and f.anonymize.strategy == "bucket" and f.anonymize.width <= 0:
            raise PolicyError(f"field {f.name!r}: the width must be above 0")
    check_rules(policy.patterns, policy.presets, spark)
