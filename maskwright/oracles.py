"""DuckDB SQL of validators and cascades, for the comparison of registered queries. Written from the rules, not from the
column expressions: each function takes an SQL expression of the matched text and gives one of a boolean."""

from __future__ import annotations

from maskwright.functions import detectors
from maskwright.functions.validators import DAYS, MONTHS, MORE_COUNTRIES

_V4 = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"


def regex(name: str) -> str:
    """A detector's expression as an SQL text. DuckDB's classes are ASCII: see ``folded``."""
    return detectors.PATTERNS[name].replace("'", "''")


def folded(text: str, upper: str = "_", lower: str = "_") -> str:
    """The text with the letters of Latin-1 as word characters of ASCII, so that word boundaries fall where Unicode's do."""
    return f"regexp_replace(regexp_replace(coalesce({text}, ''), '[À-ÖØ-Þ]', '{upper}', 'g'), '[ß-öø-ÿ]', '{lower}', 'g')"


def _spelt(text: str, back: bool = False) -> str:
    """The text with each letter of Latin-1 as its number between low lines, and back."""
    for i in (i for i in range(0xC0, 0x100) if chr(i).isalpha()):
        text = f"replace({text}, '_{i}_', '{chr(i)}')" if back else f"replace({text}, '{chr(i)}', '_{i}_')"
    return text


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '', 'g')"


def _luhn(d: str) -> str:
    doubled = f"2 * substr({d}, i, 1)::INT"
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN (CASE WHEN {doubled} > 9 THEN {doubled} - 9 ELSE {doubled} END) ELSE substr({d}, i, 1)::INT END)) % 10 = 0)"


def luhn(m: str) -> str:
    d = _digits(m)
    return f"(length({d}) >= 2 AND {_luhn(d)})"


def credit_card(m: str) -> str:
    d = _digits(m)
    return f"(regexp_full_match({d}, '[2-6][0-9]{{12,18}}') AND len(list_distinct(string_split({d}, ''))) > 1 AND {_luhn(d)})"


def iban(m: str) -> str:
    c = f"upper(regexp_replace({m}, '\\s', '', 'g'))"
    values = f"list_transform(string_split(substr({c}, 5) || substr({c}, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) - 55 END)"
    return f"(regexp_full_match({c}, '[0-9A-Z]{{5,}}') AND list_reduce(list_prepend(0, {values}), lambda r, v: (r * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1)"


def bic(m: str) -> str | None:
    """None where Python knows no list of countries."""
    try:
        from pytz import country_names
    except ImportError:
        return None
    known = ", ".join(f"'{c}'" for c in sorted({*country_names, *MORE_COUNTRIES}))
    return f"(length({m}) IN (8, 11) AND substr({m}, 5, 2) IN ({known}) AND substr({m}, 7, 1) NOT IN ('0', '1') AND substr({m}, 8, 1) <> 'O')"


def ip_address(m: str) -> str:
    six = f"regexp_replace({m}, ':{_V4}$', ':0:0')"
    side = "([0-9A-Fa-f]{1,4}(:[0-9A-Fa-f]{1,4})*)?"
    groups = f"len(list_filter(string_split({six}, ':'), lambda g: g <> ''))"
    return f"(regexp_full_match({m}, '{_V4}') OR regexp_full_match({six}, '([0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}') OR (regexp_full_match({six}, '{side}::{side}') AND {groups} <= 7))"


def mac_address(m: str) -> str:
    h = f"lower(regexp_replace({m}, '[^0-9A-Fa-f]', '', 'g'))"
    return f"(length({h}) = 12 AND len(list_distinct(string_split({h}, ''))) > 1)"


def url(m: str) -> str:
    rest = f"regexp_extract({m}, '^(?:https?://|ftps?://)?([^/?#]*)', 1)"
    host = f"regexp_extract(regexp_extract(regexp_replace({rest}, '^(?:www\\.)+', ''), '([^@]*)$', 1), '^([^:]*)', 1)"
    return f"(regexp_matches({m}, '^(https?://|ftps?://|www\\.)') AND NOT regexp_matches({m}, '\\s') AND ({host} = 'localhost' OR regexp_full_match({host}, '{_V4}') OR regexp_full_match({host}, '[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')))"


def ssn(m: str) -> str:
    d = _digits(m)
    return f"(length({d}) = 9 AND substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6, 4) <> '0000')"


def date_of_birth(m: str) -> str:
    n = f"list_transform(regexp_extract_all({m}, '[0-9]+'), lambda x: x::HUGEINT)"
    month = "CASE " + " ".join(f"WHEN contains(lower({m}), '{name}') THEN {i}" for i, name in enumerate(MONTHS, 1)) + " END"
    last = f"[{', '.join(map(str, DAYS))}]"

    def day(y: str, mo: str, d: str) -> str:
        leap = f"(({y}) % 4 = 0 AND ({y}) % 100 <> 0 OR ({y}) % 400 = 0)"
        return f"(({mo}) BETWEEN 1 AND 12 AND ({d}) BETWEEN 1 AND ({last})[({mo})::INT] + CASE WHEN ({mo}) = 2 AND {leap} THEN 1 ELSE 0 END)"

    a, b, c = (f"({n})[{i}]" for i in (1, 2, 3))
    named = f"len({n}) = 2 AND CASE WHEN {a} > 31 THEN {day(a, month, b)} ELSE {day(b, month, a)} END"
    plain = f"len({n}) = 3 AND CASE WHEN {a} > 31 THEN {day(a, b, c)} ELSE {day(c, b, a)} OR {day(c, a, b)} END"
    return f"coalesce(CASE WHEN ({month}) IS NOT NULL THEN {named} ELSE {plain} END, false)"


def email(m: str) -> str:
    local, domain = f"split_part({m}, '@', 1)", f"split_part({m}, '@', 2)"
    return f"(strlen({m}) <= 254 AND strlen({local}) BETWEEN 1 AND 64 AND strlen({domain}) <= 255 AND NOT regexp_matches({local}, '^\\.|\\.$|\\.\\.') AND regexp_full_match({domain}, '[^@.]+(\\.[^@.]+)*\\.[A-Za-z]{{2,}}'))"


def phone(m: str) -> str:
    d = _digits(m)
    return f"(length({d}) BETWEEN 7 AND 15 AND NOT (starts_with(ltrim({m}), '+') AND starts_with({d}, '0')))"


_RULES = {f.__name__: f for f in (email, iban, bic, credit_card, ip_address, mac_address, url, ssn, date_of_birth, phone)}


def accepts(name: str, m: str) -> str | None:
    """Whether the detector's own validator accepts a match; None if SQL can't say."""
    return _RULES[name](m) if name in _RULES else "true"


def counts(name: str, table: str, key: str, text: str = "text") -> str | None:
    """Accepted matches of a detector in each row."""
    ok = accepts(name, "m")
    plain = folded(text, "X", "x") if "\\p{L" in detectors.PATTERNS[name] else folded(text)
    return ok and f"SELECT {key}, cast(len(list_filter(regexp_extract_all({plain}, '{regex(name)}'), lambda m: {ok})) AS BIGINT) AS matches FROM {table}"


def report(names: tuple[str, ...], table: str) -> str:
    """Matches, rejected matches and rows with matches of each detector."""

    def one(name: str) -> str:
        found = f"regexp_extract_all({folded('text')}, '{regex(name)}')"
        return f"""SELECT '{name}' AS rule, cast(sum(ok) AS BIGINT) AS matches, cast(sum(n - ok) AS BIGINT) AS rejected, count(*) FILTER (ok > 0) AS docs
            FROM (SELECT len(found) AS n, len(list_filter(found, lambda m: {accepts(name, 'm')})) AS ok FROM (SELECT {found} AS found FROM {table}))"""

    return " UNION ALL ".join(map(one, names))


def cascade(rules: list[tuple[str, str]], table: str, key: str) -> str | None:
    """(key, text) after rules (detector, label), each over what the one before has left. The pieces of a text between its
    matches are glued with the labels, or the matches that are rejected."""
    steps = [f"t0 AS (SELECT {key}, {_spelt('text')} AS text FROM {table})"]
    for i, (name, label) in enumerate(rules):
        ok = accepts(name, "m")
        if ok is None:
            return None
        glue = f"list_transform(hits, lambda m: CASE WHEN {ok} THEN '{label}' ELSE m END)"
        found = f"SELECT {key}, text, regexp_split_to_array(text, '{regex(name)}') AS parts, regexp_extract_all(text, '{regex(name)}') AS hits FROM t{i}"
        joined = "array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(glue[i], '')), '')"
        steps.append(f"g{i + 1} AS (SELECT {key}, text, parts, len(hits) AS n, {glue} AS glue FROM ({found}))")
        steps.append(f"t{i + 1} AS (SELECT {key}, CASE WHEN n > 0 THEN {joined} ELSE text END AS text FROM g{i + 1})")
    return f"WITH {', '.join(steps)} SELECT {key}, {_spelt('text', True)} AS text FROM t{len(rules)}"
