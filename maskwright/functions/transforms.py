"""Column transforms of anonymization. Missing and empty values pass through; values that don't fit become ``*``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPRESSED = "*"
_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _or_suppressed(text: Column, value: Column) -> Column:
    return F.when(text.isNull() | (text == ""), text).otherwise(F.coalesce(value, F.lit(SUPPRESSED)))


def redact(text: Column, replacement: str = "REDACTED") -> Column:
    return F.when(text.isNull() | (text == ""), text).otherwise(F.lit(replacement))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def whole_number(text: Column) -> Column:
    """BIGINT of a text: whole numbers as they are, others floored; null if it is none or doesn't fit."""

    def parsed(t: Column) -> Column:
        whole = F.when(t.rlike("^[+-]?[0-9]+$"), t.try_cast("bigint"))
        return F.coalesce(whole, bound(F.when(t.rlike(_NUMBER), t.try_cast("double")), _floored))

    return bound(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), parsed)


def _floored(real: Column) -> Column:
    return F.when((real >= F.lit(-9223372036854775808.0)) & (real < F.lit(9223372036854775808.0)), F.floor(real))


def _bucket(n: Column, width: int) -> Column:
    w = F.lit(width).cast("bigint")
    label = lambda low: F.concat(low.cast("string"), F.lit("-"), F.try_add(low, w - 1).cast("string"))
    return bound(n, lambda n: bound(F.try_subtract(n, F.pmod(n, w)), label))


def bucket(text: Column, width: int) -> Column:
    """``lo-hi`` of the bucket of this width; overflow is suppressed."""
    return _or_suppressed(text, _bucket(whole_number(text), width))


def bucket_number(number: Column, kind: T.DataType, width: int) -> Column:
    """The bucket of a column that is a number: as ``bucket`` of its text, without the text."""
    n = number.cast("bigint") if isinstance(kind, T.IntegralType) else bound(number.cast("double"), lambda x: F.when(~F.isnan(x), _floored(x)))
    return F.when(number.isNotNull(), F.coalesce(_bucket(n, width), F.lit(SUPPRESSED)))


def date_truncate(text: Column, granularity: str) -> Column:
    """``year`` or ``year_month`` of a text that begins like an ISO date."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    year = F.regexp_extract(t, r"^([0-9]{4})(?:$|[-/.])", 1)
    month = F.when(year != "", F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2})", 1))
    value = year if granularity == "year" else month
    return _or_suppressed(text, F.when(value != "", value))


def keep_prefix(text: Column, chars: int, pad: str = "*") -> Column:
    """The first ``chars`` characters, the others as ``pad``. Not trimmed."""
    hidden = F.greatest(F.length(text) - chars, F.lit(0))
    return F.concat(F.substring(text, 1, chars), F.call_function("repeat", F.lit(pad), hidden))
