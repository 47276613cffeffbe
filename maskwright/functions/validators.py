"""Validators as native column expressions: each takes the matched text and gives a non-null boolean."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LABELS = {
    "none": "none",
    "luhn": "the Luhn check digit",
    "card_brand": "card length, issuer and Luhn check digit",
    "iban_mod97": "the mod-97 check",
    "ssn_us": "the rules for issued numbers",
    "ip_address": "address parsing",
    "calendar_date": "the calendar",
    "email_syntax": "e-mail syntax",
    "url_syntax": "URL syntax",
    "phone_e164": "the limits of E.164",
    "mac_address": "hardware address parsing",
    "bic_structure": "structure and country of ISO 9362",
}
NAMES = tuple(LABELS)

# Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
#: Codes in use beside those of ISO 3166.
MORE_COUNTRIES = ("XK",)


@lru_cache(1)
def countries() -> tuple[str, ...]:
    """ISO 3166 two-letter codes as the JVM has them, and MORE_COUNTRIES."""
    jvm = SparkSession.active()._jvm
    return (*jvm.java.util.Locale.getISOCountries(), *MORE_COUNTRIES)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def luhn(x: Column) -> Column:
    d = digits(x)
    return _sure((F.length(d) >= 2) & F.call_function("luhn_check", d))


def card_brand(x: Column) -> Column:
    d = digits(x)
    return _sure(d.rlike("^[2-6][0-9]{12,18}$") & ~d.rlike("^(.)\\1*$") & F.call_function("luhn_check", d))


def mod97(text: Column) -> Column:
    """Remainder by 97 of a text of digits and letters (A = 10 .. Z = 35); null if it holds anything else."""
    plain = F.upper(text)
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + value(c)) % 97).otherwise((r * 100 + value(c)) % 97)
    rest = F.aggregate(F.filter(F.split(plain, ""), lambda c: c != ""), F.lit(0), step)
    return F.when(plain.rlike("^[0-9A-Z]*$"), rest)


def iban_mod97(x: Column) -> Column:
    compact = F.regexp_replace(x, "(?U)\\s", "")
    return _sure((F.length(compact) >= 5) & compact.rlike("^[0-9A-Za-z]+$") & (mod97(F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))) == 1))


def ssn_us(x: Column) -> Column:
    return _sure(digits(x).rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"))


_V4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}"


def ip_address(x: Column) -> Column:
    """IPv4 without leading zeros, or IPv6 with at most one ::, which stands for at least one group."""
    six = F.regexp_replace(x, ":" + _V4 + "$", ":0:0")
    groups = F.size(F.filter(F.split(six, ":"), lambda g: g != ""))
    side = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
    return _sure(x.rlike("^" + _V4 + "$") | six.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$") | (six.rlike(f"^{side}::{side}$") & (groups <= 7)))


def _day_ok(year: Column, month: Column, day: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.element_at(F.array(*map(F.lit, DAYS)), month.cast("int")) + F.when((month == 2) & leap, 1).otherwise(0)
    return F.when(month.between(1, 12), day.between(1, last)).otherwise(False)


def calendar_date(x: Column) -> Column:
    """A real date: year first if the first number is above 31, else day and month in either order."""
    low = F.lower(x)
    n = F.filter(F.transform(F.filter(F.split(low, "[^0-9]+"), lambda t: t != ""), lambda t: t.try_cast("bigint")), lambda v: v.isNotNull())
    at = lambda i: F.get(n, F.lit(i))
    month = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(MONTHS, 1))):
        month = F.when(low.contains(name), i).otherwise(month)
    named = (F.size(n) == 2) & F.when(at(0) > 31, _day_ok(at(0), month, at(1))).otherwise(_day_ok(at(1), month, at(0)))
    plain = (F.size(n) == 3) & F.when(at(0) > 31, _day_ok(at(0), at(1), at(2))).otherwise(_day_ok(at(2), at(1), at(0)) | _day_ok(at(2), at(0), at(1)))
    return _sure(F.when(month.isNotNull(), named).otherwise(plain))


def email_syntax(x: Column) -> Column:
    local, domain = F.substring_index(x, "@", 1), F.substr(x, F.length(F.substring_index(x, "@", 1)) + 2)
    fits = (F.octet_length(x) <= 254) & F.octet_length(local).between(1, 64) & (F.octet_length(domain) <= 255)
    return _sure(fits & ~local.rlike(r"^\.|\.$|\.\.") & domain.rlike(r"^[^@.]+(?:\.[^@.]+)*\.[A-Za-z]{2,}$"))


def url_syntax(x: Column) -> Column:
    rest = F.regexp_extract(x, r"(?s)^(?:https?://|ftps?://|(?=www\.))(.*)$", 1)
    host = F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), r"^(?:www\.)+", "")
    host = F.regexp_extract(F.regexp_extract(host, "([^@]*)$", 1), "^([^:]*)", 1)
    named = host.rlike(r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")
    return _sure(x.rlike(r"^(?:https?://|ftps?://|www\.)") & ~x.rlike(r"(?U)\s") & ((host == "localhost") | host.rlike("^" + _V4 + "$") | named))


def phone_e164(x: Column) -> Column:
    d = digits(x)
    return _sure(F.length(d).between(7, 15) & ~(F.ltrim(x).startswith("+") & d.startswith("0")))


def mac_address(x: Column) -> Column:
    h = F.lower(F.regexp_replace(x, "[^0-9A-Fa-f]", ""))
    return _sure((F.length(h) == 12) & ~h.rlike("^(.)\\1*$"))


def bic_structure(x: Column) -> Column:
    return _sure(F.length(x).isin(8, 11) & F.substring(x, 5, 2).isin(*countries()) & ~F.substring(x, 7, 1).isin("0", "1") & (F.substring(x, 8, 1) != "O"))


def none(x: Column) -> Column:
    return F.lit(True)


def accepts(name: str, x: Column) -> Column:
    """The validator of this name on a matched text."""
    return globals()[name](x) if name in LABELS else F.raise_error(F.lit(f"no validator {name}"))
