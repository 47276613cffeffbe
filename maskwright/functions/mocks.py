"""Mock values: a keyed, deterministic value of the same shape that passes structural checks. Native expressions.

``hexed`` is the 64 hex digits of the keyed hash of the original (label ``mock``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.transforms import bound
from maskwright.functions.validators import digits as only_digits
from maskwright.functions.validators import mod97

SHAPES = ("iban", "email", "phone", "credit_card", "mac_address")
#: Fixed values.
MAIL_DOMAIN, LEAST_IBAN, FALLBACK_COUNTRY = "@example.com", 15, "DE"


def _byte(hexed: Column, i: Column) -> Column:
    return F.conv(F.substr(hexed, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")


def digit_array(hexed: Column, count: Column) -> Column:
    """``count`` decimal digits from the 32 bytes; a further round through them adds 1. The hash is computed once."""
    one = lambda h: lambda i: ((_byte(h, i) + (i / 32).cast("int")) % 256) % 10
    made = bound(hexed, lambda h: F.transform(F.sequence(F.lit(0), count - 1), one(h)))
    return F.when(count > 0, made).otherwise(F.array().cast("array<int>"))


def _stitched(original: Column, fresh: Column) -> Column:
    """The original with its digits replaced by those of the array, in turn: the pieces between digits, each with the next."""
    return F.array_join(F.zip_with(F.split(original, "[0-9]", -1), fresh, lambda piece, d: F.concat(piece, F.coalesce(d.cast("string"), F.lit("")))), "")


def phone(hexed: Column, original: Column) -> Column:
    """Punctuation and number of digits stay; the first digit isn't 0."""
    fresh = digit_array(hexed, F.length(only_digits(original)))
    return _stitched(original, F.transform(fresh, lambda d, i: F.when(i == 0, F.greatest(d, F.lit(1))).otherwise(d)))


def credit_card(hexed: Column, original: Column) -> Column:
    """Separators and length stay; begins with 999 and ends in a Luhn digit. A lone digit stays as it is."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    weighed = lambda body: F.transform(F.reverse(body), lambda d, i: F.when(i % 2 == 0, doubled(d)).otherwise(d))
    check = lambda body: (10 - F.aggregate(weighed(body), F.lit(0), lambda a, d: a + d) % 10) % 10
    body = lambda n: F.transform(digit_array(hexed, n - 1), lambda d, i: F.when(i < 3, 9).otherwise(d))
    made = lambda n: bound(body(n), lambda b: _stitched(original, F.concat(b, F.array(check(b)))))
    return bound(F.length(only_digits(original)), lambda n: F.when(n < 2, original).otherwise(made(n)))


def iban(hexed: Column, original: Column) -> Column:
    """Without spaces: upper-case country and length stay, digits with right check digits follow."""
    compact = F.regexp_replace(original, "(?U)\\s", "")
    country = F.when(compact.rlike("^[A-Z]{2}"), F.substring(compact, 1, 2)).otherwise(FALLBACK_COUNTRY)
    body = F.array_join(digit_array(hexed, F.greatest(F.length(compact), F.lit(LEAST_IBAN)) - 4).cast("array<string>"), "")
    made = lambda c, b: F.concat(c, F.lpad((98 - mod97(F.concat(b, c, F.lit("00")))).cast("string"), 2, "0"), b)
    return bound(country, lambda c: bound(body, lambda b: made(c, b)))


def email(hexed: Column, original: Column) -> Column:
    """Ten letters in a domain reserved for examples."""
    letters = bound(hexed, lambda h: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.char(97 + _byte(h, i) % 26)))
    return F.concat(F.array_join(letters, ""), F.lit(MAIL_DOMAIN))


def mac_address(hexed: Column, original: Column) -> Column:
    """A locally administered unicast address in the original's separators and letter case."""
    first = lambda h: _byte(h, F.lit(0)).bitwiseAND(0xFE).bitwiseOR(0x02)
    raw = bound(hexed, lambda h: F.lower(F.concat(F.lpad(F.hex(first(h).cast("long")), 2, "0"), F.substring(h, 3, 10))))
    part = lambda c, at, n: F.substring(c, at, n)
    pairs = lambda c, s: F.concat_ws(s, *[part(c, i, 2) for i in range(1, 12, 2)])
    dotted = lambda c: F.concat_ws(".", part(c, 1, 4), part(c, 5, 4), part(c, 9, 4))
    shaped = lambda c: F.when(original.contains("."), dotted(c)).when(original.contains("-"), pairs(c, "-")).otherwise(pairs(c, ":"))
    return bound(bound(raw, lambda r: F.when(original.rlike("[a-z]"), r).otherwise(F.upper(r))), shaped)


def mock(shape: str, hexed: Column, original: Column) -> Column:
    return {"iban": iban, "email": email, "phone": phone, "credit_card": credit_card, "mac_address": mac_address}[shape](hexed, original)
