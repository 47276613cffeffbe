"""Secrets, dataset keys and keyed hashes.

Tokens are HMAC-SHA256 under a key that each dataset has of its own (HKDF-SHA256 of the secret). The hash is computed by
native expressions; the two padded keys come from a one-row relation by scalar subquery, so that no plan, event log or
user interface shows them.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.errors import SecretError

LEAST_BYTES, LEAST_DISTINCT, TOKEN_CHARS = 32, 12, 32
_PLAIN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=")


def resolve_secret(env: str | None, inline: str | None, allow_inline_fallback: bool) -> tuple[str, list[str]]:
    """(secret, warnings). The environment comes first; an unset or empty variable is an error unless a fallback is allowed."""
    if env:
        if value := os.environ.get(env):
            return value, strength(value)
        if inline and allow_inline_fallback:
            return inline, [f"variable {env} is unset or empty: the inline secret was used, and anyone who has the policy can reverse the tokens", *strength(inline)]
        hint = "; set key.allow_inline_fallback to permit the inline secret" if inline else ""
        raise SecretError(f"the secret variable {env} is unset or empty{hint}")
    if inline:
        return inline, ["the secret is written in the policy: use this for demonstrations only", *strength(inline)]
    raise SecretError("this job derives values from a secret, but the policy has no key source (key.env)")


def strength(secret: str) -> list[str]:
    """Warnings on a weak secret; a short one is an error."""
    raw = secret.encode()
    if len(raw) < LEAST_BYTES:
        raise SecretError(f"the secret has {len(raw)} bytes; {LEAST_BYTES} are the least")
    if not _PLAIN.issuperset(raw) or len(set(raw)) < LEAST_DISTINCT:
        return ["the secret doesn't look random: generate one, for instance with openssl rand -base64 32"]
    return []


def dataset_key(secret: str, dataset: str, purpose: str = "tokens") -> bytes:
    """HKDF-SHA256, one block: 32 bytes that depend on the secret, the dataset and the purpose."""
    extracted = hmac.new(b"maskwright/1", secret.encode(), hashlib.sha256).digest()
    return hmac.new(extracted, f"{purpose}\x1f{dataset}".encode() + b"\x01", hashlib.sha256).digest()


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer padded key of HMAC-SHA256."""
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


#: Columns of the padded keys.
HIDDEN = ("§inner", "§outer")


def secret_cells(spark: SparkSession, *values: bytes) -> list[Column]:
    """Binary constants that no plan shows."""
    row = spark.createDataFrame([tuple(map(bytearray, values))], ", ".join(f"c{i} binary" for i in range(len(values))))
    return [row.select(f"c{i}").scalar() for i in range(len(values))]


@dataclass(frozen=True)
class Keyed:
    """HMAC under one key as column expressions."""

    inner: Column
    outer: Column

    @staticmethod
    def on(df: DataFrame, key: bytes) -> tuple[DataFrame, Keyed]:
        """The frame with the padded keys as columns, and expressions on them. Select what you want afterwards."""
        cells = secret_cells(df.sparkSession, *pads(key))
        return df.withColumns(dict(zip(HIDDEN, cells))), Keyed(F.col(HIDDEN[0]), F.col(HIDDEN[1]))

    def hex(self, label: str, domain: str, value: Column) -> Column:
        """HMAC of a labelled, length-prefixed domain and a text, as 64 lower-case hex digits."""
        message = F.concat(self.inner, F.lit(bytearray(prefix(label, domain))), value.cast("binary"))
        return F.sha2(F.concat(self.outer, F.unhex(F.sha2(message, 256))), 256)

    def token(self, domain: str, value: Column) -> Column:
        return F.substring(self.hex("token", domain, value), 1, TOKEN_CHARS)


def prefix(label: str, domain: str) -> bytes:
    """What precedes the value in a keyed message; the length makes every (label, domain) prefix-free."""
    raw = domain.encode()
    return f"{label}\x1f{len(raw)}:".encode() + raw + b"\x1f"


def hex_of(key: bytes, label: str, domain: str, value: str) -> str:
    """The same on the driver or in a Python worker."""
    return hmac.new(key, prefix(label, domain) + value.encode(), hashlib.sha256).hexdigest()
