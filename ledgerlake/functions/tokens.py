"""Typed pseudonyms: a value's token is a keyed digest of its class and normal form, computed by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The signs of a token's tail, classes whose values are digits alone, quotes that fold.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
DIGIT_CLASSES = frozenset({"inn", "kpp", "ogrn", "acc", "corr", "bic", "snils", "sfr", "card", "phone", "doc"})
QUOTES, FOLDED = "«»“”„ёЁ", '"""""еЕ'
TOKEN = r"\[\[([a-z][a-z0-9_:]{0,31}):([0-9A-Z]{1,16})\]\]"


def normalize(kind: str, x: Column) -> Column:
    """The form in which equal values of a class are equal strings."""
    if kind in DIGIT_CLASSES:
        return F.regexp_replace(x, "[^0-9]", "")
    if kind == "email":
        return F.lower(F.trim(x))
    if kind == "iban":
        return F.upper(F.regexp_replace(x, r"\s", ""))
    if kind == "dob":
        return F.substring(F.trim(x), 1, 10)
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return flat if kind == "addr" else F.lower(F.translate(flat, QUOTES, FOLDED))


def pads(secret: bytes) -> tuple[str, str]:
    """Inner and outer key blocks of HMAC-SHA256 in hex."""
    if len(secret) > 64:
        raise ValueError("a secret has 64 bytes at most")
    block = secret.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def keyed_digest(message: Column, secret: bytes) -> Column:
    """HMAC-SHA256 in lower-case hex."""
    inner, outer = pads(secret)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def tail(digest: Column, signs: int = 10) -> Column:
    """The low 5 * signs bits of a digest, for up to ten signs a chunk."""
    if signs > 10:  # eighty bits in two chunks of forty
        return F.concat(_signs(F.substring(digest, 45, 10), 8), _signs(F.substring(digest, 55, 10), 8))
    return _signs(F.substring(digest, 52, 13), signs)


def _signs(hexed: Column, signs: int) -> Column:
    """The low 5 * signs bits of a hexadecimal number. Its digits of base 32 are renamed, so the digest behind it is used, and worked out, once."""
    return F.translate(F.substring(F.lpad(F.conv(hexed, 16, 32), 16, "0"), -signs, signs), "ABCDEFGHIJKLMNOPQRSTUV", ALPHABET[10:])


def token(kind: str, x: Column, secret: bytes, signs: int = 10) -> Column:
    """[[kind:tail]]; a null stays null."""
    message = F.concat(F.lit(kind).cast("binary"), F.lit(b"\0"), normalize(kind, x).cast("binary"))
    return F.concat(F.lit(f"[[{kind}:"), tail(keyed_digest(message, secret), signs), F.lit("]]"))


def token_of(kind: Column, x: Column, secret: bytes, signs: int = 10) -> Column:
    """The token of a value whose class is a column."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    normal = (
        F.when(kind.isin(*sorted(DIGIT_CLASSES)), F.regexp_replace(x, "[^0-9]", ""))
        .when(kind == "email", F.lower(F.trim(x)))
        .when(kind == "iban", F.upper(F.regexp_replace(x, r"\s", "")))
        .when(kind == "dob", F.substring(F.trim(x), 1, 10))
        .when(kind == "addr", flat)
        .otherwise(F.lower(F.translate(flat, QUOTES, FOLDED)))
    )
    message = F.concat(kind.cast("binary"), F.lit(b"\0"), normal.cast("binary"))
    return F.concat(F.lit("[["), kind, F.lit(":"), tail(keyed_digest(message, secret), signs), F.lit("]]"))


def is_token(x: Column) -> Column:
    return F.coalesce(x.rlike(f"^{TOKEN}$"), F.lit(False))


def token_class(x: Column) -> Column:
    """The class of a whole-string token, else an empty string."""
    return F.regexp_extract(x, f"^{TOKEN}$", 1)


def tokens_in(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


def has_partial_token(x: Column) -> Column:
    """Whether brackets are left over once whole tokens are taken out."""
    return F.regexp_replace(x, TOKEN, "").rlike(r"\[\[|\]\]")


def replace_matches(x: Column, pattern: str, make) -> Column:  # noqa: ANN001
    """x with make(match) for every match of the pattern: what lies between and what is made are joined in turn."""
    between = F.split(x, pattern)
    made = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), make)
    return F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), made.alias("b")), lambda p: F.array(p["a"], F.coalesce(p["b"], F.lit(""))))), "")
