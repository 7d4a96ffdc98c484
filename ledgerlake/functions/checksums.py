"""Check digits of identifiers as column expressions, evaluated by Spark itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published weights of check digits, prefixes of settlement accounts, card ranges
# (prefix length, low, high).
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12_A = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12_B = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
ACCOUNT_PREFIXES = ("401", "402", "403", "404", "405", "406", "407", "408", "420", "421", "422", "423", "424", "425", "426")
ACCOUNT_PREFIXES_5 = ("40102", "03100", "03212", "03214", "03222", "03224", "03231", "03241")
CARD_RANGES = ((1, 4, 4), (2, 51, 55), (4, 2221, 2720), (4, 2200, 2204), (2, 50, 50), (2, 56, 58), (2, 62, 62), (2, 34, 34), (2, 37, 37))


def digit(x: Column, k: int) -> Column:
    """The digit at place k, from 0."""
    return F.substring(x, k + 1, 1).cast("int")


def weighted(x: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + digit(x, k) * w
    return total


def _checked(x: Column, shape: str, test: Column) -> Column:
    """test is evaluated only where x has the shape; a null is not valid."""
    return F.when(F.coalesce(x.rlike(shape), F.lit(False)), test).otherwise(F.lit(False))


def inn_control(x: Column) -> Column:
    """The last digit that the first nine of a ten-digit number ask for."""
    return weighted(x, INN_10) % 11 % 10


def inn_valid(x: Column) -> Column:
    ten = _checked(x, "^[0-9]{10}$", inn_control(x) == digit(x, 9))
    twelve = _checked(x, "^[0-9]{12}$", (weighted(x, INN_12_A) % 11 % 10 == digit(x, 10)) & (weighted(x, INN_12_B) % 11 % 10 == digit(x, 11)))
    return ten | twelve


def ogrn_valid(x: Column) -> Column:
    short = _checked(x, "^[0-9]{13}$", F.substring(x, 1, 12).cast("bigint") % 11 % 10 == digit(x, 12))
    long = _checked(x, "^[0-9]{15}$", F.substring(x, 1, 14).cast("bigint") % 13 % 10 == digit(x, 14))
    return short | long


def snils_valid(x: Column) -> Column:
    total = weighted(x, SNILS)
    return _checked(x, "^[0-9]{11}$", F.when(total < 100, total).otherwise(total % 101 % 100) == F.substring(x, 10, 2).cast("int"))


def luhn_valid(x: Column) -> Column:
    digits = F.transform(F.split(F.reverse(x), ""), lambda d: d.cast("int"))
    folded = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9))
    return _checked(x, "^[0-9]{13,19}$", F.aggregate(folded, F.lit(0), lambda s, d: s + d) % 10 == 0)


def iban_valid(x: Column) -> Column:
    """The remainder is carried from sign to sign, so no number outgrows a long."""
    turned = F.split(F.concat(F.substring(x, 5, 30), F.substring(x, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    carry = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + value(c)) % 97).otherwise((r * 100 + value(c)) % 97)
    return _checked(x, "^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$", F.aggregate(turned, F.lit(0), carry) == 1)


def account_known(x: Column) -> Column:
    return _checked(x, "^[0-9]{20}$", F.substring(x, 1, 3).isin(*ACCOUNT_PREFIXES) | F.substring(x, 1, 5).isin(*ACCOUNT_PREFIXES_5))


def card_network_known(x: Column) -> Column:
    known = F.lit(False)
    for n, low, high in CARD_RANGES:
        known = known | F.substring(x, 1, n).cast("int").between(low, high)
    return _checked(x, "^[0-9]{13,19}$", known)


def _sum(x: str, weights: tuple[int, ...]) -> int:
    return sum(int(c) * w for c, w in zip(x, weights))


def inn_ok(x: str) -> bool:
    """inn_valid() of one literal, for a condition that is checked before anything runs."""
    if len(x) == 10:
        return _sum(x, INN_10) % 11 % 10 == int(x[9])
    return len(x) == 12 and _sum(x, INN_12_A) % 11 % 10 == int(x[10]) and _sum(x, INN_12_B) % 11 % 10 == int(x[11])


def ogrn_ok(x: str) -> bool:
    return len(x) in (13, 15) and int(x[:-1]) % (11 if len(x) == 13 else 13) % 10 == int(x[-1])


def snils_ok(x: str) -> bool:
    total = _sum(x, SNILS)
    return len(x) == 11 and (total if total < 100 else total % 101 % 100) == int(x[9:])
