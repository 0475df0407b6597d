"""Checksums and shape tests as Column expressions. Each delta says how much a candidate's score moves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _digit(d: Column, i: Column | int) -> Column:
    return F.substr(d, (i if isinstance(i, Column) else F.lit(i)), F.lit(1)).try_cast("int")


def _distinct(d: Column) -> Column:
    return F.size(F.array_distinct(F.split(d, "")))


def _weighted(d: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights, 1):
        total = total + F.coalesce(_digit(d, i), F.lit(0)) * w
    return total


def _luhn(d: Column) -> Column:
    return F.call_function("luhn_check", d)


def luhn(x: Column) -> Column:
    d = digits(x)
    return (F.length(d) >= 12) & _luhn(d)


def card_delta(x: Column) -> Column:
    d = digits(x)
    return (
        F.when(~F.length(d).between(13, 19), -0.4)
        .when(_distinct(d) == 1, -0.5)
        .when(_luhn(d) & d.rlike("^(?:3[0-9]|4|5|6|2[2-7])"), 0.35)
        .when(_luhn(d), 0.2)
        .when(F.length(d).isin(15, 16), 0.05)
        .otherwise(-0.3)
    )


def ssn_delta(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) != 9, -0.5).when(d.rlike("^(?:000|666)|^...00|0000$"), -0.3).when(d.startswith("9"), -0.1).otherwise(0.1)


def pan_delta(x: Column) -> Column:
    return F.when(~x.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), -0.5).when(F.substr(x, F.lit(4), F.lit(1)).isin(*"PCHFATBLJG"), 0.2).otherwise(-0.25)


#: Weights of the PESEL check digit; letter values of IBAN start at 10.
PESEL_WEIGHTS = [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]


def pesel_delta(x: Column) -> Column:
    month = F.substr(x, F.lit(3), F.lit(2)).try_cast("int")
    century = F.element_at(F.array(*map(F.lit, (1900, 2000, 2100, 2200, 1800))), F.least(F.floor(month / 20).cast("int"), F.lit(4)) + 1)
    born = F.try_to_timestamp(F.format_string("%04d-%02d-%s", century + F.substr(x, F.lit(1), F.lit(2)).try_cast("int"), month % 20, F.substr(x, F.lit(5), F.lit(2))), F.lit("yyyy-MM-dd"))
    check = (F.lit(10) - _weighted(x, PESEL_WEIGHTS) % 10) % 10
    return F.when(born.isNull(), -0.4).when(x.rlike("[^0-9]"), 0.1).when(check == _digit(x, 11), 0.3).otherwise(-0.1)


def iban_ok(x: Column) -> Column:
    v = F.upper(F.regexp_replace(x, r"\s", ""))
    turned = F.split(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$") & (F.aggregate(turned, F.lit(0), step) == 1)


def iban_delta(x: Column) -> Column:
    shape = F.upper(F.regexp_replace(x, r"\s", "")).rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}$")
    return F.when(~shape, -0.5).when(iban_ok(x), 0.35).otherwise(-0.3)


def phone_delta(x: Column) -> Column:
    """Shapes only: without numbering-plan metadata a number with a country code counts as possible."""
    d = digits(x)
    return (
        F.when(~F.length(d).between(7, 15), -0.4)
        .when(_distinct(d) <= 2, -0.3)
        .when(F.trim(x).rlike(r"^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{2}|[0-9]{4})$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), -0.4)
        .when(F.trim(x).startswith("+"), 0.25)
        .when((F.length(d) == 10) & d.rlike("^[2-9]"), 0.25)
        .when(d.startswith("0") & F.length(d).between(9, 12), 0.1)
        .when(F.length(d) == 9, 0.1)
        .otherwise(-0.1)
    )


def date_delta(x: Column, as_of_year: int) -> Column:
    year = F.regexp_extract(x, "((?:19|20)[0-9]{2})", 1).try_cast("int")
    return F.when(year > as_of_year, -0.4).when(year > as_of_year - 14, -0.15).otherwise(0.0)


#: Parts of a mailbox name that stand for a role, not a person.
ROLE_WORDS = "info|support|sales|admin|office|help|helpdesk|contact|team|noreply|no-reply|service|security|billing|hr|jobs|press|legal|privacy|desk"


def mailbox_delta(x: Column) -> Column:
    return F.when(F.lower(F.substring_index(x, "@", 1)).rlike(f"(?:^|[._-])(?:{ROLE_WORDS})(?:$|[._-])"), -0.45).otherwise(0.0)


def _dihedral() -> tuple[list[list[int]], list[list[int]]]:
    """The Verhoeff tables: products in the dihedral group of ten elements, and the powers of its permutation."""
    times = [[(a + b) % 5 if a < 5 and b < 5 else (a + b - 5) % 5 + 5 if a < 5 else (a - b - 5) % 5 + 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
    first, powers = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]
    for _ in range(7):
        powers.append([first[i] for i in powers[-1]])
    return times, powers


def verhoeff(x: Column) -> Column:
    times, powers = _dihedral()
    flat = F.array(*[F.lit(v) for row in times for v in row])
    permuted = F.array(*[F.lit(v) for row in powers for v in row])
    d = F.reverse(digits(x))
    at = F.transform(F.split(d, ""), lambda c, i: F.element_at(permuted, ((i % 8) * 10 + F.coalesce(c.try_cast("int"), F.lit(0)) + 1).cast("int")))
    return F.aggregate(at, F.lit(0), lambda a, v: F.element_at(flat, a * 10 + v + 1)) == 0


def aadhaar_delta(x: Column) -> Column:
    d = digits(x)
    return F.when(F.length(d) != 12, -0.5).when(d.rlike("^[01]"), -0.25).when(_distinct(d) <= 2, -0.4).when(verhoeff(d), 0.3).otherwise(-0.15)


def gstin_delta(x: Column) -> Column:
    state = F.substr(x, F.lit(1), F.lit(2)).try_cast("int")
    alphabet = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    total = F.lit(0)
    for i in range(1, 15):
        product = F.position(F.substr(x, F.lit(i), F.lit(1)), alphabet) - 1
        product = product * (1 if i % 2 else 2)
        total = total + F.floor(product / 36) + product % 36
    check = F.substr(alphabet, ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))
    ok_state = state.between(1, 38) | state.isin(97, 99)
    return F.when(~x.rlike("^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"), -0.5).when(~ok_state, -0.2).when(check == F.substr(x, F.lit(15), F.lit(1)), 0.3).otherwise(0.0)


def ipv4_delta(x: Column) -> Column:
    p = F.transform(F.split(x, r"\."), lambda c: c.try_cast("int"))
    bad = (F.size(p) != 4) | F.exists(p, lambda c: c.isNull() | (c > 255))
    return (
        F.when(bad, -0.6)
        .when((p[0] == 127) | (p[0] == 0) | p[0].between(224, 239), -0.3)
        .when(F.length(x) <= 8, -0.15)
        .when((p[0] == 10) | ((p[0] == 172) & p[1].between(16, 31)) | ((p[0] == 192) & (p[1] == 168)), 0.0)
        .otherwise(0.1)
    )


def ip_delta(x: Column) -> Column:
    """IPv4 or IPv6: eight groups of up to four hex digits, one run of zero groups shortened to "::"."""
    groups = F.filter(F.split(x, ":"), lambda g: g != "")
    short = F.size(F.split(x, "::", -1)) - 1
    count = F.size(groups)
    whole = (short == 0) & (count == 8) & ~x.rlike("^:|:$")
    cut = (short == 1) & (count <= 7) & ~x.rlike(":::") & ~x.rlike("^:[^:]|[^:]:$")
    six = (
        F.when(~(whole | cut) | F.exists(groups, lambda g: ~g.rlike("^[0-9A-Fa-f]{1,4}$")), -0.6)
        .when(x.rlike("(?i)^ff") | x.rlike("^[0:]*:?:[0:]*1?$"), -0.3)
        .when(x.rlike("(?i)^(?:f[cd]|fe[89ab])"), 0.0)
        .otherwise(0.1)
    )
    return F.when(F.contains(x, F.lit(":")), six).otherwise(ipv4_delta(x))
