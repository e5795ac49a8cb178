"""Checksums and validity rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits, spaces and hyphens aside, with a valid mod-10 checksum."""
    bare = F.regexp_replace(value, "[\\s-]", "")
    numbers = F.transform(F.split(F.reverse(bare), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int")))
    return F.coalesce(bare.rlike("^[0-9]{13,19}$") & (F.aggregate(F.filter(numbers, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0), F.lit(False))


def ipv4(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"), F.lit(False))


def ipv6(value: Column) -> Column:
    """Eight groups, or fewer with one compression."""
    groups = F.size(F.filter(F.split(value, ":"), lambda g: g != ""))
    shape = value.rlike("^[0-9A-Fa-f:]+$") & ~value.rlike("[0-9A-Fa-f]{5}|:::|^:[^:]|[^:]:$|::.*::")
    return F.coalesce(shape & F.when(F.contains(value, F.lit("::")), groups <= 7).otherwise(groups == 8), F.lit(False))


def ssn(value: Column) -> Column:
    """Area not 000, 666 or 900-999 but for 987; group not 00; serial not 0000."""
    area = F.substring(value, 1, 3)
    bad = area.isin("000", "666") | ((area >= "900") & (area != "987"))
    return F.coalesce(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~bad & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000"), F.lit(False))


def phone(value: Column) -> Column:
    """7 to 15 digits in a plausible national or international form.

    A rule subset: numbering-plan tables are not available, so assigned areas are not looked up.
    """
    d = digits(value)
    plus = F.regexp_replace(value, "^[^+0-9]*", "").startswith("+")
    international = F.when(d.startswith("91"), d.rlike("^91[6-9][0-9]{9}$")).when(d.startswith("1"), d.rlike("^1[2-9][0-9]{2}[2-9][0-9]{6}$")).when(d.startswith("44"), d.rlike("^44[1-9][0-9]{8,9}$")).when(d.startswith("61"), d.rlike("^61[2-478][0-9]{8}$")).when(d.startswith("65"), d.rlike("^65[3689][0-9]{7}$")).when(d.startswith("971"), d.rlike("^971[2-9][0-9]{7,8}$")).otherwise(F.length(d).between(8, 15))
    national = d.rlike("^[6-9][0-9]{9}$") | d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$") | d.rlike("^0[1-9][0-9]{8,9}$")
    return F.coalesce(F.length(d).between(7, 15) & F.when(plus, international).otherwise(national), F.lit(False))
