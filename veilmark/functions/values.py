"""Keys, seeds and replacement values: pure functions of a SHA-256 seed.

Values keep the format of their category, are deterministic, and lie in ranges reserved for examples where there are any.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import AREA_CODES, SAFE_DOMAINS, TEST_NETS

FIRST = "Avery Blake Casey Devon Ellis Finley Gray Harper Indigo Jules Kai Lane Morgan Noel Oakley Parker Quinn Reese Sage Tatum".split()
LAST = "Ashford Brook Calder Dune Everly Frost Garnet Hollis Ivers Juniper Kestrel Lark Marlow North Orchard Pike Quarry Ridge Sable Thorne".split()
STEMS = "Amberline Bluecrest Copperfield Dovetail Emberstone Fernhill Goldleaf Harborlight Ironwood Jasperline Kingfisher Lakemont Moonridge Northgate Oakhaven Pinecrest".split()
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def stripped(value: Column) -> Column:
    """value without white space at its ends."""
    return F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")


def normalized(value: Column, entity: Column) -> Column:
    """The key of a value: spaces collapsed for persons, digits with the leading plus for phones, lower case."""
    bare = stripped(value)
    plus = F.when(bare.startswith("+"), F.lit("+")).otherwise(F.lit(""))
    return F.when(entity == "PERSON", F.lower(F.regexp_replace(bare, "(?U)\\s+", " "))).when(entity == "PHONE_NUMBER", F.concat(plus, F.regexp_replace(bare, "[^0-9]", ""))).otherwise(F.lower(bare))


def seed_hash(key: Column, entity: Column) -> Column:
    return F.sha2(F.concat(F.lower(stripped(key)), F.lit(":"), entity), 256)


def seed(hashed: Column, part: int = 0) -> Column:
    """A 32-bit number from eight hexadecimal digits of the hash."""
    return F.conv(F.substring(hashed, 1 + 8 * part, 8), 16, 10).cast("long")


def pick(pool: list, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (n % len(pool) + 1).cast("int"))


def digits(n: Column, low: int, high: int) -> Column:
    """A number from low to high as text."""
    return (n % (high - low + 1) + low).cast("string")


def padded(n: Column, width: int) -> Column:
    return F.lpad((n % 10**width).cast("string"), width, "0")


def person(h: Column) -> Column:
    return F.concat_ws(" ", pick(FIRST, seed(h, 0)), pick(LAST, seed(h, 1)))


def email(h: Column) -> Column:
    return F.concat(F.lower(pick(FIRST, seed(h, 0))), F.lit("."), F.lower(pick(LAST, seed(h, 1))), F.lit("@"), pick(SAFE_DOMAINS, seed(h, 2)))


def linked_email(fake_person: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(fake_person, "\\W+", ".")), F.lit("@example.com"))


def phone(h: Column, key: Column) -> Column:
    india = F.concat(F.lit("+91 "), digits(seed(h, 0), 6, 9), padded(seed(h, 1), 4), F.lit(" "), padded(seed(h, 2), 5))
    other = F.concat(F.lit("+1-"), pick(AREA_CODES, seed(h, 0)).cast("string"), F.lit("-555-"), padded(seed(h, 1), 4))
    return F.when(key.startswith("+91") | key.rlike("^[6-9][0-9]{9}$"), india).otherwise(other)


def organization(h: Column, key: Column) -> Column:
    low = F.lower(key)
    suffix = F.when(F.contains(low, F.lit("pvt")) | F.contains(low, F.lit("ltd")), "Pvt Ltd").when(F.contains(low, F.lit("inc")), "Inc.").when(F.contains(low, F.lit("llp")), "LLP").otherwise("Corp")
    return F.concat(pick(STEMS, seed(h, 0)), F.lit(" "), digits(seed(h, 1), 100, 9999), F.lit(" "), suffix)


def address(h: Column) -> Column:
    return F.concat(F.lit("Plot "), digits(seed(h, 0), 10, 999), F.lit(", Synthetic Avenue, Test City, "), digits(seed(h, 1), 100000, 999999))


def ssn(h: Column) -> Column:
    area = seed(h, 0) % 800 + 100
    return F.concat_ws("-", F.when(area == 666, 665).otherwise(area).cast("string"), digits(seed(h, 1), 10, 99), digits(seed(h, 2), 1000, 9999))


def card(h: Column) -> Column:
    """A 16-digit number with prefix 4 and a valid check digit, in groups of four."""
    body = F.concat(F.lit("4"), padded(seed(h, 0), 7), padded(seed(h, 1), 7))
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 1, d.try_cast("int")).otherwise((d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int"))), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    whole = F.concat(body, ((10 - total % 10) % 10).cast("string"))
    return F.concat_ws("-", *[F.substring(whole, 1 + 4 * k, 4) for k in range(4)])


def birth_date(h: Column) -> Column:
    return F.concat_ws("-", F.lpad(digits(seed(h, 0), 1, 28), 2, "0"), pick(MONTHS, seed(h, 1)), digits(seed(h, 2), 1975, 2000))


def ip(h: Column) -> Column:
    return F.concat(pick(TEST_NETS, seed(h, 0)), F.lit("."), digits(seed(h, 1), 1, 254))


def replacement(entity: Column, key: Column, h: Column) -> Column:
    return (
        F.when(entity == "PERSON", person(h)).when(entity == "EMAIL_ADDRESS", email(h)).when(entity == "PHONE_NUMBER", phone(h, key)).when(entity == "ORGANIZATION", organization(h, key)).when(entity == "ADDRESS", address(h))
        .when(entity == "SSN", ssn(h)).when(entity == "CREDIT_CARD", card(h)).when(entity == "DATE_OF_BIRTH", birth_date(h)).when(entity == "IP_ADDRESS", ip(h)).otherwise(F.concat(F.lit("SYNTHETIC_"), entity))
    )
