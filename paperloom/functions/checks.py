"""Checksums of ids, as column functions and as plain functions for the span detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two digits of an id's letter, and the weights.
LETTER_CODES = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", (10, 11, 12, 13, 14, 15, 16, 17, 34, 18, 19, 20, 21, 22, 35, 23, 24, 25, 26, 27, 28, 29, 32, 30, 31, 33)))
ID_WEIGHTS = (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1)
BUSINESS_WEIGHTS = (1, 2, 1, 2, 1, 2, 4, 1)


def national_id_valid(value: Column) -> Column:
    v = F.upper(value)
    code = F.element_at(F.create_map(*[F.lit(x) for kv in LETTER_CODES.items() for x in kv]), F.left(v, F.lit(1)))
    total = F.floor(code / 10) * ID_WEIGHTS[0] + (code % 10) * ID_WEIGHTS[1]
    for k, w in enumerate(ID_WEIGHTS[2:], 2):
        total = total + F.substring(v, k, 1).try_cast("int") * w
    return F.coalesce(v.rlike("^[A-Z][12][0-9]{8}$") & (total % 10 == 0), F.lit(False))


def business_id_valid(value: Column) -> Column:
    total = F.lit(0)
    for k, w in enumerate(BUSINESS_WEIGHTS, 1):
        p = F.substring(value, k, 1).try_cast("int") * w
        total = total + F.floor(p / 10) + p % 10
    fits = (total % 10 == 0) | ((F.substring(value, 7, 1) == "7") & ((total + 1) % 10 == 0))
    return F.coalesce(value.rlike("^[0-9]{8}$") & fits, F.lit(False))


def card_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[\s\-]", "")
    return F.coalesce(digits.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", digits), F.lit(False))


def is_national_id(value: str) -> bool:
    value = value.upper()
    if len(value) != 10 or value[0] not in LETTER_CODES or value[1] not in "12" or not value[1:].isdecimal():
        return False
    digits = [*divmod(LETTER_CODES[value[0]], 10), *map(int, value[1:])]
    return sum(d * w for d, w in zip(digits, ID_WEIGHTS)) % 10 == 0


def is_business_id(value: str) -> bool:
    if len(value) != 8 or not value.isdecimal():
        return False
    total = sum(sum(divmod(int(d) * w, 10)) for d, w in zip(value, BUSINESS_WEIGHTS))
    return total % 10 == 0 or (value[6] == "7" and total % 10 == 9)


def is_card(value: str) -> bool:
    digits = [int(c) for c in value if c.isdecimal()]
    if not 13 <= len(digits) <= 19 or any(not (c.isdecimal() or c.isspace() or c == "-") for c in value):
        return False
    return (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
