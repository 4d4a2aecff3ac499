"""Capture codes: three low bits for the attributes of the condition (s=1, p=2, o=4), three for the projected attribute.

Helpers take and give Columns; `of_int` variants serve plans and tests.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = {"s": 1, "p": 2, "o": 4}
CHARS = {bit: char for char, bit in BITS.items()}


def is_valid_int(code: int) -> bool:
    """One projected attribute, one or two other attributes in the condition, no other bit."""
    condition, projected = code & 7, code >> 3
    return code < 64 and projected.bit_count() == 1 and condition.bit_count() in (1, 2) and not condition & projected


VALID = tuple(c for c in range(64) if is_valid_int(c))


def codes_of(projection: str) -> list[int]:
    """The valid codes whose projected attribute is among `projection`, e.g. "so"."""
    return [c for c in VALID if CHARS[c >> 3] in projection]


def condition(code: Column) -> Column:
    return code.bitwiseAND(7)


def projected(code: Column) -> Column:
    """The projection bits in their place."""
    return code.bitwiseAND(56)


def size(code: Column) -> Column:
    """1 for a unary condition, 2 for a binary one."""
    return F.bit_count(condition(code)).cast("int")


def first_sub(code: Column) -> Column:
    """The code with the lower condition attribute only: its value is v1."""
    c = condition(code)
    return projected(code).bitwiseOR(c.bitwiseAND(-c)).cast("int")


def second_sub(code: Column) -> Column:
    """The code with the higher condition attribute only: its value is v2."""
    c = condition(code)
    return projected(code).bitwiseOR(c.bitwiseAND(c - 1)).cast("int")


def char(bit: Column) -> Column:
    return F.when(bit == 1, "s").when(bit == 2, "p").when(bit == 4, "o").otherwise("")


def pretty(code: Column, v1: Column, v2: Column) -> Column:
    """s[p=v1,o=v2]; without a projection bit [p=v1]."""
    c = condition(code)
    low, high = c.bitwiseAND(-c), c.bitwiseAND(c - 1)
    second = F.when(high == 0, F.lit("")).otherwise(F.concat(F.lit(","), char(high), F.lit("="), v2))
    return F.concat(char(F.shiftright(projected(code), 3)), F.lit("["), char(low), F.lit("="), v1, second, F.lit("]"))


def implied(dep: tuple[Column, Column, Column], ref: tuple[Column, Column, Column]) -> Column:
    """Whether `ref` equals `dep` or drops one of its two conditions."""
    (dc, d1, d2), (rc, r1, r2) = dep, ref
    same = (dc == rc) & (d1 == r1) & (d2 == r2)
    sub = (size(dc) == 2) & (r2 == "") & (((rc == first_sub(dc)) & (r1 == d1)) | ((rc == second_sub(dc)) & (r1 == d2)))
    return same | sub
