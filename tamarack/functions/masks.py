"""Masks as column expressions: a keyed hash of (type, value) picks from short vocabularies.

The same value of one type has the same mask in every table and run with the
same salt, without a dictionary of values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.config import CITIES, FIRST_NAMES, LAST_NAMES, STATES, STREETS

#: White space that Python's strip() takes off; a value of nothing else is blank.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: ``KEY`` keeps keys keys: 128 bits of the hash, so that different values stay different.
TYPES = ("PERSON_NAME", "STREET_ADDRESS", "CITY", "STATE", "ZIP", "PHONE", "EMAIL", "SSN", "GENERIC_PII", "KEY")


def _pick(words: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (number % len(words)).cast("int") + 1)


def _digits(number: Column, width: int) -> Column:
    return F.lpad((number % 10**width).cast("string"), width, "0")


def _person(h: Callable[[int], Column]) -> Column:
    return F.concat_ws(" ", _pick(FIRST_NAMES, h(0)), _pick(LAST_NAMES, h(1)))


def _street(h: Callable[[int], Column]) -> Column:
    return F.concat_ws(" ", (h(0) % 9999 + 1).cast("string"), _pick(STREETS, h(1)))


def _phone(h: Callable[[int], Column]) -> Column:
    return F.concat_ws("-", (h(0) % 800 + 200).cast("string"), _digits(h(1), 3), _digits(h(2), 4))


def _email(h: Callable[[int], Column]) -> Column:
    return F.lower(F.concat(_pick(FIRST_NAMES, h(0)), F.lit("."), _pick(LAST_NAMES, h(1)), _digits(h(2), 2), F.lit("@example.com")))


def _ssn(h: Callable[[int], Column]) -> Column:
    return F.concat_ws("-", _digits(h(0), 3), _digits(h(1), 2), _digits(h(2), 4))


def _generic(h: Callable[[int], Column]) -> Column:
    return F.concat(F.lit("MASKED_"), *(F.char(h(k) % 26 + 97) for k in range(4)))


_MASKS = {
    "PERSON_NAME": _person,
    "STREET_ADDRESS": _street,
    "CITY": lambda h: _pick(CITIES, h(0)),
    "STATE": lambda h: _pick(STATES, h(0)),
    "ZIP": lambda h: _digits(h(0), 5),
    "PHONE": _phone,
    "EMAIL": _email,
    "SSN": _ssn,
}


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.btrim(text, F.lit(SPACES)) == "")


def digest(value: Column, mask_type: str, salt: str) -> Column:
    """The keyed hash of a value, in hexadecimal."""
    return F.sha2(F.concat(F.lit(f"{salt}|{mask_type}|"), value.cast("string")), 256)


def mask_of(digest: Column, mask_type: str, again: bool = False) -> Column:
    """The mask that a digest picks; another one with ``again``, for a value that is its own mask."""
    if mask_type == "KEY":
        return F.concat(F.lit("KEY_"), F.substring(digest, 33 if again else 1, 32))
    return _MASKS.get(mask_type, _generic)(lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") + (1 if again and k == 0 else 0))


def mask_value(value: Column, mask_type: str, salt: str) -> Column:
    """The mask of a value, as a string. Null, empty and white space stay; the mask is never the value itself."""
    text, hashed = value.cast("string"), digest(value, mask_type, salt)
    first = mask_of(hashed, mask_type)
    return F.when(is_blank(text), text).when(first == text, mask_of(hashed, mask_type, again=True)).otherwise(first)
