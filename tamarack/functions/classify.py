"""Column expressions that classify field names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.config import Rules


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(name: Column, patterns: tuple[str, ...]) -> Column:
    return _any([name.contains(p) for p in patterns])


def ends_with_any(name: Column, ends: tuple[str, ...]) -> Column:
    return _any([name.endswith(e) for e in ends])


def field_class(name: Column, rules: Rules = Rules()) -> Column:
    """scd2, control, pii, key, filler or business: the first that the lower-cased name fits."""
    n = F.lower(name)
    return (
        F.when(contains_any(n, rules.scd2), "scd2")
        .when(contains_any(n, rules.control), "control")
        .when(contains_any(n, rules.pii), "pii")
        .when(ends_with_any(n, rules.key_ends) | n.startswith("business_id"), "key")
        .when(n.contains("filler"), "filler")
        .otherwise("business")
    )


def pii_type(name: Column, rules: Rules = Rules()) -> Column:
    """The kind of personal data that the name speaks of."""
    n = F.lower(name)
    return (
        F.when(contains_any(n, rules.pii_name), "PERSON_NAME")
        .when(contains_any(n, rules.pii_address), "ADDRESS")
        .when(contains_any(n, rules.pii_phone), "PHONE")
        .when(contains_any(n, rules.pii_id), "IDENTIFIER")
        .otherwise("UNKNOWN_PII")
    )


def mask_route(name: Column, rules: Rules = Rules()) -> Column:
    """The mask that the name asks for; null if none."""
    n = F.lower(name)
    out = None
    for kind, patterns in rules.mask_routes:
        test = contains_any(n, patterns)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return F.lit(None).cast("string") if out is None else out


def normalised_key(name: Column, rules: Rules = Rules()) -> Column:
    """The name under which keys are compared."""
    n = F.replace(F.replace(F.lower(name), F.lit("mtch_"), F.lit("")), F.lit("bus_"), F.lit("business_"))
    return F.regexp_replace(n, rules.strip_prefix, "") if rules.strip_prefix else n


def name_mask_type(name: str, rules: Rules = Rules()) -> str | None:
    """``mask_route`` of one name, on the driver."""
    return next((kind for kind, patterns in rules.mask_routes if any(p in name.lower() for p in patterns)), None)


def name_is_pii(name: str, rules: Rules = Rules()) -> bool:
    return any(p in name.lower() for p in rules.pii)
