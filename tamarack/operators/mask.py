"""Masking of tables: which columns, with which masks, and what was masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.classify import name_is_pii, name_mask_type
from tamarack.functions.config import Rules
from tamarack.functions.digits import mask_digits
from tamarack.functions.masks import digest, is_blank, mask_of


#: Schema of ``mask_stats``.
STATS = "table_name string, pii_fields int, pii_columns array<string>, rows_masked long, total_values_masked long"
#: Masks of numbers and codes, which ``keep_format`` replaces by permutations of their digits.
NUMBERS = ("ZIP", "PHONE", "SSN", "IDENTIFIER", "GENERIC_PII")


def mask_type(name: str, pii_type: str | None = None, rules: Rules = Rules()) -> str:
    """The mask of a column: what its name asks for, else its profile's type, else the generic one."""
    return name_mask_type(name, rules) or pii_type or "GENERIC_PII"


def mask_columns(df: DataFrame, profile_types: dict[str, str] | None = None, protect: tuple[str, ...] = (), rules: Rules = Rules(), keep_format: bool = False) -> dict[str, str]:
    """Columns to mask and their masks: those the profile marks as personal and those whose names do.

    ``profile_types`` gives the profile's type by lower-case name; ``protect`` names
    columns (keys, control fields) that stay as they are. With ``keep_format`` numbers
    and codes have the mask ``DIGITS``: as many digits, one mask for each value, integers stay integers.
    """
    types, kept = profile_types or {}, {p.lower() for p in protect}

    def chosen(c: str) -> str:
        found = mask_type(c, types.get(c.lower()), rules)
        return "DIGITS" if keep_format and found in NUMBERS else found

    return {
        c: chosen(c)
        for c in df.columns
        if c.lower() not in kept and (c.lower() in types or name_mask_type(c, rules) or name_is_pii(c, rules))
    }


def mask(df: DataFrame, columns: dict[str, str], salt: str, max_lengths: dict[str, int] | None = None) -> DataFrame:
    """``df`` with the columns masked, as strings, without a shuffle; cut to ``max_lengths`` where given.

    Give keys the type ``KEY`` or ``DIGITS`` where masked tables are joined: other
    types draw from short vocabularies, so that two keys may share a mask. ``DIGITS``
    keeps the width, so it is never cut, and integers stay of their type.
    """
    limits, order = max_lengths or {}, df.columns
    mark = "_"
    while any(c.startswith(mark) for c in order):  # names of our own
        mark += "_"
    of = {c: F.col(f"`{c}`") for c in order}
    hashes, firsts = ({c: f"{mark}{what}{k}" for k, c in enumerate(order) if c in columns and columns[c] != "DIGITS"} for what in ("hash", "first"))
    # each value is hashed once and its mask made once: every step uses the columns of the one before
    hashed = df.select(*of.values(), *(digest(of[c], columns[c], salt).alias(h) for c, h in hashes.items()))
    made = hashed.select("*", *(mask_of(F.col(hashes[c]), columns[c]).alias(f) for c, f in firsts.items()))

    def masked(c: str):
        if columns[c] == "DIGITS":
            return mask_digits(of[c], df.schema[c].dataType, salt).alias(c)
        text, first = of[c].cast("string"), F.col(firsts[c])
        out = F.when(is_blank(text), text).when(first == text, mask_of(F.col(hashes[c]), columns[c], again=True)).otherwise(first)
        return (F.substring(out, 1, limits[c]) if c in limits else out).alias(c)

    return made.select(*(masked(c) if c in columns else of[c] for c in order))


def _filled(c: str):
    value = F.col(f"`{c}`")
    return value.isNotNull() & (value.cast("string") != "")


def filled_values(columns: dict[str, str]) -> Column:
    """An aggregate: the cells of the columns that are not null or empty."""
    return sum((F.count_if(_filled(c)) for c in columns), F.lit(0)).cast("long")


def mask_stats(df: DataFrame, columns: dict[str, str], table: str) -> DataFrame:
    """One row: columns masked, rows, and cells that are not null or empty, in one pass over the unmasked table."""
    total = sum((F.coalesce(F.sum(F.when(_filled(c), 1)), F.lit(0)) for c in columns), F.lit(0))
    return df.agg(F.count("*").alias("rows_masked"), total.cast("long").alias("total_values_masked")).select(
        F.lit(table).alias("table_name"), F.lit(len(columns)).alias("pii_fields"), F.array(*map(F.lit, sorted(columns))).cast("array<string>").alias("pii_columns"), "rows_masked", "total_values_masked"
    )


def before_after(df: DataFrame, masked: DataFrame, key: str, columns: dict[str, str], table: str) -> DataFrame:
    """Values of the masked columns before and after, of the row with the smallest key."""

    def first(rows: DataFrame) -> DataFrame:
        return rows.orderBy(key, *columns).limit(1)

    def unpivoted(rows: DataFrame, name: str) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(columns[c]).alias("mask_type"), F.col(f"`{c}`").cast("string").alias(name)) for c in columns))
        return rows.select(F.explode(cells).alias("x")).select("x.*")

    row = first(df)
    after = masked.join(row.select(F.col(key)), key, "left_semi")
    return unpivoted(row, "before").join(unpivoted(first(after), "after").drop("mask_type"), "column_name").select(F.lit(table).alias("table_name"), "column_name", "mask_type", "before", "after")
