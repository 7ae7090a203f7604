"""Masks that keep a number's format and tell all numbers apart: a keyed permutation of the digits.

Numbers of one width are pairs of their left and right half, on which Feistel steps
act in turns: a step adds to one half a keyed hash of the other, so it can be taken
back. A mask takes the steps, moves on by a keyed distance that is not zero, and takes
the steps back. So no two numbers of a width share a mask, and none is its own mask,
without a walk over values outside the range and without a dictionary. Ranges that are
not a power of ten (integers have no leading zero and end at their type's last value)
are cut into parts that are all pairs of so many left and so many right halves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.functions.masks import digest, is_blank, mask_of

#: Steps in each direction, and the longest run of digits (each half is a 64-bit integer).
STEPS, MOST_DIGITS = 6, 36
_INTEGRAL = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _power(n: Column) -> Column:
    """10 to the n, up to 18."""
    return F.element_at(F.array(*(_long(10**k) for k in range(19))), n.cast("int") + 1)


def _hash(salt: str, tag: Column, step: int, half: Column) -> Column:
    text = F.concat(F.lit(f"{salt}|DIGITS|"), tag, F.lit(f"|{step}|"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def _number(digits: Column) -> Column:
    return F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), _long(0))


def _text_halves(c: dict[str, Column]) -> dict[str, Column]:
    """Halves, sizes of their ranges, first left half, and a tag of the range; of texts with digits, as many as are permuted."""
    kept = F.when(c["fits"], c["digits"]).otherwise("0")
    return {"l": _number(kept.substr(F.lit(1), c["lw"])), "r": _number(kept.substr(c["lw"] + 1, c["rw"])), "a": _power(F.least(c["lw"], F.lit(18))), "b": _power(F.least(c["rw"], F.lit(18))), "f": _long(0), "tag": c["width"].cast("string")}


def _integer_halves(c: dict[str, Column], bits: int) -> dict[str, Column]:
    """The same of integers: the last value of the type, which ends one later below zero, cuts the widest range in two."""
    most, least = str(2 ** (bits - 1) - 1), str(2 ** (bits - 1))
    split, negative, width = len(most) - len(most) // 2, c["negative"], c["width"]
    last_left, last_right = (F.when(negative, _long(int(least[cut]))).otherwise(_long(int(most[cut]))) for cut in (slice(0, split), slice(split, None)))
    left = c["digits"].substr(F.lit(1), c["lw"]).cast("bigint")
    low = F.when((width == 1) & ~negative, _long(0)).otherwise(_power(c["lw"] - 1))
    widest = width == len(most)
    ends = widest & (left == last_left)
    first = F.when(ends, last_left).otherwise(low)
    return {
        "l": left - first, "r": _number(c["digits"].substr(c["lw"] + 1, c["rw"])), "a": F.when(ends, _long(1)).when(widest, last_left - low).otherwise(_power(c["lw"]) - low), "b": F.when(ends, last_right + 1).otherwise(_power(c["rw"])),
        "f": first, "tag": F.concat_ws(",", *(x.cast("string") for x in (width, negative, ends))),
    }


def _step(k: int, c: dict[str, Column], salt: str) -> dict[str, Column]:
    """A half's next value. Step ``STEPS`` is the move; those after it take back."""
    if k == STEPS:
        def moved(half: str, size: str) -> Column:
            return (c[half] + _hash(salt, c["tag"], k, c[size]) % F.greatest(c[size] - 1, _long(1)) + 1) % c[size]

        return {"l": F.when(c["a"] > 1, moved("l", "a")).otherwise(c["l"]), "r": F.when(c["a"] > 1, c["r"]).otherwise(moved("r", "b"))}
    at = k if k < STEPS else 2 * STEPS - k
    mine, other, size = ("l", "r", "a") if at % 2 == 0 else ("r", "l", "b")
    amount = _hash(salt, c["tag"], at, c[other]) % c[size]
    return {mine: (c[mine] + (amount if k < STEPS else c[size] - amount)) % c[size]}


def _masked(start: dict[str, Column], salt: str, joined: Callable[[Column], Column]) -> Column:
    """``joined`` of the halves after all steps. Every step reads a struct of the one before, so that nothing is computed twice."""

    def following(k: int) -> Callable[[Column], Column]:
        def step(acc: Column) -> Column:
            now = {name: acc[name] for name in start}
            return F.struct(*(x.alias(name) for name, x in (now | _step(k, now, salt)).items()))

        return step

    at = F.struct(*(x.alias(name) for name, x in start.items()))
    for k in range(2 * STEPS + 1):
        at = F.transform(F.array(at), following(k))[0]
    return F.transform(F.array(at), joined)[0]


def _right(c: dict[str, Column], acc: Column) -> Column:
    return F.when(c["rw"] > 0, F.lpad(acc["r"].cast("string"), c["rw"], "0")).otherwise("")


def _cells(text: Column) -> dict[str, Column]:
    digits = F.regexp_replace(text, "[^0-9]", "")
    width = F.length(digits)
    right = F.floor(width / 2).cast("int")
    return {"digits": digits, "width": width, "lw": width - right, "rw": right, "fits": (width > 0) & (width <= MOST_DIGITS), "negative": text.startswith("-")}


def mask_digits(value: Column, kind: T.DataType, salt: str) -> Column:
    """The mask of a value of a type.

    Integers become integers of the same type, sign and number of digits. Everything
    else is a text whose digits 0-9 are permuted while all other characters stay; a text
    without digits, or with more than ``MOST_DIGITS``, has the mask of the type KEY.
    Null, empty and white space stay.
    """
    text, bits = value.cast("string"), _INTEGRAL.get(type(kind))
    c = _cells(text)
    if bits:
        found = _masked(_integer_halves(c, bits), salt, lambda acc: F.concat(F.when(c["negative"], "-").otherwise(""), (acc["l"] + acc["f"]).cast("string"), _right(c, acc)))
        return F.when(value.isNotNull(), found.cast(kind))

    def filled(acc: Column) -> Column:
        new = F.concat(F.lpad(acc["l"].cast("string"), c["lw"], "0"), _right(c, acc))
        # the digits go where digits were: between the pieces that they part
        return F.when(text == c["digits"], new).otherwise(F.array_join(F.zip_with(F.split(text, "[0-9]", -1), F.split(new, ""), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))

    return F.when(is_blank(text), text).when(c["fits"], _masked(_text_halves(c), salt, filled)).otherwise(mask_of(digest(text, "KEY", salt), "KEY"))


def digits_sql(source: str, value: str, salt: str, bits: int | None = None) -> str:
    """DuckDB SQL: the rows of ``source`` with ``masked``; of texts (all with 1 to 36 digits) or of integers of so many bits."""

    def h(width: str, step: str, half: str) -> str:
        return f"('0x' || substr(sha256('{salt}|DIGITS|' || ({width})::VARCHAR || '|{step}|' || ({half})::VARCHAR), 1, 15))::BIGINT"

    if bits is None:
        parts = "0::BIGINT AS fst, (10 ** lw)::BIGINT AS a, (10 ** rw)::BIGINT AS b, w::VARCHAR AS tag"
        digits, sign = f"regexp_replace(({value})::VARCHAR, '[^0-9]', '', 'g')", "false"
    else:
        full = len(str(2 ** (bits - 1)))
        split = full - full // 2
        most, least = str(2 ** (bits - 1) - 1), str(2 ** (bits - 1))
        low = "(CASE WHEN w = 1 AND NOT neg THEN 0 ELSE 10 ** (lw - 1) END)::BIGINT"
        last_l, last_r = (f"(CASE WHEN neg THEN {int(least[cut])} ELSE {int(most[cut])} END)" for cut in (slice(0, split), slice(split, None)))
        ends = f"(w = {full} AND l = {last_l})"
        parts = f"""(CASE WHEN {ends} THEN {last_l} ELSE {low} END)::BIGINT AS fst, (CASE WHEN {ends} THEN 1 WHEN w = {full} THEN {last_l} - {low} ELSE (10 ** lw)::BIGINT - {low} END)::BIGINT AS a,
            (CASE WHEN {ends} THEN {last_r} + 1 ELSE 10 ** rw END)::BIGINT AS b, w::VARCHAR || ',' || neg::VARCHAR || ',' || {ends}::VARCHAR AS tag"""
        digits, sign = f"ltrim(({value})::VARCHAR, '-')", f"({value}) < 0"
    sql = f"SELECT *, {digits} AS d, len({digits})::INT AS w, {sign} AS neg FROM {source}"
    sql = f"SELECT *, w - w // 2 AS lw, w // 2 AS rw, left(d, w - w // 2)::BIGINT AS l, coalesce(nullif(right(d, w // 2), '')::BIGINT, 0) AS r FROM ({sql})"
    sql = f"SELECT * REPLACE (l - fst AS l) FROM (SELECT *, {parts} FROM ({sql}))"
    for k in range(2 * STEPS + 1):
        at = k if k < STEPS else 2 * STEPS - k
        if k == STEPS:
            move = "({0} + " + h("tag", str(k), "{1}") + " % greatest({1} - 1, 1) + 1) % {1}"
            sql = f"SELECT * REPLACE (CASE WHEN a > 1 THEN {move.format('l', 'a')} ELSE l END AS l, CASE WHEN a > 1 THEN r ELSE {move.format('r', 'b')} END AS r) FROM ({sql})"
            continue
        mine, other, size = ("l", "r", "a") if at % 2 == 0 else ("r", "l", "b")
        amount = f"{h('tag', str(at), other)} % {size}"
        sql = f"SELECT * REPLACE (({mine} + {amount if k < STEPS else f'{size} - {amount}'}) % {size} AS {mine}) FROM ({sql})"
    if bits:
        masked = "((CASE WHEN neg THEN '-' ELSE '' END) || (l + fst)::VARCHAR || CASE WHEN rw > 0 THEN lpad(r::VARCHAR, rw, '0') ELSE '' END)::BIGINT"
    else:
        new = "(lpad(l::VARCHAR, lw, '0') || CASE WHEN rw > 0 THEN lpad(r::VARCHAR, rw, '0') ELSE '' END)"
        masked = f"""array_to_string(list_transform(list_zip(regexp_split_to_array(({value})::VARCHAR, '[0-9]'), list_concat(string_split({new}, ''), [''])), lambda x: x[1] || coalesce(x[2], '')), '')"""
    return f"SELECT *, {masked} AS masked FROM ({sql})"
