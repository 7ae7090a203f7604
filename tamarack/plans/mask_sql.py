"""The masks as DuckDB SQL, for comparison."""

from __future__ import annotations

from tamarack.functions.config import CITIES, FIRST_NAMES, LAST_NAMES, STATES, STREETS
from tamarack.functions.masks import SPACES


_SPACES = " || ".join(f"chr({ord(c)})" for c in SPACES)


def _list(words: tuple[str, ...]) -> str:
    return "list_value(" + ", ".join(f"'{w}'" for w in words) + ")"


def mask_sql(value: str, mask_type: str, salt: str) -> str:
    """An expression equal to ``functions.masks.mask_value``."""

    def build(shift: int) -> str:
        def h(k: int) -> str:
            return f"(('0x' || substr(sha256('{salt}|{mask_type}|' || ({value})::VARCHAR), {1 + 8 * k}, 8))::BIGINT + {shift if k == 0 else 0})"

        def pick(words: tuple[str, ...], k: int) -> str:
            return f"{_list(words)}[({h(k)} % {len(words)}) + 1]"

        def digits(k: int, width: int) -> str:
            return f"lpad(({h(k)} % {10**width})::VARCHAR, {width}, '0')"

        return {
            "PERSON_NAME": f"{pick(FIRST_NAMES, 0)} || ' ' || {pick(LAST_NAMES, 1)}",
            "STREET_ADDRESS": f"({h(0)} % 9999 + 1)::VARCHAR || ' ' || {pick(STREETS, 1)}",
            "CITY": pick(CITIES, 0),
            "STATE": pick(STATES, 0),
            "ZIP": digits(0, 5),
            "PHONE": f"({h(0)} % 800 + 200)::VARCHAR || '-' || {digits(1, 3)} || '-' || {digits(2, 4)}",
            "EMAIL": f"lower({pick(FIRST_NAMES, 0)} || '.' || {pick(LAST_NAMES, 1)} || {digits(2, 2)} || '@example.com')",
            "KEY": f"'KEY_' || substr(sha256('{salt}|{mask_type}|' || ({value})::VARCHAR), {1 + 32 * shift}, 32)",
            "SSN": f"{digits(0, 3)} || '-' || {digits(1, 2)} || '-' || {digits(2, 4)}",
        }.get(mask_type, "'MASKED_' || " + " || ".join(f"chr(({h(k)} % 26 + 97)::INT)" for k in range(4)))

    text = f"({value})::VARCHAR"
    return f"CASE WHEN {text} IS NULL OR trim({text}, {_SPACES}) = '' THEN {text} WHEN ({build(0)}) = {text} THEN {build(1)} ELSE {build(0)} END"
