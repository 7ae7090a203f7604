"""The statements of a DDL text: what is quoted or commented out is told apart before anything is looked for."""

from __future__ import annotations

import re
from typing import NamedTuple

_QUOTED = re.compile(r"""--[^\n]* | /\*.*?(?:\*/|\Z) | '(?:[^']|'')*(?:'|\Z) | "(?:[^"]|"")*(?:"|\Z)""", re.S | re.X)
_CREATE = re.compile(r"\bCREATE\s+(?:(?:MULTI)?SET\s+)?TABLE\b", re.I)
_MARK = re.compile(r"[();,]|\bCREATE\b", re.I)


class Statement(NamedTuple):
    """The text before the column list, its items and their shapes, and the text behind it up to the statement's end."""

    head: str
    items: list[str]
    shapes: list[str]
    tail: str


def shaped(text: str) -> tuple[str, str]:
    """The text without its comments, and its shape, in which quoted text is underscores as well; both as long as the text."""

    def blank(m: re.Match, quoted: bool) -> str:
        found = m[0]
        if found[0] not in "'\"":
            return re.sub(r"[^\n]", " ", found)
        if not quoted:
            return found
        closed = len(found) > 1 and found[-1] == found[0]
        return found[0] + "_" * (len(found) - 1 - closed) + found[0] * closed

    return _QUOTED.sub(lambda m: blank(m, False), text), _QUOTED.sub(lambda m: blank(m, True), text)


def statements(text: str) -> list[Statement]:
    """The CREATE TABLE statements of a text.

    A statement ends at a semicolon, at the next CREATE outside parentheses, or with
    the text; items of the column list are parted by its own commas alone. A list
    that is never closed ends with its statement.
    """
    code, shape = shaped(text)
    out, after = [], 0
    for start in _CREATE.finditer(shape):
        if start.start() < after:
            continue
        depth, opened, closed, cuts, stop = 0, None, None, [], len(shape)
        for m in _MARK.finditer(shape, start.end()):
            mark, at = m[0], m.start()
            if mark == "(":
                if opened is None:
                    opened, cuts = at, [at]
                depth += 1
            elif mark == ")":
                depth = max(depth - 1, 0)
                if depth == 0 and closed is None and opened is not None:
                    closed = at
            elif mark == ",":
                if depth == 1 and closed is None:
                    cuts.append(at)
            elif mark == ";" or depth == 0:
                stop = at
                break
        after = stop
        if opened is None:
            out.append(Statement(code[start.start() : stop], [], [], ""))
            continue
        end = stop if closed is None else closed
        bounds = [(a + 1, b) for a, b in zip(cuts, [*cuts[1:], end])]
        out.append(Statement(code[start.start() : opened], [code[a:b] for a, b in bounds], [shape[a:b] for a, b in bounds], "" if closed is None else code[closed + 1 : stop]))
    return out
