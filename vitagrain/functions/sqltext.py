"""Small helpers for composing Spark SQL expression text.

Column functions in this package take and return SQL expression text. Text
composes inside array lambdas, parses in one step, and lets long word lists
become constant-folded literals instead of hundreds of column objects.
"""

from __future__ import annotations

from collections.abc import Iterable


def raw(value: str) -> str:
    """Raw string literal, for patterns with backslashes."""
    if "'" not in value:
        return f"r'{value}'"
    if '"' not in value:
        return f'r"{value}"'
    raise ValueError(f"pattern mixes both quotes: {value}")


def text(value: str) -> str:
    """Ordinary string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def items(values: Iterable[str]) -> str:
    return ", ".join(text(v) for v in values)


def array(values: Iterable[str]) -> str:
    return f"array({items(values)})"


def matches(value: str, pattern: str) -> str:
    return f"({value}) RLIKE {raw(pattern)}"


def replace(value: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({value}, {raw(pattern)}, {text(by)})"


def let(name: str, value: str, body: str) -> str:
    """Bind a value once inside an expression."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def first(values: str, limit: int | None = None) -> str:
    """The first values of an array, all of them without a limit."""
    return values if limit is None else f"slice({values}, 1, {limit})"


WHITE_SPACE = r"' \t\n\r\u000B\u000C'"


def strip(value: str, characters: str | None = None) -> str:
    """Trim a set of characters, white space by default, from both ends."""
    return f"trim(BOTH {WHITE_SPACE if characters is None else text(characters)} FROM {value})"


#: Runs of white space other than a single blank: what collapsing changes. One bit class decides most characters.
RUNS = r"[ \t\n\x0B\f\r](?:\s|(?<! ))\s*+"


def collapse(value: str) -> str:
    """Runs of white space become one blank; ends are trimmed."""
    return f"trim(regexp_replace({value}, {raw(RUNS)}, ' '))"
