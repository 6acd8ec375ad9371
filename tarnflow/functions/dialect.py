"""Expressions of streaming SQL in Spark's dialect.

Expressions are handed to Spark as they are, but for the few spellings that mean
something else there. Rewrites leave quoted text alone.
"""

from __future__ import annotations

import re

_QUOTED = re.compile(r"('(?:[^']|'')*'|`(?:[^`]|``)*`)")
_LISTAGG = re.compile(r"\b(LISTAGG|STRING_AGG)\s*\(", re.I)
_SIMPLE = (
    (re.compile(r"\bPROCTIME\s*\(\s*\)", re.I), "current_timestamp()"),
    (re.compile(r"\bLOCALTIMESTAMP\b(?!\s*\()", re.I), "localtimestamp()"),
    (re.compile(r"\bLOCALTIME\b(?!\s*\()", re.I), "current_time()"),
    (re.compile(r"\bIFNULL\s*\(", re.I), "coalesce("),
)


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Arguments of a call whose bracket opens before ``start``, and where it ends."""
    depth, quote, parts, last, at = 0, "", [], start, start
    while at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")" and depth:
            depth -= 1
        elif c == ")":
            return [*parts, text[last:at]], at
        elif c == "," and not depth:
            parts.append(text[last:at])
            last = at + 1
        at += 1
    raise ValueError(f"unbalanced brackets in {text!r}")


def rewrite(expression: str, order: str | None = None) -> str:
    """The expression as Spark reads it.

    ``order`` is the time column that makes FIRST_VALUE, LAST_VALUE and LISTAGG
    follow the order of arrival in aggregates instead of any order.
    """
    parts = _QUOTED.split(expression)
    for k in range(0, len(parts), 2):
        for pattern, into in _SIMPLE:
            parts[k] = pattern.sub(into, parts[k])
    text = "".join(parts)
    found = _LISTAGG.search(text)
    if found and not re.search(r"WITHIN\s+GROUP", text, re.I):
        arguments, end = _arguments(text, found.end())
        separator = arguments[1].strip() if len(arguments) > 1 else "','"
        within = f" WITHIN GROUP (ORDER BY {order})" if order else ""
        text = f"{text[: found.start()]}listagg({arguments[0].strip()}, {separator}){within}{rewrite(text[end + 1 :], order)}"
    if order:
        for name, function in (("FIRST_VALUE", "min_by"), ("LAST_VALUE", "max_by")):
            while (hit := re.search(rf"\b{name}\s*\(", text, re.I)) is not None:
                arguments, end = _arguments(text, hit.end())
                if re.match(r"\s*OVER\b", text[end + 1 :], re.I):
                    break
                text = f"{text[: hit.start()]}{function}({arguments[0].strip()}, {order}){text[end + 1 :]}"
    return text


def quote(name: str) -> str:
    """An identifier in backticks."""
    return "`" + name.replace("`", "``") + "`"
