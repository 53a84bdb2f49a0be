"""Evaluation of arithmetic expressions with floor division, modulo and powers."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|//|[-+*/%()]))")


def evaluate(text: str) -> float | None:
    """Value of an expression of numbers, ``+ - * / // % **`` and brackets; None if it is none or has no finite value."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        tokens.append(float(m[1]) if m[1] else m[2])
        at = m.end()
    tokens.append(None)
    place = 0

    def take(*signs: str) -> str | None:
        nonlocal place
        if tokens[place] in signs and isinstance(tokens[place], str):
            place += 1
            return tokens[place - 1]
        return None

    def chain(part, *signs):
        value = part()
        while sign := take(*signs):
            other = part()
            if sign == "+":
                value += other
            elif sign == "-":
                value -= other
            elif sign == "*":
                value *= other
            elif sign == "/":
                value /= other
            elif sign == "//":
                value //= other
            else:
                value %= other
        return value

    def total() -> float:
        return chain(product, "+", "-")

    def product() -> float:
        return chain(signed, "*", "/", "//", "%")

    def signed() -> float:
        sign = take("+", "-")
        if sign:
            value = signed()
            return -value if sign == "-" else value
        return power()

    def power() -> float:
        value = atom()
        return value ** signed() if take("**") else value

    def atom() -> float:
        nonlocal place
        if take("("):
            value = total()
            if not take(")"):
                raise ValueError("open bracket")
            return value
        value = tokens[place]
        if not isinstance(value, float):
            raise ValueError("no number")
        place += 1
        return value

    try:
        value = total()
    except (ValueError, ArithmeticError, RecursionError, TypeError):  # the last: a complex number in //, % or **
        return None
    if place != len(tokens) - 1 or isinstance(value, complex) or value != value or value in (float("inf"), float("-inf")):
        return None
    return value
