"""Parsing and rendering of the values that operators work on."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextlib import suppress
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import Any

_BASES = {"0x": 16, "0b": 2, "0o": 8}
_MEASURE = re.compile(r"([+-]?\d+(?:\.\d+)?)\s*([A-Za-z]+)?")
_EQUATION = re.compile(r"(\d+)(\D)(\d+)")

# Roman numerals by size.
_ROMAN = (
    (1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"),
    (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"),
)


def _read(text: str, kind: Callable[[str], Any]) -> Any:
    """``kind`` of the stripped text, None where it is no such number."""
    with suppress(ValueError):
        return kind(text.strip())
    return None


@lru_cache(1 << 16)
def whole(text: str) -> int | None:
    """Integer value of a text, prefixes 0x, 0b and 0o understood."""
    return _read(text, lambda bare: int(bare, _BASES.get(bare.lower().lstrip("+-")[:2], 10)))


def real(text: str) -> float | None:
    """Floating value of a text."""
    return _read(text, float)


@lru_cache(1 << 16)
def bits(text: str) -> str | None:
    """The stripped text if it holds only zeros and ones."""
    bare = text.strip()
    return bare if bare and not bare.strip("01") else None


def measure(text: str) -> tuple[float, str | None] | None:
    """Value and lower-case unit of a measurement."""
    m = _MEASURE.fullmatch(text.strip())
    return (float(m[1]), m[2].lower() if m[2] else None) if m else None


def equation(text: str) -> tuple[str, str, str] | None:
    """Left digits, operator sign and right digits of a two-number equation."""
    m = _EQUATION.fullmatch(text.strip())
    return m.groups() if m else None


def places(text: str) -> int:
    """Digits after the decimal point."""
    return len(text.strip().rpartition(".")[2]) if "." in text else 0


def rendered(number: Decimal, most: int, least: int, rounding: str = ROUND_HALF_UP) -> str:
    """``number`` rounded to ``most`` decimals, without the zeros beyond ``least`` of them.

    Written from its whole count of the last decimal: the digits of that count, cut before the decimals.
    """
    digits = str(abs(int(number.scaleb(most).to_integral_value(rounding)))).zfill(most + 1)
    before, after = digits[: len(digits) - most], digits[len(digits) - most :]
    after = after[: max(least, len(after.rstrip("0")))]
    return ("-" if number.is_signed() else "") + before + ("." + after if after else "")


def fixed(value: float, decimals: int) -> str:
    """With that many decimals, halves away from zero on the shortest decimal form."""
    return rendered(Decimal(repr(value)), max(0, decimals), max(0, decimals))


def trimmed(value: float, decimals: int) -> str:
    """As :func:`fixed` without trailing zeros, but with one decimal at least where any were asked for."""
    return rendered(Decimal(repr(value)), max(0, decimals), min(1, max(0, decimals)))


def plain(value: float) -> str:
    """Whole numbers without a point, others with up to ten decimals of their exact value."""
    return f"{value:.0f}".removeprefix("-" * (value == 0)) if float(value).is_integer() else rendered(Decimal(value), 10, 0, ROUND_HALF_EVEN)


def to_roman(value: int) -> str | None:
    """Roman numeral of 1..3999."""
    if not 0 < value < 4000:
        return None
    out = []
    for size, sign in _ROMAN:
        times, value = divmod(value, size)
        out.append(sign * times)
    return "".join(out)


@lru_cache(1 << 16)
def isomorph(word: str) -> tuple[int, ...]:
    """Each character as the number of its first occurrence."""
    seen: dict[str, int] = {}
    return tuple(seen.setdefault(c, len(seen)) for c in word)
