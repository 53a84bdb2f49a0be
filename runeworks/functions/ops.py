"""Catalogue operators that are plain column expressions: no Python in the hot path.

Each function takes the text column (or integer column) first, then the parameters; where
an operator does not apply the result is null.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from runeworks.functions.text import roman, strip

LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _words(x: Column) -> Column:
    return F.split(strip(x), r"(?U)\s+")


def rotate_left(x: Column, k: int) -> Column:
    """Rotated to the left by ``k``; to the right where negative."""
    n = F.length(x)
    at = F.pmod(F.lit(k), F.greatest(n, F.lit(1)))
    return F.concat(F.substr(x, at + 1), F.substr(x, F.lit(1), at))


def reverse_tokens(x: Column) -> Column:
    """Words in reverse order; blank texts as they are."""
    return F.when(strip(x) == "", x).otherwise(F.array_join(F.reverse(_words(x)), " "))


def sort_chars(x: Column) -> Column:
    """Characters in code point order."""
    return F.array_join(F.array_sort(_chars(x)), "")


def sort_tokens(x: Column) -> Column:
    """Words in code point order; blank texts as they are."""
    return F.when(strip(x) == "", x).otherwise(F.array_join(F.array_sort(_words(x)), " "))


def stable_unique_chars(x: Column) -> Column:
    """First occurrence of each character."""
    return F.array_join(F.array_distinct(_chars(x)), "")


def caesar_shift(x: Column, shift: int) -> Column:
    """ASCII letters shifted along the alphabet."""
    k = shift % 26
    return F.translate(x, LOWER + UPPER, LOWER[k:] + LOWER[:k] + UPPER[k:] + UPPER[:k])


def substitute(x: Column, mapping: dict[str, str]) -> Column:
    """Characters replaced by a map of single characters."""
    return F.translate(x, "".join(mapping), "".join(mapping.values()))


def delete_characters(x: Column, chars: str) -> Column:
    """Without the given characters."""
    return F.translate(x, chars, "")


def _signed(v: Column, digits: Column) -> Column:
    return F.concat(F.when(v < 0, "-").otherwise(""), digits)


def decimal_to_binary(v: Column) -> Column:
    """Binary digits with the sign in front."""
    return _signed(v, F.bin(F.abs(v)))


def decimal_to_hex(v: Column) -> Column:
    """Hexadecimal digits with the sign in front."""
    return _signed(v, F.lower(F.hex(F.abs(v))))


def decimal_to_roman(v: Column) -> Column:
    """Roman numeral of 1..3999."""
    return roman(v)


def bits(x: Column) -> Column:
    """The stripped text if it holds only zeros and ones."""
    bare = strip(x)
    return F.when(bare.rlike(r"\A[01]+\z"), bare)


def binary_value(x: Column) -> Column:
    """Value of a binary string."""
    return F.conv(bits(x), 2, 10).cast("long")


def digit_sum(x: Column) -> Column:
    """Sum of the decimal digits; null without any."""
    digits = F.regexp_extract_all(x, F.lit("[0-9]"), F.lit(0))
    return F.when(F.size(digits) > 0, F.aggregate(digits, F.lit(0), lambda a, d: a + d.cast("int")))


# What the filter and count modes keep.
KEPT = {
    "digits": "[^0-9]", "letters": r"\P{L}", "vowels": "[^aeiouAEIOU]", "consonants": r"[\P{L}aeiouAEIOU]", "alnum": r"[^\p{L}\p{N}]",
}


def filter_characters(x: Column, mode: str) -> Column:
    """Only the characters of one kind."""
    return F.regexp_replace(x, KEPT[mode], "")


def count_items(x: Column, mode: str) -> Column:
    """How many characters, words, digits, letters, different characters or vowels a text has."""
    if mode == "chars":
        return F.length(x)
    if mode == "tokens":
        return F.size(F.filter(_words(x), lambda w: w != ""))
    if mode == "unique_chars":
        return F.size(F.array_distinct(_chars(F.replace(x, F.lit(" "), F.lit("")))))
    return F.length(filter_characters(x, mode))


def unit_convert(x: Column, source: str, target: str, factor: float) -> Column:
    """A measurement in another unit, up to ten decimals, none where whole."""
    parts = F.split(strip(x), r"\s+")
    value = F.try_multiply(parts[0].try_cast("double"), F.lit(factor))
    text = F.regexp_replace(F.format_string("%.10f", value), r"\.?0+\z", "")
    return F.when((F.size(parts) == 2) & (F.lower(F.get(parts, 1)) == source) & value.isNotNull(), F.concat(text, F.lit(f" {target}")))


def fixed_decimals(value: Column, decimals: int) -> Column:
    """Rounded half away from zero on the shortest decimal form of a double."""
    exact = value.cast("string").cast("decimal(38,10)")
    return F.round(exact, decimals).cast(f"decimal(38,{decimals})").cast("string")


def scale_measurement(x: Column, factor: float, decimals: int) -> Column:
    """The number of a measurement times ``factor``."""
    return fixed_decimals(F.regexp_extract(x, r"([+-]?\d+(?:\.\d+)?)", 1).try_cast("double") * factor, decimals)


def gravity_distance(t: Column, g: float, decimals: int) -> Column:
    """Distance fallen in ``t`` seconds."""
    return fixed_decimals(F.lit(0.5 * g) * t * t, decimals)


def swap_nibbles(x: Column) -> Column:
    """Halves of a binary string of even length, swapped."""
    b = bits(x)
    half = F.floor(F.length(b) / 2).cast("int")
    return F.when(F.length(b) % 2 == 0, F.concat(F.substr(b, half + 1), F.substr(b, F.lit(1), half)))


def reverse_bits(x: Column) -> Column:
    """A binary string backwards."""
    return F.reverse(bits(x))


def binary_invert(x: Column) -> Column:
    """Zeros and ones exchanged."""
    return F.translate(bits(x), "01", "10")


def binary_rotate(x: Column, k: int) -> Column:
    """A binary string rotated to the left, to the right where negative."""
    return rotate_left(bits(x), k)


def binary_mask(x: Column, mask: int, how: str, width: int = 8) -> Column:
    """A binary string under ``xor``, ``and`` or ``or`` with a mask."""
    v = binary_value(x)
    changed = {"xor": v.bitwiseXOR(mask), "and": v.bitwiseAND(mask), "or": v.bitwiseOR(mask)}[how]
    return F.lpad(F.bin(changed), width, "0")


def binary_permutation(x: Column, order: list[int]) -> Column:
    """Bits in another order; null where the width differs."""
    b = bits(x)
    return F.when(F.length(b) == len(order), F.concat(*[F.substring(b, i + 1, 1) for i in order]))


def binary_nibble_map(x: Column, maps: list[dict[str, str]]) -> Column:
    """Every group of four bits through its map; null for one unseen."""
    b = bits(x)
    parts = [
        F.element_at(F.create_map(*[F.lit(s) for kv in m.items() for s in kv]), F.substring(b, 4 * i + 1, 4)) for i, m in enumerate(maps)
    ]
    return F.when(F.length(b) == 4 * len(maps), F.concat(*parts))


def binary_affine(x: Column, masks: list[int], bias: list[int]) -> Column:
    """Each output bit as the parity of some input bits, plus a bias."""
    b, v = bits(x), binary_value(x)
    parity = [((F.bit_count(v.bitwiseAND(m)) + c) % 2).cast("string") for m, c in zip(masks, bias)]
    return F.when(F.length(b) == len(masks), F.concat(*parity))
