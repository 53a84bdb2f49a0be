"""Canonical labels: family, subtype, source, split, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family names that stand for another family.
FAMILY_ALIASES = {
    "bit_manipulation": "bit",
    "bit_operations": "bit",
    "unit_conversion": "unit",
    "arithmetic_equation": "equation",
}

# Three-letter language codes and their two-letter forms.
LANGUAGE_CODES = {
    "eng": "en",
    "deu": "de",
    "ger": "de",
    "fra": "fr",
    "fre": "fr",
    "spa": "es",
    "rus": "ru",
    "jpn": "ja",
}


def lookup(key: Column, table: dict[str, str]) -> Column:
    """``table[key]``, or ``key`` itself where the table has no such entry."""
    pairs = [F.lit(x) for entry in table.items() for x in entry]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), key)


def label(col: Column) -> Column:
    """Label without its typing: case, outer blanks and kind of separator.

    ``" Bit-Xor mask"`` becomes ``bit_xor_mask``. Null, empty and ``unknown``
    give null: there is no label.
    """
    bare = F.regexp_replace(F.lower(col), r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+\z", "")
    joined = F.regexp_replace(bare, r"(?U)[\s_\-‐-―]+", "_")
    return F.nullif(F.nullif(joined, F.lit("")), F.lit("unknown"))


def family_label(col: Column, tags: Column | None = None) -> Column:
    """Canonical family; a null family falls back on the first of ``tags``."""
    raw = col if tags is None else F.coalesce(col, F.get(tags, 0))
    return lookup(label(raw), FAMILY_ALIASES)


def language(col: Column) -> Column:
    """Two-letter language of a code such as ``en-GB``, ``ENG`` or ``en``; null and ``und`` give null."""
    base = F.regexp_extract(F.lower(F.trim(col)), r"^([a-z]{2,3})", 1)
    return F.when((base != "") & (base != "und"), lookup(base, LANGUAGE_CODES))
