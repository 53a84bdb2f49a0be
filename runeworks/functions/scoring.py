"""Scoring of predictions: exact and tolerant equality of answers."""

from __future__ import annotations

import re
import unicodedata
from decimal import MAX_EMAX, MIN_EMIN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from runeworks.functions.text import TRAILING, _balanced

RELATIVE, ABSOLUTE = 1e-2, 1e-5
# Any exponent that a text may have: what is too large for it is infinite and matches nothing.
_CONTEXT = Context(prec=50, Emax=MAX_EMAX, Emin=MIN_EMIN, traps=[InvalidOperation])
_BLANKS = re.compile(r"\s+")
_END = re.compile(f"[{TRAILING}]+\\Z")
_FRACTION = re.compile(r"([+-]?\d+)/([+-]?\d+)")
_LATEX = re.compile(r"\\frac\{([^{}]+)\}\{([^{}]+)\}")
_BASES = {"0x": 16, "0b": 2, "0o": 8}


def answer_form(text: str | None) -> str:
    """The answer a text gives, in the form for comparison: the content of its single valid box, else all of it."""
    text = text or ""
    if "\\boxed{" in text:
        found = _balanced(text)
        if len(found) == 1 and found[0]:
            text = found[0]
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _END.sub("", _BLANKS.sub(" ", text).strip()).replace("\u2212", "-")


def numeric_value(text: str | None) -> Decimal | None:
    """Value of a number, fraction or prefixed integer; texts that are none, and non-finite ones, have no value."""
    bare = answer_form(text).replace(",", "").replace(" ", "")
    if not bare or not any(c.isdigit() for c in bare):
        return None
    if m := _LATEX.fullmatch(bare):
        above, below = numeric_value(m[1]), numeric_value(m[2])
        value = _CONTEXT.divide(above, below) if above is not None and below else None
        return value if value is not None and value.is_finite() else None
    if m := _FRACTION.fullmatch(bare):
        return _CONTEXT.divide(Decimal(m[1]), below) if (below := Decimal(m[2])) else None
    try:
        base = _BASES.get(bare.lower().lstrip("+-")[:2])
        value = Decimal(int(bare, base)) if base else Decimal(bare)
    except (InvalidOperation, ValueError):
        return None
    return value if value.is_finite() else None


def numbers_match(a: Decimal | None, b: Decimal | None, relative: float = RELATIVE, absolute: float = ABSOLUTE) -> bool:
    """Whether two values differ by no more than the larger of both tolerances."""
    if a is None or b is None:
        return False
    most = max(Decimal(str(absolute)), _CONTEXT.multiply(Decimal(str(relative)), max(a.copy_abs(), b.copy_abs())))
    return _CONTEXT.subtract(a, b).copy_abs() <= most


SCORE = (
    StructType()
    .add("boxed_valid", BooleanType())
    .add("extracted_answer", StringType())
    .add("exact", BooleanType())
    .add("numeric", BooleanType())
)


@F.pandas_udf(SCORE)
def _score(prediction: pd.Series, target: pd.Series) -> pd.DataFrame:
    rows, values = [], {}
    for p, t in zip(prediction, target):
        if p is None:
            rows.append((None, None, None, None))
            continue
        found = _balanced(p)
        valid = len(found) == 1 and bool(found[0])
        if t not in values:
            values[t] = (answer_form(t), numeric_value(t))
        form, number = values[t]
        exact = answer_form(p) == form
        rows.append((valid, found[0] if valid else None, exact, number is not None and numbers_match(numeric_value(p), number)))
    return pd.DataFrame(rows, columns=["boxed_valid", "extracted_answer", "exact", "numeric"])


# What a text of printable ASCII must look like for the JVM to score it as the Python kernel does.
_PRINTABLE = r"^[\x20-\x7E\t\n\r]*\z"
_FLAT_BOX = r"\\boxed\{([^{}]*)\}"
_DECIMAL = r"^[+-]?\d{1,15}(?:\.\d{1,10})?\z"
_NO_NUMBER = r"^[^0-9]*\z|[ghjklmpqsuvwzGHJKLMPQSUVWZ]"


def _simple_form(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"[.!?,;:]+\z", "")


def score(prediction: Column, target: Column) -> Column:
    """Struct of ``boxed_valid, extracted_answer, exact, numeric`` of a prediction against its target.

    A null counts as the empty text, so an empty prediction of an empty target is exact. Texts
    of printable ASCII with closed flat boxes, whose values are plain decimals or hold a
    letter that no number has, are scored in the JVM; only the others go to Python.
    """
    p, t = F.coalesce(prediction, F.lit("")), F.coalesce(target, F.lit(""))

    def parts(x: Column) -> tuple[Column, Column, Column, Column]:
        found = F.transform(F.regexp_extract_all(x, F.lit(_FLAT_BOX), F.lit(1)), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+\z", "")))
        flat = F.regexp_like(x, F.lit(_PRINTABLE)) & (F.size(found) == F.regexp_count(x, F.lit(r"\\boxed\{")))
        valid = (F.size(found) == 1) & (F.get(found, 0) != "")
        form = _simple_form(F.when(valid, F.get(found, 0)).otherwise(x))
        bare = F.regexp_replace(form, "[, ]", "")
        plain = F.regexp_like(bare, F.lit(_DECIMAL))
        number = F.when(plain, bare.try_cast("decimal(25,10)"))
        return flat & (plain | F.regexp_like(bare, F.lit(_NO_NUMBER))), F.when(valid, F.get(found, 0)), form, number

    simple_p, answer, p_form, a = parts(p)
    simple_t, _, t_form, b = parts(t)
    simple = simple_p & simple_t
    least = F.greatest(F.lit(ABSOLUTE).cast("decimal(12,6)"), F.greatest(F.abs(a), F.abs(b)) * F.lit(RELATIVE).cast("decimal(3,2)"))
    near = F.coalesce(F.abs(a - b) <= least, F.lit(False))
    hard = _score(F.when(~simple, p), F.when(~simple, t))
    quick = F.struct(answer.isNotNull().alias("boxed_valid"), answer.alias("extracted_answer"), (p_form == t_form).alias("exact"), near.alias("numeric"))
    return F.when(simple, quick).otherwise(hard)
