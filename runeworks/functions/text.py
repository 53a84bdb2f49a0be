"""Text normalisation and extraction as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Punctuation that does not count at the end of an answer.
TRAILING = "。．.!！?？,，;；:："

# First of these phrases in a prompt tells its family, in this order.
FAMILY_PHRASES = {
    "bit": "bit manipulation rule transforms 8-bit binary numbers",
    "gravity": "gravitational constant has been secretly changed",
    "unit": "secret unit conversion is applied to measurements",
    "cipher": "secret encryption rules are used on text",
    "numeral": "numbers are secretly converted into a different numeral system",
    "equation": "secret set of transformation rules is applied to equations",
}

# Instruction of a family whose prompt has none.
FAMILY_INSTRUCTIONS = {
    "bit": "In Alice's Wonderland, a secret bit manipulation rule transforms 8-bit binary numbers.",
    "gravity": "In Alice's Wonderland, the gravitational constant has been secretly changed.",
    "unit": "In Alice's Wonderland, a secret unit conversion is applied to measurements.",
    "cipher": "In Alice's Wonderland, secret encryption rules are used on text.",
    "numeral": "In Alice's Wonderland, numbers are secretly converted into a different numeral system.",
    "equation": "In Alice's Wonderland, a secret set of transformation rules is applied to equations.",
}

# Fixed value: the sentence that asks for a boxed answer.
ANSWER_CONTRACT = r"Return exactly one final answer as \boxed{...}."


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def is_ascii(col: Column) -> Column:
    """Whether a text holds ASCII characters only."""
    return F.octet_length(col) == F.char_length(col)


def nfkc(col: Column) -> Column:
    """Unicode compatibility composition; the JVM functions have none, so texts beyond ASCII, and only they, go to Python."""
    return F.when(is_ascii(col), col).otherwise(_composed(F.when(~is_ascii(col), col)))


def strip(col: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def collapse_blanks(col: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def strip_trailing_punctuation(col: Column) -> Column:
    """Without the run of sentence marks at the end."""
    return F.regexp_replace(strip(col), f"[{TRAILING}]+\\z", "")


def canonical_text(col: Column) -> Column:
    """NFKC, line ends as ``\\n``, runs of spaces and tabs as one space, stripped."""
    lines = F.regexp_replace(nfkc(col), "\r\n|\r", "\n")
    return strip(F.regexp_replace(lines, "[ \t]+", " "))


def exact_form(col: Column) -> Column:
    """The form in which answers are compared for equality."""
    return F.translate(strip_trailing_punctuation(collapse_blanks(nfkc(col))), "\u2212", "-")


def _balanced(text: str | None) -> list[str]:
    found: list[str] = []
    if not text:
        return found
    mark, at = "\\boxed{", 0
    while (start := text.find(mark, at)) >= 0:
        depth, i = 1, start + len(mark)
        begin = i
        while depth:
            nearest = min((p for p in (text.find("{", i), text.find("}", i)) if p >= 0), default=-1)
            if nearest < 0:
                return found
            depth += 1 if text[nearest] == "{" else -1
            i = nearest + 1
        found.append(text[begin : i - 1].strip())
        at = i
    return found


@F.pandas_udf(ArrayType(StringType()))
def boxed_answers(text: pd.Series) -> pd.Series:
    """Contents of all ``\\boxed{...}`` with balanced braces; an unterminated one ends the search."""
    return text.map(_balanced)


def single_box(boxes: Column) -> Column:
    """``answer, is_valid, error`` of the array of boxed answers: valid with exactly one that is not empty."""
    one = F.get(boxes, 0)
    error = (
        F.when(boxes.isNull() | (F.size(boxes) == 0), "missing_boxed_answer")
        .when(F.size(boxes) > 1, "multiple_boxed_answers")
        .when(one == "", "empty_boxed_answer")
    )
    return F.struct(F.when(error.isNull(), one).alias("answer"), error.isNull().alias("is_valid"), error.alias("error"))


def wrap_boxed(col: Column) -> Column:
    """The stripped text in a box."""
    return F.concat(F.lit("\\boxed{"), strip(col), F.lit("}"))


def boxed_output(col: Column, fallback: Column) -> Column:
    """The single valid box of a text rewrapped, else ``fallback`` in a box."""
    found = single_box(boxed_answers(col))
    return F.when(found["is_valid"], wrap_boxed(found["answer"])).otherwise(wrap_boxed(fallback))


def boxed_or_error(col: Column) -> Column:
    """The single valid box of a text rewrapped; any other text fails the query with the reason."""
    found = single_box(boxed_answers(col))
    return F.when(found["is_valid"], wrap_boxed(found["answer"])).otherwise(F.raise_error(F.concat(F.lit("no single box: "), found["error"])))


def finished(col: Column) -> Column:
    """A generated text as it is kept: its single valid box rewrapped, else stripped."""
    found = single_box(boxed_answers(col))
    return F.when(found["is_valid"], wrap_boxed(found["answer"])).otherwise(strip(col))


def detect_family(prompt: Column) -> Column:
    """Family whose phrase the prompt contains, null without any."""
    low, out = F.lower(prompt), None
    for family, phrase in FAMILY_PHRASES.items():
        hit = low.contains(phrase)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out


def instruction(prompt: Column, family: Column) -> Column:
    """First block of a prompt, else its first line, else the instruction of its family."""
    bare = strip(prompt)
    block = strip(F.split(bare, "\n\n", 2)[0])
    line = strip(F.split(bare, "\n", 2)[0])
    by_family = F.lit("")
    for name, text in reversed(FAMILY_INSTRUCTIONS.items()):
        by_family = F.when(F.coalesce(family, detect_family(prompt)) == name, text).otherwise(by_family)
    return F.when(block != "", block).when(line != "", line).otherwise(by_family)


def with_contract(prompt: Column) -> Column:
    """The prompt with the sentence that asks for a boxed answer, once."""
    bare = strip(prompt)
    return (
        F.when(bare == "", ANSWER_CONTRACT)
        .when(bare.contains(ANSWER_CONTRACT), bare)
        .otherwise(F.concat(bare, F.lit("\n" + ANSWER_CONTRACT)))
    )


def tokens(col: Column) -> Column:
    """Words where the text has spaces, else characters."""
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    return F.when(F.instr(col, " ") > 0, F.filter(F.split(strip(col), r"(?U)\s+"), lambda t: t != "")).otherwise(chars)


def words(col: Column) -> Column:
    """Words between blanks of any kind."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda t: t != "")


def word_count(col: Column) -> Column:
    """Number of :func:`words`."""
    return F.size(words(col))


def isomorph(word: Column) -> Column:
    """Pattern of a word: each character as the number of its first occurrence, such as ``0.1.1.2``."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: (F.array_position(F.array_distinct(chars), c) - 1).cast("string")), ".")


def roman(number: Column) -> Column:
    """Roman numeral of 1..3999; null outside."""
    def digit(place: int, one: str, five: str, ten: str) -> Column:
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        return F.get(F.array(*map(F.lit, forms)), (F.floor(number / place) % 10).cast("int"))

    joined = F.concat(digit(1000, "M", "", ""), digit(100, "C", "D", "M"), digit(10, "X", "L", "C"), digit(1, "I", "V", "X"))
    return F.when(number.between(1, 3999), joined)
