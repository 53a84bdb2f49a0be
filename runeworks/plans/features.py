"""Features of support pairs, and the family and subtype they tell."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from runeworks.functions.text import detect_family, strip, tokens

_NUMBER = r"\A\s*[+-]?\d+(?:\.\d+)?\s*\z"
_MEASURE = r"\A\s*[+-]?\d+(?:\.\d+)?\s*[A-Za-z]+\s*\z"
_BINARY = r"\A\s*[01]+\s*\z"
_ROMAN = r"\A\s*[IVXLCDM]+\s*\z"
_EQUATION = r"\A\s*\d+\D\d+\s*\z"
_UNIT = r"(?U)\A\s*[+-]?\d+(?:\.\d+)?\s*([A-Za-z]+)\s*\z"


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def whole_number(text: str) -> int | None:
    """Whole number of any size that a text spells, with ``0x``, ``0b`` or ``0o`` in that base; None for others."""
    low = text.lower()
    base = next((n for mark, n in (("0x", 16), ("0b", 2), ("0o", 8)) if low.startswith((mark, "-" + mark, "+" + mark))), 10)
    try:
        return int(text, base)
    except ValueError:
        return None


def _whole_features(a: str, b: str) -> tuple[float, bool, bool]:
    source, target = whole_number(a), whole_number(b)
    base = source is not None and (target == source or b.lower() in {format(source, "b"), format(source, "o"), format(source, "x")})
    solid = a.replace(" ", "")
    words = a.split() if " " in a.strip() else a.strip()
    counts = (len(a), len(solid), len(words), sum(map(str.isdigit, a)), sum(map(str.isalpha, a)), len(set(solid)))
    return SequenceMatcher(None, a, b).ratio(), base, target is not None and target in counts


@F.pandas_udf(StructType().add("similarity", DoubleType()).add("base_conversion", BooleanType()).add("counting", BooleanType()))
def whole_features(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Share of matching blocks, whether ``b`` is the number ``a`` in some base, and whether it counts something of ``a``."""
    found = [_whole_features(x, y) for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["similarity", "base_conversion", "counting"])


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 1 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def bijective(a: Column, b: Column) -> Column:
    """Whether each character of ``a`` always stands for the same one of ``b``, and the other way round."""
    links = F.size(F.array_distinct(F.arrays_zip(_chars(a), _chars(b))))
    return (F.length(a) == F.length(b)) & (links == F.size(F.array_distinct(_chars(a)))) & (links == F.size(F.array_distinct(_chars(b))))


def _sides(puzzles: DataFrame) -> DataFrame:
    return puzzles.select("id", F.posexplode("parsed_examples").alias("pos", "__p")).select(
        "id", "pos", F.coalesce("__p.input", F.lit("")).alias("a"), F.coalesce("__p.output", F.lit("")).alias("b")
    )


def pair_shapes(puzzles: DataFrame) -> DataFrame:
    """One row per support pair: ``id, pos`` and the features that column functions express."""
    return _sides(puzzles).select("id", "pos", *_shapes())


def pair_features(puzzles: DataFrame) -> DataFrame:
    """One row per support pair: ``id, pos`` and its features. Null sides count as empty."""
    rows = _sides(puzzles).withColumn("__whole", whole_features(F.col("a"), F.col("b")))
    return rows.select("id", "pos", *_shapes(), F.round("__whole.similarity", 9).alias("similarity"), "__whole.base_conversion", "__whole.counting")


def _shapes() -> list[Column]:
    a, b = F.col("a"), F.col("b")
    unit_a, unit_b = F.lower(F.regexp_extract(a, _UNIT, 1)), F.lower(F.regexp_extract(b, _UNIT, 1))
    numeric_a, numeric_b = a.rlike(_NUMBER), b.rlike(_NUMBER)
    return [
        F.length(a).alias("input_length"),
        F.length(b).alias("output_length"),
        (F.length(b) - F.length(a)).alias("length_change"),
        F.round(jaccard(_chars(a), _chars(b)), 9).alias("char_overlap"),
        F.round(jaccard(tokens(a), tokens(b)), 9).alias("token_overlap"),
        (F.array_sort(_chars(a)) == F.array_sort(_chars(b))).alias("same_multiset"),
        (F.reverse(a) == b).alias("reversed"),
        (F.reverse(tokens(a)) == tokens(b)).alias("tokens_reversed"),
        a.rlike(_EQUATION).alias("equation_like"),
        numeric_a.alias("numeric_input"),
        numeric_b.alias("numeric_output"),
        (a.rlike(_BINARY) & b.rlike(_BINARY)).alias("binary"),
        (a.rlike(_MEASURE) & (numeric_b | b.rlike(_MEASURE))).alias("measured"),
        b.rlike(_ROMAN).alias("roman_output"),
        (bijective(a, b) & (a != b) & F.concat(a, b).rlike(r"\p{L}")).alias("char_map"),
        ((unit_a != "") & (unit_b != "") & (unit_a != unit_b)).alias("unit_conversion"),
    ]


def with_block_ratio(puzzles: DataFrame) -> DataFrame:
    """``id, pos, ratio``: the similarity alone, null where a side is."""
    rows = puzzles.select("id", F.posexplode("parsed_examples").alias("pos", "__p"))
    return rows.select("id", "pos", block_ratio(F.col("__p.input"), F.col("__p.output")).alias("ratio"))


def _means(puzzles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Means of the features of each puzzle's pairs, flags as shares; zeros without pairs."""
    flags = [c for c, t in pairs.dtypes if t == "boolean"]
    numbers = [c for c in pairs.columns if c not in ("id", "pos", *flags)]
    means = pairs.groupBy("id").agg(
        F.count(F.lit(1)).alias("pairs"),
        *[F.round(F.avg(c), 9).alias(c) for c in numbers],
        *[F.round(F.avg(F.col(c).cast("double")), 9).alias(c) for c in flags],
    )
    joined = puzzles.select("id").join(means, "id", "left")
    return joined.select("id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in means.columns if c != "id"])


def puzzle_features(puzzles: DataFrame) -> DataFrame:
    """Mean pair features of each puzzle; puzzles without pairs have zeros."""
    return _means(puzzles, pair_features(puzzles))


def puzzle_shapes(puzzles: DataFrame) -> DataFrame:
    """As :func:`puzzle_features`, of the features that need no Python."""
    return _means(puzzles, pair_shapes(puzzles))


def infer_family(pairs: Column) -> Column:
    """Family that support pairs tell where nothing names one; no pairs count as equation.

    Scores: bit, unit and numeral 1.0, equation 0.8, gravity and cipher 0.5; ties go by name.
    """

    def every(test) -> Column:
        return F.forall(pairs, test)

    def ok(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    bit = every(lambda p: ok(p["input"].rlike(_BINARY) & p["output"].rlike(_BINARY)))
    unit = every(lambda p: ok(p["input"].rlike(_MEASURE)))
    numeral = every(lambda p: ok(p["output"].rlike(_ROMAN)))
    equation = every(lambda p: ok(p["input"].rlike(_EQUATION)))
    cipher = F.exists(pairs, lambda p: ok(p["input"].contains(" ") | p["input"].rlike(r"\A[A-Za-z]+\z")))
    gravity = every(lambda p: ok(p["input"].rlike(_NUMBER) & p["output"].rlike(_NUMBER)))
    return (
        F.when(F.coalesce(F.size(pairs), F.lit(0)) < 1, "equation")
        .when(bit, "bit")
        .when(numeral, "numeral")
        .when(unit, "unit")
        .when(equation, "equation")
        .when(cipher, "cipher")
        .when(gravity, "gravity")
        .otherwise("equation")
    )


def shape(pairs: Column) -> Column:
    """Coarse form of the pairs: binary, measurement, numeric_equation, numeric or symbolic."""

    def every(pattern: str, both: bool = False) -> Column:
        return F.forall(
            pairs,
            lambda p: F.coalesce(p["input"].rlike(pattern) & (p["output"].rlike(pattern) if both else F.lit(True)), F.lit(False)),
        )

    return (
        F.when(F.coalesce(F.size(pairs), F.lit(0)) < 1, "symbolic")
        .when(every(_BINARY, True), "binary")
        .when(every(_MEASURE), "measurement")
        .when(every(_EQUATION), "numeric_equation")
        .when(every(_NUMBER, True), "numeric")
        .otherwise("symbolic")
    )


def rotation_of(a: Column, b: Column) -> Column:
    """Whether ``b`` is ``a`` rotated."""
    return (F.length(a) == F.length(b)) & F.concat(a, a).contains(b)


def infer_subtype(family: Column, pairs: Column, query: Column, prompt: Column) -> Column:
    """Subtype by the first test that hits, family by family."""

    def ok(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    def every(test) -> Column:
        return F.forall(pairs, lambda p: ok(test(strip(p["input"]), strip(p["output"]))))

    def some(test) -> Column:
        return F.exists(pairs, lambda p: ok(test(strip(p["input"]), strip(p["output"]))))

    def nibble(a: Column, b: Column) -> Column:
        return (F.length(a) != 8) | (F.concat(F.substring(a, 5, 4), F.substring(a, 1, 4)) == b)

    masks = F.array_distinct(F.transform(pairs, lambda p: F.conv(strip(p["input"]), 2, 10).cast("long").bitwiseXOR(F.conv(strip(p["output"]), 2, 10).cast("long"))))
    bit = (
        F.when(every(rotation_of), "bit_rotate")
        .when(some(lambda a, b: F.length(a) == 8) & every(nibble), "bit_nibble")
        .when(F.size(masks) == 1, "bit_xor_mask")
        .when((F.size(pairs) >= 3) & some(lambda a, b: a != b), "bit_permutation")
        .otherwise("bit_affine")
    )

    counts = every(lambda a, b: (F.size(F.split(a, r"\s+")) == F.size(F.split(b, r"\s+"))) & (F.size(F.split(a, r"\s+")) > 1))
    low = F.lower(F.coalesce(prompt, F.lit("")))
    cipher = (
        F.when(every(bijective), "cipher_char_sub")
        .when(counts, "cipher_token_sub")
        .when(some(lambda a, b: F.array_sort(_chars(a)) == F.array_sort(_chars(b))), "cipher_perm")
        .when(low.contains("vocab") | low.contains("dictionary"), "cipher_vocab")
        .when(low.contains("caesar") | low.contains("shift"), "cipher_char_sub")
        .otherwise("cipher_vocab")
    )
    alnum = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    equation = (
        F.when(every(lambda a, b: a.rlike(_EQUATION)) & ok(query.rlike(_EQUATION)), "equation_numeric")
        .when(every(lambda a, b: alnum(a) == b), "equation_delete")
        .when(every(lambda a, b: F.length(b) <= F.length(a)), "equation_position")
        .when(some(lambda a, b: alnum(a) != a), "equation_template")
        .otherwise("equation_symbolic")
    )
    unit = F.when(some(lambda a, b: b.rlike(r"[A-Za-z]")), "unit_convert").otherwise("unit_scale")
    numeral = F.when(every(lambda a, b: b.rlike(_ROMAN)), "numeral_roman").otherwise("numeral_other")
    return (
        F.when(family == "bit", bit)
        .when(family == "cipher", cipher)
        .when(family == "equation", equation)
        .when(family == "unit", unit)
        .when(family == "numeral", numeral)
        .when(family == "gravity", "gravity_inverse_square")
    )


def apply_tags(puzzles: DataFrame) -> DataFrame:
    """Puzzles with the tags written into ``family``, ``subtype``, ``confidence`` and ``composition_key``; a subtype that is there stays."""
    own = [c for c in puzzles.columns if c not in ("family", "subtype", "confidence", "composition_key")]
    subtype = F.coalesce("subtype", "tag_subtype") if "subtype" in puzzles.columns else F.col("tag_subtype")
    return tagged(puzzles.drop("composition_key")).select(
        *own, F.col("tag_family").alias("family"), subtype.alias("subtype"), F.col("tag_confidence").alias("confidence"), "composition_key"
    )


def tagged(puzzles: DataFrame) -> DataFrame:
    """Puzzles with ``tag_family, tag_subtype, tag_confidence, composition_key``.

    The family is the declared one, else the one the prompt names, else the one the pairs
    tell, at confidence 1 in the first two cases and the pairs' score in the third.
    """
    declared = F.coalesce(F.col("family"), detect_family(F.col("raw_prompt")))
    told = infer_family(F.col("parsed_examples"))
    scores = {"bit": 1.0, "unit": 1.0, "numeral": 1.0, "equation": 0.8, "gravity": 0.5, "cipher": 0.5}
    score = F.element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), told)
    out = puzzles.withColumn("tag_family", F.coalesce(declared, told)).withColumn(
        "tag_confidence", F.when(declared.isNotNull(), 1.0).otherwise(score)
    )
    out = out.withColumn(
        "tag_subtype", infer_subtype(F.col("tag_family"), F.col("parsed_examples"), F.col("query"), F.col("raw_prompt"))
    )
    return out.withColumn("composition_key", F.concat_ws("|", "tag_family", "tag_subtype", shape(F.col("parsed_examples"))))
