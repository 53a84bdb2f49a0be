"""What the search tells about puzzles: annotations, subtype hints, a second search, acceptance of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.signatures import signature_bucket
from runeworks.operators.splits import source_kind
from runeworks.search.engine import search_programs

# Subtypes that tell no more than the family.
GENERAL_SUBTYPES = {"equation": "equation_symbolic", "cipher": "cipher_vocab", "bit": "bit_affine"}

# Operators that point to a subtype, by family, the first group that occurs counts.
HINTS: dict[str, tuple[tuple[tuple[str, ...], str], ...]] = {
    "equation": (
        (("operator_template",), "equation_template"),
        (("position_transducer",), "equation_position"),
        (("delete_characters",), "equation_delete"),
    ),
    "cipher": ((("caesar_shift",), "cipher_char_sub"),),
    "bit": (
        (("binary_rotate_left", "binary_rotate_right"), "bit_rotate"),
        (("binary_xor_mask", "binary_and_mask", "binary_or_mask", "bitwise_xor_constant", "bitwise_and_constant", "bitwise_or_constant"), "bit_xor_mask"),
        (("swap_nibbles", "binary_nibble_map"), "bit_nibble"),
        (("binary_permutation", "reverse_bits"), "bit_permutation"),
    ),
}
PERMUTING, REPLACING = ("reverse_tokens", "sort_tokens"), ("vocabulary_cipher", "fixed_substitution")


def subtype_hint(family: Column, subtype: Column, steps: Column) -> Column:
    """A subtype that the steps of a program tell, for puzzles whose own one tells no more than the family; else null."""

    def uses(names: tuple[str, ...]) -> Column:
        return F.arrays_overlap(steps, F.array(*map(F.lit, names)))

    hint = F.when(F.lit(False), F.lit(None).cast("string"))
    hint = hint.when((family == "cipher") & uses(PERMUTING) & uses(REPLACING), "cipher_perm")
    for name, groups in HINTS.items():
        for operators, told in groups:
            hint = hint.when((family == name) & uses(operators), told)
    general = F.when(F.lit(False), F.lit(False))
    for name, told in GENERAL_SUBTYPES.items():
        general = general.when(family == name, subtype == told)
    return F.when(F.coalesce(general, F.lit(False)), hint)


def annotate(puzzles: DataFrame, beam: int = 8, depth: int = 2) -> DataFrame:
    """Each puzzle with what its two best programs tell.

    Adds ``program_signature, signature_bucket, composition_key, confidence, coverage, verifiable,
    margin, steps, answer, debug``. ``coverage`` is the share of support pairs that the best
    program explains; it is ``verifiable`` if that is all of them and it answers the query.
    ``margin`` is its score less that of the second, 0 without one, and may be negative.
    ``debug`` is the program as JSON. Puzzles without a program have nulls, coverage 0 and margin 0.
    """
    best = search_programs(puzzles, beam, depth, 1)
    shown = F.to_json(F.struct("steps", "parameters", "score", "exact", "confidence", "margin", "support", "answer"))
    told = best.select(
        "id", F.col("signature").alias("program_signature"), signature_bucket(F.col("signature")).alias("signature_bucket"),
        "confidence", F.col("support").alias("__c"), F.col("margin").alias("__m"), "steps", "answer", shown.alias("debug"),
    )
    key = F.concat_ws("|", F.coalesce("family", F.lit("unknown")), F.coalesce("subtype", F.lit("unknown")), "signature_bucket")
    return (
        puzzles.drop("confidence", "margin", "steps", "signature")
        .join(told, "id", "left")
        .withColumn("coverage", F.coalesce("__c", F.lit(0.0)))
        .withColumn("verifiable", (F.col("coverage") == 1.0) & F.col("answer").isNotNull())
        .withColumn("margin", F.coalesce("__m", F.lit(0.0)))
        .withColumn("composition_key", F.when(F.col("program_signature").isNotNull(), key))
        .drop("__c", "__m")
    )


def annotate_missing(puzzles: DataFrame, beam: int = 8, depth: int = 2) -> DataFrame:
    """Only puzzles without a program or confidence are searched; ``puzzles`` has ``program_signature, confidence`` too.

    The others keep what they have, and have no answer, steps or debug text.
    """
    done = F.coalesce((F.col("program_signature") != "") & F.col("confidence").isNotNull(), F.lit(False))
    fresh = annotate(puzzles.where(~done).drop("program_signature"), beam, depth)
    return puzzles.where(done).unionByName(fresh, allowMissingColumns=True)


def quality(prefix: str = "") -> Column:
    """What makes an annotation better than another, in this order: verifiable, coverage, a program, confidence, margin."""
    c = lambda name: F.col(prefix + name)
    return F.struct(
        F.coalesce(c("verifiable"), F.lit(False)), F.coalesce(c("coverage"), F.lit(0.0)), F.coalesce(c("program_signature") != "", F.lit(False)),
        F.coalesce(c("confidence"), F.lit(0.0)), F.coalesce(c("margin"), F.lit(0.0)),
    )


def rescue(annotated: DataFrame, families: tuple[str, ...] = ("bit", "cipher", "equation"), beam: int = 12, depth: int = 4, hints: bool = True) -> DataFrame:
    """A wider and deeper search of official puzzles of hard families that are not verifiable yet.

    ``annotated`` is the result of :func:`annotate` with ``source``. With ``hints`` the search takes the
    subtype that the first program points to. The second annotation replaces the first only
    where it is strictly better by :func:`quality`; ``rescued`` tells where, ``hint`` what was hinted.
    """
    hard = F.col("family").isin(*families) & (source_kind(F.col("source")) == "official") & ~F.col("verifiable")
    hint = subtype_hint(F.col("family"), F.col("subtype"), F.col("steps")) if hints else F.lit(None).cast("string")
    tried = annotated.where(F.coalesce(hard, F.lit(False))).withColumn("hint", hint)
    columns = ("program_signature", "signature_bucket", "composition_key", "confidence", "coverage", "verifiable", "margin", "steps", "answer", "debug")
    again = annotate(
        tried.select("id", "family", F.coalesce("hint", "subtype").alias("subtype"), "query", "parsed_examples"), beam, depth
    ).select("id", *[F.col(c).alias(f"__{c}") for c in columns])
    both = annotated.join(tried.select("id", "hint"), "id", "left").join(again, "id", "left")
    better = F.coalesce(quality("__") > quality(), F.lit(False)) & F.col("__coverage").isNotNull()
    return both.withColumn("rescued", better).withColumns({c: F.when(F.col("rescued"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop(
        *[f"__{c}" for c in columns]
    )


def rescue_counts(rescued: DataFrame) -> DataFrame:
    """Per family: puzzles, those hinted, rescued, and rescued with a hint."""
    hinted = F.col("hint").isNotNull()
    return rescued.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hinted).alias("hinted"), F.count_if("rescued").alias("rescued"), F.count_if(F.col("rescued") & hinted).alias("rescued_with_hint")
    )


def hint_counts(puzzles: DataFrame) -> DataFrame:
    """``family, from_subtype, to_subtype, n``: how often each hint is given to official puzzles (``family, subtype, source, steps``)."""
    hinted = puzzles.where(source_kind(F.col("source")) == "official").withColumn("to_subtype", subtype_hint(*map(F.col, ("family", "subtype", "steps"))))
    return hinted.where("to_subtype IS NOT NULL").groupBy("family", F.col("subtype").alias("from_subtype"), "to_subtype").agg(F.count(F.lit(1)).alias("n"))


def accept(matches_reference: Column, confidence: Column, exact: Column, threshold: float = 0.8) -> Column:
    """``accepted, reason, confidence`` of a label found by the search: it matches the reference, or a sure program explains every pair."""
    matched = F.coalesce(matches_reference, F.lit(False))
    sure = F.coalesce((confidence >= threshold) & (exact >= 1), F.lit(False))
    reason = F.when(matched, "matches_reference").when(sure, "high_confidence_solver_trace").otherwise("low_confidence_or_incorrect")
    return F.struct((matched | sure).alias("accepted"), reason.alias("reason"), F.when(matched, 1.0).otherwise(confidence).alias("confidence"))
