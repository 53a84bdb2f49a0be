"""Program signatures and their coarse buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runeworks.functions.labels import lookup

# Short names of operators inside signatures.
OP_SHORT_NAMES = {
    "binary_xor_mask": "xor",
    "binary_affine_transform": "affine",
    "binary_rotate_left": "rotl",
    "binary_rotate_right": "rotr",
    "binary_permutation": "perm",
    "binary_nibble_map": "nibble",
    "swap_nibbles": "swap_nibbles",
    "reverse_bits": "reverse_bits",
    "decimal_to_roman": "dec2roman",
    "scale_measurement": "scale",
    "unit_convert": "convert",
    "gravity_distance": "inverse_square",
    "caesar_shift": "caesar",
    "fixed_substitution": "char_sub",
    "vocabulary_cipher": "vocab_sub",
    "delete_characters": "delete",
    "position_transducer": "position",
    "operator_template": "template",
    "binary_equation_rule": "eq_rule",
    "add_constant": "add",
    "multiply_constant": "mul",
    "affine_transform": "affine",
}


def signature_bucket(signature: Column) -> Column:
    """``a:p>b:q`` becomes ``a>b``: the parameters go, the steps stay."""
    return F.array_join(
        F.transform(F.split(signature, ">"), lambda s: F.trim(F.split(s, ":", 2)[0])), ">"
    )


def bucket_key(bucket: Column, signature: Column) -> Column:
    """Bucket in short operator names however it is typed, from ``signature`` where it is null or empty.

    Letter case, blanks, separators inside names, long operator names and left-over
    parameters make no difference. Null when neither column names a step.
    """

    def coarse(text: Column) -> Column:
        bare = F.regexp_replace(F.lower(text), r"(?U)^[\s\u200b]+|[\s\u200b]+\z", "")

        def step(s: Column) -> Column:
            name = F.regexp_replace(F.split(s, ":", 2)[0], r"(?U)^[\s\u200b]+|[\s\u200b]+\z", "")
            return lookup(F.regexp_replace(name, r"(?U)[\s\-_]+", "_"), OP_SHORT_NAMES)

        joined = F.array_join(F.transform(F.split(bare, "[>→]"), step), ">")
        return F.when((bare != "") & (bare != "unknown") & (joined != ""), joined)

    return F.coalesce(coarse(bucket), coarse(signature))
