"""SQL for the pN_ queries that SQL can express."""

from __future__ import annotations

# The puzzle that holds, with canonical labels.
PUZZLE = r"""
puzzle AS (
  SELECT id,
    CASE lower(f) WHEN 'bit_manipulation' THEN 'bit' WHEN 'bit_operations' THEN 'bit'
      WHEN 'unit_conversion' THEN 'unit' WHEN 'arithmetic_equation' THEN 'equation' ELSE f END AS family,
    subtype, source, confidence
  FROM (
    SELECT id, nullif(nullif(regexp_replace(lower(regexp_replace(f, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), ''), 'unknown') AS f,
      nullif(nullif(regexp_replace(lower(regexp_replace(s, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), ''), 'unknown') AS subtype,
      nullif(nullif(regexp_replace(lower(regexp_replace(r, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), ''), 'unknown') AS source,
      confidence
    FROM (
      SELECT id, coalesce(metadata.official_family, metadata.family_tags[1]) AS f, metadata.subtype AS s,
        metadata.source AS r, metadata.teacher_confidence AS confidence,
        row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn
      FROM puzzles) WHERE rn = 1))
"""

# Short names of operators inside signatures.
SHORT_OPS = {
    "binary_xor_mask": "xor", "binary_affine_transform": "affine", "binary_rotate_left": "rotl",
    "binary_rotate_right": "rotr", "binary_permutation": "perm", "binary_nibble_map": "nibble",
    "decimal_to_roman": "dec2roman", "scale_measurement": "scale", "unit_convert": "convert",
    "gravity_distance": "inverse_square", "caesar_shift": "caesar", "fixed_substitution": "char_sub",
    "vocabulary_cipher": "vocab_sub", "delete_characters": "delete", "position_transducer": "position",
    "operator_template": "template", "binary_equation_rule": "eq_rule", "add_constant": "add",
    "multiply_constant": "mul", "affine_transform": "affine",
}

RANKED = f"""
WITH {PUZZLE},
alias(long_name, short_name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in SHORT_OPS.items())}),
program AS (
  SELECT DISTINCT id, CASE WHEN trim(coalesce(signature_bucket, '')) = '' THEN signature ELSE signature_bucket END AS b
  FROM program_signatures),
step AS (
  SELECT id, u.i, trim(lower(split_part(list_extract(string_split(b, '>'), u.i), ':', 1))) AS s
  FROM program, LATERAL (SELECT unnest(range(1, len(string_split(b, '>')) + 1)) AS i) u WHERE b IS NOT NULL),
named AS (
  SELECT id, string_agg(coalesce(short_name, s), '>' ORDER BY i) AS contributor
  FROM step LEFT JOIN alias ON s = long_name GROUP BY id),
ranked AS (
  SELECT *, count(*) OVER () AS total, row_number() OVER (PARTITION BY contributor ORDER BY quality DESC, id) AS rk
  FROM (SELECT id, contributor, CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence NOT BETWEEN 0 AND 1 THEN -1 ELSE confidence END AS quality
    FROM named JOIN puzzle USING (id)))
"""

_LIMIT = "least(coalesce(max_records, total), CASE WHEN max_share_bp IS NULL THEN total ELSE greatest(1, total * max_share_bp // 10000) END)"

P4 = f"{RANKED} SELECT policy_name, id FROM ranked, bucket_caps WHERE rk > {_LIMIT}"

P4_CAPPED = f"{RANKED} SELECT policy_name, id, contributor, quality, rk AS rank, rk <= {_LIMIT} AS kept FROM ranked, bucket_caps"


P1 = f"""
WITH {PUZZLE},
cell AS (SELECT source, family, count(*) AS n FROM puzzle WHERE source IS NOT NULL GROUP BY 1, 2),
have AS (
  SELECT t.mix_name, t.source, t.official_family, max_repeats, target_share * total_records AS wanted, coalesce(sum(n), 0) AS n
  FROM mix_targets t LEFT JOIN cell c ON c.source = t.source AND (t.official_family = '*' OR c.family = t.official_family)
  GROUP BY ALL)
SELECT mix_name, source, official_family FROM have WHERE n * max_repeats < floor(round(wanted, 6) + 0.5)
"""

P5 = f"""
WITH {PUZZLE},
n AS (SELECT family, subtype, count(*) AS n FROM puzzle WHERE subtype IS NOT NULL GROUP BY 1, 2)
SELECT plan_name, official_family, q.subtype FROM sample_quotas q
LEFT JOIN n ON n.family = q.official_family AND n.subtype = q.subtype
WHERE coalesce(n.n, 0) < greatest(floor(round(target_share * plan_rows, 6) + 0.5), min_rows)
"""


P5_REPORT = f"""
WITH {PUZZLE},
n AS (SELECT family, subtype, count(*) AS n FROM puzzle WHERE subtype IS NOT NULL GROUP BY 1, 2),
asked AS (
  SELECT DISTINCT plan_name, official_family, q.subtype, greatest(floor(round(target_share * plan_rows, 6) + 0.5), min_rows)::BIGINT AS wanted, coalesce(n.n, 0) AS available
  FROM sample_quotas q LEFT JOIN n ON n.family = q.official_family AND n.subtype = q.subtype),
drawn_ AS (SELECT *, least(wanted, available) AS drawn FROM asked)
SELECT *, greatest(wanted - drawn, 0) AS deficit, coalesce(drawn / nullif(sum(drawn) OVER (PARTITION BY plan_name), 0), 0)::DOUBLE AS actual_share FROM drawn_
"""


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {"p1_found": P1, "p4_found": P4, "p4_capped": P4_CAPPED, "p5_found": P5, "p5_report": P5_REPORT}
