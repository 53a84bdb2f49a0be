"""SQL of the registered queries that SQL can express on whole tables."""

from __future__ import annotations

from runeworks.functions.text import FAMILY_INSTRUCTIONS, FAMILY_PHRASES
from runeworks.plans.prompts import EQUATION, PAIR_FORMS, QUERY_FORMS, STARTS
from runeworks.plans.queries import BIAS, LETTERS, MASKS, NIBBLES
from runeworks.plans.replica import ANNOUNCED
from runeworks.plans.teacher import GENERAL_SUBTYPES, HINTS, PERMUTING, REPLACING

LOW = "abcdefghijklmnopqrstuvwxyz"

# Fixed value: what counts as a blank in Unicode.
_BLANK = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _label(col: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({col}), '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g')"
    return f"nullif(nullif({bare}, ''), 'unknown')"


def _family(col: str) -> str:
    return (
        f"CASE {_label(col)} WHEN 'bit_manipulation' THEN 'bit' WHEN 'bit_operations' THEN 'bit' "
        f"WHEN 'unit_conversion' THEN 'unit' WHEN 'arithmetic_equation' THEN 'equation' ELSE {_label(col)} END"
    )


PUZZLE = f"""puzzle AS (
  SELECT id, query, target_answer, raw_prompt, parsed_examples, {_family('f')} AS family, {_label('s')} AS subtype,
    {_label('r')} AS source, {_label('x')} AS split, CASE WHEN isnan(conf) THEN NULL ELSE conf END AS confidence, conf, difficulty
  FROM (SELECT id, query, target_answer, raw_prompt, parsed_examples, coalesce(metadata.official_family, metadata.family_tags[1]) AS f,
      metadata.subtype AS s, metadata.source AS r, metadata.split AS x, metadata.teacher_confidence AS conf, metadata.difficulty AS difficulty,
      row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM puzzles) WHERE rn = 1)"""

RECORD = f"""record AS (
  SELECT record_id, id, prompt, completion, stage, {_family('official_family')} AS family, {_label('subtype')} AS subtype,
    target_answer, program_signature AS signature
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY built_at DESC) AS rn FROM sft_records) WHERE rn = 1)"""

PROGRAM = f"""program AS (
  SELECT id, {_family('official_family')} AS family, {_label('subtype')} AS subtype, steps, signature, signature_bucket
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY solved_at DESC) AS rn FROM program_signatures) WHERE rn = 1)"""

EVAL = rf"""answer AS (
  SELECT *, CASE WHEN len(boxes) = 1 AND boxes[1] <> '' THEN boxes[1] END AS extracted
  FROM (SELECT record_id, run_id, example_id, coalesce(prediction, '') AS prediction, coalesce(target, '') AS target,
      {_family('official_family')} AS family, {_label('subtype')} AS subtype,
      [regexp_replace(b, '^\s+|\s+$', '', 'g') for b in regexp_extract_all(coalesce(prediction, ''), '\\boxed\{{([^{{}}]*)\}}', 1)] AS boxes
    FROM {{SOURCE}})),
form AS (
  SELECT *, {{p}} AS pf, {{t}} AS tf FROM answer),
number AS (
  SELECT *, try_cast(replace(replace(pf, ',', ''), ' ', '') AS DOUBLE) AS pn, try_cast(replace(replace(tf, ',', ''), ' ', '') AS DOUBLE) AS tn FROM form),
score AS (
  SELECT *, extracted IS NOT NULL AS boxed_valid, pf = tf AS exact,
    coalesce(isfinite(pn) AND isfinite(tn) AND abs(pn - tn) <= greatest(1e-5, 1e-2 * greatest(abs(pn), abs(tn))), false) AS numeric,
    len([w for w in regexp_split_to_array(prediction, '{{BLANKS}}') if w <> '']) AS output_tokens FROM number),
scored AS (SELECT *, exact OR numeric AS correct FROM score)"""

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_PLAIN = "".join(chr(0x21 + i) for i in range(94))


def _form(col: str) -> str:
    wide, plain = _WIDE.replace("'", "''"), _PLAIN.replace("'", "''")
    text = rf"regexp_replace(translate({col}, '{wide}', '{plain}'), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g')"
    return rf"regexp_replace(trim({text}), '[。．.!！?？,，;；:：]+$', '')"


_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC) AS rn FROM eval_records) WHERE rn = 1)"
_WITH_LABELS = f"""(SELECT e.record_id, e.run_id, e.example_id, e.prediction, p.target_answer AS target, p.family AS official_family, p.subtype
      FROM {_LAST} e JOIN puzzle p ON p.id = e.example_id)"""
EVAL = EVAL.replace("{BLANKS}", _BLANK).replace("{p}", _form("coalesce(extracted, prediction)")).replace("{t}", _form("target"))
JOINED = EVAL.replace("{SOURCE}", _WITH_LABELS)
EVAL = EVAL.replace("{SOURCE}", _LAST)

_MEASURES = """count(*) AS n, round(coalesce(avg(boxed_valid::DOUBLE), 0), 9) AS boxed_rate, round(coalesce(avg(exact::DOUBLE), 0), 9) AS exact_rate,
  round(coalesce(avg(numeric::DOUBLE), 0), 9) AS numeric_rate, round(coalesce(avg(correct::DOUBLE), 0), 9) AS correct_rate,
  round(1 - round(coalesce(avg(boxed_valid::DOUBLE), 0), 9), 9) AS invalid_rate, round(coalesce(avg(output_tokens), 0), 9) AS mean_output_tokens"""

# Operators.

P = "SELECT p_partkey AS id, ({}) AS value FROM part"
N = "SELECT o_orderkey AS id, CAST({} AS VARCHAR) AS value FROM (SELECT o_orderkey, o_custkey - 50 AS v FROM orders)"
B = "SELECT p_partkey AS id, ({}) AS value FROM (SELECT p_partkey, p_partkey % 256 AS v, lpad(bin(p_partkey % 256), 8, '0') AS b FROM part)"


def _roman(v: str) -> str:
    forms = [("", "M", "MM", "MMM")]
    for one, five, ten in (("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")):
        forms.append(("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))
    parts = [f"list_extract({list(f)!r}, (({v}) // {10 ** (3 - i)} % 10)::INT + 1)" for i, f in enumerate(forms)]
    return f"CASE WHEN {v} BETWEEN 1 AND 3999 THEN {' || '.join(parts)} END"


def _shifted(k: int) -> tuple[str, str]:
    return LOW + LOW.upper(), LOW[k:] + LOW[:k] + LOW.upper()[k:] + LOW.upper()[:k]


_CHARS = "string_split(p_name, '')"
_WORDS = "string_split(trim(p_name), ' ')"
_PARITY = " || ".join(f"CAST((bit_count((v & {m})::BIGINT) + {c}) % 2 AS VARCHAR)" for m, c in zip(MASKS, BIAS))
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NIBBLES.items())
_VOWEL = "[^aeiouAEIOU]"

OPERATORS = {
    "op_identity": P.format("p_name"),
    "op_reverse_string": P.format("reverse(p_name)"),
    "op_reverse_tokens": P.format(f"array_to_string(list_reverse({_WORDS}), ' ')"),
    "op_rotate_left": P.format("substr(p_name, 3 % length(p_name) + 1) || substr(p_name, 1, 3 % length(p_name))"),
    "op_rotate_right": P.format("right(p_name, 2) || left(p_name, length(p_name) - 2)"),
    "op_sort_chars": P.format(f"array_to_string(list_sort({_CHARS}), '')"),
    "op_sort_tokens": P.format(f"array_to_string(list_sort({_WORDS}), ' ')"),
    "op_stable_unique_chars": f"""SELECT id, string_agg(c, '' ORDER BY i) AS value FROM (SELECT id, c, min(i) AS i FROM (
        SELECT p_partkey AS id, unnest({_CHARS}) AS c, generate_subscripts({_CHARS}, 1) AS i FROM part) GROUP BY 1, 2) GROUP BY 1""",
    "op_caesar_shift": P.format("translate(p_name, '%s', '%s')" % _shifted(5)),
    "op_fixed_substitution": P.format(f"translate(p_name, '{''.join(LETTERS)}', '{''.join(LETTERS.values())}')"),
    "op_delete_characters": P.format("replace(replace(p_name, 'a', ''), 'e', '')"),
    "op_decimal_to_binary": N.format("CASE WHEN v < 0 THEN '-' ELSE '' END || bin(abs(v))"),
    "op_binary_to_decimal": B.format("CAST(v AS VARCHAR)"),
    "op_decimal_to_hex": N.format("CASE WHEN v < 0 THEN '-' ELSE '' END || lower(to_hex(abs(v)))"),
    "op_decimal_to_roman": N.format(_roman("v")),
    "op_add_constant": N.format("v + 7"),
    "op_multiply_constant": N.format("v * -3"),
    "op_affine_transform": N.format("v * 2 + 5"),
    "op_digit_sum": N.format("list_sum([d::INT for d in regexp_extract_all(CAST(v AS VARCHAR), '[0-9]')])"),
    "op_filter_digits": P.format("regexp_replace(p_name, '[^0-9]', '', 'g')"),
    "op_filter_letters": P.format("regexp_replace(p_name, '[^a-zA-Z]', '', 'g')"),
    "op_filter_vowels": P.format(f"regexp_replace(p_name, '{_VOWEL}', '', 'g')"),
    "op_filter_consonants": P.format(r"regexp_replace(p_name, '[^b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]', '', 'g')"),
    "op_filter_alnum": P.format("regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')"),
    "op_count_chars": P.format("CAST(length(p_name) AS VARCHAR)"),
    "op_count_tokens": P.format(f"CAST(len({_WORDS}) AS VARCHAR)"),
    "op_count_digits": P.format("CAST(length(regexp_replace(p_name, '[^0-9]', '', 'g')) AS VARCHAR)"),
    "op_count_letters": P.format("CAST(length(regexp_replace(p_name, '[^a-zA-Z]', '', 'g')) AS VARCHAR)"),
    "op_count_unique_chars": P.format("CAST(len(list_distinct(string_split(replace(p_name, ' ', ''), ''))) AS VARCHAR)"),
    "op_count_vowels": P.format(f"CAST(length(regexp_replace(p_name, '{_VOWEL}', '', 'g')) AS VARCHAR)"),
    "op_unit_convert": N.format("CAST(v * 1000 AS VARCHAR) || ' m'"),
    "op_scale_measurement": N.format("CAST(CAST(v * 75 AS DECIMAL(38, 2)) / 100 AS DECIMAL(38, 2))"),
    "op_gravity_distance": N.format("CAST(CAST(475 * v * v AS DECIMAL(38, 2)) / 100 AS DECIMAL(38, 2))"),
    "op_binary_permutation": B.format(" || ".join(f"substr(b, {i + 1}, 1)" for i in (3, 0, 1, 2, 7, 6, 5, 4))),
    "op_binary_nibble_map": B.format(f"CASE left(b, 4) {_CASES} END || CASE right(b, 4) {_CASES} END"),
    "op_swap_nibbles": B.format("right(b, 4) || left(b, 4)"),
    "op_reverse_bits": B.format("reverse(b)"),
    "op_binary_rotate_left": B.format("right(b, 5) || left(b, 3)"),
    "op_binary_rotate_right": B.format("right(b, 3) || left(b, 5)"),
    "op_binary_invert": B.format("translate(b, '01', '10')"),
    "op_binary_xor_mask": B.format("lpad(bin(xor(v, 177)), 8, '0')"),
    "op_binary_and_mask": B.format("lpad(bin(v & 177), 8, '0')"),
    "op_binary_or_mask": B.format("lpad(bin(v | 177), 8, '0')"),
    "op_binary_affine_transform": B.format(_PARITY),
    "op_bitwise_xor_constant": N.format("xor(v, 3)"),
    "op_bitwise_and_constant": N.format("v & 7"),
    "op_bitwise_or_constant": N.format("v | 1"),
}

# Fits.

PAIR = """pair AS (SELECT o_orderkey AS id, l_quantity::BIGINT AS x, l_partkey % 256 AS b, o_custkey AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ONE = "CASE WHEN min(v) = max(v) THEN min(v) END AS parameter, count(*) AS pairs"

FITS = {
    "fit_xor_mask": f"WITH {PAIR} SELECT id, {_ONE} FROM (SELECT id, (CASE WHEN b % 17 = 0 THEN c + 1 ELSE c END) % 256 AS v FROM pair) GROUP BY id",
    "fit_or_mask": f"WITH {PAIR} SELECT id, {_ONE} FROM (SELECT id, xor(b, b | (c % 16)) AS v FROM pair) GROUP BY id",
    "fit_add_constant": f"WITH {PAIR} SELECT id, {_ONE} FROM (SELECT id, c % 11 - CASE WHEN x = 13 THEN 1 ELSE 0 END AS v FROM pair) GROUP BY id",
    "fit_multiply_constant": f"WITH {PAIR} SELECT id, {_ONE} FROM (SELECT id, c % 5 + 1 AS v FROM pair WHERE x <> 0) GROUP BY id",
    "fit_affine": f"WITH {PAIR} SELECT id, min(c % 5 + 1) AS a, min(c % 11) AS b, count(*) AS pairs FROM pair GROUP BY id HAVING min(x) < max(x)",
    "fit_scale": f"WITH {PAIR} SELECT id, round(avg((c % 3 + 1) * 0.25::DOUBLE), 6) AS factor, count(*) AS pairs FROM pair WHERE x > 0 GROUP BY id",
}

_TRIED = [
    ("identity", "a"), ("decimal_to_roman", _roman("try_cast(a AS BIGINT)")), ("reverse_string", "reverse(a)"), ("sort_chars", "array_to_string(list_sort(string_split(a, '')), '')"),
    ("stable_unique_chars", "(SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, min(i) AS i FROM (SELECT unnest(string_split(a, '')) AS c, generate_subscripts(string_split(a, ''), 1) AS i) GROUP BY c))"),
    *[(f"rotate_left:{k}", f"CASE WHEN a = '' THEN '' ELSE substr(a, {k} % length(a) + 1) || substr(a, 1, {k} % length(a)) END") for k in range(1, 8)],
    *[(f"caesar_shift:{k:02d}", "translate(a, '%s', '%s')" % _shifted(k)) for k in range(1, 26)],
]

DEPTH1 = f"""WITH {PUZZLE}, given AS (SELECT id, e.input AS a, coalesce(e.output, '') AS b FROM (SELECT id, unnest(parsed_examples) AS e FROM puzzle) WHERE e.input IS NOT NULL),
tested AS (SELECT id, count(*) AS pairs, {', '.join(f"bool_and(coalesce(({sql}) = b, false)) AS h{i}" for i, (_, sql) in enumerate(_TRIED))} FROM given GROUP BY id),
named AS (SELECT id, pairs, CASE {' '.join(f"WHEN h{i} THEN '{name}'" for i, (name, _) in enumerate(_TRIED))} END AS program FROM tested)
SELECT * FROM named WHERE program IS NOT NULL"""

JUDGED = rf"""{EVAL}, {PUZZLE}, {PROGRAM}, judged AS (
  SELECT *, CASE error_type WHEN 'format_error' THEN 'format' WHEN 'numeric_only' THEN 'numeric_margin' WHEN 'wrong_family' THEN 'wrong_family'
    WHEN 'wrong_subtype' THEN 'wrong_rule' WHEN 'wrong_signature' THEN 'wrong_rule' WHEN 'search_miss' THEN 'wrong_rule' ELSE 'low_confidence' END AS reason
  FROM (SELECT s.record_id, s.example_id, s.correct, s.numeric, s.boxed_valid, p.family, p.subtype, p.confidence,
    CASE WHEN s.correct AND s.numeric AND NOT s.exact THEN 'numeric_only' WHEN s.correct THEN 'correct' WHEN NOT s.boxed_valid THEN 'format_error'
      WHEN s.family <> p.family THEN 'wrong_family' WHEN s.subtype <> p.subtype THEN 'wrong_subtype'
      WHEN nullif(regexp_extract(s.prediction, '(?:^|[;|])\s*sig=([^;|\s]+)', 1), '') <> g.signature THEN 'wrong_signature'
      WHEN coalesce(p.confidence, 0) < 0.5 THEN 'low_confidence' ELSE 'search_miss' END AS error_type
    FROM scored s JOIN puzzle p ON s.example_id = p.id LEFT JOIN program g ON g.id = p.id))"""


def _key(seed: int, col: str) -> str:
    return f"md5('{seed}|' || {col})"


def _group_split(seed: int, within: bool) -> str:
    part = "PARTITION BY family" if within else ""
    target = "greatest(floor(count(*) * 0.15), 1)"
    keep = "WHERE family IS NOT NULL" if within else ""
    totals = f"SELECT family, {target} AS target FROM grouped GROUP BY family" if within else f"SELECT {target} AS target FROM grouped"
    return f"""WITH {PROGRAM}, grouped AS (SELECT id, family, concat_ws('|', family, subtype, coalesce(signature, {_BUCKET})) AS grp FROM program {keep}),
sized AS (SELECT {'family,' if within else ''} grp, count(*) AS n FROM grouped GROUP BY ALL),
taken AS (SELECT *, coalesce(sum(n) OVER ({part} ORDER BY n, {_key(seed, 'grp')}, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
total AS ({totals})
SELECT g.id, {'g.family,' if within else ''} CASE WHEN t.before < total.target THEN 'valid' ELSE 'train' END AS role
FROM grouped g JOIN taken t ON g.grp = t.grp {'AND g.family = t.family JOIN total ON total.family = g.family' if within else ', total'}"""


_ALIASES = {
    "binary_xor_mask": "xor", "binary_affine_transform": "affine", "binary_rotate_left": "rotl", "binary_rotate_right": "rotr",
    "binary_permutation": "perm", "binary_nibble_map": "nibble", "decimal_to_roman": "dec2roman", "scale_measurement": "scale",
    "unit_convert": "convert", "gravity_distance": "inverse_square", "caesar_shift": "caesar", "fixed_substitution": "char_sub",
    "vocabulary_cipher": "vocab_sub", "delete_characters": "delete", "position_transducer": "position", "operator_template": "template",
    "binary_equation_rule": "eq_rule", "add_constant": "add", "multiply_constant": "mul", "affine_transform": "affine",
}


def _bucket_of(col: str) -> str:
    step = "trim(lower(split_part(s, ':', 1)))"
    case = f"CASE {step} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALIASES.items())} ELSE {step} END"
    return f"array_to_string([{case} for s in string_split({col}, '>')], '>')"


_BUCKET = f"CASE WHEN trim(coalesce(signature_bucket, '')) = '' THEN {_bucket_of('signature')} ELSE {_bucket_of('signature_bucket')} END"

_HARD = "family IN ('cipher', 'bit', 'equation')"
_EDGES = f"""WITH {PROGRAM}, edge AS (SELECT family, steps[i] AS lhs, steps[i + 1] AS rhs FROM (SELECT family, steps, unnest(range(1, len(steps))) AS i FROM program WHERE steps IS NOT NULL))"""
_WORDS_OF = "len([w for w in regexp_split_to_array({}, '" + _BLANK.replace("{", "{{").replace("}", "}}") + "') if w <> ''])"
_MEASURED = f"""measured AS (SELECT *, {_WORDS_OF.format('prompt')} + {_WORDS_OF.format('completion')} AS total_words
  FROM record WHERE length(prompt) > 0 AND length(completion) > 0)"""


def _percentile(q: float) -> str:
    return f"quantile_disc(total_words, {q})::BIGINT AS p{int(q * 100)}"


def _stripped(col: str) -> str:
    return f"regexp_replace({col}, '^{_BLANK}|{_BLANK}$', '', 'g')"


def _last_of(found: str) -> str:
    return f"[x for x in [{_stripped('y')} for y in {found}] if x <> ''][-1]"


_OFFICIAL = ", ".join(
    [_last_of(r"regexp_extract_all(text, '\\boxed\{([^}]*)(?:\}|$)', 1)")]
    + [_last_of(f"regexp_extract_all(text, '{form}', 1)") for form in ANNOUNCED]
    + [_last_of(r"regexp_extract_all(text, '(-?\d+(?:\.\d+)?)', 1)"), _last_of("string_split(text, chr(10))"), "'NOT_FOUND'"]
)

_PRINT = "[c for c in string_split({}, '') if c <> '']"
_TOKENS = "CASE WHEN contains({0}, ' ') THEN [t for t in regexp_split_to_array(" + _stripped("{0}").replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + ", '" + _BLANK.replace("{", "{{").replace("}", "}}") + "') if t <> ''] ELSE " + _PRINT.replace("{}", "{0}") + " END"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"round(CASE WHEN {both} = 0 THEN 1.0 ELSE len(list_distinct(list_intersect({a}, {b})))::DOUBLE / {both} END, 9)"


# The line forms of the features, as the engine of the SQL writes them.
_NUM, _MEAS, _BIN, _ROM, _EQ, _UNIT_OF = (
    r"^\s*[+-]?\d+(?:\.\d+)?\s*$", r"^\s*[+-]?\d+(?:\.\d+)?\s*[A-Za-z]+\s*$", r"^\s*[01]+\s*$", r"^\s*[IVXLCDM]+\s*$", r"^\s*\d+\D\d+\s*$",
    "^" + _BLANK[:-1] + r"*[+-]?\d+(?:\.\d+)?" + _BLANK[:-1] + "*([A-Za-z]+)" + _BLANK[:-1] + "*$",
)
_CHARS_A, _CHARS_B = _PRINT.format("a"), _PRINT.format("b")
_LINKS = "len(list_distinct([z[1] || chr(1) || z[2] for z in list_zip(ca, cb)]))"

SHAPES = f"""WITH {PUZZLE}, side AS (SELECT id, pos - 1 AS pos, coalesce(e.input, '') AS a, coalesce(e.output, '') AS b
    FROM (SELECT id, unnest(parsed_examples) AS e, generate_subscripts(parsed_examples, 1) AS pos FROM puzzle)),
  split_ AS (SELECT *, {_CHARS_A} AS ca, {_CHARS_B} AS cb, {_TOKENS.format('a')} AS ta, {_TOKENS.format('b')} AS tb,
    lower(regexp_extract(a, '{_UNIT_OF}', 1)) AS ua, lower(regexp_extract(b, '{_UNIT_OF}', 1)) AS ub FROM side)
  SELECT id, pos, length(a) AS input_length, length(b) AS output_length, length(b) - length(a) AS length_change, {_jaccard('ca', 'cb')} AS char_overlap, {_jaccard('ta', 'tb')} AS token_overlap,
    list_sort(ca) = list_sort(cb) AS same_multiset, list_reverse(ca) = cb AS reversed, list_reverse(ta) = tb AS tokens_reversed, regexp_matches(a, '{_EQ}') AS equation_like,
    regexp_matches(a, '{_NUM}') AS numeric_input, regexp_matches(b, '{_NUM}') AS numeric_output, regexp_matches(a, '{_BIN}') AND regexp_matches(b, '{_BIN}') AS binary,
    regexp_matches(a, '{_MEAS}') AND (regexp_matches(b, '{_NUM}') OR regexp_matches(b, '{_MEAS}')) AS measured, regexp_matches(b, '{_ROM}') AS roman_output,
    length(a) = length(b) AND {_LINKS} = len(list_distinct(ca)) AND {_LINKS} = len(list_distinct(cb)) AND a <> b AND regexp_matches(a || b, '\\p{{L}}') AS char_map,
    ua <> '' AND ub <> '' AND ua <> ub AS unit_conversion FROM split_"""


_MEANS = ("input_length", "output_length", "length_change", "char_overlap", "token_overlap")
_FLAGS = (
    "same_multiset", "reversed", "tokens_reversed", "equation_like", "numeric_input", "numeric_output", "binary", "measured", "roman_output", "char_map",
    "unit_conversion",
)


def _every(test: str, of: str = "ps") -> str:
    return f"(CASE WHEN {of} IS NOT NULL THEN coalesce(list_bool_and([coalesce({test}, false) for p in {of}]), true) END)"


def _some(test: str, of: str = "ps") -> str:
    return f"coalesce(list_bool_or([coalesce({test}, false) for p in {of}]), false)"


def _is(side: str, form: str) -> str:
    return f"regexp_matches(p.{side}, '{form}')"


def _subtype() -> str:
    chars = {side: f"[c for c in string_split(p.{side}, '') if c <> '']" for side in "ab"}
    links = f"len(list_distinct([z[1] || chr(1) || z[2] for z in list_zip({chars['a']}, {chars['b']})]))"
    one_to_one = f"length(p.a) = length(p.b) AND {links} = len(list_distinct({chars['a']})) AND {links} = len(list_distinct({chars['b']}))"
    bare = "regexp_replace(p.a, '[^\\p{L}\\p{N}]', '', 'g')"
    number = "try_cast('0b' || p.{} AS BIGINT)"
    masks = f"len(list_distinct([coalesce(xor({number.format('a')}, {number.format('b')})::VARCHAR, '') for p in ps]))"
    words = "len(regexp_split_to_array(p.{}, '\\s+'))"
    prompt = "lower(coalesce(raw_prompt, ''))"
    return f"""CASE tag_family WHEN 'bit' THEN CASE WHEN {_every("length(p.a) = length(p.b) AND contains(p.a || p.a, p.b)")} THEN 'bit_rotate'
        WHEN {_some("length(p.a) = 8")} AND {_every("length(p.a) <> 8 OR substr(p.a, 5, 4) || substr(p.a, 1, 4) = p.b")} THEN 'bit_nibble'
        WHEN {masks} = 1 THEN 'bit_xor_mask' WHEN len(ps) >= 3 AND {_some("p.a <> p.b")} THEN 'bit_permutation' ELSE 'bit_affine' END
      WHEN 'cipher' THEN CASE WHEN {_every(one_to_one)} THEN 'cipher_char_sub' WHEN {_every(f"{words.format('a')} = {words.format('b')} AND {words.format('a')} > 1")} THEN 'cipher_token_sub'
        WHEN {_some(f"list_sort({chars['a']}) = list_sort({chars['b']})")} THEN 'cipher_perm' WHEN contains({prompt}, 'vocab') OR contains({prompt}, 'dictionary') THEN 'cipher_vocab'
        WHEN contains({prompt}, 'caesar') OR contains({prompt}, 'shift') THEN 'cipher_char_sub' ELSE 'cipher_vocab' END
      WHEN 'equation' THEN CASE WHEN {_every(_is('a', _EQ))} AND coalesce(regexp_matches(query, '{_EQ}'), false) THEN 'equation_numeric' WHEN {_every(f"{bare} = p.b")} THEN 'equation_delete'
        WHEN {_every("length(p.b) <= length(p.a)")} THEN 'equation_position' WHEN {_some(f"{bare} <> p.a")} THEN 'equation_template' ELSE 'equation_symbolic' END
      WHEN 'unit' THEN CASE WHEN {_some(_is('b', '[A-Za-z]'))} THEN 'unit_convert' ELSE 'unit_scale' END
      WHEN 'numeral' THEN CASE WHEN {_every(_is('b', _ROM))} THEN 'numeral_roman' ELSE 'numeral_other' END WHEN 'gravity' THEN 'gravity_inverse_square' END"""


_TOLD = f"""CASE WHEN coalesce(len(raw), 0) < 1 THEN 'equation' WHEN {_every(_is('a', _BIN) + ' AND ' + _is('b', _BIN), 'raw')} THEN 'bit' WHEN {_every(_is('b', _ROM), 'raw')} THEN 'numeral'
    WHEN {_every(_is('a', _MEAS), 'raw')} THEN 'unit' WHEN {_every(_is('a', _EQ), 'raw')} THEN 'equation' WHEN {_some("contains(p.a, ' ') OR regexp_matches(p.a, '^[A-Za-z]+$')", 'raw')} THEN 'cipher'
    WHEN {_every(_is('a', _NUM) + ' AND ' + _is('b', _NUM), 'raw')} THEN 'gravity' ELSE 'equation' END"""
_DECLARED = "coalesce(family, CASE " + " ".join(f"WHEN contains(lower(raw_prompt), '{phrase}') THEN '{f}'" for f, phrase in FAMILY_PHRASES.items()) + " END)"

TAGGED = f"""WITH {PUZZLE}, paired AS (SELECT *, [{{a: e.input, b: e.output}} for e in parsed_examples] AS raw, [{{a: {_stripped('e.input')}, b: {_stripped('e.output')}}} for e in parsed_examples] AS ps FROM puzzle),
  told AS (SELECT *, {_DECLARED} AS declared, {_TOLD} AS told FROM paired),
  scored_ AS (SELECT *, coalesce(declared, told) AS tag_family, CASE WHEN declared IS NOT NULL THEN 1.0 WHEN told = 'equation' THEN 0.8 WHEN told IN ('gravity', 'cipher') THEN 0.5 ELSE 1.0 END::DOUBLE AS tag_confidence FROM told),
  tagged AS (SELECT *, {_subtype()} AS tag_subtype FROM scored_)"""


def _pairs_of(form: str, flags: str) -> str:
    """Stripped pairs of one line form, as lists of two, those with an empty side left out."""
    sides = [f"regexp_extract_all(t, '(?{flags}){form}', {i})" for i in (1, 2)]
    made = f"[[{_stripped('z[1]')}, {_stripped('z[2]')}] for z in list_zip({sides[0]}, {sides[1]})]"
    return f"[y for y in {made} if y[1] <> '' AND y[2] <> '']"


def _parsed() -> str:
    """Pairs and query of the line forms; the labelled ones need to look ahead, which this engine's patterns cannot, and stand in no table."""
    arrow, becomes, gravity, equation = (form.split(")", 1)[1] for form in (*PAIR_FORMS.values(), EQUATION))
    heading = "contains(lower(y[1] || ' ' || y[2]), 'input') AND contains(lower(y[1] || ' ' || y[2]), 'output')"
    lines = f"list_concat([y for y in {_pairs_of(arrow, 'm')} if NOT ({heading})], {_pairs_of(becomes, 'mi')}, {_pairs_of(gravity, 'mi')})"
    bad = " OR ".join(["contains(lower(y[2]), 'given d')", *(f"starts_with(lower(y[1]), '{start}')" for start in STARTS)])
    asked = " ".join(f"WHEN regexp_matches(t, '(?i){form.split(')', 1)[1]}') THEN {_stripped(f"regexp_extract(t, '(?i){form.split(')', 1)[1]}', 1)")}" for form in QUERY_FORMS[1:])
    canonical = rf"regexp_replace(regexp_replace(translate(raw_prompt, '{_WIDE.replace("'", "''")}', '{_PLAIN.replace("'", "''")}'), '\r\n|\r', chr(10), 'g'), '[ \t\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g')"
    return f"""WITH {PUZZLE}, canon AS (SELECT id, {_stripped(canonical)} AS t FROM puzzle), lined AS (SELECT *, {lines} AS lines FROM canon),
      more AS (SELECT *, [y for y in {_pairs_of(equation, 'm')} if NOT ({bad}) AND NOT list_contains(lines, y)] AS extra FROM lined),
      found_ AS (SELECT id, t, list_concat(lines, [y for y in extra if list_position(extra, y) > 0]) AS found FROM more)
      SELECT id, len(found)::INT AS pairs, CASE {asked} ELSE '' END AS asked, to_json([{{input: y[1], output: y[2]}} for y in found])::VARCHAR AS found FROM found_ WHERE t IS NOT NULL
      UNION ALL SELECT id, NULL, NULL, NULL FROM found_ WHERE t IS NULL"""


PARSED = _parsed()


def _hint() -> str:
    def uses(names: tuple[str, ...]) -> str:
        return f"list_has_any(steps, {list(names)!r})"

    cases = [f"WHEN family = 'cipher' AND {uses(PERMUTING)} AND {uses(REPLACING)} THEN 'cipher_perm'"]
    cases += [f"WHEN family = '{f}' AND {uses(names)} THEN '{told}'" for f, groups in HINTS.items() for names, told in groups]
    general = " OR ".join(f"family = '{f}' AND subtype = '{told}'" for f, told in GENERAL_SUBTYPES.items())
    return f"CASE WHEN {general} THEN CASE {' '.join(cases)} END END"


_OWN_ANSWER = "'\\boxed{' || " + _stripped("p.target_answer") + " || '}'"
_KIND = "CASE source WHEN 'synthetic' THEN 'synth' WHEN 'repair' THEN 'repair' ELSE 'official' END"


def _rendered() -> str:
    """A prompt in its family's style, as :func:`render_prompt` writes it."""
    lines = {"gravity": "'For t = ' || x.a || 's, distance = ' || x.b || ' m'", "unit": "x.a || ' becomes ' || x.b"}
    intro = {"gravity": "Here are some example observations:", "unit": "For example:", "cipher": "Here are some examples:", "numeral": "Here are some examples:"}
    asks = {
        "gravity": ("Now, determine the falling distance for t = ", "s given d = 0.5*g*t^2."), "unit": ("Now, convert the following measurement: ", ""),
        "cipher": ("Now, decrypt the following text: ", ""), "numeral": ("Now, write the number ", " in the Wonderland numeral system."),
    }
    shown = "[{a: coalesce(e.input, ''), b: coalesce(e.output, '')} for e in parsed_examples]"

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    cases = []
    for family in (*FAMILY_INSTRUCTIONS, None):
        own = f"CASE f {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in FAMILY_INSTRUCTIONS.items())} ELSE '' END"
        before, after = asks.get(family, ("Now, determine the output for: ", ""))
        line = lines.get(family, "x.a || ' -> ' || x.b")
        parts = f"list_concat([{own}, {text(intro.get(family, 'Here are some examples of input -> output:'))}], [{line} for x in {shown}], [{text(before)} || query || {text(after)}])"
        cases.append((f"WHEN {text(family)} THEN " if family else "ELSE ") + f"array_to_string({parts}, chr(10))")
    return f"CASE f {' '.join(cases)} END"


_NOVEL_RULE = "concat_ws('|', family, coalesce(subtype, 'unknown'), coalesce(signature, bucket, 'unknown'))"


def _novelty() -> str:
    """The six splits as one query."""
    parts = [f"SELECT 'iid' AS split_name, CASE WHEN ('0x' || substr({_key(42, 'id')}, 1, 8))::UBIGINT / 4294967296.0 < 0.15 THEN 'valid' ELSE 'train' END AS role, id FROM puzzle"]
    tables = []
    whole = [("family_holdout", "family", 43), ("composition_holdout", "composition", 44)]
    for name, col, seed in whole:
        tables.append(f"""{name}_g AS (SELECT {col} AS grp, count(*) AS n FROM keyed GROUP BY 1),
{name}_t AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY n, {_key(seed, 'grp')}, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_g)""")
        parts.append(f"""SELECT '{name}', CASE WHEN before < (SELECT greatest(floor(count(*) * 0.15), 1) FROM keyed) THEN 'valid' ELSE 'train' END, id FROM keyed JOIN {name}_t ON grp = {col}""")
    inside = [("rule_novelty_all", "true", 45), ("hard_triad_rule_novelty", "family IN ('bit', 'cipher', 'equation')", 46), ("easy_triad_sanity", "family IN ('gravity', 'numeral', 'unit')", 47)]
    for name, kept, seed in inside:
        tables.append(f"""{name}_k AS (SELECT * FROM keyed WHERE {kept}),
{name}_g AS (SELECT family, rule, count(*) AS n FROM {name}_k GROUP BY 1, 2),
{name}_f AS (SELECT family, greatest(floor(sum(n) * 0.15), 1) AS target, count(*) > 1 AND min(n) <= greatest(floor(sum(n) * 0.15), 1) AS apart FROM {name}_g GROUP BY 1),
{name}_t AS (SELECT family, rule, coalesce(sum(n) OVER (PARTITION BY family ORDER BY n, {_key(seed, 'rule')}, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_g),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY {_key(seed, 'id')}, id) - 1 AS place FROM {name}_k)""")
        parts.append(f"""SELECT '{name}', CASE WHEN CASE WHEN f.apart THEN t.before ELSE r.place END < f.target THEN 'valid' ELSE 'train' END, r.id
          FROM {name}_r r JOIN {name}_f f ON f.family = r.family JOIN {name}_t t ON t.family = r.family AND t.rule = r.rule""")
    return f"""WITH {PUZZLE}, {PROGRAM}, named AS (SELECT id, signature, {_BUCKET} AS bucket FROM program),
keyed AS (SELECT id, family, concat_ws('|', family, coalesce(subtype, 'unknown'), coalesce(bucket, 'unknown')) AS composition, {_NOVEL_RULE} AS rule
  FROM (SELECT p.id, coalesce(p.family, 'unknown') AS family, p.subtype, n.signature, n.bucket FROM puzzle p LEFT JOIN named n ON n.id = p.id WHERE coalesce(p.source, '') <> 'synthetic')),
{", ".join(tables)}, member AS ({" UNION ALL ".join(parts)})"""


_NODES = "SELECT op, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM {t}), 9) AS weight FROM (SELECT unnest(steps) AS op FROM {t}) GROUP BY op"

_ORDERED = "(SELECT DISTINCT o_orderkey, o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"

PLAIN = {
    "search_numerals": f"SELECT o_orderkey::VARCHAR AS id, 'dec2roman' AS signature, 1.0::DOUBLE AS exact, {_roman('(1 + o_custkey % 3999)')} AS answer FROM {_ORDERED}",
    "search_masks": f"""SELECT o_orderkey::VARCHAR AS id, 'xor:' || (o_custkey % 256)::VARCHAR AS signature, 1.0::DOUBLE AS exact, lpad(bin(xor(o_orderkey % 256, o_custkey % 256)), 8, '0') AS answer
      FROM {_ORDERED}""",
    "search_scales": f"""SELECT o_orderkey::VARCHAR AS id, 1.0::DOUBLE AS exact, CAST(CAST((o_orderkey % 50 + 1) * (1 + o_custkey % 7) * 25 AS DECIMAL(20, 2)) / 100 AS DECIMAL(20, 2))::VARCHAR AS answer
      FROM {_ORDERED}""",
    "search_depth1": DEPTH1,
    "boxed_flat": rf"""WITH {EVAL} SELECT record_id, extracted AS answer, extracted IS NOT NULL AS is_valid,
      CASE WHEN len(boxes) = 0 THEN 'missing_boxed_answer' WHEN len(boxes) > 1 THEN 'multiple_boxed_answers' WHEN boxes[1] = '' THEN 'empty_boxed_answer' END AS error FROM answer""",
    "prompt_instructions": rf"""WITH {PUZZLE} SELECT id, regexp_replace(string_split(bare, chr(10) || chr(10))[1], '\s+$', '') AS instruction, CAST(NULL AS VARCHAR) AS named_family,
      length(bare) + length(chr(10) || 'Return exactly one final answer as \boxed{{...}}.') AS contract_chars
      FROM (SELECT id, regexp_replace(raw_prompt, '^\s+|\s+$', '', 'g') AS bare FROM puzzle WHERE raw_prompt IS NOT NULL)""",
    "roman_numbers": f"SELECT o_orderkey, {_roman('o_orderkey')} AS roman FROM orders",
    "eval_rates": f"""WITH {EVAL} SELECT 'all' AS level, CAST(NULL AS VARCHAR) AS family, CAST(NULL AS VARCHAR) AS subtype, {_MEASURES} FROM scored
      UNION ALL SELECT 'family', family, NULL, {_MEASURES} FROM scored WHERE family IS NOT NULL GROUP BY family
      UNION ALL SELECT 'subtype', family, subtype, {_MEASURES} FROM scored WHERE family IS NOT NULL AND subtype IS NOT NULL GROUP BY family, subtype""",
    "eval_coverage": f"""WITH {EVAL}, {PUZZLE}, per AS (SELECT run_id, example_id, count(*) AS n FROM answer GROUP BY 1, 2)
      SELECT run_id, sum(CASE WHEN p.id IS NOT NULL THEN n ELSE 0 END)::BIGINT AS matched, count(*) FILTER (p.id IS NULL) AS unexpected_ids,
        count(*) FILTER (n > 1) AS duplicate_ids, (SELECT count(*) FROM puzzle) - count(*) FILTER (p.id IS NOT NULL) AS missing_ids
      FROM per LEFT JOIN puzzle p ON p.id = example_id GROUP BY run_id""",
    "eval_splits": f"""WITH {EVAL}, {PUZZLE} SELECT split, count(*) AS n, round(avg(exact::DOUBLE), 9) AS exact_rate, round(avg(correct::DOUBLE), 9) AS correct_rate
      FROM scored JOIN puzzle ON example_id = id WHERE split IS NOT NULL GROUP BY split""",
    "error_taxonomy": f"WITH {JUDGED} SELECT family, error_type, reason, count(*) AS n FROM judged GROUP BY ALL",
    "hardcase_topk": f"""WITH {JUDGED} SELECT record_id, example_id, family, error_type, reason FROM judged
      ORDER BY correct, boxed_valid, CASE WHEN {_HARD} THEN 0 ELSE 1 END, coalesce(confidence, 0), record_id LIMIT 32""",
    "curriculum_buckets": f"""WITH {JUDGED} SELECT concat_ws(':', coalesce(family, 'unknown'), subtype, CASE WHEN correct THEN 'easy' WHEN numeric THEN 'medium'
      WHEN family IN ('equation', 'bit') THEN 'hard' WHEN coalesce(confidence, 0) >= 0.75 THEN 'medium' ELSE 'hard' END) AS bucket, count(*) AS n FROM judged GROUP BY 1""",
    "eval_joined": f"WITH {PUZZLE}, {JOINED} SELECT record_id, run_id, example_id, family, subtype, boxed_valid, exact, numeric, correct FROM scored",
    "eval_missing_ids": f"WITH {PUZZLE}, {EVAL} SELECT id FROM puzzle ANTI JOIN (SELECT example_id AS id FROM answer) USING (id)",
    "eval_unexpected_ids": f"WITH {PUZZLE}, {EVAL} SELECT DISTINCT coalesce(example_id, '') AS example_id FROM answer WHERE coalesce(example_id, '') NOT IN (SELECT id FROM puzzle)",
    "eval_duplicate_ids": f"WITH {EVAL} SELECT run_id, example_id, count(*) AS n FROM answer GROUP BY 1, 2 HAVING count(*) > 1",
    "eval_checksum": f"""WITH {PUZZLE}, {JOINED} SELECT run_id, count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', example_id, prediction, correct::VARCHAR)), 1, 8))::BIGINT)::BIGINT AS checksum
      FROM scored GROUP BY run_id""",
    "eval_official": f"""WITH {EVAL}, got AS (SELECT record_id, coalesce({_OFFICIAL}) AS answer, {_stripped('target')} AS t FROM (SELECT record_id, prediction AS text, target FROM answer)),
      valued AS (SELECT *, try_cast(a AS DOUBLE) AS x, try_cast(t AS DOUBLE) AS y FROM (SELECT *, {_stripped('answer')} AS a FROM got))
      SELECT record_id, answer, coalesce(CASE WHEN regexp_matches(t, '^[01]+$') THEN lower(a) = t WHEN x IS NOT NULL AND y IS NOT NULL
        THEN abs(x - y) <= greatest(1e-2 * greatest(abs(x), abs(y)), 1e-5) ELSE lower(a) = lower(t) END, false) AS correct FROM valued""",
    "outcome_partition": f"""WITH {EVAL}, {PUZZLE} SELECT record_id, example_id, CASE WHEN correct THEN 'success' ELSE 'failure' END AS outcome
      FROM scored WHERE example_id IN (SELECT id FROM puzzle WHERE split IN ('valid', 'test', 'audit'))""",
    "failure_types": f"""WITH {EVAL} SELECT family, CASE WHEN correct AND numeric AND NOT exact THEN 'numeric_only' WHEN correct THEN 'correct'
      WHEN NOT boxed_valid OR prediction = '' THEN 'format_error' WHEN numeric THEN 'numeric_only' ELSE 'wrong_answer' END AS failure_type, count(*) AS n FROM scored GROUP BY 1, 2""",
    "pair_shapes": SHAPES,
    "subtype_hints": f"""WITH {PUZZLE}, {PROGRAM}, hinted AS (SELECT family, subtype AS from_subtype, {_hint()} AS to_subtype
        FROM (SELECT p.family, p.subtype, p.source, g.steps FROM puzzle p JOIN program g ON g.id = p.id) WHERE {_KIND} = 'official')
      SELECT family, from_subtype, to_subtype, count(*) AS n FROM hinted WHERE to_subtype IS NOT NULL GROUP BY ALL""",
    "synth_summary": f"""WITH {PUZZLE}, {PROGRAM} SELECT p.family, p.subtype, len(g.steps) AS steps, count(*) AS n FROM puzzle p LEFT JOIN program g ON g.id = p.id
      WHERE p.source = 'synthetic' GROUP BY ALL""",
    "family_sample": f"WITH {PUZZLE} SELECT id, family FROM puzzle QUALIFY row_number() OVER (PARTITION BY coalesce(family, 'unknown') ORDER BY id) <= 50",
    "mixed_stages": f"""WITH {RECORD}, named AS (SELECT record_id, id, target_answer, signature, stage, coalesce(family, 'unknown') AS family FROM record),
      turned AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY record_id) AS turn FROM named WHERE stage = 'stage3'),
      seated AS (SELECT *, row_number() OVER (ORDER BY turn, coalesce(list_position(['equation', 'cipher', 'bit'], family), 4), family) AS place FROM turned),
      bucketed AS (SELECT *, 0 AS b, 'strict' AS bucket FROM named WHERE stage = 'stage1' UNION ALL SELECT *, 1, 'synth' FROM named WHERE stage = 'stage2'
        UNION ALL SELECT record_id, id, target_answer, signature, stage, family, 2, 'silver' FROM seated
          WHERE place <= (SELECT floor(0.25 * greatest(1, count(*))) FROM named WHERE stage IN ('stage1', 'stage2')))
      SELECT record_id, bucket FROM bucketed QUALIFY row_number() OVER (PARTITION BY id, target_answer, signature ORDER BY b, record_id) = 1""",
    "split_members": f"""WITH {PUZZLE}, ruled AS ({_group_split(42, False)}), drawn AS (SELECT id, ('0x' || substr({_key(44, 'id')}, 1, 8))::UBIGINT / 4294967296.0 >= 0.15 AS own FROM puzzle)
      SELECT p.id, {_KIND} AS kind FROM puzzle p JOIN drawn d ON d.id = p.id WHERE (d.own OR {_KIND} <> 'official') AND p.id NOT IN (SELECT id FROM ruled WHERE role = 'valid')""",
    "wide_records": rf"""WITH {PUZZLE}, {PROGRAM}, full_ AS (SELECT p.*, nullif(g.signature, '') AS signature, coalesce(p.family, 'unknown') AS fam, {_OWN_ANSWER} AS boxed,
          regexp_replace(p.raw_prompt, '{_BLANK}$', '') AS bare FROM puzzle p LEFT JOIN program g ON g.id = p.id WHERE regexp_replace(p.raw_prompt, '{_BLANK}', '', 'g') <> '')
      SELECT id, md5(CASE WHEN regexp_matches(bare, '(?i)boxed|final answer') THEN bare ELSE bare || chr(10) || 'Return exactly one final answer as \boxed{{...}}.' END) AS prompt,
        concat_ws('; ', 'family=' || fam, 'sub=' || subtype, 'sig=' || coalesce(signature, 'identity'), 'answer=' || coalesce(boxed, '\boxed{{}}')) AS completion,
        'stage2' AS stage, 'raw_with_guard' AS prompt_mode, 'short_trace' AS trace_style, 'raw' AS source_prompt_type, target_answer, coalesce(family, 'equation') AS official_family, subtype,
        signature AS program_signature, conf AS teacher_confidence, coalesce(source, 'official') AS source_dataset, difficulty, split, coalesce(source, 'official') AS metadata FROM full_""",
    "chat_records": rf"""WITH {PUZZLE}, {PROGRAM} SELECT p.id, md5('<|im_start|>user' || chr(10) || coalesce(p.raw_prompt, '') || chr(10) || 'Please put your final answer inside `\boxed{{}}`. For example: `\boxed{{your answer}}`'
        || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10)) AS prompt,
      'fam=' || coalesce(p.family, 'unknown') || '|sub=' || coalesce(p.subtype, 'unknown') || '|sig=' || coalesce(nullif(g.signature, ''), 'identity') || chr(10) || '</think>' || chr(10)
        || coalesce({_OWN_ANSWER}, '\boxed{{}}') AS completion, 'chat_thinking' AS source_prompt_type FROM puzzle p LEFT JOIN program g ON g.id = p.id""",
    "rendered_prompts": rf"""WITH {PUZZLE}, made AS (SELECT id, {_stripped('made')} AS t FROM (SELECT id, {_rendered()} AS made FROM (SELECT *, coalesce(family, 'equation') AS f FROM puzzle WHERE query IS NOT NULL)))
      SELECT id, md5(t || chr(10) || 'Return exactly one final answer as \boxed{{...}}.') AS digest FROM made""",
    "exact_forms": f"WITH {PUZZLE} SELECT id, {_form('target_answer')} AS form FROM puzzle WHERE target_answer IS NOT NULL",
    "novelty_splits": f"{_novelty()} SELECT split_name, role, id FROM member",
    "novelty_split_stats": f"{_novelty()} SELECT split_name, role, p.family, p.subtype, count(*) AS n FROM member JOIN puzzle p USING (id) GROUP BY ALL",
    "part_percentiles": f"""WITH {RECORD}, {_MEASURED}, part AS (SELECT stage, family, {_WORDS_OF.format('prompt')} AS pw, {_WORDS_OF.format('completion')} AS cw FROM measured)
      SELECT stage, family, count(*) AS n, quantile_disc(pw, 0.5)::BIGINT AS prompt_p50, quantile_disc(pw, 0.95)::BIGINT AS prompt_p95, quantile_disc(cw, 0.5)::BIGINT AS completion_p50,
        quantile_disc(cw, 0.95)::BIGINT AS completion_p95 FROM part GROUP BY stage, family""",
    "prompt_audit": f"""WITH {RECORD}, part AS (SELECT stage, CASE WHEN length(prompt) > 0 THEN {_WORDS_OF.format('prompt')} END AS w FROM record)
      SELECT stage, count(*) AS n, count(*) FILTER (w IS NULL) AS missing, count(*) FILTER (w > 512) AS over_budget, quantile_disc(w, 0.5)::BIGINT AS p50, quantile_disc(w, 0.95)::BIGINT AS p95,
        quantile_disc(w, 0.99)::BIGINT AS p99, coalesce(max(w), 0) AS most_words, round(coalesce(avg(w), 0), 9) AS mean_words, coalesce(max(w) <= 512, false) AS fits FROM part GROUP BY stage""",
    "parsed_prompts": PARSED,
    "family_report": TAGGED + """ SELECT tag_family, tag_subtype, count(*) AS n, round(avg(tag_confidence), 9) AS mean_confidence FROM tagged GROUP BY ALL""",
    "puzzle_shapes": f"""WITH shape AS ({SHAPES}) SELECT p.id, coalesce(pairs, 0) AS pairs, {', '.join(f'coalesce("{c}", 0) AS "{c}"' for c in (*_MEANS, *_FLAGS))}
      FROM (SELECT DISTINCT id FROM puzzles WHERE id IS NOT NULL) p LEFT JOIN (SELECT id, count(*) AS pairs, {', '.join(f'round(avg({c}), 9) AS {c}' for c in _MEANS)},
        {', '.join(f'round(avg("{c}"::INT::DOUBLE), 9) AS "{c}"' for c in _FLAGS)} FROM shape GROUP BY id) s ON s.id = p.id""",
    "repair_failures": rf"""WITH {EVAL}, {PUZZLE}, {PROGRAM}, lastly AS (SELECT *, nullif(regexp_extract(prediction, '(?:^|[;|])\s*sig=([^;|\s]+)', 1), '') AS predicted FROM scored WHERE example_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY record_id DESC) = 1),
      known AS (SELECT p.id, coalesce(p.family, 'equation') AS family, p.subtype, p.conf, nullif(g.signature, '') AS signature FROM puzzle p LEFT JOIN program g ON g.id = p.id),
      repair AS (SELECT k.id, CASE WHEN NOT l.boxed_valid THEN 'format_error' WHEN l.family <> k.family THEN 'wrong_family' WHEN l.subtype <> k.subtype THEN 'wrong_subtype'
          WHEN l.predicted <> k.signature THEN 'wrong_signature' WHEN coalesce(k.conf, 0) < 0.5 THEN 'low_confidence' ELSE 'search_miss' END AS error_type,
          k.signature AS target_signature, l.predicted AS predicted_signature FROM known k JOIN lastly l ON l.example_id = k.id AND NOT l.correct)
      SELECT id, 'repair' AS repair_source, 'repair' AS source_dataset, error_type, target_signature, predicted_signature FROM repair""",
    "family_counts": f"WITH {PUZZLE} SELECT family, subtype, source, split, count(*) AS n FROM puzzle GROUP BY ALL",
    "split_by_rule": _group_split(42, False),
    "split_by_rule_balanced": _group_split(43, True),
    "split_random": f"""WITH {PUZZLE} SELECT id, CASE WHEN ('0x' || substr({_key(44, 'id')}, 1, 8))::UBIGINT / 4294967296.0 < 0.15 THEN 'valid' ELSE 'train' END AS role FROM puzzle""",
    "split_leak_free": f"""WITH {PUZZLE}, {PROGRAM}, both_ AS (SELECT p.id, split, g.signature FROM puzzle p JOIN program g USING (id) WHERE g.signature IS NOT NULL)
      SELECT id, split, signature FROM both_ WHERE split IN ('valid', 'test', 'audit') AND signature NOT IN (SELECT signature FROM both_ WHERE split = 'train')""",
    "signature_cap": f"""WITH {PROGRAM}, named AS (SELECT id, {_BUCKET} AS bucket FROM program)
      SELECT id, bucket FROM named QUALIFY row_number() OVER (PARTITION BY coalesce(bucket, 'id:' || id) ORDER BY id) <= 20""",
    "dedupe_records": f"""WITH {RECORD} SELECT record_id, stage FROM record
      QUALIFY row_number() OVER (PARTITION BY id, target_answer, signature ORDER BY stage NULLS FIRST, record_id) = 1""",
    "oversampled_families": f"WITH {RECORD} SELECT record_id, unnest(range(CASE WHEN {_HARD} THEN 3 ELSE 1 END)) AS repeat_index FROM record",
    "round_robin": f"""WITH {RECORD}, turned AS (SELECT record_id, family, row_number() OVER (PARTITION BY family ORDER BY record_id) AS turn FROM record WHERE family IS NOT NULL)
      SELECT record_id, turn, row_number() OVER (ORDER BY turn, coalesce(list_position(['cipher', 'bit', 'equation', 'numeral', 'unit', 'gravity'], family), 7), family) AS place FROM turned""",
    "repair_replay": f"""WITH {EVAL}, {RECORD}, failed AS (SELECT DISTINCT example_id AS id FROM scored WHERE NOT correct),
      repair AS (SELECT record_id FROM record SEMI JOIN failed USING (id)),
      rest AS (SELECT record_id, row_number() OVER (ORDER BY record_id) AS rk FROM record ANTI JOIN failed USING (id))
      SELECT record_id, 'repair' AS bucket FROM repair UNION ALL SELECT record_id, 'replay' FROM rest WHERE rk <= (SELECT floor(count(*) * 0.25) FROM repair)""",
    "rendered_records": rf"""WITH {PUZZLE}, {PROGRAM}, solved AS (
        SELECT p.id, coalesce(p.family, 'unknown') AS family, p.subtype, coalesce(nullif(g.signature, ''), 'identity') AS signature,
          '\boxed{{' || regexp_replace(p.target_answer, '^{_BLANK}|{_BLANK}$', '', 'g') || '}}' AS boxed, md5(regexp_replace(p.raw_prompt, '{_BLANK}$', '')) AS prompt_digest
        FROM puzzle p LEFT JOIN program g ON g.id = p.id WHERE p.target_answer IS NOT NULL AND p.query <> '')
      SELECT id, 'answer_only' AS trace_style, prompt_digest, boxed AS completion FROM solved
      UNION ALL SELECT id, 'short_trace', prompt_digest, concat_ws('; ', 'family=' || family, 'sub=' || subtype, 'sig=' || signature, 'answer=' || boxed) FROM solved
      UNION ALL SELECT id, 'token_trace', prompt_digest, 'fam=' || family || '|sub=' || coalesce(subtype, 'unknown') || '|sig=' || signature || '|' || boxed FROM solved""",
    "length_percentiles": f"""WITH {RECORD}, {_MEASURED} SELECT stage, family, count(*) AS n, {_percentile(0.5)}, {_percentile(0.95)}, {_percentile(0.99)},
      round(avg(total_words), 9) AS mean_words, max(total_words) AS most_words, round(avg((total_words > 128)::INT::DOUBLE), 9) AS over_share FROM measured GROUP BY stage, family""",
    "max_seq_recommend": f"""WITH {RECORD}, {_MEASURED} SELECT p95, CASE WHEN p95 <= 1024 THEN 1024 ELSE least(greatest(1536, p95), 2048) END AS max_length
      FROM (SELECT {_percentile(0.95)} FROM measured)""",
    "sft_summary": f"""WITH {RECORD} SELECT stage, count(*) AS n, count(DISTINCT id) AS puzzles, round(1 - count(DISTINCT id)::DOUBLE / count(*), 9) AS repeat_share,
      round(avg(coalesce({_HARD}, false)::INT::DOUBLE), 9) AS hard_share FROM record GROUP BY stage""",
    "rule_graph_nodes": f"WITH {PROGRAM}, stepped AS (SELECT steps FROM program WHERE steps IS NOT NULL) {_NODES.format(t='stepped')}",
    "rule_graph_edges": f"{_EDGES} SELECT lhs, rhs, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM edge), 9) AS weight FROM edge GROUP BY 1, 2",
    "rule_graph_family": f"""{_EDGES}, cell AS (SELECT family, lhs, rhs, count(*) AS n FROM edge WHERE family IS NOT NULL GROUP BY ALL)
      SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY family), 9) AS weight FROM cell""",
    "rule_graph_positions": f"""WITH {PROGRAM}, placed AS (SELECT unnest(steps) AS op, generate_subscripts(steps, 1) - 1 AS position FROM program WHERE steps IS NOT NULL),
      cell AS (SELECT position, op, count(*) AS n FROM placed GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY position), 9) AS weight FROM cell""",
    "merged_weights": f"""WITH once AS (SELECT id, steps, solved_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY solved_at DESC) AS rn FROM program_signatures)
        WHERE rn = 1 AND steps IS NOT NULL),
      early AS (SELECT * FROM once WHERE solved_at < TIMESTAMP '2025-07-01'), late AS (SELECT * FROM once WHERE solved_at >= TIMESTAMP '2025-07-01'),
      o AS ({_NODES.format(t='early')}), w AS ({_NODES.format(t='late')})
      SELECT op, CASE WHEN w.weight IS NULL THEN o.weight ELSE round((coalesce(o.weight, 0) + w.weight) / 2, 9) END AS weight, coalesce(o.n, 0) + coalesce(w.n, 0) AS n
      FROM o FULL JOIN w USING (op)""",
    "signature_buckets": f"""WITH {PROGRAM} SELECT {_BUCKET} AS bucket, array_to_string([trim(split_part(s, ':', 1)) for s in string_split(signature, '>')], '>') AS own_bucket, count(*) AS n
      FROM program GROUP BY ALL""",
}


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    kernels = {name.replace("op_", "kernel_", 1): sql for name, sql in OPERATORS.items()}
    fits = {f"kernel_{name}": FITS[name] for name in ("fit_xor_mask", "fit_or_mask")}
    return {**OPERATORS, **kernels, **FITS, **fits, "kernel_depth1": DEPTH1, **PLAIN}
