"""Registered queries over the project's tables, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runeworks.functions import ops
from runeworks.functions.labels import family_label, label, language
from runeworks.functions.signatures import bucket_key, signature_bucket
from runeworks.functions.text import (
    boxed_answers, canonical_text, detect_family, exact_form, instruction, isomorph, roman, single_box, tokens, with_contract, word_count, words,
    wrap_boxed,
)
from runeworks.operators import graph, lengths, selection, splits
from runeworks.operators.latest import latest
from runeworks.operators.puzzles import current_puzzles
from runeworks.plans import evaluate, features, kernels, novelty, prompts, records, replica, synth, teacher
from runeworks.search.engine import annotated, search_programs
from runeworks.session import settle
from runeworks.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _puzzles(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_puzzles(table(spark, folder, "puzzles"), *columns)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Training records, each once, with canonical labels."""
    return latest(
        table(spark, folder, "sft_records"),
        "record_id",
        "built_at",
        id=F.col("id"),
        prompt=F.col("prompt"),
        completion=F.col("completion"),
        stage=F.col("stage"),
        family=family_label(F.col("official_family")),
        subtype=label(F.col("subtype")),
        source=label(F.col("source_dataset")),
        lang=language(F.col("lang")),
        target_answer=F.col("target_answer"),
        signature=F.col("program_signature"),
    )


def _programs(spark: SparkSession, folder: str) -> DataFrame:
    """Solved puzzles, each once: ``id, family, steps, signature, bucket``."""
    return latest(
        table(spark, folder, "program_signatures"),
        "id",
        "solved_at",
        family=family_label(F.col("official_family")),
        subtype=label(F.col("subtype")),
        steps=F.col("steps"),
        signature=F.col("signature"),
        bucket=bucket_key(F.col("signature_bucket"), F.col("signature")),
    )


def _text_op(change: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), change(F.col("p_name")).cast("string").alias("value"))

    return query


def _number_op(change: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        v = F.col("o_custkey") - 50
        return table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), change(v).cast("string").alias("value"))

    return query


def _bit_op(change: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        b = F.lpad(F.bin(F.col("p_partkey") % 256), 8, "0")
        return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), change(b).cast("string").alias("value"))

    return query


#: Parameters that the operator queries use, shared with their SQL.
NIBBLES = {f"{i:04b}": f"{(i * 7 + 3) % 16:04b}" for i in range(16)}
MASKS, BIAS = [129, 66, 36, 24, 20, 10, 5, 131], [0, 1, 0, 1, 1, 0, 0, 1]
LETTERS = {"a": "q", "e": "w", "i": "z", "o": "x"}


def operator_queries() -> dict[str, Query]:
    """One query for each catalogue operator with a column form."""
    text, number, bit = _text_op, _number_op, _bit_op
    return {
        "op_identity": text(lambda x: x),
        "op_reverse_string": text(F.reverse),
        "op_reverse_tokens": text(ops.reverse_tokens),
        "op_rotate_left": text(lambda x: ops.rotate_left(x, 3)),
        "op_rotate_right": text(lambda x: ops.rotate_left(x, -2)),
        "op_sort_chars": text(ops.sort_chars),
        "op_sort_tokens": text(ops.sort_tokens),
        "op_stable_unique_chars": text(ops.stable_unique_chars),
        "op_caesar_shift": text(lambda x: ops.caesar_shift(x, 5)),
        "op_fixed_substitution": text(lambda x: ops.substitute(x, LETTERS)),
        "op_delete_characters": text(lambda x: ops.delete_characters(x, "ae")),
        "op_decimal_to_binary": number(ops.decimal_to_binary),
        "op_binary_to_decimal": bit(ops.binary_value),
        "op_decimal_to_hex": number(ops.decimal_to_hex),
        "op_decimal_to_roman": number(ops.decimal_to_roman),
        "op_add_constant": number(lambda v: v + 7),
        "op_multiply_constant": number(lambda v: v * -3),
        "op_affine_transform": number(lambda v: v * 2 + 5),
        "op_digit_sum": number(lambda v: ops.digit_sum(v.cast("string"))),
        **{f"op_filter_{m}": text(lambda x, m=m: ops.filter_characters(x, m)) for m in ops.KEPT},
        **{f"op_count_{m}": text(lambda x, m=m: ops.count_items(x, m)) for m in ("chars", "tokens", "digits", "letters", "unique_chars", "vowels")},
        "op_unit_convert": number(lambda v: ops.unit_convert(F.concat(v.cast("string"), F.lit(" km")), "km", "m", 1000.0)),
        "op_scale_measurement": number(lambda v: ops.scale_measurement(F.concat(v.cast("string"), F.lit(" m")), 0.75, 2)),
        "op_gravity_distance": number(lambda v: ops.gravity_distance(v.cast("double"), 9.5, 2)),
        "op_binary_permutation": bit(lambda b: ops.binary_permutation(b, [3, 0, 1, 2, 7, 6, 5, 4])),
        "op_binary_nibble_map": bit(lambda b: ops.binary_nibble_map(b, [NIBBLES, NIBBLES])),
        "op_swap_nibbles": bit(ops.swap_nibbles),
        "op_reverse_bits": bit(ops.reverse_bits),
        "op_binary_rotate_left": bit(lambda b: ops.binary_rotate(b, 3)),
        "op_binary_rotate_right": bit(lambda b: ops.binary_rotate(b, -3)),
        "op_binary_invert": bit(ops.binary_invert),
        "op_binary_xor_mask": bit(lambda b: ops.binary_mask(b, 0b10110001, "xor")),
        "op_binary_and_mask": bit(lambda b: ops.binary_mask(b, 0b10110001, "and")),
        "op_binary_or_mask": bit(lambda b: ops.binary_mask(b, 0b10110001, "or")),
        "op_binary_affine_transform": bit(lambda b: ops.binary_affine(b, MASKS, BIAS)),
        "op_bitwise_xor_constant": number(lambda v: v.bitwiseXOR(3)),
        "op_bitwise_and_constant": number(lambda v: v.bitwiseAND(7)),
        "op_bitwise_or_constant": number(lambda v: v.bitwiseOR(1)),
    }


# Fits: parameters inferred from all pairs of a puzzle. An order is a puzzle, its lines are pairs.


def _order_pairs(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("x"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("id"), "x", (F.col("l_partkey") % 256).alias("bits_in"), F.col("o_custkey").alias("c")
    )


def _constant(value: Column) -> list[Column]:
    """The only value of a group, null if there are several, and how many pairs agree on it."""
    return [F.when(F.min(value) == F.max(value), F.min(value)).alias("parameter"), F.count(F.lit(1)).alias("pairs")]


def fit_xor_mask(spark: SparkSession, folder: str) -> DataFrame:
    """The mask between input and output bits of each puzzle, where all pairs have the same."""
    p = _order_pairs(spark, folder)
    out = p["bits_in"].bitwiseXOR(F.when(p["bits_in"] % 17 == 0, p["c"] + 1).otherwise(p["c"]) % 256)
    return p.withColumn("out", out).groupBy("id").agg(*_constant(F.col("bits_in").bitwiseXOR(F.col("out"))))


def fit_or_mask(spark: SparkSession, folder: str) -> DataFrame:
    """The mask that turns on bits of each puzzle, where every input bit stays and all pairs have the same."""
    p = _order_pairs(spark, folder).withColumn("out", F.col("bits_in").bitwiseOR(F.col("c") % 16))
    added = F.col("bits_in").bitwiseXOR(F.col("out"))
    kept = F.bool_and(F.col("bits_in").bitwiseAND(F.col("out")) == F.col("bits_in"))
    return p.groupBy("id").agg(
        F.when(kept & (F.min(added) == F.max(added)), F.min(added)).alias("parameter"), F.count(F.lit(1)).alias("pairs")
    )


def fit_add_constant(spark: SparkSession, folder: str) -> DataFrame:
    """The difference between output and input of each puzzle, where all pairs have the same."""
    p = _order_pairs(spark, folder).withColumn("y", F.col("x") + F.col("c") % 11 - F.when(F.col("x") == 13, 1).otherwise(0))
    return p.groupBy("id").agg(*_constant(F.col("y") - F.col("x")))


def fit_multiply_constant(spark: SparkSession, folder: str) -> DataFrame:
    """The exact quotient of output and input of each puzzle, where all pairs have the same."""
    p = _order_pairs(spark, folder).withColumn("y", F.col("x") * (F.col("c") % 5 + 1))
    usable = p.where((F.col("x") != 0) & (F.col("y") % F.col("x") == 0))
    return usable.groupBy("id").agg(*_constant(F.expr("y div x")))


def fit_affine(spark: SparkSession, folder: str) -> DataFrame:
    """Slope and intercept of each puzzle from its least and greatest input, where every pair lies on the line."""
    p = _order_pairs(spark, folder).withColumn("y", F.col("x") * (F.col("c") % 5 + 1) + F.col("c") % 11)
    ends = p.groupBy("id").agg(F.min(F.struct("x", "y")).alias("lo"), F.max(F.struct("x", "y")).alias("hi"), F.count(F.lit(1)).alias("pairs"))
    wide = ends.where(F.col("hi.x") > F.col("lo.x"))
    slope = wide.withColumn("a", F.expr("(hi.y - lo.y) div (hi.x - lo.x)")).withColumn("b", F.expr("lo.y - a * lo.x"))
    checked = p.join(slope.select("id", "a", "b", "pairs"), "id").groupBy("id", "a", "b", "pairs").agg(
        F.bool_and(F.col("y") == F.col("a") * F.col("x") + F.col("b")).alias("ok")
    )
    return checked.where("ok").select("id", "a", "b", "pairs")


def fit_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Mean ratio of output and input of each puzzle, where no ratio is further than 0.005 from it."""
    p = _order_pairs(spark, folder).where("x > 0").withColumn("r", (F.col("x") * (F.col("c") % 3 + 1) * 25) / 100.0 / F.col("x"))
    means = p.groupBy("id").agg(F.avg(F.col("r").cast("double")).alias("factor"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count(F.lit(1)).alias("pairs"))
    near = (F.col("hi") - F.col("factor") <= 0.005) & (F.col("factor") - F.col("lo") <= 0.005)
    return means.where(near).select("id", F.round("factor", 6).alias("factor"), "pairs")


def search_depth1(spark: SparkSession, folder: str) -> DataFrame:
    """Relational search of one step: the first simple operator that explains every pair of a puzzle.

    Pairs meet a fixed table of operators and parameters inside the row, so there is one
    shuffle, by puzzle.
    """
    pairs = _puzzles(spark, folder, "parsed_examples").select("id", F.explode("parsed_examples").alias("p")).select(
        "id", F.col("p.input").alias("a"), F.coalesce("p.output", F.lit("")).alias("b")
    ).where("a IS NOT NULL")
    a = F.col("a")
    tried: list[tuple[str, Column]] = [
        ("identity", a), ("decimal_to_roman", ops.decimal_to_roman(a.try_cast("long"))), ("reverse_string", F.reverse(a)), ("sort_chars", ops.sort_chars(a)), ("stable_unique_chars", ops.stable_unique_chars(a)),
        *[(f"rotate_left:{k}", ops.rotate_left(a, k)) for k in range(1, 8)],
        *[(f"caesar_shift:{k:02d}", ops.caesar_shift(a, k)) for k in range(1, 26)],
    ]
    hits = F.array(*[F.coalesce(made == F.col("b"), F.lit(False)) for _, made in tried])
    every = pairs.select("id", hits.alias("h")).groupBy("id").agg(
        F.count(F.lit(1)).alias("pairs"), *[F.bool_and(F.col("h")[i]).alias(f"h{i}") for i in range(len(tried))]
    )
    first = F.coalesce(*[F.when(F.col(f"h{i}"), F.lit(name)) for i, (name, _) in enumerate(tried)])
    return every.select("id", "pairs", first.alias("program")).where("program IS NOT NULL")


# Text and prompts.


def canonical_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical form and word count of every document, as a hash and sizes."""
    text = table(spark, folder, "documents").select("doc_id", canonical_text(F.col("text")).alias("t"))
    return text.select("doc_id", F.length("t").alias("chars"), word_count(F.col("t")).alias("words"), F.md5("t").alias("digest"))


def boxed_flat(spark: SparkSession, folder: str) -> DataFrame:
    """The single boxed answer of every prediction, or why there is none."""
    rows = evaluate.current_records(table(spark, folder, "eval_records"))
    found = rows.withColumn("b", single_box(boxed_answers(F.col("prediction"))))
    return found.select("record_id", F.col("b.answer").alias("answer"), F.col("b.is_valid").alias("is_valid"), F.col("b.error").alias("error"))


def exact_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical form of every target answer."""
    return _puzzles(spark, folder, "target_answer").where("target_answer IS NOT NULL").select("id", exact_form(F.col("target_answer")).alias("form"))


def parsed_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs and query that the raw prompts give."""
    p = _puzzles(spark, folder, "raw_prompt")
    text = p.select("id", canonical_text(F.col("raw_prompt")).alias("t"))
    got = text.withColumn("pairs", prompts.extract_pairs(F.col("t"))).withColumn("asked", prompts.extract_query(F.col("t")))
    return got.select("id", F.size("pairs").alias("pairs"), "asked", F.to_json("pairs").alias("found"))


def rendered_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt of every puzzle rendered anew in its family's style."""
    p = _puzzles(spark, folder, "family", "query", "parsed_examples").where("query IS NOT NULL")
    return p.select("id", F.md5(prompts.render_prompt(F.col("family"), F.col("parsed_examples"), F.col("query"))).alias("digest"))


def prompt_instructions(spark: SparkSession, folder: str) -> DataFrame:
    """Instruction, named family and answer contract of every prompt."""
    p = _puzzles(spark, folder, "raw_prompt").where("raw_prompt IS NOT NULL")
    named = detect_family(F.col("raw_prompt"))
    return p.select(
        "id", instruction(F.col("raw_prompt"), named).alias("instruction"), named.alias("named_family"),
        F.length(with_contract(F.col("raw_prompt"))).alias("contract_chars"),
    )


def query_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, isomorph pattern of each word, in order, and boxed form of every query."""
    p = _puzzles(spark, folder, "query").where("query IS NOT NULL")
    q = F.col("query")
    return p.select("id", F.size(tokens(q)).alias("tokens"), F.transform(words(q), isomorph).alias("pattern"), wrap_boxed(q).alias("boxed"))


def roman_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Roman numerals of order keys below 4000."""
    return table(spark, folder, "orders").select("o_orderkey", roman(F.col("o_orderkey")).alias("roman"))


# Scoring.


def eval_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the recorded predictions by level."""
    return evaluate.evaluate(table(spark, folder, "eval_records"))


def eval_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of every run against all puzzles."""
    return evaluate.coverage(evaluate.current_records(table(spark, folder, "eval_records")), _puzzles(spark, folder, "split"))


def eval_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by split."""
    return evaluate.split_rates(evaluate.current_records(table(spark, folder, "eval_records")), _puzzles(spark, folder, "split"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    records = evaluate.current_records(table(spark, folder, "eval_records"))
    return evaluate.judged(records, _known(spark, folder))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """Labels, confidence, margin and program of every puzzle."""
    p = _puzzles(spark, folder, "family", "subtype", "confidence", "margin")
    return p.join(_programs(spark, folder).select("id", "signature"), "id", "left")


def error_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    """Records per family and error class."""
    records = evaluate.current_records(table(spark, folder, "eval_records"))
    return evaluate.error_counts(records, _known(spark, folder))


def hardcase_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 32 hardest records."""
    return evaluate.hard_cases(_judged(spark, folder)).select("record_id", "example_id", "family", "error_type", "reason")


def curriculum_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the curriculum buckets."""
    return evaluate.curriculum(_judged(spark, folder))


# Evaluation against labels.


def _predictions(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.current_records(table(spark, folder, "eval_records")).select("record_id", "run_id", "example_id", "prediction")


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return _puzzles(spark, folder, "target_answer", "family", "subtype")


def eval_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Every prediction held against the current answer of its puzzle."""
    rows = replica.joined(_predictions(spark, folder), _labels(spark, folder), "example_id")
    return rows.select("record_id", "run_id", "example_id", "family", "subtype", "boxed_valid", "exact", "numeric", "correct")


def eval_missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Puzzles that no prediction answers."""
    return replica.missing_ids(_predictions(spark, folder), _labels(spark, folder), "example_id")


def eval_unexpected_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of predictions that are no puzzle."""
    return replica.unexpected_ids(_predictions(spark, folder), _labels(spark, folder), "example_id")


def eval_duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Puzzles that a run predicts more than once."""
    return replica.duplicate_ids(_predictions(spark, folder), "run_id", "example_id")


def eval_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """Checksum of the scored records of each run."""
    return replica.checksum(replica.joined(_predictions(spark, folder), _labels(spark, folder), "example_id"), "run_id", key="example_id")


def eval_official(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the predictions by the published extraction, and whether they count."""
    rows = evaluate.current_records(table(spark, folder, "eval_records"))
    got = rows.withColumn("answer", replica.official_answer(F.col("prediction")))
    return got.select("record_id", "answer", F.coalesce(replica.official_match(F.col("answer"), F.col("target")), F.lit(False)).alias("correct"))


def outcome_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Successes and failures among the predictions of puzzles outside train."""
    scores = evaluate.scored(evaluate.current_records(table(spark, folder, "eval_records")))
    asked = _puzzles(spark, folder, "split").where("split IN ('valid', 'test', 'audit')").select("id")
    return replica.outcomes(scores, "example_id", asked).select("record_id", "example_id", "outcome")


def failure_types(spark: SparkSession, folder: str) -> DataFrame:
    """Records per family and failure type."""
    s = evaluate.scored(evaluate.current_records(table(spark, folder, "eval_records")))
    kind = replica.failure_type(*map(F.col, ("correct", "exact", "numeric", "boxed_valid", "prediction")))
    return s.groupBy("family", kind.alias("failure_type")).agg(F.count(F.lit(1)).alias("n"))


def benchmark_families(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the search by family."""
    p = _puzzles(spark, folder, "family", "subtype", "query", "parsed_examples", "target_answer")
    return replica.benchmark_report(replica.benchmark(p, 6, 2))


# Features and tags.


def pair_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """The features of every support pair that need no Python."""
    return features.pair_shapes(_puzzles(spark, folder, "parsed_examples"))


def pair_features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of every support pair."""
    return features.pair_features(_puzzles(spark, folder, "parsed_examples"))


def puzzle_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Means of :func:`pair_shapes` of every puzzle."""
    return features.puzzle_shapes(_puzzles(spark, folder, "parsed_examples"))


def puzzle_features(spark: SparkSession, folder: str) -> DataFrame:
    """Mean features of every puzzle."""
    return features.puzzle_features(_puzzles(spark, folder, "parsed_examples"))


def family_report(spark: SparkSession, folder: str) -> DataFrame:
    """Puzzles by tagged family and subtype, with mean confidence."""
    tagged = features.tagged(_puzzles(spark, folder, "family", "query", "raw_prompt", "parsed_examples"))
    return tagged.groupBy("tag_family", "tag_subtype").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("tag_confidence"), 9).alias("mean_confidence")
    )


def family_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Puzzles by declared family, subtype, source and split."""
    p = _puzzles(spark, folder, "family", "subtype", "source", "split")
    return p.groupBy("family", "subtype", "source", "split").agg(F.count(F.lit(1)).alias("n"))


def subtype_hints(spark: SparkSession, folder: str) -> DataFrame:
    """How often the program of an official puzzle points to a subtype that tells more than its own."""
    p = _puzzles(spark, folder, "family", "subtype", "source").join(_programs(spark, folder).select("id", "steps"), "id")
    return teacher.hint_counts(p)


def synth_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Synthetic puzzles by family, subtype and length of their program."""
    p = _puzzles(spark, folder, "family", "subtype", "source").where("source = 'synthetic'")
    return p.join(_programs(spark, folder).select("id", F.size("steps").alias("steps")), "id", "left").groupBy("family", "subtype", "steps").agg(F.count(F.lit(1)).alias("n"))


# Splits and selection.


def family_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first 50 puzzles of each family by id."""
    p = _puzzles(spark, folder, "family")
    return selection.cap_per_key(p, F.coalesce("family", F.lit("unknown")), [F.col("id").asc()], 50).select("id", "family")


def mixed_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the first stage, the second, and some of the third, each puzzle, answer and program once."""
    rows = _records(spark, folder).select("record_id", "id", "target_answer", "signature", "stage", F.coalesce("family", F.lit("unknown")).alias("family"))
    parts = [rows.where(F.col("stage") == s) for s in ("stage1", "stage2", "stage3")]
    mixed = records.mixed_buckets(*parts, ["id", "target_answer", "signature"], "family", ["record_id"], 0.25, 1_000_000)
    return mixed.select("record_id", "bucket")


def split_members(spark: SparkSession, folder: str) -> DataFrame:
    """Puzzles of the random split's train part, with all synthetic ones, less those of the rule split's valid part."""
    p = _puzzles(spark, folder, "source")
    programs = _programs(spark, folder).withColumn("grp", F.concat_ws("|", "family", "subtype", F.coalesce("signature", "bucket")))
    members = splits.random_split(p.select("id"), "id", 0.15, 44)
    held = splits.group_split(programs, "grp", 0.15, 42).select("id", "role")
    return splits.select_split(p, members, "id", "train", held, "valid").select("id", splits.source_kind(F.col("source")).alias("kind"))


def split_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Validation and training puzzles apart by rule group, with overshoot of the last group."""
    programs = _programs(spark, folder).withColumn("grp", F.concat_ws("|", "family", "subtype", F.coalesce("signature", "bucket")))
    return splits.group_split(programs, "grp", 0.15, 42).select("id", "role")


def split_by_rule_balanced(spark: SparkSession, folder: str) -> DataFrame:
    """As the split by rule, inside every family."""
    programs = _programs(spark, folder).withColumn("grp", F.concat_ws("|", "family", "subtype", F.coalesce("signature", "bucket")))
    return splits.group_split(programs, "grp", 0.15, 43, "family").select("id", "family", "role")


def split_random(spark: SparkSession, folder: str) -> DataFrame:
    """Random split of all puzzles."""
    return splits.random_split(_puzzles(spark, folder, "split"), "id", 0.15, 44).select("id", "role")


def split_leak_free(spark: SparkSession, folder: str) -> DataFrame:
    """Puzzles outside train whose program does not stand in train."""
    p = _puzzles(spark, folder, "split").join(_programs(spark, folder).select("id", "signature").where("signature IS NOT NULL"), "id")
    return splits.leak_free(p.where("split IN ('valid', 'test', 'audit')"), p.where("split = 'train'"), "signature").select("id", "split", "signature")


def signature_cap(spark: SparkSession, folder: str) -> DataFrame:
    """At most 20 solved puzzles of each program bucket, by id."""
    capped = selection.cap_per_key(_programs(spark, folder), F.coalesce("bucket", F.concat(F.lit("id:"), "id")), [F.col("id").asc()], 20)
    return capped.select("id", "bucket")


def dedupe_records(spark: SparkSession, folder: str) -> DataFrame:
    """First record of each puzzle, answer and program; stages in order, then record ids."""
    rows = _records(spark, folder).select("record_id", "id", "target_answer", "signature", "stage")
    return selection.first_per_key(
        rows, [F.col("id"), F.col("target_answer"), F.col("signature")], [F.col("stage"), F.col("record_id")]
    ).select("record_id", "stage")


def oversampled_families(spark: SparkSession, folder: str) -> DataFrame:
    """Records of hard families three times, others once."""
    times = F.when(F.col("family").isin("cipher", "bit", "equation"), 3).otherwise(1)
    return selection.oversample(_records(spark, folder).select("record_id", "family"), times).select("record_id", "repeat_index")


# Families in the order of a round, hard ones first.
ROUND = ["cipher", "bit", "equation", "numeral", "unit", "gravity"]


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Records that name a family, as the SQL has it, interleaved over the families, hard ones first; see balanced_records for all."""
    rows = _records(spark, folder).select("record_id", "family").where("family IS NOT NULL")
    return selection.interleave(rows, "family", ROUND, [F.col("record_id").asc()]).select("record_id", "turn", "place")


def balanced_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records interleaved over the families, hard ones twice a turn and those without a family last, at most 64 of a program or else puzzle."""
    rows = _records(spark, folder).select(
        "record_id", "family", F.coalesce(F.nullif("signature", F.lit("")), F.concat(F.lit("id:"), F.coalesce("id", F.lit("unknown")))).alias("program")
    )
    twice = {f: 2 for f in ("cipher", "bit", "equation")}
    return selection.interleave(rows, "family", ROUND, [F.col("record_id").asc()], visits=twice, cap=F.col("program"), most=64).select(
        "record_id", "family", "turn", "place"
    )


def repair_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Records of puzzles that some prediction fails, and a quarter as many of others."""
    scores = evaluate.scored(evaluate.current_records(table(spark, folder, "eval_records")))
    failed = scores.where(~F.col("correct")).select(F.col("example_id").alias("id")).distinct()
    rows = _records(spark, folder).select("record_id", "id")
    return selection.replay_mix(
        rows.join(failed, "id", "left_semi"), rows.join(failed, "id", "left_anti"), 0.25, [F.col("record_id").asc()]
    ).select("record_id", "bucket")


def _solved(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    programs = _programs(spark, folder).select("id", "signature", "bucket")
    return _puzzles(spark, folder, "family", "subtype", *columns).join(programs, "id", "left")


def rendered_records(spark: SparkSession, folder: str) -> DataFrame:
    """Training records of every puzzle in the three styles, prompts as digests."""
    p = _solved(spark, folder, "raw_prompt", "query", "parsed_examples", "target_answer")
    made = [records.training_records(p, style, "stage2") for style in records.STYLES]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("id", "trace_style", F.md5("prompt").alias("prompt_digest"), "completion")


def _full(spark: SparkSession, folder: str) -> DataFrame:
    p = _puzzles(spark, folder, "family", "subtype", "raw_prompt", "query", "parsed_examples", "target_answer", "confidence", "source", "difficulty", "split", "extras")
    return p.join(_programs(spark, folder).select("id", "signature"), "id", "left")


def wide_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of fifteen columns of every puzzle with a prompt, prompts as digests."""
    rows = records.wide_records(_full(spark, folder), "stage2", "raw_with_guard", "short_trace").where("source_prompt_type = 'raw'")
    nested = F.to_json("metadata")
    return rows.withColumn("prompt", F.md5("prompt")).withColumn("metadata", F.get_json_object(nested, "$.source_dataset"))


def chat_records(spark: SparkSession, folder: str) -> DataFrame:
    """Chat prompts and thinking completions of every puzzle."""
    rows = records.wide_records(_full(spark, folder), "stage3", "chat_thinking", "token_trace", records.ChatTemplate(), metadata=False)
    return rows.select("id", F.md5("prompt").alias("prompt"), "completion", "source_prompt_type")


def repair_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Records to repair what the latest prediction of a puzzle fails, with why."""
    return _repair(spark, folder, 0.0)


def repair_set(spark: SparkSession, folder: str) -> DataFrame:
    """As :func:`repair_failures`, and a quarter as many records to replay."""
    return _repair(spark, folder, 0.25)


def _repair(spark: SparkSession, folder: str, ratio: float) -> DataFrame:
    scores = evaluate.scored(evaluate.current_records(table(spark, folder, "eval_records")).where("example_id IS NOT NULL"))
    named = F.nullif(F.regexp_extract("prediction", r"(?:^|[;|])\s*sig=([^;|\s]+)", 1), F.lit(""))
    kept = scores.select("record_id", "example_id", "correct", "boxed_valid", "exact", "numeric", "family", "subtype", named.alias("signature"))
    last = settle(
        latest(
            kept, "example_id", "record_id", correct=F.col("correct"), boxed_valid=F.col("boxed_valid"), exact=F.col("exact"), numeric=F.col("numeric"),
            predicted_family=F.col("family"), predicted_subtype=F.col("subtype"), predicted_signature=F.col("signature"),
        ).withColumnRenamed("example_id", "id")
    )
    made = records.repair_set(_full(spark, folder), last.where(~F.col("correct")), last.where("correct"), ratio)
    return made.select("id", "repair_source", "source_dataset", "error_type", "target_signature", "predicted_signature")


def novelty_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The six splits of all puzzles."""
    return novelty.build_splits(_solved(spark, folder, "source"))


def novelty_split_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the six splits by family and subtype."""
    p = _solved(spark, folder, "source")
    return novelty.split_stats(novelty.build_splits(p), p)


# Graph and lengths.


def length_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Length statistics of the records by stage and family."""
    return lengths.length_percentiles(_records(spark, folder), "stage", "family", limit=128)


def part_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and completion lengths of the records by stage and family."""
    return lengths.part_percentiles(_records(spark, folder), "stage", "family")


def prompt_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of the records against a budget of 512 words, by stage."""
    return lengths.prompt_audit(_records(spark, folder), "stage")


def max_seq_recommend(spark: SparkSession, folder: str) -> DataFrame:
    """Recommended sequence length."""
    return lengths.recommended_length(_records(spark, folder))


def sft_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of the records by stage."""
    return lengths.record_summary(_records(spark, folder))


def merged_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Step weights of programs solved in the first half year, updated by those solved later."""
    raw = latest(table(spark, folder, "program_signatures"), "id", "solved_at", steps=F.col("steps"), solved_at=F.col("solved_at")).where("steps IS NOT NULL")
    early = F.col("solved_at") < F.lit("2025-07-01").cast("timestamp_ntz")
    return graph.merge_weights(graph.rule_nodes(raw.where(early)), graph.rule_nodes(raw.where(~early)), ["op"])


def signature_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """Programs of each canonical bucket, and the bucket its own signature gives."""
    p = _programs(spark, folder)
    return p.groupBy("bucket", signature_bucket(F.col("signature")).alias("own_bucket")).agg(F.count(F.lit(1)).alias("n"))


# Search and generation: no SQL form.


def search_beam(spark: SparkSession, folder: str) -> DataFrame:
    """The best program of every puzzle at beam 6 and depth 2."""
    return search_programs(_puzzles(spark, folder, "family", "subtype", "query", "parsed_examples"), 6, 2, 1)


def annotate_top1(spark: SparkSession, folder: str) -> DataFrame:
    """Every puzzle with its best program, support and whether it is verifiable."""
    a = annotated(_puzzles(spark, folder, "family", "subtype", "query", "parsed_examples", "target_answer"))
    return a.select("id", "family", "signature", "confidence", "support", "verifiable", "margin", (F.col("answer") == F.col("target_answer")).alias("solved"))


def rescued_puzzles(spark: SparkSession, folder: str) -> DataFrame:
    """Every puzzle annotated, hard ones searched again with hints where the first search did not do."""
    a = teacher.annotate(_puzzles(spark, folder, "family", "subtype", "source", "query", "parsed_examples"), 6, 2)
    done = teacher.rescue(settle(a), beam=8, depth=3)
    return done.select("id", "family", "program_signature", "coverage", "verifiable", "composition_key", "hint", "rescued")


def synthetic_puzzles(spark: SparkSession, folder: str) -> DataFrame:
    """2000 generated puzzles, none of which stands in the table."""
    return synth.generate(spark, 2000, 42, _puzzles(spark, folder, "query", "target_answer", "parsed_examples"))


def queries() -> dict[str, Query]:
    """Name to query."""
    plain = [
        fit_xor_mask, fit_or_mask, fit_add_constant, fit_multiply_constant, fit_affine, fit_scale, search_depth1,
        canonical_documents, boxed_flat, exact_forms, parsed_prompts, rendered_prompts, prompt_instructions, query_tokens, roman_numbers,
        eval_rates, eval_coverage, eval_splits, eval_joined, eval_missing_ids, eval_unexpected_ids, eval_duplicate_ids, eval_checksum, eval_official,
        outcome_partition, failure_types, benchmark_families, error_taxonomy, hardcase_topk, curriculum_buckets,
        pair_shapes, puzzle_shapes, pair_features, puzzle_features, family_report, family_counts, subtype_hints, synth_summary, family_sample, mixed_stages, split_members,
        split_by_rule, split_by_rule_balanced, split_random, split_leak_free, signature_cap, dedupe_records, oversampled_families, round_robin, balanced_records, repair_replay,
        rendered_records, wide_records, chat_records, repair_failures, repair_set, novelty_splits, novelty_split_stats,
        length_percentiles, part_percentiles, prompt_audit, max_seq_recommend, sft_summary, merged_weights, signature_buckets,
        search_beam, annotate_top1, rescued_puzzles, synthetic_puzzles,
    ]
    graphs = {
        "rule_graph_nodes": graph.rule_nodes,
        "rule_graph_edges": graph.rule_edges,
        "rule_graph_family": graph.rule_edges_by_family,
        "rule_graph_positions": graph.rule_positions,
    }
    return {
        **operator_queries(),
        **kernels.kernel_queries(NIBBLES, MASKS, BIAS, LETTERS),
        **{q.__name__: q for q in plain},
        **{n: (lambda s, d, op=op: op(_programs(s, d).where("steps IS NOT NULL"))) for n, op in graphs.items()},
    }
