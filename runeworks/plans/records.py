"""Training records rendered from puzzles: guarded prompts, completions in several styles, chat wrapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.text import ANSWER_CONTRACT, wrap_boxed
from runeworks.operators.selection import first_per_key, interleave
from runeworks.plans.evaluate import HARD_FAMILIES, error_class
from runeworks.plans.prompts import render_prompt
from runeworks.session import settle

STYLES = ("answer_only", "short_trace", "token_trace")


def guarded_prompt(prompt: Column, rendered: Column) -> Column:
    """The raw prompt asking once for a boxed answer; a blank one is replaced by the rendered prompt."""
    bare = F.regexp_replace(prompt, r"(?U)\s+\z", "")
    asks = bare.contains(ANSWER_CONTRACT) | bare.rlike(r"(?i)\\boxed\{|boxed|final answer")
    return (
        F.when(F.coalesce(F.regexp_replace(bare, r"(?U)\s", ""), F.lit("")) == "", rendered)
        .when(asks, bare)
        .otherwise(F.concat(bare, F.lit("\n" + ANSWER_CONTRACT)))
    )


def trace_body(style: str, family: Column, subtype: Column, signature: Column) -> Column:
    """What a completion says before its answer; empty for ``answer_only``."""
    family = F.coalesce(F.nullif(family, F.lit("")), F.lit("unknown"))
    signature = F.coalesce(F.nullif(signature, F.lit("")), F.lit("identity"))
    if style == "answer_only":
        return F.lit("")
    if style == "short_trace":
        sub = F.when(F.coalesce(subtype, F.lit("")) != "", F.concat(F.lit("sub="), subtype))
        return F.concat_ws("; ", F.concat(F.lit("family="), family), sub, F.concat(F.lit("sig="), signature))
    if style == "token_trace":
        sub = F.coalesce(F.nullif(subtype, F.lit("")), F.lit("unknown"))
        return F.concat(F.lit("fam="), family, F.lit("|sub="), sub, F.lit("|sig="), signature)
    raise ValueError(f"no style {style}")


def completion(style: str, family: Column, subtype: Column, signature: Column, answer: Column) -> Column:
    """A completion in one of :data:`STYLES`; a null answer gives an empty box."""
    boxed = wrap_boxed(F.coalesce(answer, F.lit("")))
    body = trace_body(style, family, subtype, signature)
    if style == "answer_only":
        return boxed
    return F.concat(body, F.lit("; answer=" if style == "short_trace" else "|"), boxed)


def thinking(body: Column, answer: Column) -> Column:
    """A completion that goes on inside an open thinking mark: the body, the closing mark, the boxed answer."""
    said = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s+\z", "")
    return F.concat(F.when(said == "", "").otherwise(F.concat(said, F.lit("\n"))), F.lit("</think>\n"), wrap_boxed(F.coalesce(answer, F.lit(""))))


@dataclass(frozen=True)
class ChatTemplate:
    """What a tokenizer's chat template puts before and after the words of a single user."""

    before: str = "<|im_start|>user\n"
    after: str = "<|im_end|>\n<|im_start|>assistant\n<think>\n"


# Fixed value: what the evaluation adds to every prompt.
GUARD = "\nPlease put your final answer inside `\\boxed{}`. For example: `\\boxed{your answer}`"

MODES = ("raw_with_guard", "generic", "chat_thinking")


def user_content(prompt: Column) -> Column:
    """The raw prompt with :data:`GUARD`."""
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit(GUARD))


def prompt_in_mode(mode: str, prompt: Column, rendered: Column, template: ChatTemplate | None = None) -> Column:
    """A prompt in one of :data:`MODES`; the chat mode needs a template."""
    if mode == "raw_with_guard":
        return guarded_prompt(F.coalesce(prompt, F.lit("")), rendered)
    if mode == "generic":
        return rendered
    if mode == "chat_thinking":
        if template is None:
            raise ValueError("the mode chat_thinking needs a chat template")
        return F.concat(F.lit(template.before), user_content(prompt), F.lit(template.after))
    raise ValueError(f"no prompt mode {mode}")


def prompt_type(mode: str, prompt: Column) -> Column:
    """Where a prompt comes from: ``raw``, or ``generic_fallback`` for a blank one; else the mode."""
    if mode != "raw_with_guard":
        return F.lit(mode)
    return F.when(F.coalesce(F.regexp_replace(prompt, r"(?U)\s", ""), F.lit("")) != "", "raw").otherwise("generic_fallback")


def metadata_value(key: str, own: Column | None = None, default: str | None = None) -> Column:
    """A value of the JSON column ``extras``, else the column ``own``, else ``default``; empty texts count as none."""
    found = [F.nullif(F.get_json_object("extras", f"$.{key}"), F.lit(""))]
    found += [] if own is None else [F.nullif(own.cast("string"), F.lit(""))]
    return F.coalesce(*found, F.lit(default).cast("string"))


def wide_records(
    puzzles: DataFrame, stage: str, mode: str = "raw_with_guard", style: str = "answer_only", template: ChatTemplate | None = None, metadata: bool = True
) -> DataFrame:
    """One training record of fifteen columns for each puzzle, with the nested ``metadata`` beside them if wanted.

    ``puzzles`` has ``id, raw_prompt, query, parsed_examples, target_answer, family, subtype, signature,
    confidence, source, difficulty, split, extras`` (a JSON text, whose values come before the columns).
    Puzzles without family count as ``equation``, those without source as ``official``.
    """
    family = metadata_value("official_family", F.col("family"), "equation")
    subtype = metadata_value("subtype", F.col("subtype"))
    program = metadata_value("program_signature", F.col("signature"))
    rendered = render_prompt(F.col("family"), F.col("parsed_examples"), F.col("query"))
    body = trace_body(style, F.col("family"), F.col("subtype"), F.col("signature"))
    answer = F.col("target_answer")
    said = thinking(body, answer) if mode == "chat_thinking" else completion(style, F.col("family"), F.col("subtype"), F.col("signature"), answer)
    rows = puzzles.select(
        "id",
        prompt_in_mode(mode, F.col("raw_prompt"), rendered, template).alias("prompt"),
        said.alias("completion"),
        F.lit(stage).alias("stage"),
        F.lit(mode).alias("prompt_mode"),
        F.lit(style).alias("trace_style"),
        prompt_type(mode, F.col("raw_prompt")).alias("source_prompt_type"),
        "target_answer",
        family.alias("official_family"),
        subtype.alias("subtype"),
        program.alias("program_signature"),
        metadata_value("teacher_confidence", F.col("confidence")).cast("double").alias("teacher_confidence"),
        metadata_value("source_dataset", metadata_value("source", F.col("source"), "official")).alias("source_dataset"),
        metadata_value("difficulty", F.col("difficulty")).cast("double").alias("difficulty"),
        "split",
        *([F.col("extras").alias("__e")] if metadata else []),
    )
    if not metadata:
        return rows
    names = ("official_family", "subtype", "program_signature", "teacher_confidence", "difficulty", "source_dataset")
    return rows.withColumn("metadata", F.struct(*names, F.coalesce("__e", F.lit("{}")).alias("extras"))).drop("__e")


def marked(records: DataFrame, source: Column) -> DataFrame:
    """Records of a repair stage: ``source_dataset`` and ``repair_source``, in the nested metadata too, say where they come from."""
    out = records.withColumn("source_dataset", source).withColumn("repair_source", source)
    if "metadata" not in records.columns:
        return out
    extras = F.from_json("metadata.extras", "map<string,string>")
    added = F.to_json(F.map_concat(F.map_filter(extras, lambda k, _: k != "repair_source"), F.create_map(F.lit("repair_source"), source)))
    return out.withColumn("metadata", F.col("metadata").withField("source_dataset", source).withField("extras", added))


def repair_set(puzzles: DataFrame, failures: DataFrame, successes: DataFrame, ratio: float, stage: str = "stage3", style: str = "short_trace", mode: str = "raw_with_guard", template: ChatTemplate | None = None) -> DataFrame:
    """Records of the puzzles that were failed, with why, and of some that were not.

    ``failures`` and ``successes`` have one row for each ``id``; failures bring ``boxed_valid, exact,
    numeric, predicted_family, predicted_subtype, predicted_signature``. The puzzle's own labels
    are the truth. ``int(n * ratio)`` replayed records are taken in rounds over the families, hard
    ones first, at most 64 of a program. Ids that no puzzle has are left out. Ids are chosen
    first, without texts; records are made of the chosen puzzles only.
    """
    labels = wide_records(puzzles, stage, mode, style, template, metadata=False).select("id", "official_family", "subtype", "program_signature", "teacher_confidence")
    why = failures.select("id", "boxed_valid", "exact", "numeric", "predicted_family", "predicted_subtype", "predicted_signature")
    truth = labels.join(why, "id").withColumn("correct", F.lit(False)).withColumnRenamed("official_family", "family")
    error = error_class(F.col("predicted_family"), F.col("predicted_subtype"), F.col("predicted_signature"), F.col("program_signature"), F.col("teacher_confidence"))
    chosen = settle(truth.select("id", F.lit("repair").alias("__s"), error.alias("error_type"), F.col("program_signature").alias("target_signature"), "predicted_signature"))
    wanted = int(chosen.count() * ratio)
    if wanted:
        program = F.coalesce(F.nullif("program_signature", F.lit("")), F.concat(F.lit("id:"), "id"))
        known = settle(labels.join(successes.select("id"), "id", "left_semi").select("id", "official_family", program.alias("__p")))
        taken = interleave(known, "official_family", list(HARD_FAMILIES), [F.col("id").asc()], take=wanted, cap=F.col("__p"), most=64)
        chosen = chosen.unionByName(taken.select("id", F.lit("replay").alias("__s")), allowMissingColumns=True)
    made = wide_records(puzzles.join(chosen.select("id"), "id", "left_semi"), stage, mode, style, template)
    return marked(made.join(chosen, "id"), F.col("__s")).drop("__s")


def repair_summary(records: DataFrame) -> DataFrame:
    """Records by repair source, family and error type."""
    return records.groupBy("repair_source", "official_family", "error_type").agg(F.count(F.lit(1)).alias("n"))


def mixed_buckets(strict: DataFrame, synth: DataFrame, silver: DataFrame, key: list[str], group: str, order: list[str], share: float, most: int) -> DataFrame:
    """Strict and synthetic rows, and silver ones up to a cap, each key once, marked by ``bucket``.

    The cap is the smaller of ``most`` and ``share`` of the other two; silver rows are taken in rounds
    over ``group``: equation, cipher, bit, then others. Of rows with one ``key`` (nulls equal each
    other) the first bucket counts, then ``order``.
    """
    wanted = min(int(share * max(1, strict.count() + synth.count())), most)
    some = interleave(silver, group, ["equation", "cipher", "bit"], [F.col(o).asc() for o in order], take=max(0, wanted)).drop("turn", "place")
    ranked = [d.withColumn("__b", F.lit(i)).withColumn("bucket", F.lit(n)) for i, (n, d) in enumerate((("strict", strict), ("synth", synth), ("silver", some)))]
    rows = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return first_per_key(rows, [F.col(k) for k in key], [F.col("__b"), *map(F.col, order)]).drop("__b")


def check_rows(rows: DataFrame, *required: str) -> DataFrame:
    """``rows`` if each has all ``required`` columns filled; else an error that names how many lack which."""
    absent = [c for c in required if c not in rows.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    lacking = rows.select(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in required]).first().asDict()
    found = {c: n for c, n in lacking.items() if n}
    if found:
        raise ValueError(f"rows lack values: {found}")
    return rows


def check_repeats(rows: DataFrame, key: str, repeats: bool) -> DataFrame:
    """``rows`` if ids repeat as a stage wants: some do where ``repeats``, else none."""
    total, ids = rows.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    if (total > ids) != repeats:
        raise ValueError(f"{total} rows of {ids} ids")
    return rows


def training_records(puzzles: DataFrame, style: str, stage: str) -> DataFrame:
    """One record per puzzle with an answer and a query: ``id, prompt, completion, stage, trace_style, family, subtype, signature``.

    ``puzzles`` has ``id, raw_prompt, query, parsed_examples, family, subtype, signature, target_answer``.
    """
    usable = puzzles.where(F.col("target_answer").isNotNull() & (F.col("query") != ""))
    rendered = render_prompt(F.col("family"), F.col("parsed_examples"), F.col("query"))
    return usable.select(
        "id",
        guarded_prompt(F.coalesce("raw_prompt", F.lit("")), rendered).alias("prompt"),
        completion(style, F.col("family"), F.col("subtype"), F.col("signature"), F.col("target_answer")).alias("completion"),
        F.lit(stage).alias("stage"),
        F.lit(style).alias("trace_style"),
        "family",
        "subtype",
        "signature",
    )


def labelled_ids(prompt: Column, completion: Column, length: int, pad: int = 0, ignored: int = -100) -> Column:
    """``input_ids, labels, attention_mask`` of token ids: the prompt's labels are ignored, all are cut or padded to ``length``."""
    p, c = (F.coalesce(x, F.array().cast("array<int>")) for x in (prompt, completion))

    def fit(ids: Column, filler: int) -> Column:
        return F.slice(F.concat(ids, F.array_repeat(F.lit(filler), length)), 1, length)

    size = F.size(p) + F.size(c)
    return F.struct(
        fit(F.concat(p, c), pad).alias("input_ids"),
        fit(F.concat(F.array_repeat(F.lit(ignored), F.size(p)), c), ignored).alias("labels"),
        fit(F.array_repeat(F.lit(1), size), 0).alias("attention_mask"),
    )


#: The JSON form of a puzzle.
PUZZLE_JSON = (
    "id string, raw_prompt string, official_instruction string, parsed_examples array<struct<input: string, output: string>>, query string, target_answer string, "
    "metadata struct<official_family: string, subtype: string, family_tags: array<string>, family_scores: map<string, double>, teacher_confidence: double, "
    "program_signature: string, composition_key: string, difficulty: double, source: string, split: string, extras: string>"
)


def encoded(puzzles: DataFrame) -> Column:
    """A puzzle of the table's own nested form as one JSON text; nulls are written too."""
    names = [c.split(" ")[0] for c in ("id", "raw_prompt", "official_instruction", "parsed_examples", "query", "target_answer", "metadata")]
    return F.to_json(F.struct(*[puzzles[n] for n in names]), {"ignoreNullFields": "false"})


def decoded(text: Column) -> Column:
    """The puzzle that a JSON text holds; one without a family has the first of its tags as family. Another text gives null."""
    found = F.from_json(text, PUZZLE_JSON)
    family = F.coalesce(found["metadata"]["official_family"], F.try_element_at(found["metadata"]["family_tags"], F.lit(1)))
    named = F.when(found["metadata"].isNotNull(), found["metadata"].withField("official_family", family))
    return F.when(found["id"].isNotNull(), found.withField("metadata", named))


def repair_order(records: DataFrame) -> list[Column]:
    """The order in which repair records are reported: hard families first, then error type and id."""
    return [F.when(records["official_family"].isin(*HARD_FAMILIES), 0).otherwise(1).asc(), records["error_type"].asc(), records["id"].asc()]


def step_order(name: Column) -> list[Column]:
    """Checkpoints by their number, those without one, such as the final one, last."""
    step = F.regexp_extract(name, r"(\d+)\D*\z", 1).try_cast("long")
    return [step.asc_nulls_last(), name.asc()]
