"""Rendered records and the six splits."""

import pytest
from pyspark.sql import functions as F

from runeworks.functions.text import ANSWER_CONTRACT
from runeworks.plans import novelty, records
from tests.conftest import DATA


def test_records(spark):
    rows = [
        ("a", "Ask.\nMore", "q", [("1", "2")], "bit", "bit_rotate", "rotl:k=1", " 7 "),
        ("b", "  ", "q", [("1", "2")], "unit", None, None, "7"),
        ("c", "Give a final answer.  ", "q", [], None, "", "", "x"),
        ("no_answer", "p", "q", [], "bit", None, None, None),
        ("no_query", "p", "", [], "bit", None, None, "1"),
        ("null_query", "p", None, [], "bit", None, None, "1"),
        ("null_prompt", None, "q", None, "bit", None, None, "1"),
    ]
    kind = "id string, raw_prompt string, query string, parsed_examples array<struct<input:string,output:string>>, family string, subtype string, signature string, target_answer string"
    df = spark.createDataFrame(rows, kind)
    short = {r.id: r for r in records.training_records(df, "short_trace", "s").collect()}
    assert set(short) == {"a", "b", "c", "null_prompt"}
    assert short["a"].prompt == "Ask.\nMore\n" + ANSWER_CONTRACT and short["a"].completion == "family=bit; sub=bit_rotate; sig=rotl:k=1; answer=\\boxed{7}"
    assert short["b"].prompt.endswith(ANSWER_CONTRACT) and "1 becomes 2" in short["b"].prompt and short["b"].completion == "family=unit; sig=identity; answer=\\boxed{7}"
    assert short["c"].prompt == "Give a final answer." and short["c"].completion == "family=unknown; sig=identity; answer=\\boxed{x}"
    token = {r.id: r.completion for r in records.training_records(df, "token_trace", "s").collect()}
    assert token["c"] == "fam=unknown|sub=unknown|sig=identity|\\boxed{x}"
    assert records.training_records(df, "answer_only", "s").where("id = 'a'").first().completion == "\\boxed{7}"
    assert [tuple(r) for r in spark.range(1).select(records.thinking(F.lit(" "), F.lit("1")), records.thinking(F.lit("b\n"), F.lit(None))).collect()] == [("</think>\n\\boxed{1}", "b\n</think>\n\\boxed{}")]
    assert records.training_records(df.limit(0), "answer_only", "s").count() == 0


def test_splits_keep_groups_together(spark):
    rows = [(f"p{i}", "synthetic" if i % 9 == 0 else "official", ("bit", "unit", None)[i % 3], "s", f"sig{i % 14}" if i % 4 else None, f"b{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "id string, source string, family string, subtype string, signature string, bucket string")
    made = novelty.build_splits(df)
    found = {}
    for r in made.collect():
        assert (r.split_name, r.id) not in found
        found[(r.split_name, r.id)] = r.role
    by = {r[0]: r for r in rows}
    assert {k[0] for k in found} == {"iid", "family_holdout", "composition_holdout", "rule_novelty_all", "hard_triad_rule_novelty", "easy_triad_sanity"}
    assert sum(k[0] == "iid" for k in found) == 300
    roles = {}
    for (name, i), role in found.items():
        if name != "iid":
            assert by[i][1] != "synthetic"
        if name == "rule_novelty_all":
            _, _, family, subtype, sig, bucket = by[i]
            assert roles.setdefault((family, subtype, sig or bucket), role) == role
    assert novelty.split_stats(made, df).agg(F.sum("n")).first()[0] == len(found)
    assert novelty.build_splits(df.limit(0)).count() == 0


def _full(spark, rows):
    kind = "id string, raw_prompt string, query string, parsed_examples array<struct<input:string,output:string>>, family string, subtype string, signature string, target_answer string, confidence double, source string, difficulty double, split string, extras string"
    return spark.createDataFrame([(i, p, "q", [("1", "2")], f, s, g, "7", c, src, 0.5, "train", x) for i, p, f, s, g, c, src, x in rows], kind)


def test_prompt_modes_and_wide_records(spark):
    df = _full(spark, [("a", "Ask.", "bit", "bit_rotate", "rotl", 0.9, "partner", '{"difficulty": 0.1, "source_dataset": "x"}'), ("b", " ", None, None, None, None, None, None), ("c", None, "unit", "", "", 0.2, "", '{"subtype": ""}')])
    wide = {r.id: r for r in records.wide_records(df, "s").collect()}
    assert len(wide["a"].asDict()) == 16 and wide["a"].metadata.extras == '{"difficulty": 0.1, "source_dataset": "x"}' and wide["b"].metadata.extras == "{}"
    assert (wide["a"].source_dataset, wide["a"].difficulty, wide["a"].source_prompt_type, wide["a"].teacher_confidence) == ("x", 0.1, "raw", 0.9)
    assert (wide["b"].source_dataset, wide["b"].official_family, wide["b"].source_prompt_type, wide["b"].program_signature) == ("official", "equation", "generic_fallback", None)
    assert (wide["c"].source_dataset, wide["c"].subtype) == ("official", None) and "1 becomes 2" in wide["c"].prompt
    generic = records.wide_records(df, "s", "generic", metadata=False).where("id = 'a'").first()
    assert generic.prompt.startswith("In Alice's") and generic.source_prompt_type == "generic" and len(generic.asDict()) == 15
    chat = records.wide_records(df, "s", "chat_thinking", "short_trace", records.ChatTemplate("<u>", "<a>")).where("id = 'a'").first()
    assert chat.prompt == "<u>Ask." + records.GUARD + "<a>" and chat.completion == "family=bit; sub=bit_rotate; sig=rotl\n</think>\n\\boxed{7}"
    with pytest.raises(ValueError, match="chat template"):
        records.wide_records(df, "s", "chat_thinking")
    with pytest.raises(ValueError, match="no prompt mode"):
        records.wide_records(df, "s", "other")
    assert records.wide_records(df.limit(0), "s").count() == 0


def test_repair_set(spark):
    df = _full(spark, [(f"p{i}", "Ask.", ("bit", "unit")[i % 2], "s", "rotl", 0.9, None, '{"repair_source": "old", "k": "v"}') for i in range(12)])
    kind = "id string, boxed_valid boolean, exact boolean, numeric boolean, predicted_family string, predicted_subtype string, predicted_signature string"
    failures = spark.createDataFrame([("p0", False, False, False, "bit", "s", None), ("p1", True, False, False, "bit", "s", None), ("p2", True, False, False, "bit", "t", None), ("p3", True, False, False, "unit", "s", "xor"), ("p4", True, False, False, None, None, "rotl"), ("gone", True, False, False, None, None, None)], kind)
    successes = spark.createDataFrame([(f"p{i}",) for i in range(5, 12)] + [("lost",)], "id string")
    made = records.repair_set(df, failures, successes, 0.5).collect()
    assert {r.id: r.error_type for r in made if r.repair_source == "repair"} == {"p0": "format_error", "p1": "wrong_family", "p2": "wrong_subtype", "p3": "wrong_signature", "p4": "search_miss"}
    replay = sorted(r.id for r in made if r.repair_source == "replay")
    assert replay == ["p10", "p11"] and all(r.metadata.extras == '{"k":"v","repair_source":"replay"}' for r in made if r.repair_source == "replay")
    summary = {(r.repair_source, r.error_type): r.n for r in records.repair_summary(records.repair_set(df, failures, successes, 0.0)).collect()}
    assert sum(summary.values()) == 5
    assert records.repair_set(df, failures.limit(0), successes, 0.5).count() == 0


def test_mixed_buckets(spark):
    def rows(*items):
        return spark.createDataFrame(list(items), "i int, k string, fam string")

    strict, synth = rows((1, "a", "bit"), (2, None, "bit")), rows((3, "a", "bit"), (4, "b", "bit"))
    silver = rows((5, None, "cipher"), (6, "c", "cipher"), (7, "d", "bit"), (8, "e", "equation"), (9, "f", "equation"))
    got = {r.i: r.bucket for r in records.mixed_buckets(strict, synth, silver, ["k"], "fam", ["i"], 0.75, 100).collect()}
    assert got == {1: "strict", 2: "strict", 4: "synth", 8: "silver", 7: "silver"}  # the cap is 3; the row with a null key repeats a strict one
    assert set(r.bucket for r in records.mixed_buckets(strict, synth, silver, ["k"], "fam", ["i"], 0.75, 0).collect()) == {"strict", "synth"}


def test_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "id string, v int")
    assert records.check_rows(df, "id") is df and records.check_repeats(df, "id", True) is df
    for call in (lambda: records.check_rows(df, "v"), lambda: records.check_rows(df, "w"), lambda: records.check_repeats(df, "id", False)):
        with pytest.raises(ValueError):
            call()


def test_labelled_ids(spark):
    df = spark.createDataFrame([([1, 2], [3]), ([1, 2, 3], [4, 5]), ([], None), (None, [9])], "p array<int>, c array<int>")
    got = [tuple(map(list, r.x)) for r in df.select(records.labelled_ids(F.col("p"), F.col("c"), 4).alias("x")).collect()]
    assert got == [([1, 2, 3, 0], [-100, -100, 3, -100], [1, 1, 1, 0]), ([1, 2, 3, 4], [-100, -100, -100, 4], [1, 1, 1, 1]), ([0] * 4, [-100] * 4, [0] * 4), ([9, 0, 0, 0], [9, -100, -100, -100], [1, 0, 0, 0])]


def test_puzzles_as_json(spark):
    puzzles = spark.read.parquet(f"{DATA}/puzzles.parquet")
    back = puzzles.select("id", "query", "metadata", records.decoded(records.encoded(puzzles)).alias("d"))
    assert back.where("NOT (d.query <=> query) OR NOT (d.id <=> id) OR NOT (d.metadata.split <=> metadata.split) OR NOT (d.metadata.extras <=> metadata.extras)").count() == 0
    legacy = spark.createDataFrame([('{"id": "a", "metadata": {"family_tags": ["bit", "x"]}}',), ('{"id": "b"}',), ("none",), (None,)], "t string").select(records.decoded(F.col("t")).alias("d")).collect()
    assert legacy[0].d.metadata.official_family == "bit" and legacy[1].d.metadata is None and legacy[2].d is None and legacy[3].d is None


def test_orders(spark):
    names = spark.createDataFrame([("checkpoint-20",), ("final",), ("checkpoint-3",)], "n string")
    assert [r.n for r in names.orderBy(*records.step_order(F.col("n"))).collect()] == ["checkpoint-3", "checkpoint-20", "final"]
    rows = spark.createDataFrame([("a", "unit", "x"), ("b", "bit", "y"), ("c", "bit", "x")], "id string, official_family string, error_type string")
    assert [r.id for r in rows.orderBy(*records.repair_order(rows)).collect()] == ["c", "b", "a"]
