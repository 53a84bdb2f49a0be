"""Evaluation against labels, outcomes, the published extraction, and what the search tells."""

import pytest
from pyspark.sql import functions as F

from runeworks.operators import graph
from runeworks.plans import evaluate, replica, teacher

LABELS = "id string, target_answer string, family string, subtype string"


def _tables(spark):
    labels = spark.createDataFrame([("a", "1", "bit", "s"), ("b", "0.5", "unit", None), ("c", None, None, None)], LABELS)
    predictions = spark.createDataFrame([("a", "\\boxed{1}"), ("a", "2"), ("b", "\\boxed{1/2}"), ("z", "1"), (None, "1")], "id string, prediction string")
    return predictions, labels


def test_replica(spark):
    predictions, labels = _tables(spark)
    got = replica.replica(predictions, labels)
    assert sorted((r.id, r.prediction, r.exact, r.numeric, r.correct) for r in got.records.collect()) == [("a", "2", False, False, False), ("a", "\\boxed{1}", True, True, True), ("b", "\\boxed{1/2}", False, True, True)]
    assert [r.id for r in got.missing.collect()] == ["c"] and sorted(r.id for r in got.unexpected.collect()) == ["", "z"] and [(r.id, r.n) for r in got.duplicate.collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="missing=1, unexpected=2, duplicate=1"):
        replica.replica(predictions, labels, strict=True)
    fine = predictions.where("prediction <> '2' AND id IN ('a', 'b')")
    assert replica.replica(fine, labels.where("id <> 'c'"), strict=True).records.count() == 2
    assert replica.replica(predictions.limit(0), labels).missing.count() == 3 and replica.joined(predictions, labels.limit(0)).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    predictions, labels = _tables(spark)
    clashing = predictions.withColumns({c: F.lit("x") for c in ("target", "family", "subtype", "exact", "numeric", "boxed_valid", "extracted_answer", "correct", "output_tokens")})
    rows = replica.joined(clashing, labels)
    assert len(rows.columns) == len(set(rows.columns)) and sorted(r.correct for r in rows.collect()) == [False, True, True]


def test_checksum_ignores_order(spark):
    predictions, labels = _tables(spark)
    rows = replica.joined(predictions, labels)
    once, again = replica.checksum(rows).first(), replica.checksum(rows.repartition(7).orderBy(F.rand(3))).first()
    assert once == again and once.n == 3 and once.checksum != replica.checksum(rows.where("id = 'a'")).first().checksum


def test_outcomes(spark):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "id string, correct boolean")
    assert {r.id: r.outcome for r in replica.outcomes(rows, "id").collect()} == {"a": "success", "b": "failure", "c": "failure"}
    only = spark.createDataFrame([("b",), ("q",)], "id string")
    assert [r.id for r in replica.outcomes(rows, "id", only).collect()] == ["b"] and replica.outcomes(rows, "id", only.limit(0)).count() == 3


def test_official_answers(spark):
    cases = [
        ("\\boxed{1} so \\boxed{ 2 } and \\boxed{}", "2", "2.01", True), ("\\boxed{a{b}c}", "a{b", "x", False), ("x \\boxed{0101", "0101", "0101", True), ("\\boxed{101}", "101", "0101", False),
        ("The final answer is: Foo\nmore 3", "Foo", "foo", True), ("Final answer: 7\nFinal answer: 8", "8", "8.05", True), ("it is 3 or -4.5 ok", "-4.5", "-4.5", True), ("one\n\n two \n", "two", "TWO", True), ("", "NOT_FOUND", "", False), (None, "NOT_FOUND", None, False),
    ]
    df = spark.createDataFrame([(i, a, t) for i, (a, _, t, _) in enumerate(cases)], "i int, p string, t string")
    got = df.withColumn("a", replica.official_answer(F.col("p"))).withColumn("ok", F.coalesce(replica.official_match(F.col("a"), F.col("t")), F.lit(False))).orderBy("i").collect()
    assert [(r.a, r.ok) for r in got] == [(w, ok) for _, w, _, ok in cases]


def test_failure_types(spark):
    rows = [(True, True, True, True, "x", "correct"), (True, False, True, True, "x", "numeric_only"), (False, False, False, False, "x", "format_error"), (False, False, False, True, "", "format_error"), (False, False, False, True, "x", "wrong_answer"), (False, False, True, True, "x", "numeric_only")]
    df = spark.createDataFrame(rows, "c boolean, e boolean, n boolean, b boolean, p string, want string")
    assert df.where(replica.failure_type(*map(F.col, "cenbp")) != F.col("want")).count() == 0


PUZZLE = "id string, family string, subtype string, source string, query string, parsed_examples array<struct<input:string,output:string>>, target_answer string"


def _puzzles(spark):
    return spark.createDataFrame(
        [
            ("r", "numeral", "numeral_roman", None, "9", [("4", "IV"), ("7", "VII")], "IX"),
            ("x", "bit", "bit_affine", "official", "00000001", [("00000000", "11110000"), ("11111111", "00001111"), ("10101010", "01011010")], "11110001"),
            ("n", "bit", "bit_affine", "official", "0001", [("0000", "zz")], "1"),
            ("e", "cipher", None, "synthetic", "q", [], "1"),
        ],
        PUZZLE,
    )


def test_annotations_and_rescue(spark):
    rows = {r.id: r for r in teacher.annotate(_puzzles(spark), 6, 2).collect()}
    assert (rows["r"].program_signature, rows["r"].coverage, rows["r"].verifiable, rows["r"].answer) == ("dec2roman", 1.0, True, "IX") and rows["r"].composition_key == "numeral|numeral_roman|dec2roman"
    assert rows["x"].answer == "11110001" and '"steps"' in rows["x"].debug
    assert (rows["e"].program_signature, rows["e"].coverage, rows["e"].verifiable, rows["e"].composition_key) == (None, 0.0, False, None)
    done = {r.id: r for r in teacher.rescue(teacher.annotate(_puzzles(spark), 6, 2), beam=4, depth=2).collect()}
    assert not any(r.rescued for r in done.values()) and done["r"].program_signature == "dec2roman"
    worse = teacher.annotate(_puzzles(spark), 6, 2).withColumns({"verifiable": F.lit(False), "coverage": F.lit(0.0), "program_signature": F.lit(None).cast("string")})
    again = {r.id: r for r in teacher.rescue(worse, beam=4, depth=2).collect()}
    counts = {r.family: tuple(r)[1:] for r in teacher.rescue_counts(teacher.rescue(worse, beam=4, depth=2)).collect()}
    assert counts["bit"] == (2, 2, 2, 2) and counts["numeral"] == (1, 0, 0, 0)
    assert again["x"].rescued and again["x"].answer == "11110001" and not again["r"].rescued and again["r"].program_signature is None
    assert teacher.annotate(_puzzles(spark).limit(0)).count() == 0


def test_only_missing_annotations_are_searched(spark):
    given = _puzzles(spark).withColumn("program_signature", F.when(F.col("id") == "r", "kept")).withColumn("confidence", F.when(F.col("id") == "r", 0.3))
    rows = {r.id: r for r in teacher.annotate_missing(given, 6, 2).collect()}
    assert (rows["r"].program_signature, rows["r"].answer) == ("kept", None) and rows["x"].program_signature is not None and len(rows) == 4


def test_hints(spark):
    cases = [
        ("equation", "equation_symbolic", ["delete_characters", "position_transducer"], "equation_position"), ("equation", "equation_symbolic", ["add_constant"], None), ("equation", "equation_numeric", ["operator_template"], None),
        ("cipher", "cipher_vocab", ["vocabulary_cipher"], None), ("cipher", "cipher_vocab", ["sort_tokens", "fixed_substitution"], "cipher_perm"), ("cipher", "cipher_vocab", ["caesar_shift"], "cipher_char_sub"),
        ("bit", "bit_affine", ["binary_affine_transform"], None), ("bit", "bit_affine", ["reverse_bits", "binary_xor_mask"], "bit_xor_mask"), ("bit", None, ["reverse_bits"], None), ("unit", "unit_scale", [], None), ("bit", "bit_affine", None, None),
    ]
    df = spark.createDataFrame([(i, f, s, x) for i, (f, s, x, _) in enumerate(cases)], "i int, family string, subtype string, steps array<string>")
    got = df.withColumn("h", teacher.subtype_hint(F.col("family"), F.col("subtype"), F.col("steps"))).orderBy("i").collect()
    assert [r.h for r in got] == [w for *_, w in cases]
    counts = teacher.hint_counts(df.withColumn("source", F.lit(None).cast("string"))).collect()
    assert sum(r.n for r in counts) == 4 and teacher.hint_counts(df.withColumn("source", F.lit("synthetic"))).count() == 0


def test_acceptance(spark):
    df = spark.createDataFrame([(True, 0.1, 0.5), (False, 0.8, 1.0), (None, 0.79, 1.0), (False, 0.9, 0.99), (None, None, None)], "m boolean, c double, e double")
    got = [tuple(r.a) for r in df.select(teacher.accept(F.col("m"), F.col("c"), F.col("e")).alias("a")).collect()]
    assert [(a, r) for a, r, _ in got] == [(True, "matches_reference"), (True, "high_confidence_solver_trace")] + [(False, "low_confidence_or_incorrect")] * 3 and got[0][2] == 1.0


def test_benchmark(spark):
    rows = replica.benchmark(_puzzles(spark), 6, 2)
    report = {r.family: r for r in replica.benchmark_report(rows).collect()}
    assert (report["numeral"].n, report["numeral"].accuracy, report["numeral"].correct_type) == (1, 1.0, 1) and report["bit"].n == 2 and report["cipher"].format_error_type == 1
    assert replica.benchmark(_puzzles(spark), families=["bit"]).count() == 2


def test_hard_cases_by_margin(spark):
    rows = spark.createDataFrame([(i, False, True, "bit", 0.5, m) for i, m in enumerate((0.3, None, 0.1, -0.2))], "record_id int, correct boolean, boxed_valid boolean, family string, confidence double, margin double")
    assert [r.record_id for r in evaluate.hard_cases(rows, 3).collect()] == [3, 1, 2]


def test_graph_round_trip(spark, tmp_path):
    steps = spark.createDataFrame([("bit", ["a", "b"]), ("bit", ["a"])], "family string, steps array<string>")
    tables = {"nodes": graph.rule_nodes(steps), "edges": graph.rule_edges(steps), "family": graph.rule_edges_by_family(steps), "positions": graph.rule_positions(steps)}
    graph.save_graph(tables, str(tmp_path / "g"))
    back = graph.load_graph(spark, str(tmp_path / "g"))
    for name, rows in tables.items():
        assert sorted(map(tuple, back[name].select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
