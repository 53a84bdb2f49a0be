"""Relational operators: nulls, ties, repeats, empty tables and dominant groups."""

import hashlib
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runeworks.operators import graph, lengths, selection, splits
from runeworks.operators.latest import latest
from runeworks.operators.ranking import running_total, salted_rank


def test_latest(spark):
    t = [datetime(2025, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([("a", t[0], "x"), ("a", t[2], None), ("a", t[1], "z"), ("b", None, "q"), (None, t[1], "n"), ("c", t[0], "k"), ("c", t[0], "m"), ("c", t[0], "m")], "id string, at timestamp, v string")
    assert {(r.id, r.v) for r in latest(df, "id", "at", v=F.col("v")).collect()} == {("a", None), ("b", "q"), ("c", "m")}
    assert latest(df.limit(0), "id", "at", v=F.col("v")).count() == 0


def test_salted_rank_is_row_number(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}", rng.randrange(5) / 4, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, q double, id int").repartition(5)
    got = {(r.g, r.id): r["rank"] for r in salted_rank(df, ["g"], [F.col("q").desc(), F.col("id").asc()]).collect()}
    want, seen = {}, {}
    for g, q, i in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[(g, i)] = seen[g]
    assert got == want
    assert salted_rank(df.limit(0), ["g"], [F.col("id").asc()]).count() == 0


def test_running_total(spark):
    rows = [(i % 3, (i * 7) % 50, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, n int, id int")
    got = {r.id: r.before for r in running_total(df, ["g"], [F.col("n").asc(), F.col("id").asc()], "n").collect()}
    for g in range(3):
        total = 0
        for _, n, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            assert got[i] == total
            total += n
    whole = running_total(df, [], [F.col("id").asc()], "n").agg(F.max("before")).first()[0]
    assert whole == sum(n for _, n, _ in rows[:-1])


def test_group_split(spark):
    rows = [(i, f"g{i % 10 if i > 60 else 0}", None if i == 5 else "f") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, grp string, fam string")
    got = splits.group_split(df, "grp", 0.15, 7).collect()
    roles = {}
    for r in got:
        assert roles.setdefault(r.grp, r.role) == r.role
    valid = sum(r.role == "valid" for r in got)
    assert len(got) == 200 and 30 <= valid < 30 + 15
    assert splits.group_split(df, "grp", 0.15, 7, "fam").count() == 199
    assert splits.group_split(df.limit(0), "grp", 0.15, 7).count() == 0


def test_group_split_falls_back_on_rows(spark):
    rows = [(i, "only", "one") for i in range(100)] + [(100 + i, f"h{i % 2}", "halves") for i in range(100)] + [(200 + i, f"s{i % 20}", "many") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, grp string, fam string")
    got = splits.group_split(df, "grp", 0.15, 7, "fam").collect()
    assert len({r.id for r in got}) == len(got) == 300
    valid = {f: sorted(r.id for r in got if r.fam == f and r.role == "valid") for f in ("one", "halves", "many")}
    assert {f: len(v) for f, v in valid.items()} == {"one": 15, "halves": 15, "many": 15}
    assert valid["one"] == sorted(sorted(range(100), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())[:15])
    assert len({(r.grp, r.role) for r in got if r.fam == "many"}) == 20


def test_select_split(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    members = spark.createDataFrame([(1, "train"), (2, "train"), (2, "valid")], "id int, role string")
    assert [r.id for r in splits.select_split(rows, members, "id", "train", members, "valid").collect()] == [1]
    assert [r.id for r in splits.leak_free(rows, members, "id").collect()] == [3]
    made = spark.createDataFrame([(1, "official"), (3, "synthetic"), (4, "repair"), (5, None), (2, "synthetic")], "id int, source string")
    assert sorted(r.id for r in splits.select_split(made, members, "id", "train").collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in splits.select_split(made, members, "id", "train", members, "valid").collect()) == [1, 3, 4]
    assert sorted(r.id for r in splits.select_split(made, members, "id", "valid").collect()) == [2]
    assert sorted(r.id for r in splits.of_kind(made, "synth").collect()) == [2, 3] and splits.of_kind(made, None) is made
    assert sorted(r.id for r in splits.of_kind(made, "official ").collect()) == [1, 5]
    with pytest.raises(ValueError, match="together"):
        splits.select_split(made, members, "id", "train", members)


def test_selection(spark):
    rows = spark.createDataFrame([(1, "a", "k"), (2, "a", None), (3, "b", None), (4, "b", "k"), (5, "c", "k")], "id int, fam string, k string")
    order = [F.col("id").asc()]
    assert sorted(r.id for r in selection.first_per_key(rows, [F.col("k")], [F.col("id")]).collect()) == [1, 2]
    assert sorted(r.id for r in selection.cap_per_key(rows, F.col("fam"), order, 1).collect()) == [1, 3, 5]
    assert selection.cap_per_key(rows, F.col("fam"), order, 0).count() == 5
    assert selection.oversample(rows, F.when(F.col("fam") == "a", 3).otherwise(0)).count() == 6
    placed = selection.interleave(rows, "fam", ["c", "b"], order, 4).orderBy("place").collect()
    assert [r.id for r in placed] == [5, 3, 1, 4]
    mixed = selection.replay_mix(rows.where("id < 4"), rows.where("id >= 4"), 0.5, order).collect()
    assert sorted((r.id, r.bucket) for r in mixed) == [(1, "repair"), (2, "repair"), (3, "repair"), (4, "replay")]


def walked(records, priority, visits, most):
    """The walk over the families, record by record."""
    families = {}
    for i, fam, key in sorted(records):
        families.setdefault(fam or "unknown", []).append((i, key))
    schedule = [f for f in priority if f in families] + sorted(set(families) - set(priority))
    given, out, turn = {}, [], 0
    while any(families.values()):
        turn += 1
        for fam in [f for f in schedule for _ in range(visits.get(f, 1))]:
            while families[fam]:
                i, key = families[fam].pop(0)
                if most <= 0 or given.get(key, 0) < most:
                    given[key] = given.get(key, 0) + 1
                    out.append((i, fam, turn))
                    break
    return out


def test_interleave_keeps_rows_without_group(spark):
    rng = random.Random(3)
    records = [(i, rng.choice(["a", "b", "b", "c", "z", "", None]), f"k{min(rng.randrange(12), 6)}") for i in range(300)]
    rows = spark.createDataFrame(records, "id int, fam string, k string")
    order = [F.col("id").asc()]
    for visits, most in (({}, 0), ({"c": 2, "b": 3}, 0), ({"b": 2}, 9), ({"b": 2}, 1)):
        placed = selection.interleave(rows, "fam", ["c", "b"], order, None, visits, F.col("k"), most).orderBy("place").collect()
        assert [(r.id, r.fam, r.turn) for r in placed] == walked(records, ["c", "b"], visits, most)
        assert [r.place for r in placed] == list(range(1, len(placed) + 1))
    assert selection.interleave(rows.limit(0), "fam", [], order, None, {}, F.col("k"), 2).count() == 0


def test_graph(spark):
    programs = spark.createDataFrame([("f", ["a", "b", "a"]), ("f", ["a"]), (None, []), ("g", ["b", "a"])], "family string, steps array<string>")
    nodes = {r.op: (r.n, r.weight) for r in graph.rule_nodes(programs).collect()}
    assert nodes == {"a": (4, 1.0), "b": (2, 0.5)}
    edges = {(r.lhs, r.rhs): r.weight for r in graph.rule_edges(programs).collect()}
    assert edges == {("a", "b"): round(1 / 3, 9), ("b", "a"): round(2 / 3, 9)}
    old = spark.createDataFrame([("a", 0.5, 2), ("z", 0.25, 1)], "op string, weight double, n long")
    merged = {r.op: (r.weight, r.n) for r in graph.merge_weights(old, graph.rule_nodes(programs), ["op"]).collect()}
    assert merged == {"a": (0.75, 6), "b": (0.25, 2), "z": (0.25, 1)}
    by_family = graph.rule_edges_by_family(programs)
    steps = spark.createDataFrame([("f", "a", "b"), ("h", "b", "a"), ("h", "x", "y")], "family string, lhs string, rhs string")
    priors = {(r.family, r.lhs): r.prior for r in graph.transition_prior(steps, by_family, graph.rule_edges(programs)).collect()}
    assert priors == {("f", "a"): 0.5, ("h", "b"): round(2 / 3, 9), ("h", "x"): 0.0}
    chains = spark.createDataFrame([("p", 0, 1.5, ["a", "b"])], "id string, rank int, score double, steps array<string>")
    vertices, links = graph.path_graph(chains)
    assert vertices.count() == 2 and links.first().target == "chain_0_step_1"


def test_prompt_and_completion_lengths(spark):
    records = [("s", " ".join("p" * n), " ".join("c" * (21 - n))) for n in range(1, 21)] + [("s", None, "c"), ("s", "", "c"), ("s", "p " * 40, None), ("t", None, None)]
    df = spark.createDataFrame(records, "stage string, prompt string, completion string")
    part = lengths.part_percentiles(df, "stage").collect()
    assert [tuple(r) for r in part] == [("s", 20, 10, 19, 10, 19)]
    audit = {r.stage: tuple(r)[1:] for r in lengths.prompt_audit(df, "stage", budget=15).collect()}
    assert audit == {"s": (23, 2, 6, 11, 20, 40, 40, round(250 / 21, 9), False), "t": (1, 1, 0, None, None, None, 0, 0.0, False)}
    assert lengths.prompt_audit(df.where("prompt != ''"), "stage", budget=40).first().fits
