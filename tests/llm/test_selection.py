"""Mixing, caps and quotas."""

import pytest
from pyspark.sql import functions as F

from runeworks.llm import caps, mixing, quotas
from runeworks.llm.oracles import oracle_sql
from runeworks.llm.queries import queries
from runeworks.llm.settings import SETTINGS_ROWS
from tests.conftest import DATA, normal
from tests.llm.helpers import build, puzzle, rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert normal(queries()[name](spark, DATA).toPandas()) == normal(duck.execute(oracle_sql()[name]).df())


def _caps(spark):
    puzzles = [
        puzzle("a", confidence=0.9), puzzle("b", confidence=0.9), puzzle("c", confidence=float("nan")), puzzle("d", confidence=1.7),
        puzzle("e", confidence=None), puzzle("f", confidence=0.1), puzzle("f", confidence=0.95, at=5), puzzle("lone"), puzzle("out"), puzzle(None),
    ]
    programs = [
        {"id": i, "signature_bucket": b, "signature": s}
        for i, b, s in [("a", "xor", None), ("b", "Binary_Xor_Mask", None), ("b", "Binary_Xor_Mask", None), ("c", None, "xor:101"), ("d", " ", "xor:1"), ("e", "XOR", "zz"), ("f", "xor:k=1", None), ("lone", None, None), (None, "xor", None), ("gone", "xor", None)]
    ]
    return build(spark, "puzzles", puzzles), build(spark, "program_signatures", programs)


def test_caps(spark):
    puzzles, programs = _caps(spark)
    policies = build(spark, "bucket_caps", [{"policy_name": "two", "max_records": 2}, {"policy_name": "half", "max_share_bp": 5000}, {"policy_name": "all"}, {"policy_name": "tiny", "max_share_bp": 1, "max_records": 5}])
    kept = caps.cap_contributors(puzzles, programs, policies)
    ranks = {r.id: r["rank"] for r in kept.where("policy_name = 'two'").collect()}
    assert ranks == {"f": 1, "a": 2, "b": 3, "c": 4, "d": 5, "e": 6}
    gone = {}
    for p, i in rows(caps.dropped_by_caps(puzzles, programs, policies)):
        gone.setdefault(p, []).append(i)
    assert gone == {"two": ["b", "c", "d", "e"], "half": ["c", "d", "e"], "tiny": ["a", "b", "c", "d", "e"]}


def test_caps_of_nothing(spark):
    puzzles, programs = _caps(spark)
    policies = build(spark, "bucket_caps", [{"policy_name": "two", "max_records": 2}])
    for p, g, c in ((puzzles.limit(0), programs, policies), (puzzles, programs.limit(0), policies), (puzzles, programs, policies.limit(0))):
        assert caps.cap_contributors(p, g, c).count() == 0 and caps.dropped_by_caps(p, g, c).columns == ["policy_name", "id"]


def _quotas(spark):
    puzzles = [puzzle(f"r{i}") for i in range(40)] + [puzzle(f"x{i}", subtype=" Bit-Affine") for i in range(3)] + [puzzle("r0", at=9), puzzle("n", subtype=None), puzzle("m", family=None, tags=["bit"], subtype="bit_rotate")]
    plan = [
        {"plan_name": "p", "plan_rows": 20, "official_family": "bit", "subtype": "bit_rotate", "target_share": 0.5, "min_rows": 1},
        {"plan_name": "p", "plan_rows": 20, "official_family": "bit", "subtype": "bit_affine", "target_share": 0.1, "min_rows": 5},
        {"plan_name": "p", "plan_rows": 20, "official_family": "bit", "subtype": "lacking", "target_share": 0.4, "min_rows": 0},
        {"plan_name": "q", "plan_rows": 41, "official_family": "bit", "subtype": "bit_rotate", "target_share": 1.0, "min_rows": None},
    ]
    return build(spark, "puzzles", puzzles), build(spark, "sample_quotas", plan)


def test_quotas(spark):
    puzzles, plan = _quotas(spark)
    assert rows(quotas.missed_quotas(puzzles, plan)) == [("p", "bit", "bit_affine"), ("p", "bit", "lacking")]
    drawn = quotas.quota_sample(puzzles, plan)
    found = rows(drawn)
    assert len(found) == len(set(found)) == 10 + 3 + 41
    assert found == rows(quotas.quota_sample(puzzles.repartition(3), plan)) and found != rows(quotas.quota_sample(puzzles, plan, seed=3))
    report = {(r.plan_name, r.subtype): (r.wanted, r.drawn, r.deficit) for r in quotas.quota_report(puzzles, plan).collect()}
    assert report == {("p", "bit_rotate"): (10, 10, 0), ("p", "bit_affine"): (5, 3, 2), ("p", "lacking"): (8, 0, 8), ("q", "bit_rotate"): (41, 41, 0)}
    assert quotas.quota_sample(puzzles.limit(0), plan).count() == 0 == quotas.quota_sample(puzzles, plan.limit(0)).count()
    assert len(rows(quotas.missed_quotas(puzzles.limit(0), plan))) == 4


def test_missed_quotas_are_those_the_sample_misses(spark, monkeypatch):
    """p5_found follows what was drawn: a sample that lacks rows has misses."""
    puzzles, plan = _quotas(spark)
    report = quotas.quota_report(puzzles, plan)
    assert rows(quotas.missed_quotas(puzzles, plan)) == rows(report.where("drawn < wanted").select("plan_name", "official_family", "subtype"))
    real = quotas._draw
    monkeypatch.setattr(quotas, "_draw", lambda p, c, s: real(p, c, s).where("id <> 'r0'"))
    assert ("q", "bit", "bit_rotate") in rows(quotas.missed_quotas(puzzles, plan))


def test_short_draws_are_filled(spark, monkeypatch):
    puzzles, plan = _quotas(spark)
    real = quotas.quota_counts
    monkeypatch.setattr(quotas, "quota_counts", lambda p, q: real(p, q).withColumn("accept", F.lit(0.0)))
    assert quotas.quota_sample(puzzles, plan).count() == 10 + 3 + 41


def _mix(spark):
    puzzles = [puzzle(f"o{i}") for i in range(30)] + [puzzle(f"s{i}", source=" Synthetic", family="unit") for i in range(10)]
    puzzles += [puzzle("u1", source=None), puzzle("u2", source="unknown", family=None), puzzle("o0", at=3)]
    targets = [
        {"mix_name": "m", "source": "official", "official_family": "*", "target_share": 0.5, "max_repeats": 1, "total_records": 40},
        {"mix_name": "m", "source": "synthetic", "official_family": "*", "target_share": 0.5, "max_repeats": 2, "total_records": 40},
        {"mix_name": "f", "source": "synthetic", "official_family": "unit", "target_share": 0.7, "max_repeats": 2, "total_records": 30},
        {"mix_name": "f", "source": "voice", "official_family": "unit", "target_share": 0.3, "max_repeats": 9, "total_records": 30},
    ]
    return build(spark, "puzzles", puzzles), build(spark, "mix_targets", targets)


def test_mixing(spark):
    puzzles, targets = _mix(spark)
    assert rows(mixing.unmet_targets(puzzles, targets)) == [("f", "synthetic", "unit"), ("f", "voice", "unit")]
    mixed = mixing.mix_sources(puzzles, targets).toPandas()
    totals = mixed.groupby(["mix_name", "source"]).copies.sum().to_dict()
    assert totals[("m", "official")] == 20 and totals[("m", "synthetic")] == 20 and 20 <= totals[("f", "synthetic")] <= 21
    assert mixed[mixed.source == "synthetic"].copies.max() <= 2 and mixed[mixed.source == "official"].copies.max() == 1
    assert not mixed.duplicated(["mix_name", "source", "official_family", "id"]).any()
    shares = {(r.mix_name, r.source): r.actual_share for r in mixing.mixture_shares(puzzles, targets).collect()}
    assert shares[("m", "official")] == 0.5


def test_fit_reaches_targets(spark):
    puzzles, targets = _mix(spark)
    _, found, fit = mixing.mixture_fit(puzzles, targets)
    for r in found:
        assert r["expected"] <= r["wanted"] * 1.02
        if r["mix_name"] == "m":
            assert r["expected"] == pytest.approx(r["wanted"], rel=0.02)
    assert len(fit.groups) == 2 and fit.steps


def test_verdicts_come_from_the_fit(spark, monkeypatch):
    """p1_found is what the fitted rates of a row's own puzzles leave open, and agrees with the shares of the mixture."""
    puzzles, targets = _mix(spark)
    report = {(r.mix_name, r.source): r for r in mixing.mixture_targets(puzzles, targets).collect()}
    assert {k: round(r.reached, 6) for k, r in report.items()} == {("m", "official"): 20, ("m", "synthetic"): 20, ("f", "synthetic"): 20, ("f", "voice"): 0}
    drawn = {(r.mix_name, r.source): r.records for r in mixing.mixture_shares(puzzles.where("metadata.source is not null and metadata.source <> 'unknown'"), targets).collect()}
    assert {k for k, r in report.items() if r.unmet} == {k for k, r in report.items() if drawn.get(k, 0) < r.wanted}
    real = mixing.fit_rates
    monkeypatch.setattr(mixing, "fit_rates", lambda m, r: (lambda fit, reached, n: (fit, 0.0 * reached, n))(*real(m, r)))
    assert len(rows(mixing.unmet_targets(puzzles, targets))) == 4


def test_verdicts_take_every_step_of_the_method(spark, monkeypatch):
    """Puzzles without labels are classified for p1_found too and fill up what a row is expected to get, not what its own puzzles reach."""
    puzzles, targets = _mix(spark)
    fitted, real = [], mixing._log_rates
    monkeypatch.setattr(mixing, "_log_rates", lambda rows, column, classes: fitted.append(column) or real(rows, column, classes))
    report = {(r.mix_name, r.source): r for r in mixing.mixture_targets(puzzles, targets).collect()}
    assert fitted == ["source", "family"]
    short = report[("f", "synthetic")]
    assert short.unmet and short.reached == 20 < short.expected <= short.wanted == 21
    _, found, _ = mixing.mixture_fit(puzzles, targets)
    assert {(r["mix_name"], r["source"]): round(r["expected"], 6) for r in found} == {k: round(r.expected, 6) for k, r in report.items()}
    assert rows(mixing.unmet_targets(puzzles, targets)) == [("f", "synthetic", "unit"), ("f", "voice", "unit")]


def test_overlapping_rows_have_totals_of_their_own(spark):
    puzzles, _ = _mix(spark)
    base = {"mix_name": "m", "target_share": 0.5, "total_records": 40, "max_repeats": 1}
    targets = build(spark, "mix_targets", [{**base, "source": "official", "official_family": "*"}, {**base, "source": "official", "official_family": "bit"}, {**base, "source": "OFFICIAL", "official_family": "*", "target_share": 0.8}])
    assert rows(mixing.unmet_targets(puzzles, targets)) == [("m", "OFFICIAL", "*")]
    many = build(spark, "mix_targets", [{**base, "source": f"s{i}", "official_family": "*"} for i in range(SETTINGS_ROWS + 1)])
    with pytest.raises(ValueError):
        mixing.unmet_targets(puzzles, many)


def test_mixing_nothing(spark):
    puzzles, targets = _mix(spark)
    assert len(rows(mixing.unmet_targets(puzzles.limit(0), targets))) == 4
    assert mixing.mix_sources(puzzles.limit(0), targets).count() == 0
    assert mixing.unmet_targets(puzzles, targets.limit(0)).count() == 0 == mixing.mix_sources(puzzles, targets.limit(0)).count()
