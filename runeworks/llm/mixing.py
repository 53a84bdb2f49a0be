"""Problem 1: mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeworks.functions.labels import family_label, label
from runeworks.llm.quotas import unit_hash
from runeworks.llm.settings import settings_rows
from runeworks.operators.latest import latest
from runeworks.operators.puzzles import MD
from runeworks.operators.ranking import ordered_slices, rank_slices
from runeworks.session import settle

#: Buckets of the hashed words that the classifier sees.
BUCKETS = 1024

#: Rounds of projected gradient steps at most, and the relative change of the totals that ends them.
ROUNDS, CHANGE = 12, 1e-4


def mix_rows(targets: DataFrame) -> list[dict]:
    """The rows of the settings table with canonical labels and whole targets, read by the driver."""
    rows = targets.select(
        "mix_name",
        "source",
        "official_family",
        label(F.col("source")).alias("s"),
        family_label(F.col("official_family")).alias("f"),
        F.coalesce("target_share", F.lit(0.0)).alias("share"),
        F.coalesce("max_repeats", F.lit(1)).cast("int").alias("repeats"),
        F.coalesce("total_records", F.lit(0)).cast("long").alias("total"),
    )
    out = [r.asDict() for r in settings_rows(rows)]
    out.sort(key=lambda r: tuple(str(r[k]) for k in ("mix_name", "official_family", "source", "share", "total")))
    for r in out:
        r["wanted"] = int(np.floor(round(r["share"] * r["total"], 6) + 0.5))
        r["repeats"] = max(0, r["repeats"])
    return out


def labelled_puzzles(puzzles: DataFrame) -> DataFrame:
    """``id, source, family, words`` of each puzzle; ``words`` are hashed words of its instruction."""
    found = F.filter(F.split(F.lower("official_instruction"), r"[^\p{L}]+"), lambda w: w != "")
    hashed = F.array_distinct(F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))
    return latest(
        puzzles,
        "id",
        "ingested_at",
        source=label(F.col(MD + "source")),
        family=family_label(F.col(MD + "official_family"), F.col(MD + "family_tags")),
        words=F.coalesce(hashed, F.array().cast("array<int>")),
    )


def _log_rates(rows: DataFrame, column: str, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes from the labelled rows: log priors and log rates of words, a row for each class.

    Counts cover every labelled row; the driver gets at most a row for each class and bucket.
    """
    known = F.when(F.col(column).isin(classes), F.col(column)).otherwise("") if classes else F.lit("")
    named = rows.where(F.col(column).isNotNull()).select(known.alias("__c"), "words")
    order = {c: i for i, c in enumerate([*classes, ""])}
    counts = np.full((len(order), BUCKETS), 0.5)
    totals = np.full(len(order), 0.5)
    for c, n in named.groupBy("__c").count().collect():
        totals[order[c]] += n
    for c, w, n in named.select("__c", F.explode("words").alias("__w")).groupBy("__c", "__w").count().collect():
        counts[order[c], w] += n
    return np.log(totals / totals.sum()), np.log(counts / counts.sum(axis=1, keepdims=True))


def memberships(puzzles: DataFrame, rows: list[dict]) -> DataFrame:
    """``id, hard, m, n``: the soft membership of each puzzle in every row of the settings; ``n`` is 1.

    A labelled puzzle belongs wholly to its own source and family. Where a label is missing,
    a classifier fitted on the labelled rows gives the posterior of each; ``hard`` tells the
    row a puzzle belongs to by its labels alone, per row.
    """
    base = settle(labelled_puzzles(puzzles))
    sources = sorted({r["s"] for r in rows if r["s"]})
    families = sorted({r["f"] for r in rows if r["f"] and r["official_family"] != "*"})
    source_prior, source_words = _log_rates(base, "source", sources)
    family_prior, family_words = _log_rates(base, "family", families)

    def posterior(prior: np.ndarray, rates: np.ndarray, found: list[int]) -> np.ndarray:
        logs = prior + rates[:, found].sum(axis=1)
        shares = np.exp(logs - logs.max())
        return shares / shares.sum()

    def soften(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_at = {s: i for i, s in enumerate(sources)}
        f_at = {f: i for i, f in enumerate(families)}
        table: dict[tuple, list[float]] = {}
        for batch in batches:
            ids, wholly, shares = batch.column(0), [], []
            for s, f, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                key = (s, f)
                m = table.get(key) if s and f else None
                if m is None:
                    ps = np.eye(len(sources) + 1)[s_at.get(s, len(sources))] if s else posterior(source_prior, source_words, found)
                    pf = np.eye(len(families) + 1)[f_at.get(f, len(families))] if f else posterior(family_prior, family_words, found)
                    m = [
                        float(ps[s_at[r["s"]]] * (1.0 if r["official_family"] == "*" else pf[f_at[r["f"]]] if r["f"] else 0.0)) if r["s"] else 0.0
                        for r in rows
                    ]
                    if s and f:
                        table[key] = m
                shares.append(m)
                wholly.append([bool(s and s == r["s"] and (r["official_family"] == "*" or f and f == r["f"])) for r in rows])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(wholly, pa.list_(pa.bool_())), pa.array(shares, pa.list_(pa.float64())), pa.array(np.ones(len(ids), dtype=np.int64))],
                names=["id", "hard", "m", "n"],
            )

    kind = base.schema["id"].dataType.simpleString()
    soft = base.mapInArrow(soften, f"id {kind}, hard array<boolean>, m array<double>, n bigint")
    return settle(soft.where(F.exists("m", lambda x: x > 0)))


def alike(members: DataFrame) -> DataFrame:
    """``hard, m, n``: members that belong alike as one row with their number, to which the fit is the same."""
    return settle(members.groupBy("hard", "m").agg(F.sum("n").alias("n")))


def own_members(members: DataFrame) -> DataFrame:
    """``hard, m, n``: only what members belong to by their labels, alike ones as one row."""
    own = members.where(F.exists("hard", lambda x: x)).groupBy("hard").agg(F.sum("n").alias("n"))
    return settle(own.select("hard", F.transform("hard", lambda x: x.cast("double")).alias("m"), "n"))


class Fit:
    """The fitted rates: a rate of each puzzle and group follows from its memberships and the steps.

    The rows of one mix that share a total form a group: those for whole sources, and those of
    each family. Should a group name a source twice, each naming is a group of its own.
    """

    def __init__(self, rows: list[dict]) -> None:
        keys, met = [], {}
        for r in rows:
            base = (str(r["mix_name"]), str(r["official_family"]))
            met[(*base, r["s"])] = met.get((*base, r["s"]), -1) + 1
            keys.append((*base, met[(*base, r["s"])]))
        self.groups = sorted(set(keys))
        self.inside = np.asarray([[k == g for k in keys] for g in self.groups], dtype=float).reshape(len(self.groups), len(rows))
        self.caps = np.asarray([r["repeats"] for r in rows], dtype=float)
        self.steps: list[np.ndarray] = []

    def rates(self, m: np.ndarray) -> np.ndarray:
        """Rates of each puzzle (row) in each group (column): the steps so far, projected after each."""
        mass = m @ self.inside.T
        caps = (m * self.caps) @ self.inside.T / np.where(mass > 0, mass, 1.0)
        rates = np.zeros_like(mass)
        for step in self.steps:
            rates = np.clip(rates - (m * step) @ self.inside.T, 0.0, caps)
        return rates


def _array(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def fit_rates(members: DataFrame, rows: list[dict]) -> tuple[Fit, np.ndarray, np.ndarray]:
    """Distributed projected gradient for nonnegative rates whose expected totals match the targets.

    Minimises the squared misses of the totals of all rows, each scaled by the mass of its
    members, over rates between 0 and the repeats allowed. A step is one pass that sums
    expected totals; rates are never stored, for each follows from the memberships and the
    few steps. Returns the fit, the expected totals, and how many members belong to each row wholly.
    """
    fit, n = Fit(rows), len(rows)
    wanted = np.asarray([r["wanted"] for r in rows], dtype=float)

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, n))
        for batch in batches:
            if batch.num_rows:
                hard, m = _array(batch.column(0), n), _array(batch.column(1), n)
                count = batch.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None]
                share = m * (fit.rates(m) @ fit.inside)
                sums += ((share * count).sum(axis=0), (m**2 * count).sum(axis=0), (hard * count).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(3 * n)), pa.array(sums.ravel())], names=["slot", "value"])

    def measure() -> np.ndarray:
        found = np.zeros(3 * n)
        summed = members.select("hard", "m", "n").mapInArrow(totals, "slot bigint, value double").groupBy("slot").agg(F.sum("value"))
        for slot, value in summed.collect():
            found[slot] = value
        return found.reshape(3, n)

    sums = measure()
    for _ in range(ROUNDS):
        fit.steps.append(np.where(sums[1] > 0, (sums[0] - wanted) / np.maximum(sums[1], 1e-12), 0.0))
        before, sums = sums, measure()
        if np.all(np.abs(sums[0] - before[0]) <= CHANGE * np.maximum(wanted, 1.0)):
            break
    return fit, sums[0], sums[2]


def mixture_fit(puzzles: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict], Fit]:
    """Memberships, the settings with ``expected`` and ``available``, and the fit over all puzzles."""
    rows = mix_rows(targets)
    members = memberships(puzzles, rows)
    fit, expected, available = fit_rates(members, rows)
    for i, r in enumerate(rows):
        r["expected"], r["available"] = float(expected[i]), int(round(available[i]))
    return members, rows, fit


def target_fit(puzzles: DataFrame, targets: DataFrame) -> list[dict]:
    """The settings with what the fits reach: ``expected, available, reached, unmet``.

    The classifier gives every puzzle its memberships. The fit over all of them tells what a row
    gets in the mixture, classified puzzles included (``expected``); the one over the same members
    by label alone, what it gets of its own puzzles (``reached``). A row whose own total stays short
    of its target by half a record or more cannot be met: the fitted rates of its puzzles are then
    all at the repeats allowed.
    """
    rows = mix_rows(targets)
    members = alike(memberships(puzzles, rows))
    _, expected, available = fit_rates(members, rows)
    _, reached, _ = fit_rates(own_members(members), rows)
    for i, r in enumerate(rows):
        r["expected"], r["available"], r["reached"] = float(expected[i]), int(round(available[i])), float(reached[i])
        r["unmet"] = bool(r["wanted"] - reached[i] >= 0.5)
    return rows


_REPORT = (
    "mix_name string, source string, official_family string, wanted bigint, max_repeats int, available bigint, expected double, reached double, unmet boolean"
)


def mixture_targets(puzzles: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of ``mix_targets``: what is wanted, available, expected of all puzzles and reached by its own, and whether it cannot be met."""
    names = ("mix_name", "source", "official_family", "wanted", "repeats", "available", "expected", "reached", "unmet")
    return puzzles.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in target_fit(puzzles, targets)], _REPORT)


def unmet_targets(puzzles: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, official_family`` of the targets that cannot be met (p1_found)."""
    return mixture_targets(puzzles, targets).where("unmet").select("mix_name", "source", "official_family")


def mix_sources(puzzles: DataFrame, targets: DataFrame, seed: int = 23) -> DataFrame:
    """The mixture: ``mix_name, source, official_family, id, copies, by_label``.

    Every target row gets its whole number of records as far as its puzzles and repeats
    allow. Puzzles without a label join the row of each group that their posterior favours, at
    their own fitted rate, rounded by a hash of id and row; they count for at most the row's
    target. The row's own puzzles get the whole part of their fitted rate, and of the records
    still missing each one more in hash order, never beyond ``max_repeats``.

    Repeated deliveries of a puzzle count once. A target with a null share or total asks for
    nothing, null repeats mean one. Rows that name unknown sources give no records. Empty
    tables give an empty result. The settings table is read by the driver, and its size
    checked (:func:`settings_rows`).
    """
    members, rows, fit = mixture_fit(puzzles, targets)
    n, spark = len(rows), puzzles.sparkSession
    kind = members.schema["id"].dataType.simpleString()

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hard, m = _array(batch.column(1), n), _array(batch.column(2), n)
            rates = fit.rates(m)
            who, which, rate, own = [], [], [], []
            for k in range(len(fit.groups)):
                of_group = fit.inside[k] > 0
                row_of = np.where(of_group, m + 2.0 * hard, -1.0).argmax(axis=1)
                mine = np.flatnonzero(m[np.arange(len(m)), row_of] * of_group[row_of] > 0)
                who.append(mine)
                which.append(row_of[mine])
                rate.append(rates[mine, k])
                own.append(hard[mine, row_of[mine]] > 0)
            who, which, rate, own = map(np.concatenate, (who, which, rate, own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who)), pa.array(which.astype(np.int32)), pa.array(rate), pa.array(own)],
                names=["id", "row", "rate", "own"],
            )

    if not rows:
        return spark.createDataFrame([], f"mix_name string, source string, official_family string, id {kind}, copies bigint, by_label boolean")
    placed = members.mapInArrow(assign, f"id {kind}, row int, rate double, own boolean").withColumn(
        "u", unit_hash(F.col("id"), F.col("row"), seed=seed)
    )
    # A rate that fails a whole number by less than the fit's own error is that number.
    whole = F.floor(F.col("rate") + 1e-6).cast("long")
    guests = placed.where(~F.col("own")).withColumn(
        "copies", whole + (F.col("u") < F.col("rate") - whole).cast("long")
    ).where(F.col("copies") > 0)
    settled_guests = settle(guests.select("id", "row", "copies", "own"))
    brought = dict(settled_guests.groupBy("row").agg(F.sum("copies")).collect())
    order = [F.col("u").asc(), F.col("id").asc()]
    own = ordered_slices(placed.where("own").select("id", "row", "u", "own", whole.alias("base")), ["row"], order)
    based = dict(own.groupBy("row").agg(F.sum("base")).collect())
    plan = []
    for j, r in enumerate(rows):
        missing = r["wanted"] - min(brought.get(j, 0), r["wanted"]) - based.get(j, 0)
        each, more = divmod(missing, r["available"]) if r["available"] else (0, 0)
        plan.append((j, each, more, r["repeats"], r["mix_name"], r["source"], r["official_family"]))
    settings = spark.createDataFrame(plan, "row int, each bigint, more bigint, most bigint, mix_name string, source string, official_family string")
    ranked = rank_slices(own, ["row"], order).join(settings.select("row", "each", "more", "most"), "row")
    copies = F.greatest(F.lit(0), F.least(F.col("most"), F.col("base") + F.col("each") + (F.col("rank") <= F.col("more")).cast("long")))
    both = ranked.select("id", "row", copies.alias("copies"), "own").unionByName(settled_guests).where(F.col("copies") > 0)
    return both.join(settings.select("row", "mix_name", "source", "official_family"), "row").select(
        "mix_name", "source", "official_family", "id", "copies", F.col("own").alias("by_label")
    )


def mixture_shares(puzzles: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target row that gets records: ``records, puzzles, most_copies`` and its actual share of the mix's records.

    Families of one mix with totals of their own have shares within each total.
    """
    drawn = mix_sources(puzzles, targets).groupBy("mix_name", "source", "official_family").agg(
        F.sum("copies").alias("records"), F.count(F.lit(1)).alias("puzzles"), F.max("copies").alias("most_copies")
    )
    whole = drawn.groupBy("mix_name", "official_family").agg(F.sum("records").alias("__t"))
    return drawn.join(whole, ["mix_name", "official_family"]).select(
        "mix_name", "source", "official_family", "records", "puzzles", "most_copies", (F.col("records") / F.col("__t")).alias("actual_share")
    )
