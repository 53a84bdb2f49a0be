"""Problem 2: same or nearly same puzzles across splits."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from runeworks.operators.puzzles import current_puzzles
from runeworks.session import settle

# Separators that no puzzle text holds after canonical typing.
FIELD, PAIR, HEAD, NOTHING = "\x01", "\x02", "\x03", "\x04"

#: A key with more than this fraction of all rows is hot and cut into slices of that size; so at most as many
#: keys as its inverse are hot, whatever the data, and the table of hot keys may be broadcast.
HOT = 1 / 1000

#: Share of the larger set of distinct pairs that two puzzles must have in common.
THRESHOLD = 0.7

_BLANK = re.compile(r"[\s\u200b-\u200f\u2060\ufeff\u00ad]+")
_NUMBER = re.compile(r"(?<![0-9.,])(?:\d[\d,]*(?:\.\d*)?|\.\d+)")


def _plain_number(match: re.Match) -> str:
    text = match.group(0)
    if match.start() and match.string[match.start() - 1].isalpha():
        return text
    whole, _, part = text.partition(".")
    if "," in whole:
        if re.fullmatch(r"\d{1,3}(,\d{3})+", whole):
            whole = whole.replace(",", "")
        elif not part and re.fullmatch(r"\d+,\d+", whole):
            whole, part = whole.split(",")
        else:
            return text
    part = part.rstrip("0")
    return (whole.lstrip("0") or "0") + ("." + part if part else "")


def canonical_typing(text: str) -> str:
    """Content of one field without its typing: Unicode form, case, blanks and number format."""
    text = unicodedata.normalize("NFKC", text).casefold().replace("−", "-")
    text = unicodedata.normalize("NFKC", _BLANK.sub("", text))
    return _NUMBER.sub(_plain_number, text) if any(c.isdigit() for c in text) else text


@F.pandas_udf(StringType())
def _canonical_fields(packed: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def field(x: str) -> str:
        got = known.get(x)
        if got is None:
            if len(known) > 200_000:
                known.clear()
            got = known[x] = x if x == NOTHING else canonical_typing(x)
        return got

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        query, _, pairs = x.partition(HEAD)
        done = [FIELD.join(field(f) for f in p.split(FIELD)) for p in pairs.split(PAIR)]
        return field(query) + HEAD + PAIR.join(done)

    return packed.map(one)


def hot_keys(counts: DataFrame, key: str, total: int) -> DataFrame:
    """``key, slices`` of the keys in ``counts`` (``key, f``) that hold more than :data:`HOT` of ``total`` rows.

    There are fewer than ``1 / HOT`` of them by construction, which bounds what the broadcast holds.
    """
    most = max(1.0, total * HOT)
    return F.broadcast(counts.where(F.col("f") > most).select(key, F.ceil(F.col("f") / most).cast("int").alias("slices")))


def _sliced(df: DataFrame, hot: DataFrame, key: str, by: str, out: str) -> DataFrame:
    """``df`` with the slice of its hot key that each row falls into by the hash of ``by``; 0 for other keys."""
    known = hot.withColumnsRenamed({key: "__k", "slices": "__s"})
    cut = F.pmod(F.xxhash64(by), F.coalesce("__s", F.lit(1))).cast("int")
    return df.join(known, F.col(key) == F.col("__k"), "left").withColumn(out, cut).drop("__k", "__s")


def _over_slices(df: DataFrame, hot: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` once for each slice of its hot key, so that it meets the rows of all of them."""
    known = hot.withColumnsRenamed({key: "__k", "slices": "__s"})
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__s", F.lit(1)) - 1)).alias(out)
    return df.join(known, F.col(key) == F.col("__k"), "left").select(*df.columns, every)


def puzzle_classes(puzzles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, side, split, source, class) and ``classes`` (class, side, n, query, pairs, tokens).

    A class holds the puzzles of one side (train or evaluation) with the same query and the
    same set of support pairs, so copies are compared once; it is named by a 128-bit digest of
    the side and these texts. ``pairs`` are the texts themselves, by which overlaps are told in
    the end. A token is a short hash of query and pair together, by which candidates are found;
    two puzzles with different queries share none.
    """
    p = current_puzzles(puzzles, "split", "source", "query", "parsed_examples")

    def field(c):
        return F.coalesce(F.regexp_replace(c, "[\x01-\x04]", ""), F.lit(NOTHING))

    pairs = F.array_join(
        F.transform("parsed_examples", lambda e: F.concat(field(e["input"]), F.lit(FIELD), field(e["output"]))), PAIR
    )
    rows = (
        p.where(F.col("split").isNotNull() & F.col("query").isNotNull() & (F.size("parsed_examples") > 0))
        .select(
            "id",
            "split",
            "source",
            F.when(F.col("split") == "train", "train").otherwise("eval").alias("side"),
            _canonical_fields(F.concat(field(F.col("query")), F.lit(HEAD), pairs)).alias("__t"),
        )
        .withColumn("query", F.substring_index("__t", HEAD, 1))
        .where((F.col("query") != "") & (F.col("query") != NOTHING))
        .withColumn("pairs", F.array_sort(F.array_distinct(F.split(F.substring_index("__t", HEAD, -1), PAIR))))
        .withColumn("class", F.unhex(F.md5(F.concat_ws(HEAD, "side", "query", F.array_join("pairs", PAIR)))))
        .select("id", "side", "split", "source", "query", "pairs", "class")
    )
    rows = settle(rows)
    first = F.first(F.struct("query", "pairs")).alias("__x")
    classes = rows.groupBy("class", "side").agg(first).select(
        "class", "side", F.size("__x.pairs").alias("n"), "__x.query", "__x.pairs",
        F.transform("__x.pairs", lambda x: F.xxhash64(F.col("__x.query"), x)).alias("tokens"),
    )
    return rows.drop("query", "pairs"), classes


def overlapping_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``eval_class, train_class, shared, larger``: classes with at least ``threshold`` of the larger set in common.

    An exact prefix-filter join. Tokens are ordered by how many classes hold them, rarest
    first; a pair of sets that reaches the threshold must share a token among the first
    ``n - ceil(threshold * n) + 1`` of each. Evaluation prefixes are the index, training
    prefixes probe it; candidates must pass the length filter and the position filter (the
    tokens left behind the shared one must still suffice) before the sets are compared, text
    by text. The classes of a hot token are cut into slices on both sides, and every slice
    of one side meets every slice of the other in a task of its own.
    """
    tokens = settle(classes.select("class", "side", "n", F.explode("tokens").alias("token")))
    freq = tokens.groupBy("token").agg(
        F.count(F.lit(1)).alias("f"), F.countDistinct("side").alias("sides")
    )
    freq = settle(freq)
    hot = hot_keys(freq, "token", tokens.count())
    # A token that only one side holds shares nothing but still takes a place in the order.
    counted = _sliced(tokens, hot, "token", "class", "part").join(_over_slices(freq, hot, "token", "part"), ["token", "part"])
    ordered = (
        counted
        .groupBy("class", "side", "n")
        .agg(F.array_sort(F.collect_list(F.struct("f", "token", "sides"))).alias("__s"))
    )
    need = F.ceil(F.round(F.col("n") * threshold, 9)).cast("int")
    prefixes = (
        ordered.select("class", "side", "n", F.posexplode(F.slice("__s", F.lit(1), F.col("n") - need + 1)).alias("pos", "t"))
        .where(F.col("t.sides") == 2)
        .select("class", "side", "n", "pos", F.col("t.token").alias("token"))
    )
    index = prefixes.where(F.col("side") == "eval").select(
        "token", F.col("class").alias("eval_class"), F.col("n").alias("en"), F.col("pos").alias("ep")
    )
    probe = prefixes.where(F.col("side") == "train").select(
        "token", F.col("class").alias("train_class"), F.col("n").alias("tn"), F.col("pos").alias("tp")
    )
    index = _over_slices(_sliced(index, hot, "token", "eval_class", "row"), hot, "token", "col")
    probe = _over_slices(_sliced(probe, hot, "token", "train_class", "col"), hot, "token", "row")
    most = F.greatest("en", "tn")
    least_shared = F.ceil(F.round(most * threshold, 9))
    candidates = (
        probe.join(index, ["token", "row", "col"])
        .where(F.least("en", "tn") >= least_shared)
        .where(F.least("ep", "tp") + F.least(F.col("en") - F.col("ep"), F.col("tn") - F.col("tp")) >= least_shared)
        .select("eval_class", "train_class")
        .distinct()
    )
    sets = classes.select("class", "n", "query", "pairs")
    larger = F.greatest("en", "tn")
    return (
        candidates.join(sets.withColumnsRenamed({"class": "eval_class", "n": "en", "query": "eq", "pairs": "et"}), "eval_class")
        .join(sets.withColumnsRenamed({"class": "train_class", "n": "tn", "query": "tq", "pairs": "tt"}), "train_class")
        .where(F.col("eq") == F.col("tq"))
        .withColumn("shared", F.size(F.array_intersect("et", "tt")))
        .where(F.col("shared") >= F.ceil(F.round(larger * threshold, 9)))
        .select("eval_class", "train_class", "shared", larger.alias("larger"))
    )


def cross_split_overlaps(puzzles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every overlap between an evaluation puzzle and a training puzzle.

    Result: ``eval_id, eval_split, eval_source, train_id, train_source, shared, larger``.
    Puzzles count once, by their latest delivery. Those without a query, pairs or split
    label are no case; a pair with a null output stands for itself and equals only a pair
    that lacks the output too. Order and repetition of pairs do not matter. Empty tables
    give an empty result. The result has a row for each pair of puzzles, as many as the
    copies of an overlapping puzzle on both sides multiplied; :func:`overlap_members` and
    :func:`overlap_report` tell the same by classes.
    """
    members, classes = puzzle_classes(puzzles)
    hits = overlapping_classes(classes, threshold)
    hot = hot_keys(members.groupBy("class").agg(F.count(F.lit(1)).alias("f")), "class", members.count())
    sliced = _sliced(members, hot, "class", "id", "part")
    ev = sliced.where(F.col("side") == "eval").select(
        F.col("class").alias("eval_class"),
        F.col("part").alias("row"),
        F.col("id").alias("eval_id"),
        F.col("split").alias("eval_split"),
        F.col("source").alias("eval_source"),
    )
    tr = sliced.where(F.col("side") == "train").select(
        F.col("class").alias("train_class"), F.col("part").alias("col"), F.col("id").alias("train_id"), F.col("source").alias("train_source")
    )
    # A hot class meets the other one slice by slice.
    cells = _over_slices(hits, hot.withColumnRenamed("class", "eval_class"), "eval_class", "row")
    cells = _over_slices(cells, hot.withColumnRenamed("class", "train_class"), "train_class", "col")
    return cells.join(ev, ["eval_class", "row"]).join(tr, ["train_class", "col"]).drop("eval_class", "train_class", "row", "col")


def overlap_pairs(puzzles: DataFrame) -> DataFrame:
    """``id_a, id_b``, smaller id first (p2_found)."""
    return cross_split_overlaps(puzzles).select(
        F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")
    )


def _linked(puzzles: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``members`` of :func:`puzzle_classes`, and ``class, links, exact``: how many puzzles of the other side each class meets."""
    members, classes = puzzle_classes(puzzles)
    hits = settle(overlapping_classes(classes, threshold))
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("__n"))
    both = hits.withColumn("__same", (F.col("shared") == F.col("larger")).cast("long"))
    sides = both.select(F.col("eval_class").alias("mine"), F.col("train_class").alias("class"), "__same").unionByName(
        both.select(F.col("train_class").alias("mine"), F.col("eval_class").alias("class"), "__same")
    )
    found = sides.join(sizes, "class").groupBy("mine").agg(F.sum("__n").alias("links"), F.sum(F.col("__n") * F.col("__same")).alias("exact"))
    return members, found.withColumnRenamed("mine", "class")


def overlap_members(puzzles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each puzzle that takes part: ``id, side, split, source, class, links``.

    ``class`` (hexadecimal) is shared by the copies of one side; ``links`` counts the puzzles of
    the other side that overlap with it. Nothing is expanded into pairs.
    """
    members, linked = _linked(puzzles, threshold)
    hot = hot_keys(members.groupBy("class").agg(F.count(F.lit(1)).alias("f")), "class", members.count())
    rows = _sliced(members, hot, "class", "id", "part").join(_over_slices(linked, hot, "class", "part"), ["class", "part"], "left")
    return rows.select("id", "side", "split", "source", F.hex("class").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def overlap_report(puzzles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per split and source of the evaluation puzzle: overlapping puzzles, pairs and exact pairs, counted by classes."""
    members, linked = _linked(puzzles, threshold)
    of_class = members.where(F.col("side") == "eval").groupBy("class", "split", "source").agg(F.count(F.lit(1)).alias("__m"))
    return (
        of_class.join(linked, "class")
        .groupBy("split", "source")
        .agg(
            F.sum("__m").alias("eval_puzzles"),
            F.sum(F.col("__m") * F.col("links")).alias("pairs"),
            F.sum(F.col("__m") * F.col("exact")).alias("exact_pairs"),
        )
    )
