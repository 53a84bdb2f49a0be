"""Transition statistics of program steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _share(n: Column, total: Column) -> Column:
    return F.round(n.cast("double") / total, 9)


def rule_nodes(programs: DataFrame) -> DataFrame:
    """``op, n, weight``: how often each step occurs, per program. ``programs`` has ``steps``."""
    total = programs.count()
    return programs.select(F.explode("steps").alias("op")).groupBy("op").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "weight", _share(F.col("n"), F.lit(max(1, total)))
    )


def _edges(programs: DataFrame, *keys: str) -> DataFrame:
    pairs = F.arrays_zip(
        F.slice("steps", F.lit(1), F.greatest(F.size("steps") - 1, F.lit(0))).alias("lhs"),
        F.slice("steps", F.lit(2), F.greatest(F.size("steps") - 1, F.lit(0))).alias("rhs"),
    )
    return (
        programs.where(F.size("steps") > 1)
        .select(*keys, F.explode(pairs).alias("__e"))
        .groupBy(*keys, F.col("__e.lhs").alias("lhs"), F.col("__e.rhs").alias("rhs"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rule_edges(programs: DataFrame) -> DataFrame:
    """``lhs, rhs, n, weight``: transitions between consecutive steps, as shares of all."""
    edges = _edges(programs)
    total = edges.agg(F.sum("n")).first()[0] or 1
    return edges.withColumn("weight", _share(F.col("n"), F.lit(total)))


def rule_edges_by_family(programs: DataFrame) -> DataFrame:
    """``family, lhs, rhs, n, weight``: as shares of the family's transitions."""
    edges = _edges(programs.where(F.col("family").isNotNull()), "family")
    totals = edges.groupBy("family").agg(F.sum("n").alias("__t"))
    return edges.join(totals, "family").withColumn("weight", _share(F.col("n"), F.col("__t"))).drop("__t")


def rule_positions(programs: DataFrame) -> DataFrame:
    """``position, op, n, weight``: steps at each position, as shares of that position."""
    placed = programs.select(F.posexplode("steps").alias("position", "op")).groupBy("position", "op").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = placed.groupBy("position").agg(F.sum("n").alias("__t"))
    return placed.join(totals, "position").withColumn("weight", _share(F.col("n"), F.col("__t"))).drop("__t")


def merge_weights(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Weights and counts of two graphs: the mean where ``new`` has the key, a missing old weight being 0; counts add up."""
    both = old.withColumnsRenamed({"weight": "__ow", "n": "__on"}).join(
        new.withColumnsRenamed({"weight": "__nw", "n": "__nn"}), keys, "full_outer"
    )
    mean = F.round((F.coalesce("__ow", F.lit(0.0)) + F.col("__nw")) / 2, 9)
    return both.select(
        *keys,
        F.when(F.col("__nw").isNull(), F.col("__ow")).otherwise(mean).alias("weight"),
        (F.coalesce("__on", F.lit(0)) + F.coalesce("__nn", F.lit(0))).alias("n"),
    )


def save_graph(graph: dict[str, DataFrame], path: str) -> None:
    """The tables of a rule graph (``nodes``, ``edges``, ``family`` and ``positions``) as Parquet below ``path``."""
    for name, rows in graph.items():
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def load_graph(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The tables that :func:`save_graph` wrote; without ``names`` all four."""
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names or ("nodes", "edges", "family", "positions")}


def transition_prior(steps: DataFrame, by_family: DataFrame, overall: DataFrame) -> DataFrame:
    """``steps`` (family, lhs, rhs) with ``prior``: the family's weight of the transition, else the overall one, else 0."""
    own = by_family.select("family", "lhs", "rhs", F.col("weight").alias("__f"))
    all_ = overall.select("lhs", "rhs", F.col("weight").alias("__o"))
    return (
        steps.join(own, ["family", "lhs", "rhs"], "left")
        .join(all_, ["lhs", "rhs"], "left")
        .withColumn("prior", F.coalesce("__f", "__o", F.lit(0.0)))
        .drop("__f", "__o")
    )


def path_graph(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of candidate programs (``id, rank, score, steps``): one path for each."""
    nodes = candidates.select("id", "rank", F.posexplode("steps").alias("step", "op")).withColumn(
        "node", F.concat_ws("_", F.lit("chain"), "rank", F.lit("step"), "step")
    )
    edges = candidates.where(F.size("steps") > 1).select(
        "id",
        F.explode(F.sequence(F.lit(0), F.size("steps") - 2)).alias("step"),
        "rank",
        F.col("score").alias("weight"),
    ).select(
        "id",
        F.concat_ws("_", F.lit("chain"), "rank", F.lit("step"), "step").alias("source"),
        F.concat_ws("_", F.lit("chain"), "rank", F.lit("step"), F.col("step") + 1).alias("target"),
        "weight",
    )
    return nodes, edges
