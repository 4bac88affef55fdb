"""Cardinality estimates by random walks, all walks at once, and their errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import materialised, numbered, pick
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import breadth_first_order, skeleton


def walks(graph: LabeledGraph, pattern: Pattern, pairs: DataFrame, order: list[int], first: int, last: int, seed: int = 7, induced: bool = True) -> DataFrame:
    """walk, weight for walks numbered from first to before last.

    A walk takes a candidate of the first vertex, then, along the spanning tree, one of the parent's neighbours
    that is a candidate and not yet on the walk. The choice is by a hash of seed, walk and step over the ids in order. The weight is
    the product of the numbers of choices; 0 where there is none, or where a further edge is missing or, induced, a forbidden one is there.
    """
    steps = skeleton(pattern, breadth_first_order(pattern, order))
    spark = pairs.sparkSession
    roots = pairs.filter(F.col("u") == steps[0].vertex).select("v")
    ranked = numbered(roots, "v", name="rank")
    lanes = spark.range(first, last).select(F.col("id").alias("walk"))
    n_roots = roots.agg(F.count("*").alias("n"))
    state = lanes.join(n_roots).withColumn("rank", F.when(F.col("n") > 0, pick(F.col("n"), seed, F.col("walk"), 0)))
    state = state.join(ranked.select("rank", F.col("v").alias(f"m{steps[0].vertex}")), "rank", "left").select("walk", f"m{steps[0].vertex}", F.when(F.col(f"m{steps[0].vertex}").isNull(), 0.0).otherwise(F.col("n").cast("double")).alias("weight"))
    for i, step in enumerate(steps[1:], 1):
        if step.parent is None:
            raise ValueError("estimates are for connected patterns")
        name = f"m{step.vertex}"
        own = pairs.filter(F.col("u") == step.vertex).select(F.col("v").alias(name))
        near = graph.adj.select(F.col("src").alias("_from"), F.col("dst").alias(name)).join(own, name, "left_semi")
        mapped = [c for c in state.columns if c.startswith("m")]
        choices = state.join(near, F.col(f"m{step.parent}") == F.col("_from")).drop("_from")
        for c in mapped:
            choices = choices.filter(F.col(c) != F.col(name))
        ranks = choices.withColumn("n", F.count("*").over(Window.partitionBy("walk"))).withColumn("rank", F.row_number().over(Window.partitionBy("walk").orderBy(name)) - 1)
        taken = ranks.filter(F.col("rank") == pick(F.col("n"), seed, F.col("walk"), i)).select("walk", name, "n")
        state = state.join(taken, "walk", "left").withColumn("weight", F.col("weight") * F.coalesce("n", F.lit(0))).drop("n")
        for v in step.extra:
            hit = graph.adj.select(F.col("src").alias(f"m{v}"), F.col("dst").alias(name), F.lit(1).alias("hit"))
            state = state.join(hit, [f"m{v}", name], "left").withColumn("weight", F.when(F.col("hit").isNull(), 0.0).otherwise(F.col("weight"))).drop("hit")
        if induced:
            for v in step.absent:
                hit = graph.adj.select(F.col("src").alias(f"m{v}"), F.col("dst").alias(name), F.lit(1).alias("hit"))
                state = state.join(hit, [f"m{v}", name], "left").withColumn("weight", F.when(F.col("hit").isNotNull(), 0.0).otherwise(F.col("weight"))).drop("hit")
    return state.select("walk", "weight")


def summary(weights: DataFrame, z: float = 1.96) -> DataFrame:
    """n, mean, half_width (z * sample deviation / root of n), estimate (the mean rounded half up)."""
    s = weights.agg(F.count("*").alias("n"), F.avg("weight").alias("mean"), F.stddev_samp("weight").alias("sd"))
    return s.select("n", "mean", (z * F.col("sd") / F.sqrt("n")).alias("half_width"), F.floor(F.col("mean") + 0.5).cast("long").alias("estimate"))


def estimate(graph: LabeledGraph, pattern: Pattern, pairs: DataFrame, order: list[int], tau: float = 100.0, most: int = 100, z: float = 1.96, seed: int = 7, induced: bool = True, batch: int = 1000) -> DataFrame:
    """The summary of up to ``most`` walks, in batches, until the half width is below tau."""
    done, n = None, 0
    while n < most:
        more = materialised(walks(graph, pattern, pairs, order, n, min(n + batch, most), seed, induced))
        done = more if done is None else done.unionByName(more)
        n = min(n + batch, most)
        found = summary(done, z)
        width = found.first()["half_width"]
        if width is not None and width < tau:
            break
    return summary(done, z)


def relative_error(rows: DataFrame, actual: str = "actual", estimated: str = "estimate") -> DataFrame:
    """rows with error = |a - e| / a; where a is 0: 0 if e is 0 too, else 1."""
    a, e = F.col(actual).cast("double"), F.col(estimated).cast("double")
    return rows.withColumn("error", F.when(a != 0, F.abs(a - e) / a).when(e == 0, 0.0).otherwise(1.0))
