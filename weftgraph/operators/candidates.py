"""Candidates: which vertices of a graph each vertex of a pattern can stand for, as rows (u, v)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import COMPLETE, holds, materialised, occurrences
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import directed

METHODS = ("groundTruth", "DAF", "graphQL")
#: Up to this degree Hall's condition is checked over all subsets of neighbours in SQL, beyond it by augmenting paths.
SUBSETS_UP_TO = 8


def _every(conditions):
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _chosen(rows: DataFrame, pattern: Pattern, condition) -> DataFrame:
    """(u, v) for each row and pattern vertex whose condition holds: one pass, no join."""
    fits = [F.when(condition(u), F.lit(u)) for u in pattern.vertices]
    return rows.select(F.explode(F.array_compact(F.array(*fits))).alias("u"), F.col("id").alias("v"))


def label_degree(graph: LabeledGraph, pattern: Pattern, mode: str = COMPLETE) -> DataFrame:
    """By label and degree."""
    return _chosen(graph.degrees(), pattern, lambda u: holds(F.col("label"), pattern.labels[u], mode) & (F.col("deg") >= pattern.degree(u)))


def label_degree_profile(graph: LabeledGraph, pattern: Pattern, mode: str = COMPLETE) -> DataFrame:
    """By label, degree and profile: the labels (or tokens) around the pattern vertex must be around the graph vertex as often."""
    needs = {u: pattern.profile(u) if mode == COMPLETE else pattern.token_profile(u) for u in pattern.vertices}
    keys = sorted({k for c in needs.values() for k in c})
    at = {k: f"n{i}" for i, k in enumerate(keys)}
    around = graph.adj.join(graph.vertices, F.col("dst") == F.col("id")).groupBy("src").agg(F.count("*").alias("deg"), *[F.sum(occurrences(F.col("label"), k, mode)).alias(at[k]) for k in keys])
    own = graph.vertices.join(around, F.col("id") == F.col("src"), "left")
    own = own.select("id", "label", F.coalesce("deg", F.lit(0)).alias("deg"), *[(F.coalesce(at[k], F.lit(0)) + occurrences(F.col("label"), k, mode)).alias(at[k]) for k in keys])
    return _chosen(own, pattern, lambda u: holds(F.col("label"), pattern.labels[u], mode) & (F.col("deg") >= pattern.degree(u)) & _every([F.col(at[k]) >= n for k, n in sorted(needs[u].items())]))


def _matchable(masks: list[int]) -> int:
    """The size of a largest matching of neighbours (bits) to vertices (one mask each), by augmenting paths."""
    of: dict[int, int] = {}

    def place(i: int, seen: set[int]) -> bool:
        mask, bit = masks[i], 0
        while mask >> bit:
            if mask >> bit & 1 and bit not in seen:
                seen.add(bit)
                if bit not in of or place(of[bit], seen):
                    of[bit] = i
                    return True
            bit += 1
        return False

    return sum(place(i, set()) for i in range(len(masks)))


def _hall(graph: LabeledGraph, pairs: DataFrame, near: dict[int, list[int]], asked: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v), or those of them that are asked for, for which the given neighbours of u can be matched to different neighbours of v through the pairs."""
    spark = pairs.sparkSession
    asked = pairs if asked is None else asked
    free = [u for u in near if not near[u]]
    bits = [(u, w, 1 << i) for u in near for i, w in enumerate(near[u])]
    kept = asked.filter(~F.col("u").isin([u for u in near if near[u]])) if free or len(near) else asked
    if not bits:
        return asked
    table = F.broadcast(spark.createDataFrame(bits, "u int, w int, bit long"))  # the pattern's edges
    seen = asked.join(table, "u").join(graph.adj, F.col("v") == F.col("src")).select("u", "v", "w", "bit", F.col("dst").alias("x"))
    seen = seen.join(pairs.select(F.col("u").alias("w"), F.col("v").alias("x")), ["w", "x"]).groupBy("u", "v", "x").agg(F.bit_or("bit").alias("mask"))
    shapes = seen.groupBy("u", "v", "mask").agg(F.count("*").alias("n"))
    few = {u: ws for u, ws in near.items() if ws and len(ws) <= SUBSETS_UP_TO}
    out = kept
    if few:
        subsets = F.broadcast(spark.createDataFrame([(u, s, bin(s).count("1")) for u, ws in few.items() for s in range(1, 1 << len(ws))], "u int, subset long, size int"))
        reach = shapes.join(subsets, "u").filter(F.col("mask").bitwiseAND(F.col("subset")) != 0).groupBy("u", "v", "subset", "size").agg(F.sum("n").alias("n"))
        whole = F.create_map(*[F.lit(x) for u, ws in few.items() for x in (u, (1 << len(ws)) - 1)])
        good = reach.filter("n >= size").groupBy("u", "v").agg(F.count("*").alias("met")).filter(F.col("met") == whole[F.col("u")]).select("u", "v")
        out = out.unionByName(good)
    many = {u: len(ws) for u, ws in near.items() if len(ws) > SUBSETS_UP_TO}
    if many:

        def match(group: pd.DataFrame) -> pd.DataFrame:
            u, v = int(group["u"].iloc[0]), int(group["v"].iloc[0])
            masks = [m for m, n in zip(group["mask"], group["n"]) for _ in range(min(int(n), many[u]))]
            return pd.DataFrame({"u": [u], "v": [v]})[[_matchable(masks) == many[u]]]

        out = out.unionByName(shapes.filter(F.col("u").isin(list(many))).groupBy("u", "v").applyInPandas(match, "u int, v long"))
    return out


def prune_globally(graph: LabeledGraph, pattern: Pattern, pairs: DataFrame) -> DataFrame:
    """Drops pairs whose neighbours cannot be matched through pairs, until nothing changes. The greatest fixpoint is unique.

    After the first round only pairs next to a dropped one are looked at again.
    """
    near = {u: pattern.neighbours(u) for u in pattern.vertices}
    pairs = asked = materialised(pairs)
    links = [(u, w) for u in near for w in near[u]]
    while links:
        gone = materialised(asked.join(_hall(graph, pairs, near, asked), ["u", "v"], "left_anti"))
        if gone.isEmpty():
            break
        pairs = materialised(pairs.join(gone, ["u", "v"], "left_anti"))
        table = F.broadcast(pairs.sparkSession.createDataFrame(links, "u int, w int"))  # the pattern's edges
        beside = gone.join(table, "u").join(graph.adj, F.col("v") == F.col("src")).select(F.col("w").alias("u"), F.col("dst").alias("v"))
        asked = pairs.join(beside, ["u", "v"], "left_semi")
    return pairs


def candidates(graph: LabeledGraph, pattern: Pattern, method: str = "graphQL", mode: str = COMPLETE, globally: bool = True) -> DataFrame:
    """(u, v) by a method's name; graphQL prunes globally too unless told otherwise."""
    if method in ("groundTruth", "DAF"):
        return label_degree(graph, pattern, mode)
    if method == "graphQL":
        pairs = label_degree_profile(graph, pattern, mode)
        return prune_globally(graph, pattern, pairs) if globally else pairs
    raise ValueError(f"unknown candidate method: {method}; known are {', '.join(METHODS)}")


def sizes(pairs: DataFrame, pattern: Pattern) -> dict[int, int]:
    found = {r["u"]: r["n"] for r in pairs.groupBy("u").agg(F.count("*").alias("n")).collect()}  # a row for each pattern vertex
    return {u: found.get(u, 0) for u in pattern.vertices}


def edge_candidates(graph: LabeledGraph, pairs: DataFrame, edges: list[tuple[int, int]]) -> DataFrame:
    """u_parent, u_child, v_parent, v_child: the graph edges that can stand for each (parent, child)."""
    table = F.broadcast(pairs.sparkSession.createDataFrame(edges, "u_parent int, u_child int"))
    first = pairs.select(F.col("u").alias("u_parent"), F.col("v").alias("v_parent")).join(table, "u_parent")
    second = pairs.select(F.col("u").alias("u_child"), F.col("v").alias("v_child"))
    return first.join(graph.adj, F.col("v_parent") == F.col("src")).withColumnRenamed("dst", "v_child").join(second, ["u_child", "v_child"]).select("u_parent", "u_child", "v_parent", "v_child")


def edge_weights(graph: LabeledGraph, pairs: DataFrame, pattern: Pattern) -> dict[tuple[int, int], int]:
    edges = sorted(pattern.edges)
    if not edges:
        return {}
    found = {(r["u_parent"], r["u_child"]): r["n"] for r in edge_candidates(graph, pairs, edges).groupBy("u_parent", "u_child").agg(F.count("*").alias("n")).collect()}
    return {e: found.get(e, 0) for e in edges}


def refine(graph: LabeledGraph, pattern: Pattern, pairs: DataFrame, order: list[int]) -> tuple[DataFrame, int]:
    """(pairs, how many were dropped): alternating passes over the directed pattern, children first.

    In a pass each vertex, in topological order, keeps the candidates whose children (or parents) can be matched
    to different neighbours. The first pass that drops nothing ends it.
    """
    edges = directed(pattern, order)
    ranked = [u for u in order if pattern.degree(u)]
    pairs = materialised(pairs)
    start = n = pairs.count()
    children = True
    while True:
        for u in reversed(ranked) if children else ranked:
            near = [b for a, b in edges if a == u] if children else [a for a, b in edges if b == u]
            if near:
                pairs = _hall(graph, pairs, {u: near})
        pairs = materialised(pairs)
        left = pairs.count()
        if left == n:
            return pairs, start - left
        n, children = left, not children


def equivalent(cs_edges: DataFrame) -> DataFrame:
    """u, v, w: candidates w of u whose candidate neighbours include all of v's (v <> w)."""
    near = cs_edges.select(F.col("u_parent").alias("u"), F.col("v_parent").alias("v"), F.struct("u_child", "v_child").alias("to")).unionByName(cs_edges.select(F.col("u_child").alias("u"), F.col("v_child").alias("v"), F.struct(F.col("u_parent").alias("u_child"), F.col("v_parent").alias("v_child")).alias("to"))).distinct()
    size = near.groupBy("u", "v").agg(F.count("*").alias("n"))
    shared = near.join(near.withColumnRenamed("v", "w"), ["u", "to"]).filter("v <> w").groupBy("u", "v", "w").agg(F.count("*").alias("k"))
    return shared.join(size, ["u", "v"]).filter("k = n").select("u", "v", "w")
