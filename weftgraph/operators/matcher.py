"""Enumeration of matches as a chain of joins in processing order.

An edge to the parent is a join with adjacency, further edges are semi-joins, forbidden ones (of induced
matches) anti-joins, and injectivity is a filter beside an equality. All mappings count, images under symmetries too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.columns import COMPLETE, materialised, numbered
from weftgraph.operators import candidates as cand
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import DYNAMIC, Step, graphql_order, processing_order, skeleton

ENUMERATIONS = ("groundTruth", "graphQL", "quickSI", "DAF", "VEQs")


def _linked(part: DataFrame, near: DataFrame, v: int, name: str, how: str) -> DataFrame:
    edge = near.select(F.col("_from").alias("_v"), F.col(name).alias("_x"))
    return part.join(edge, (F.col(f"m{v}") == F.col("_v")) & (F.col(name) == F.col("_x")), how)


def extend(part: DataFrame | None, graph: LabeledGraph, pairs: DataFrame, step: Step, induced: bool, injective: bool = True) -> DataFrame:
    """The partial matches with one more vertex. Of adjacency only the edges of the vertex's candidates take part, met in its buckets."""
    name = f"m{step.vertex}"
    own = pairs.filter(F.col("u") == step.vertex).select(F.col("v").alias(name))
    if part is None:
        return own
    before = part.columns
    near = own.join(graph.adj, F.col(name) == F.col("src")).select(F.col("dst").alias("_from"), name)
    if step.parent is None:
        part = part.crossJoin(own)  # another component of the pattern
    else:
        part = part.join(near, F.col(f"m{step.parent}") == F.col("_from")).drop("_from")
    if injective:
        for c in before:
            if c != f"m{step.parent}":  # no vertex is its own neighbour
                part = part.filter(F.col(c) != F.col(name))
    for v in step.extra:
        part = _linked(part, near, v, name, "left_semi")
    if induced:
        for v in step.absent:
            part = _linked(part, near, v, name, "left_anti")
    return part


def embeddings(graph: LabeledGraph, pattern: Pattern, pairs: DataFrame, order: list[int], induced: bool) -> DataFrame:
    """Columns m<u> for each pattern vertex, a row for each match."""
    part = None
    for step in skeleton(pattern, order):
        part = extend(part, graph, pairs, step, induced)
    return part.select(*[f"m{u}" for u in pattern.vertices])


@dataclass(frozen=True)
class Config:
    """candidates, order and enumeration by name, and how labels compare. ``gamma`` is the share of pairs that an edge is thought to keep."""

    candidates: str = "graphQL"
    order: str = "graphQL"
    enumeration: str = "quickSI"
    mode: str = COMPLETE
    gamma: float = 0.5
    globally: bool = True

    def checked(self) -> Config:
        if self.enumeration not in ENUMERATIONS:
            raise ValueError(f"unknown enumeration: {self.enumeration}; known are {', '.join(ENUMERATIONS)}")
        if self.order == DYNAMIC and self.enumeration in ("quickSI", "DAF", "VEQs"):
            raise ValueError(f"the dynamic order does not go with {self.enumeration}")
        return self


@dataclass
class Plan:
    """A pattern with its candidates and order (none where each partial match has its own), ready to be enumerated or counted."""

    graph: LabeledGraph
    pattern: Pattern
    pairs: DataFrame
    order: list[int]
    sizes: dict[int, int]
    order_cost: float = 0.0
    pruned_locally: int = 0
    pruned_globally: int = 0
    refined: int = 0
    config: Config = field(default_factory=Config)

    def matches(self, induced: bool) -> DataFrame:
        if self.config.order == DYNAMIC:
            return dynamic_levels(self.graph, self.pattern, self.pairs, induced)[0]
        return embeddings(self.graph, self.pattern, self.pairs, self.order, induced)

    def count(self, induced: bool) -> DataFrame:
        return self.matches(induced).agg(F.count("*").alias("n_matches"))


def plan(graph: LabeledGraph, pattern: Pattern, config: Config = Config()) -> Plan:
    """Filters candidates and chooses the order. The counts of candidates are all that the driver gets."""
    config = config.checked()
    local = cand.candidates(graph, pattern, config.candidates, config.mode, globally=False)
    local = materialised(local)
    sizes = cand.sizes(local, pattern)
    pairs, by_local = local, sum(sizes.values())
    if config.candidates == "graphQL" and config.globally:
        pairs = cand.prune_globally(graph, pattern, local)
        sizes = cand.sizes(pairs, pattern)
    weights = cand.edge_weights(graph, pairs, pattern) if config.order == "quickSI" else None
    order = [] if config.order == DYNAMIC else processing_order(pattern, sizes, config.order, config.gamma, weights)
    after_global, refined = sum(sizes.values()), 0
    if config.enumeration in ("DAF", "VEQs"):
        pairs, refined = cand.refine(graph, pattern, pairs, order)
        sizes = cand.sizes(pairs, pattern)
    cost = graphql_order(pattern, sizes, config.gamma)[1]
    total = graph.vertices.count() * len(pattern.labels)
    return Plan(graph, pattern, pairs, order, sizes, cost, total - by_local, by_local - after_global, refined, config)


def match(graph: LabeledGraph, pattern: Pattern, induced: bool = True, config: Config = Config()) -> DataFrame:
    return plan(graph, pattern, config).matches(induced)


def count_matches(graph: LabeledGraph, pattern: Pattern, induced: bool = True, config: Config = Config()) -> int:
    return plan(graph, pattern, config).count(induced).first()[0]


LEVELS = "level long, vertex long, n_partial long, n_candidates long, n_calls long, n_stuck long, n_conflicts long"


def search_profile(p: Plan, induced: bool) -> DataFrame:
    """level, vertex, n_partial (valid partial matches before it), n_candidates, n_calls = n_partial * n_candidates, n_stuck, n_conflicts.

    n_calls adds up to the number of backtracking calls that a depth-first search in this order makes. n_stuck counts partial
    matches without any extension before injectivity, n_conflicts the extensions that injectivity drops. With the dynamic
    order, as of dynamic_levels.
    """
    if p.config.order == DYNAMIC:
        return dynamic_levels(p.graph, p.pattern, p.pairs, induced)[1]
    rows, part = None, None
    spark = p.pairs.sparkSession
    for i, step in enumerate(skeleton(p.pattern, p.order)):
        if part is None:
            before, free = spark.createDataFrame([(1,)], "n long"), extend(None, p.graph, p.pairs, step, induced).withColumn("_row", F.lit(0))
        else:
            part = materialised(part.withColumn("_row", F.monotonically_increasing_id()))
            before, free = part.agg(F.count("*").alias("n")), extend(part, p.graph, p.pairs, step, induced, injective=False)
        images = [c for c in free.columns if c.startswith("m")]
        valid = F.size(F.array_distinct(F.array(*images))) == len(images)
        free = materialised(free.withColumn("_valid", valid))
        counts = before.crossJoin(free.agg(F.countDistinct("_row").alias("reached"), F.count_if(~F.col("_valid")).alias("lost")))  # one row each
        row = counts.select(F.lit(i).alias("level"), F.lit(step.vertex).alias("vertex"), F.col("n").alias("n_partial"), F.lit(p.sizes[step.vertex]).cast("long").alias("n_candidates"), (F.col("n") * p.sizes[step.vertex]).alias("n_calls"), (F.col("n") - F.col("reached")).alias("n_stuck"), F.col("lost").alias("n_conflicts"))
        rows = row if rows is None else rows.unionByName(row)
        part = free.filter("_valid").drop("_row", "_valid")
    return rows


def dynamic_levels(graph: LabeledGraph, pattern: Pattern, pairs: DataFrame, induced: bool) -> tuple[DataFrame, DataFrame]:
    """(matches with columns m<u>, levels): at each level, each partial match goes on with the vertex that has the fewest candidates left for it.

    Left for a vertex are its candidates that are next to the images of all its mapped neighbours; ties go to the highest degree, then to the
    smallest vertex. levels are as of search_profile with a row for each level and vertex that was chosen: n_candidates and n_calls add up the candidates
    that were left, n_stuck counts partial matches with a vertex that has none.
    """
    spark, us = pairs.sparkSession, pattern.vertices
    sizes = cand.sizes(pairs, pattern)
    number = lambda values: F.create_map(*[F.lit(x) for u in us for x in (u, values[u])])
    beside = F.create_map(*[x for u in us for x in (F.lit(u), F.array(*[F.lit(v) for v in pattern.neighbours(u)]).cast("array<int>"))])
    table = F.broadcast(spark.createDataFrame([(u, w) for u in us for w in pattern.neighbours(u)], "w int, u int"))  # the pattern's edges
    own = pairs.select("u", F.col("v").alias("x"))
    state = spark.createDataFrame([({},)], "m map<int,long>")
    levels = None
    for level in range(len(us)):
        state = materialised(state.withColumn("_row", F.monotonically_increasing_id()))
        asked = state.select("_row", "m", F.explode("m").alias("w", "image")).join(table, "w").filter(~F.map_contains_key("m", F.col("u"))).select("_row", "u", "image")
        due = asked.groupBy("_row", "u").agg(F.count("*").alias("due"))
        left = asked.join(graph.adj, F.col("image") == F.col("src")).withColumnRenamed("dst", "x").join(own, ["u", "x"]).groupBy("_row", "u", "x").agg(F.count("*").alias("met"))
        left = materialised(left.join(due, ["_row", "u"]).filter("met = due").select("_row", "u", "x"))
        linked = due.join(left.groupBy("_row", "u").agg(F.count("*").alias("n")), ["_row", "u"], "left").select("_row", "u", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("linked"))
        alone = state.select("_row", "m", F.explode(F.array(*map(F.lit, us))).alias("u")).filter(~F.map_contains_key("m", F.col("u")) & ~F.arrays_overlap(F.map_keys("m"), beside[F.col("u")]))
        alone = alone.select("_row", "u", number(sizes)[F.col("u")].cast("long").alias("n"), F.lit(False).alias("linked"))
        best = F.min_by(F.struct("u", "n", "linked"), F.struct("n", (-number({u: pattern.degree(u) for u in us})[F.col("u")]).alias("less"), "u"))
        chosen = materialised(linked.unionByName(alone).groupBy("_row").agg(best.alias("b")).select("_row", "b.*"))
        options = left.join(chosen.filter("linked").select("_row", "u"), ["_row", "u"]).unionByName(chosen.filter("not linked").join(own, "u").select("_row", "u", "x"))
        free = options.join(state, "_row")
        if induced:
            apart = free.select("_row", "x", "u", F.explode("m").alias("w", "image")).filter(~F.array_contains(beside[F.col("u")], F.col("w")))
            free = free.join(apart.join(graph.adj, (F.col("image") == F.col("src")) & (F.col("x") == F.col("dst"))).select("_row", "x"), ["_row", "x"], "left_anti")
        free = materialised(free.withColumn("_valid", ~F.array_contains(F.map_values("m"), F.col("x"))))
        lost = free.filter(~F.col("_valid")).groupBy("u").agg(F.count("*").alias("n_conflicts"))
        of = chosen.groupBy("u").agg(F.count("*").alias("n_partial"), F.sum("n").alias("n_candidates"), F.count_if(F.col("n") == 0).alias("n_stuck")).join(lost, "u", "left")
        of = of.select(F.lit(level).alias("level"), F.col("u").alias("vertex"), "n_partial", "n_candidates", F.col("n_candidates").alias("n_calls"), "n_stuck", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))
        levels = of if levels is None else levels.unionByName(of)
        state = free.filter("_valid").select(F.map_concat("m", F.create_map("u", "x")).alias("m"))
    return state.select(*[F.col("m")[u].alias(f"m{u}") for u in us]), levels


def mappings(matches: DataFrame, pattern: Pattern) -> DataFrame:
    """mapping: each match as 'u->v;...'."""
    return matches.select(F.concat_ws("", *[F.concat(F.lit(f"{u}->"), F.col(f"m{u}").cast("string"), F.lit(";")) for u in pattern.vertices]).alias("mapping"))


def report(matches: DataFrame, pattern: Pattern) -> DataFrame:
    """idx, mapping: each match as 'u->v;...' in the order of the strings, numbered from 1."""
    return numbered(mappings(matches, pattern), "mapping").select((F.col("idx") + 1).alias("idx"), "mapping")
