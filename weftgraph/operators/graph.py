"""Labelled graphs as two tables, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.columns import bucketed, digits, largest_and_sum, materialised, tokens, whole, whole_type
from weftgraph.plans.pattern import Pattern


#: Pairs of a root and a vertex that breadth-first searches for the diameter hold at once.
PAIRS = 4_000_000


@dataclass(frozen=True)
class LabeledGraph:
    """vertices (id long, label string), edges (src long, dst long) with src < dst, each once."""

    vertices: DataFrame
    edges: DataFrame
    near: DataFrame | None = None  # both directions, where they are written

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> LabeledGraph:
        """From any list of edges: either direction, repeats and loops are allowed and come to one edge or none."""
        pairs = edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).filter("src <> dst").distinct()
        return cls(vertices.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label")), pairs)

    @classmethod
    def from_pattern(cls, spark: SparkSession, pattern: Pattern) -> LabeledGraph:
        return cls(spark.createDataFrame(sorted(pattern.labels.items()), "id long, label string"), spark.createDataFrame(sorted(pattern.edges), "src long, dst long"))

    def cached(self) -> LabeledGraph:
        """Both tables written to the shared folder, for plans of several actions; the edges in both directions, in buckets by src."""
        near = bucketed(self.adj, "src")
        return LabeledGraph(materialised(self.vertices), near.filter("src < dst"), near)

    @property
    def adj(self) -> DataFrame:
        """src, dst in both directions."""
        if self.near is not None:
            return self.near
        return self.edges.unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

    def degrees(self) -> DataFrame:
        """id, label, deg; isolated vertices have degree 0."""
        counted = self.adj.groupBy("src").agg(F.count("*").alias("deg"))
        return self.vertices.join(counted, F.col("id") == F.col("src"), "left").select("id", "label", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))

    def neighbour_labels(self) -> DataFrame:
        """id, label: a row for each vertex's own label and for each neighbour's."""
        near = self.adj.join(self.vertices, F.col("dst") == F.col("id")).select(F.col("src").alias("id"), "label")
        return self.vertices.select("id", "label").unionByName(near)

    def profile(self) -> DataFrame:
        """id, label, cnt: the multiset of a vertex's own and its neighbours' labels."""
        return self.neighbour_labels().groupBy("id", "label").agg(F.count("*").alias("cnt"))

    def profile_maps(self) -> DataFrame:
        """id, profile: the same as a map of labels to numbers, a row for each vertex."""
        return self.profile().groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "cnt"))).alias("profile"))

    def profile_arrays(self) -> DataFrame:
        """id, items: the same as a sorted array."""
        return self.neighbour_labels().groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("items"))

    def token_profile(self) -> DataFrame:
        """id, token, cnt: the same over the labels' tokens."""
        return self.neighbour_labels().select("id", F.explode(tokens("label")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("cnt"))

    def profile_subsets(self) -> DataFrame:
        """id, n_subsets: the number of distinct sub-multisets of the profile, the empty one included. Exact: all long or, where one needs it, all decimal(38,0), beyond that all strings of digits."""
        times = lambda a, c: F.try_multiply(a, (c + 1).cast("decimal(20,0)"))  # noqa: E731  null beyond 38 digits
        counts = self.profile().groupBy("id").agg(F.collect_list("cnt").alias("counts"))
        found = materialised(counts.select("id", F.aggregate("counts", F.lit(1).cast("decimal(38,0)"), times).alias("n_subsets"), "counts"))
        most, beyond = found.agg(F.max("n_subsets"), F.count_if(F.isnull("n_subsets"))).first()
        held = found.filter("n_subsets is not null").select("id", F.col("n_subsets").cast("string" if beyond else whole_type(most)).alias("n_subsets"))
        if not beyond:
            return held
        long = F.udf(lambda counts: digits(prod(c + 1 for c in counts)), "string")
        return held.unionByName(found.filter("n_subsets is null").select("id", long("counts").alias("n_subsets")))

    def induced(self, ids: DataFrame) -> LabeledGraph:
        """The subgraph of the given ids (column id) with all edges between them."""
        ids = ids.select("id").distinct()
        inside = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return LabeledGraph(self.vertices.join(ids, "id", "left_semi"), inside.select("src", "dst"))

    def with_edges(self, more: DataFrame) -> LabeledGraph:
        return LabeledGraph.of(self.vertices, self.edges.unionByName(more.select("src", "dst")))

    def without_edges(self, gone: DataFrame) -> LabeledGraph:
        pairs = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return LabeledGraph(self.vertices, self.edges.join(pairs, ["src", "dst"], "left_anti"))

    def with_vertices(self, more: DataFrame) -> LabeledGraph:
        return LabeledGraph(self.vertices.unionByName(more.select("id", "label")), self.edges)

    def copied(self, shift: int) -> LabeledGraph:
        return LabeledGraph(self.vertices.withColumn("id", F.col("id") + shift), self.edges.select((F.col("src") + shift).alias("src"), (F.col("dst") + shift).alias("dst")))

    def union(self, other: LabeledGraph, shift: int) -> LabeledGraph:
        """The disjoint union with ``other``, whose ids grow by ``shift``."""
        moved = other.copied(shift)
        return LabeledGraph(self.vertices.unionByName(moved.vertices), self.edges.unionByName(moved.edges))

    def leaves(self) -> DataFrame:
        return self.adj.groupBy("src").agg(F.count("*").alias("deg")).filter("deg = 1").select(F.col("src").alias("id"))

    def stats(self, subsets: DataFrame | None = None) -> DataFrame:
        """One row: vertices, edges, labels, largest and average degree, density, largest number and sum of distinct profile subsets (or of ``subsets``, a table like theirs)."""
        d = self.degrees().agg(F.count("*").alias("n_vertices"), F.countDistinct("label").alias("n_labels"), F.coalesce(F.max("deg"), F.lit(0)).alias("max_degree"), F.sum("deg").alias("total"))
        most, total = largest_and_sum(self.profile_subsets() if subsets is None else subsets, "n_subsets")
        n, e = F.col("n_vertices"), (F.col("total") / 2).cast("long")
        return d.select("n_vertices", e.alias("n_edges"), "n_labels", "max_degree", (F.col("total") / n).alias("avg_degree"), F.when(n > 1, 2.0 * e / (n * (n - 1))).alias("density"), whole(most).alias("max_subsets"), whole(total).alias("sum_subsets"))

    def components(self) -> DataFrame:
        """id, component: the smallest id that edges lead to. Labels spread and jump by pointers until nothing changes."""
        near = materialised(self.adj)
        state = materialised(self.vertices.select("id", F.col("id").alias("component")))
        while True:
            least = near.join(state, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("least"))
            grown = state.join(least, F.col("id") == F.col("src"), "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
            jump = grown.select(F.col("id").alias("at"), F.col("component").alias("further"))
            after = materialised(grown.join(jump, F.col("component") == F.col("at")).select("id", F.col("further").alias("component")))
            moved = after.join(state.withColumnRenamed("component", "before"), "id").filter("component <> before").isEmpty()
            state = after
            if moved:
                return state

    def connected(self) -> bool:
        return self.components().select("component").distinct().limit(2).count() <= 1

    def distances(self, roots: DataFrame, near: DataFrame | None = None) -> DataFrame:
        """root, id, dist: breadth first from each root (column id) over frontiers. near: the edges in both directions, where they are at hand."""
        near = materialised(self.adj) if near is None else near
        found = frontier = materialised(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("dist")).distinct())
        while True:
            step = frontier.join(near, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id"), (F.col("dist") + 1).alias("dist")).distinct()
            frontier = materialised(step.join(found, ["root", "id"], "left_anti"))
            if frontier.isEmpty():
                return found
            found = materialised(found.unionByName(frontier))

    def diameter(self) -> int | None:
        """The longest shortest path; None if not connected.

        Two vertices at most i from a first one are at most 2 i apart. So searches go from the vertices farthest from one of the highest degree inwards,
        until what is left cannot be farther apart than what was found; some in parts, where their pairs are more than PAIRS.
        """
        near = materialised(self.adj)
        degrees = materialised(self.degrees())
        n, fewest = degrees.agg(F.count("*"), F.min("deg")).first()
        if not n:
            return None
        if fewest == n - 1:
            return min(n - 1, 1)
        centre = degrees.orderBy(F.desc("deg"), "id").limit(1).select("id")
        around = materialised(degrees.join(self.distances(centre, near).select("id", "dist"), "id", "left"))
        if not around.filter("dist is null").isEmpty():
            return None
        top = around.agg(F.max("dist")).first()[0]
        best = max(top, 2)  # as two vertices without an edge are

        def farthest(roots: DataFrame) -> int:
            return self.distances(roots.select("id"), near).agg(F.max("dist")).first()[0] or 0

        while 2 * top > best:
            left = around.filter((2 * F.col("dist") > best) & (F.col("dist") <= top))
            if left.count() * n <= PAIRS:
                return max(best, farthest(left))
            level = around.filter(F.col("dist") == top)
            best = max(best, farthest(level.orderBy("deg", "id").limit(max(1, min(16, PAIRS // n)))))
            lots = level.count() * n // PAIRS + 1
            for k in range(lots):
                if 2 * top <= best:
                    break
                best = max(best, farthest(level.filter(F.pmod(F.xxhash64("id"), F.lit(lots)) == k)))
            top -= 1
        return best
