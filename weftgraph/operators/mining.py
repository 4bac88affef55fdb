"""Frequent neighbourhood profiles (multisets of labels) and patterns built from them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import materialised
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern


def generate(level: DataFrame) -> DataFrame:
    """items one longer: two itemsets (sorted arrays, column items) with the same beginning, the later last item appended; an item may repeat."""
    k = F.size("items")
    cut = level.select(F.slice("items", 1, F.greatest(k - 1, F.lit(0))).alias("head"), F.element_at("items", -1).alias("last")) if level.columns else level
    other = cut.withColumnRenamed("last", "more")
    return cut.join(other, "head").filter("last <= more").select(F.concat("head", F.array("last", "more")).alias("items"))


def prune(grown: DataFrame, level: DataFrame) -> DataFrame:
    """The grown itemsets all of whose subsets with one item less are in the level."""
    less = grown.select("items", F.explode(F.sequence(F.lit(1), F.size("items"))).alias("i"))
    subsets = less.select("items", F.concat(F.slice("items", 1, F.col("i") - 1), F.slice("items", F.col("i") + 1, F.size("items"))).alias("part")).distinct()
    bad = subsets.join(level.select(F.col("items").alias("part")), "part", "left_anti").select("items").distinct()
    return grown.join(bad, "items", "left_anti")


#: Levels of so many itemsets at most are grown on the driver, larger ones by joins; the result is the same.
FEW = 20_000


def _grown(level: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """As generate and prune, for sorted tuples."""
    known, heads = set(level), {}
    for items in level:
        heads.setdefault(items[:-1], []).append(items[-1])
    out = [(*head, a, b) for head, lasts in heads.items() for a in lasts for b in lasts if a <= b]
    return [x for x in out if all(x[:i] + x[i + 1 :] in known for i in range(len(x)))]


def _needs(itemsets: DataFrame) -> DataFrame:
    """items, label (the first), needs (label to number) of each itemset."""
    labels = F.array_distinct("items")
    counts = F.transform(labels, lambda x: F.size(F.filter("items", lambda y: x == y)).cast("long"))
    return itemsets.select("items", F.element_at("items", 1).alias("label"), F.map_from_arrays(labels, counts).alias("needs"))


def _holding(profiles: DataFrame, itemsets: DataFrame, few: bool) -> DataFrame:
    """items and the columns of profiles (profile: label to number) for each itemset that a profile holds as a multiset.

    A profile meets the itemsets that begin with one of its labels; a few itemsets are sent to all executors.
    """
    needs = _needs(itemsets)
    needs = F.broadcast(needs) if few else needs
    met = profiles.select("*", F.explode(F.map_keys("profile")).alias("label")).join(needs, "label")
    return met.filter(F.forall(F.map_entries("needs"), lambda x: F.coalesce(F.col("profile")[x["key"]], F.lit(0)) >= x["value"])).drop("label", "needs")


def frequent_profiles(graph: LabeledGraph, min_support: float, longest: int | None = None) -> DataFrame:
    """items, support: multisets of labels in more than min_support profiles (a share of the vertices if at most 1), level by level.

    Equal profiles are counted once, with their number.
    """
    if min_support <= 1:
        min_support = min_support * graph.vertices.count()
    spark = graph.vertices.sparkSession
    profiles = graph.profile_maps().select(F.sort_array(F.map_entries("profile")).alias("entries")).groupBy("entries").agg(F.count("*").alias("many"))
    profiles = materialised(profiles.select(F.map_from_entries("entries").alias("profile"), "many"))
    enough = F.col("support") > min_support
    level = profiles.select(F.explode(F.map_keys("profile")).alias("label"), "many").groupBy("label").agg(F.sum("many").alias("support"))
    level = level.select(F.array("label").alias("items"), "support").filter(enough)
    schema, found, known, k = "items array<string>, support long", None, [], 1
    while True:
        # a level that the driver can hold comes as rows, one job each; a larger one is written
        rows = level.limit(FEW + 1).collect()
        if small := len(rows) <= FEW:
            known += [(r["items"], r["support"]) for r in rows]
        else:
            level = materialised(level)
            found = level if found is None else found.unionByName(level)
        if not rows or k == longest:
            break
        if small:
            grown = _grown(sorted(tuple(r["items"]) for r in rows))
            if not grown:
                break
            itemsets, few = spark.createDataFrame([(list(x),) for x in grown], "items array<string>"), len(grown) <= FEW
        else:
            itemsets = materialised(prune(generate(level), level))
            few = itemsets.count() <= FEW
        level = _holding(profiles, itemsets, few).groupBy("items").agg(F.sum("many").alias("support")).filter(enough)
        k += 1
    held = spark.createDataFrame(known, schema)
    return held if found is None else held.unionByName(found)


def supporters(graph: LabeledGraph, itemsets: DataFrame) -> DataFrame:
    """items, id: the vertices whose profile holds the itemset."""
    itemsets = materialised(itemsets.select("items"))
    return _holding(graph.profile_maps(), itemsets, itemsets.count() <= FEW).select("items", "id")


def supporter_ids(graph: LabeledGraph, itemsets: DataFrame) -> DataFrame:
    """items, ids: the sorted ids of the vertices whose profile holds the itemset, for reports of bounded size."""
    return supporters(graph, itemsets).groupBy("items").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def star_roots(graph: LabeledGraph, itemsets: DataFrame, min_support: float) -> DataFrame:
    """items, root, n: the most common label among the supporting vertices, where more than min_support have it; ties by label."""
    of = supporters(graph, itemsets).join(graph.vertices, "id").groupBy("items", "label").agg(F.count("*").alias("n"))
    best = of.withColumn("place", F.row_number().over(Window.partitionBy("items").orderBy(F.desc("n"), "label"))).filter("place = 1")
    return best.filter(F.col("n") >= min_support).select("items", F.col("label").alias("root"), "n")


def star(root: str, items: list[str]) -> Pattern:
    """The root with a leaf for each other item; one occurrence of the root's label is the root itself."""
    leaves = list(items)
    if root in leaves:
        leaves.remove(root)
    return Pattern.of([root, *leaves], [(0, i) for i in range(1, len(leaves) + 1)])


def _roots_around(graph: LabeledGraph, roots_1: DataFrame, roots_2: DataFrame) -> DataFrame:
    """x, n_1, n_2, n_both, first, second: how many roots of each set, and of both, are next to a vertex, and whether it is one of them itself. For all vertices next to a root, and roots."""
    one, two = (r.select("id").distinct().withColumn(c, F.lit(1)) for r, c in ((roots_1, "a"), (roots_2, "b")))
    roots = one.join(two, "id", "full").select("id", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    near = graph.adj.join(roots, F.col("src") == F.col("id")).select(F.col("dst").alias("x"), "a", "b", F.lit(0).alias("own_a"), F.lit(0).alias("own_b"))
    own = roots.select(F.col("id").alias("x"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("a").alias("own_a"), F.col("b").alias("own_b"))
    total = lambda c: F.sum(c).cast("long")
    return near.unionByName(own).groupBy("x").agg(total("a").alias("n_1"), total("b").alias("n_2"), total(F.col("a") * F.col("b")).alias("n_both"), F.max("own_a").alias("first"), F.max("own_b").alias("second"))


def merge_counts(graph: LabeledGraph, roots_1: DataFrame, roots_2: DataFrame) -> DataFrame:
    """label, n: common neighbours, by label, of pairs of different roots (columns id). Roots are counted at each neighbour, pairs are not listed."""
    pairs = F.col("n_1") * F.col("n_2") - F.col("n_both")
    around = _roots_around(graph, roots_1, roots_2).select("x", pairs.alias("pairs")).filter("pairs > 0")
    return around.join(graph.vertices, F.col("x") == F.col("id")).groupBy("label").agg(F.sum("pairs").alias("n"))


def edge_counts(graph: LabeledGraph, roots_1: DataFrame, roots_2: DataFrame, labels_1: list[str], labels_2: list[str]) -> DataFrame:
    """label_1, label_2, n: edges between a neighbour of one root and one of another, neither of them the other's root, by the neighbours' labels.

    Roots are counted at each end of an edge, pairs are not listed.
    """
    around = _roots_around(graph, roots_1, roots_2).join(graph.vertices, F.col("x") == F.col("id"))
    a = around.filter(F.col("label").isin(labels_1)).select(F.col("x").alias("src"), F.col("label").alias("label_1"), "n_1", "second")
    b = around.filter(F.col("label").isin(labels_2)).select(F.col("x").alias("dst"), F.col("label").alias("label_2"), "n_2", "first")
    met = graph.adj.join(a, "src").join(b, "dst").withColumn("n", (F.col("n_1") - F.col("first")) * (F.col("n_2") - F.col("second")))
    return met.filter("n > 0").groupBy("label_1", "label_2").agg(F.sum("n").alias("n"))


def union_by_merge(first: Pattern, second: Pattern, counts: dict[str, int], threshold: float) -> Pattern | None:
    """Both stars, with leaves of a label that roots share more than ``threshold`` times made one, one to one; None without any."""
    both, by = first.union(second)
    ours = {u: None for u in first.leaves()}
    pairs, used = [], set()
    for label, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        if n <= threshold:
            continue
        theirs = [v + by for v in second.leaves() if second.labels[v] == label and v + by not in used]
        for u in [u for u in ours if first.labels[u] == label]:
            if theirs:
                pairs.append((u, v := theirs.pop(0)))
                used.add(v)
    if not pairs:
        return None
    into = {v: u for u, v in pairs}
    return Pattern.of({u: label for u, label in both.labels.items() if u not in into}, [(into.get(a, a), into.get(b, b)) for a, b in both.edges])


def union_by_edge(first: Pattern, second: Pattern, counts: dict[tuple[str, str], int], threshold: float) -> Pattern | None:
    """Both stars, with an edge between leaves of labels that are linked ``threshold`` times or more, the most frequent first, each leaf once; None without any."""
    both, by = first.union(second)
    used: set[int] = set()
    edges = []
    for (a, b), n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        if n < threshold:
            continue
        left = [u for u in first.leaves() if first.labels[u] == a and u not in used]
        right = [v + by for v in second.leaves() if second.labels[v] == b and v + by not in used]
        if left and right:
            edges.append((left[0], right[0]))
            used |= {left[0], right[0]}
    return both.with_edges(edges) if edges else None


#: What came of combining stars.
NO_STAR, ONE_STAR, NOT_CONNECTED, COMBINED = "no star", "one star only", "not connected", "combined"


@dataclass(frozen=True)
class Combined:
    """status, the pattern (None unless stars were combined, or the first was asked for alone) and the stars it is made of, the most frequent first."""

    status: str
    pattern: Pattern | None
    stars: list[Pattern]


def combine_stars(graph: LabeledGraph, itemsets: DataFrame, min_support: float, size: int = 2, connection: str = "edge", threshold: float = 100) -> Combined:
    """The two most frequent stars among the frequent profiles of ``size`` items, ties by items, made one pattern.

    connection: merge, edge or none (the first star alone, whether there is a second or not).
    """
    if connection not in ("merge", "edge", "none"):
        raise ValueError(f"unknown connection: {connection}")
    sized = materialised(itemsets.filter(F.size("items") == size).select("items"))
    rows = star_roots(graph, sized, min_support).orderBy(F.desc("n"), "items").limit(2).collect()  # two are what is asked for
    stars = [star(r["root"], r["items"]) for r in rows]
    if not stars:
        return Combined(NO_STAR, None, stars)
    if connection == "none":
        return Combined(COMBINED, stars[0], stars[:1])
    if len(stars) == 1:
        return Combined(ONE_STAR, None, stars)

    def ids(row) -> DataFrame:
        wanted = sized.filter(F.col("items") == F.array(*map(F.lit, row["items"])))
        return supporters(graph, wanted).join(graph.vertices.filter(F.col("label") == row["root"]), "id").select("id")

    if connection == "merge":
        counts = {r["label"]: r["n"] for r in merge_counts(graph, *map(ids, rows)).collect()}
        joined = union_by_merge(*stars, counts, threshold)
    else:
        labels = [sorted({p.labels[u] for u in p.leaves()}) for p in stars]
        counts = {(r["label_1"], r["label_2"]): r["n"] for r in edge_counts(graph, *map(ids, rows), *labels).collect()}
        joined = union_by_edge(*stars, counts, threshold)
    return Combined(COMBINED if joined else NOT_CONNECTED, joined, stars)


def minimum_support(share: float, n: int) -> float:
    return share * n if share <= 1 else math.floor(share)
