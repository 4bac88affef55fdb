"""Sample patterns drawn from a graph, many at once: every lane is one sample, every round one step of all lanes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.columns import materialised, pick, quantiles
from weftgraph.operators import matcher
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import breadth_first_order, graphql_order, skeleton

METHODS = ("neighbour", "walk")


def first_vertices(graph: LabeledGraph, lanes: int, seed: int = 7) -> DataFrame:
    """lane, id: a start for each lane, the vertex with the least hash of seed, lane and id among those of the lane's hash bucket.

    Vertices are dealt to lanes by their own hash, so no global numbering is needed; a lane without vertices has no start.
    """
    lot = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("start"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    dealt = graph.vertices.select("id", lot.alias("lot")).withColumn("lane", F.col("lot") % lanes)
    return dealt.groupBy("lane").agg(F.min_by("id", F.struct("lot", "id")).alias("id"))


def _chosen(options: DataFrame, round_: int, seed: int) -> DataFrame:
    """lane, id: one of each lane's options by hash, over the ids in order."""
    lane = Window.partitionBy("lane")
    ranked = options.withColumn("n", F.count("*").over(lane)).withColumn("rank", F.row_number().over(lane.orderBy("id")) - 1)
    return ranked.filter(F.col("rank") == pick(F.col("n"), seed, F.col("lane"), round_)).select("lane", "id")


def random_neighbours(graph: LabeledGraph, lanes: int, size: int, seed: int = 7) -> DataFrame:
    """lane, step, id: grown by a random vertex next to what is there. Lanes that cannot grow to the size are dropped. Edges: all between the vertices."""
    near = materialised(graph.adj)
    grown = materialised(first_vertices(graph, lanes, seed).select("lane", F.lit(0).alias("step"), "id"))
    for step in range(1, size):
        options = grown.join(near, F.col("id") == F.col("src")).select("lane", F.col("dst").alias("id")).distinct().join(grown, ["lane", "id"], "left_anti")
        grown = materialised(grown.unionByName(_chosen(options, step, seed).select("lane", F.lit(step).alias("step"), "id")))
    full = grown.groupBy("lane").agg(F.count("*").alias("n")).filter(F.col("n") == size).select("lane")
    return grown.join(full, "lane", "left_semi")


def _filled(near: DataFrame, starts: DataFrame, size: int) -> list[int]:
    """The lanes whose start has ``size`` vertices at least in its component."""
    grown = materialised(starts.select("lane", "id"))
    while True:
        counts = grown.groupBy("lane").agg(F.count("*").alias("n"))
        small = grown.join(counts.filter(F.col("n") < size), "lane", "left_semi")
        more = materialised(small.join(near, F.col("id") == F.col("src")).select("lane", F.col("dst").alias("id")).distinct().join(small, ["lane", "id"], "left_anti"))
        if more.isEmpty():
            return [r["lane"] for r in counts.filter(F.col("n") >= size).collect()]  # a number for each lane
        grown = materialised(grown.unionByName(more))


def random_walks(graph: LabeledGraph, lanes: int, size: int, seed: int = 7, most_steps: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(lane, step, id of first visits; lane, src, dst of the edges walked): walks until ``size`` different vertices were met; other lanes are dropped.

    Lanes whose component is too small are dropped at once, so that no walk goes on to most_steps in vain. Where the lanes are is all that the driver holds;
    a step is one pass over the neighbours of these vertices, without a shuffle of the graph.
    """
    spark = graph.vertices.sparkSession
    starts = materialised(first_vertices(graph, lanes, seed))
    ranks = Window.partitionBy("src")
    near = materialised(graph.adj)
    alive = set(_filled(near, starts, size))
    near = materialised(near.withColumn("n", F.count("*").over(ranks)).withColumn("rank", F.row_number().over(ranks.orderBy("dst")) - 1))
    at = {r["lane"]: r["id"] for r in starts.collect() if r["lane"] in alive}  # a row for each lane
    seen = {lane: {v: 0} for lane, v in at.items()}
    walked: set[tuple[int, int, int]] = set()
    for step in range(1, most_steps + 1):
        going = [(lane, at[lane]) for lane in sorted(at) if len(seen[lane]) < size]
        if not going:
            break
        here = spark.createDataFrame(going, "lane long, id long")
        moved = near.filter(F.col("src").isin([v for _, v in going])).join(F.broadcast(here), F.col("src") == F.col("id"))
        for r in moved.filter(F.col("rank") == pick(F.col("n"), seed, F.col("lane"), step)).select("lane", "src", "dst").collect():
            at[r["lane"]] = r["dst"]
            seen[r["lane"]].setdefault(r["dst"], step)
            walked.add((r["lane"], min(r["src"], r["dst"]), max(r["src"], r["dst"])))
    full = {lane for lane, met in seen.items() if len(met) == size}
    visits = [(lane, step, v) for lane in sorted(full) for v, step in seen[lane].items()]
    return spark.createDataFrame(visits, "lane long, step int, id long"), spark.createDataFrame(sorted(e for e in walked if e[0] in full), "lane long, src long, dst long")


def completed(graph: LabeledGraph, samples: DataFrame) -> DataFrame:
    """lane, src, dst: all edges between a lane's vertices."""
    a, b = (samples.select("lane", F.col("id").alias(c)) for c in ("src", "dst"))
    return a.join(graph.edges, "src").join(b, ["lane", "dst"]).select("lane", "src", "dst")


def properties(graph: LabeledGraph, samples: DataFrame, edges: DataFrame) -> DataFrame:
    """lane, n, e, avg_degree, density, n_labels of each sample."""
    v = samples.join(graph.vertices, "id").groupBy("lane").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))
    e = edges.groupBy("lane").agg(F.count("*").alias("e"))
    n = F.col("n")
    return v.join(e, "lane", "left").withColumn("e", F.coalesce("e", F.lit(0)).cast("long")).select("lane", "n", "e", (2.0 * F.col("e") / n).alias("avg_degree"), F.when(n > 1, 2.0 * F.col("e") / (n * (n - 1))).alias("density"), "n_labels")


def feasible(rows: DataFrame, low: float, high: float) -> DataFrame:
    """rows (n, avg_degree) with ok: whether taking away edges can bring a connected sample's average degree into [low, high)."""
    tree = 2.0 * (F.col("n") - 1) / F.col("n")
    return rows.withColumn("ok", F.greatest(tree, F.lit(float(low))) < F.least(F.col("avg_degree"), F.lit(float(high))))


def _lot(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def trimmed(pattern: Pattern, degree=None, diameter=None, density=None, seed: int = 7, lane: int = 0) -> Pattern | None:
    """The pattern less edges, taken away by hash order and never ones that hold it together, until the ranges (low, high) hold; None if they cannot."""
    inside = lambda value, bounds: bounds is None or bounds[0] <= value <= bounds[1]
    left = sorted(pattern.edges, key=lambda e: (_lot(seed, lane, *e), e))
    while True:
        if inside(pattern.average_degree(), degree) and inside(pattern.diameter(), diameter) and inside(pattern.density(), density):
            return pattern
        while left:
            less = pattern.without_edge(left.pop(0))
            if less.connected():
                pattern = less
                break
        else:
            return None


def with_properties(graph: LabeledGraph, samples: DataFrame, edges: DataFrame, degree=None, diameter=None, density=None, labels=None, seed: int = 7) -> DataFrame:
    """lane, vertices (array of id, label), edges (array of src, dst): the samples trimmed to the ranges, those that can be."""
    v = samples.join(graph.vertices, "id").groupBy("lane").agg(F.sort_array(F.collect_list(F.struct("id", "label"))).alias("vertices"))
    e = edges.groupBy("lane").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("edges"))

    def trim(batches):
        for rows in batches:
            out = []
            for lane, vs, es in zip(rows["lane"], rows["vertices"], rows["edges"]):
                p = Pattern.of({x["id"]: x["label"] for x in vs}, [] if es is None else [(x["src"], x["dst"]) for x in es])
                if (labels is None or labels[0] <= len(set(p.labels.values())) <= labels[1]) and p.connected() and (t := trimmed(p, degree, diameter, density, seed, lane)):
                    out.append((lane, [dict(zip(("id", "label"), x)) for x in sorted(t.labels.items())], [dict(zip(("src", "dst"), x)) for x in sorted(t.edges)]))
            yield pd.DataFrame(out, columns=["lane", "vertices", "edges"])

    schema = "lane long, vertices array<struct<id:long,label:string>>, edges array<struct<src:long,dst:long>>"
    return v.join(e, "lane", "left").mapInPandas(trim, schema)


def patterns(rows: DataFrame) -> dict[int, Pattern]:
    """Patterns by lane on the driver, numbered from 0 by id."""
    out = {}
    for r in rows.orderBy("lane").collect():
        at = {x["id"]: i for i, x in enumerate(r["vertices"])}
        out[r["lane"]] = Pattern.of([x["label"] for x in r["vertices"]], [(at[x["src"]], at[x["dst"]]) for x in r["edges"]])
    return out


def share_found(graph: LabeledGraph, size: int, lanes: int, low: float, high: float, seed: int = 7) -> DataFrame:
    """size, p: the share of samples of a size that can be trimmed to an average degree in [low, high)."""
    samples = random_neighbours(graph, lanes, size, seed)
    ok = feasible(properties(graph, samples, completed(graph, samples)), low, high)
    return ok.agg(F.count_if("ok").alias("good")).select(F.lit(size).alias("size"), (F.col("good") / F.lit(lanes)).alias("p"))


def same_shape(a: Pattern, b: Pattern) -> bool:
    """Whether two patterns are the same but for the numbering of vertices."""
    key = lambda p: (len(p.edges), sorted((p.labels[u], p.degree(u), tuple(sorted(p.profile(u).items()))) for u in p.vertices))
    if key(a) != key(b):
        return False
    order = [u for part in a.components() for u, _ in a.breadth_first(part[0])]

    def place(done: dict[int, int]) -> bool:
        if len(done) == len(order):
            return True
        u = order[len(done)]
        for v in b.vertices:
            if v not in done.values() and a.labels[u] == b.labels[v] and a.degree(u) == b.degree(v) and all(a.adjacent(u, w) == b.adjacent(v, x) for w, x in done.items()):
                done[u] = v
                if place(done):
                    return True
                del done[u]
        return False

    return place({})


def distinct_patterns(found: dict[int, tuple[Pattern, float]]) -> list[tuple[Pattern, float, int]]:
    """(pattern, mean of the estimates, how many more were the same) without repeats of a shape."""
    kept: list[list] = []
    for _, (p, value) in sorted(found.items()):
        for k in kept:
            if same_shape(k[0], p):
                k[1].append(value)
                break
        else:
            kept.append([p, [value]])
    return [(p, sum(v) / len(v), len(v) - 1) for p, v in kept]


def outliers(estimates: DataFrame, factor: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """estimates (lane, estimate) with fence = Q3 + factor * (Q3 - Q1) and status: 'hard' above it, 'possibly hard' for the largest if none is, else 'usual'; for each group of keys."""
    keys = keys or []
    rows = estimates.withColumn("_all", F.lit(0))
    fence = quantiles(rows, ["_all", *keys], "estimate", {"q1": 0.25, "q3": 0.75}).select("_all", *keys, (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("fence"))
    most = rows.groupBy("_all", *keys).agg(F.max("estimate").alias("most"))
    status = F.when(F.col("estimate") > F.col("fence"), "hard").when((F.col("most") <= F.col("fence")) & (F.col("estimate") == F.col("most")), "possibly hard").otherwise("usual")
    return rows.join(fence.join(most, ["_all", *keys]), ["_all", *keys]).withColumn("status", status).drop("most", "_all")


def estimates(graph: LabeledGraph, found: dict[int, Pattern], walks: int = 100, seed: int = 7, induced: bool = True) -> DataFrame:
    """lane, mean: the mean weight of random walks (as of estimate.walks, over candidates by label, degree and profile in the greedy order) for many connected patterns at once.

    Patterns are rows of a small table, so all of them are estimated by the same few joins, whatever their number.
    """
    spark = graph.vertices.sparkSession
    needs = [(lane, u, p.labels[u], p.degree(u), dict(p.profile(u))) for lane, p in found.items() for u in p.vertices]
    vertices = materialised(graph.profile_maps().join(graph.degrees(), "id").select(F.col("id").alias("v"), "label", "deg", "profile"))
    needs = spark.createDataFrame(needs, "lane long, u int, label string, least long, needs map<string,long>")
    fits = (F.col("deg") >= F.col("least")) & F.forall(F.map_entries("needs"), lambda x: F.coalesce(F.col("profile")[x["key"]], F.lit(0)) >= x["value"])
    counts = vertices.join(F.broadcast(needs), "label").filter(fits).groupBy("lane", "u").agg(F.count("*").alias("n")).collect()  # a row for each vertex of each pattern
    sizes = {lane: dict.fromkeys(p.vertices, 0) for lane, p in found.items()}
    for r in counts:
        sizes[r["lane"]][r["u"]] = r["n"]
    steps = []
    for lane, p in found.items():
        order = breadth_first_order(p, graphql_order(p, sizes[lane])[0])
        place = {u: i for i, u in enumerate(order)}
        for i, s in enumerate(skeleton(p, order)):
            if i and s.parent is None:
                raise ValueError("estimates are for connected patterns")
            steps.append((lane, i, s.vertex, place.get(s.parent, -1), [place[v] for v in s.extra], [place[v] for v in s.absent]))
    steps = materialised(spark.createDataFrame(steps, "lane long, i int, u int, parent int, extra array<int>, absent array<int>").join(needs, ["lane", "u"]))
    roots = vertices.join(F.broadcast(steps.filter("i = 0")), "label").filter(fits).select("lane", "v")
    each = Window.partitionBy("lane")
    roots = roots.withColumn("n", F.count("*").over(each)).withColumn("rank", F.row_number().over(each.orderBy("v")) - 1)
    lanes = spark.createDataFrame([(lane,) for lane in found], "lane long").join(spark.range(walks).select(F.col("id").alias("walk")))
    taken = roots.join(F.broadcast(lanes), "lane").filter(F.col("rank") == pick(F.col("n"), seed, F.col("walk"), 0))
    state = materialised(lanes.join(taken.select("lane", "walk", F.array("v").alias("m"), F.col("n").cast("double").alias("weight")), ["lane", "walk"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))))
    near = materialised(graph.adj)
    done = state.filter("weight = 0").select("lane", "weight")
    for i in range(1, max((len(p.labels) for p in found.values()), default=0)):
        step = F.broadcast(steps.filter(F.col("i") == i).drop("i"))
        going = state.filter("weight > 0").join(step, "lane", "left")
        done = done.unionByName(going.filter("u is null").select("lane", "weight"))
        going = materialised(going.filter("u is not null"))
        choices = going.join(near, F.element_at("m", F.col("parent") + 1) == F.col("src")).join(vertices.withColumnRenamed("label", "its"), F.col("dst") == F.col("v")).filter((F.col("its") == F.col("label")) & fits & ~F.array_contains("m", F.col("dst")))
        each = Window.partitionBy("lane", "walk")
        ranked = choices.select("lane", "walk", "dst").withColumn("n", F.count("*").over(each)).withColumn("rank", F.row_number().over(each.orderBy("dst")) - 1)
        taken = ranked.filter(F.col("rank") == pick(F.col("n"), seed, F.col("walk"), i)).select("lane", "walk", "dst", "n")
        after = going.join(taken, ["lane", "walk"], "left")
        met = after.select("lane", "walk", "dst", "m", F.explode(F.concat("extra", "absent")).alias("at")).select("lane", "walk", F.element_at("m", F.col("at") + 1).alias("src"), "dst", "at")
        met = met.join(near, ["src", "dst"], "left_semi").groupBy("lane", "walk").agg(F.collect_set("at").alias("met"))  # places of one pattern
        after = after.join(met, ["lane", "walk"], "left").withColumn("met", F.coalesce("met", F.array().cast("array<int>")))
        right = F.size(F.array_except("extra", "met")) == 0
        if induced:
            right = right & ~F.arrays_overlap("absent", "met")
        weight = F.when(F.col("n").isNotNull() & right, F.col("weight") * F.col("n")).otherwise(0.0)
        state = materialised(after.select("lane", "walk", F.concat("m", F.array("dst")).alias("m"), weight.alias("weight")))
        done = done.unionByName(state.filter("weight = 0").select("lane", "weight"))
    done = done.unionByName(state.filter("weight > 0").select("lane", "weight"))
    return done.groupBy("lane").agg(F.avg("weight").alias("mean"))


def hard_grid(graph: LabeledGraph, size: int, lanes: int, cells: dict[tuple, dict], factor: float = 3.0, walks: int = 100, seed: int = 7, induced: bool = True, method: str = "neighbour") -> dict[tuple, list[tuple[Pattern, float, int, str]]]:
    """For each cell, (pattern, estimate, others of its shape, status) of the samples with its properties whose estimated matches are unusually many.

    cells: the ranges degree, diameter, density, labels of with_properties by any key. The same samples are trimmed for each cell, and all cells and lanes are estimated together.
    """
    if method not in METHODS:
        raise ValueError(f"unknown sampling method: {method}; known are {', '.join(METHODS)}")
    samples = materialised(random_neighbours(graph, lanes, size, seed) if method == "neighbour" else random_walks(graph, lanes, size, seed)[0])
    edges = materialised(completed(graph, samples))
    found, names = {}, list(cells)
    trimmed_rows = None
    for k, name in enumerate(names):
        rows = with_properties(graph, samples, edges, **cells[name], seed=seed).withColumn("lane", F.col("lane") + k * lanes)
        trimmed_rows = rows if trimmed_rows is None else trimmed_rows.unionByName(rows)
    if trimmed_rows is not None:
        found = patterns(trimmed_rows)
    out: dict[tuple, list] = {name: [] for name in names}
    if not found:
        return out
    means = materialised(estimates(graph, found, walks, seed, induced).select("lane", F.floor(F.col("lane") / lanes).alias("cell"), F.col("mean").alias("estimate")))
    flagged = outliers(means, factor, ["cell"]).collect()  # a row for each sample pattern
    for k, name in enumerate(names):
        for status in ("hard", "possibly hard"):
            values = {r["lane"]: (found[r["lane"]], r["estimate"]) for r in flagged if r["cell"] == k and r["status"] == status}
            out[name] += [(*d, status) for d in distinct_patterns(values)]
    return out


def hard_to_find(graph: LabeledGraph, size: int, lanes: int, degree=None, diameter=None, density=None, labels=None, factor: float = 3.0, walks: int = 100, seed: int = 7, induced: bool = True, method: str = "neighbour") -> list[tuple[Pattern, float, int, str]]:
    """(pattern, estimate, others of its shape, status): samples with the asked properties whose estimated matches are unusually many."""
    cell = dict(degree=degree, diameter=diameter, density=density, labels=labels)
    return hard_grid(graph, size, lanes, {(): cell}, factor, walks, seed, induced, method)[()]


def matches_of_samples(graph: LabeledGraph, found: dict[int, Pattern], induced: bool = True, config: matcher.Config = matcher.Config()) -> dict[int, int]:
    """The number of matches of each sample; at least one where the sample is induced."""
    return {lane: matcher.count_matches(graph, p, induced, config) for lane, p in found.items()}
