"""Command line: python -m weftgraph.cli VERB ... Every constant is an option; nothing is written over its input."""

from __future__ import annotations

import argparse
import itertools

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.columns import COMPLETE, SUBSETS
from weftgraph.operators import candidates as cand
from weftgraph.operators import backtrack
from weftgraph.operators import estimate as est
from weftgraph.operators import evaluate, generate, matcher, mining
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.planner import DYNAMIC, ORDERS, processing_order
from weftgraph.sources import formats


def _config(a) -> matcher.Config:
    return matcher.Config(a.candidates, a.order, a.enumeration, a.mode, a.gamma)


def _planned(a, graph, pattern):
    c = _config(a)
    pairs = cand.materialised(cand.candidates(graph, pattern, c.candidates, c.mode))
    sizes = cand.sizes(pairs, pattern)
    weights = cand.edge_weights(graph, pairs, pattern) if c.order == "quickSI" else None
    return pairs, processing_order(pattern, sizes, c.order, c.gamma, weights)


def known_graphs(spark, a):
    graph, pattern = formats.read_graph(spark, a.target, a.target_format).cached(), formats.read_pattern(spark, a.query, a.query_format)
    plan = matcher.plan(graph, pattern, _config(a))
    found = cand.materialised(matcher.report(plan.matches(a.induced), pattern))
    profile = cand.materialised(matcher.search_profile(plan, a.induced))
    calls = profile.agg(F.sum("n_calls")).first()[0]
    formats.write_report(formats.report_lines(a.query, a.target, found, calls, found.count(), a.induced), a.out)
    stats = spark.createDataFrame([(a.query, a.target, a.candidates, a.order, a.enumeration, int(calls), plan.pruned_locally, plan.pruned_globally, plan.refined, float(plan.order_cost))], "query string, target string, candidates string, processing_order string, enumeration string, n_backtracking long, pruned_locally long, pruned_globally long, refined long, order_cost double")
    stats.write.parquet(f"{a.out}-stats")
    profile.write.parquet(f"{a.out}-levels")
    if a.enumeration == "DAF":
        backtrack.failing_set_counters(plan, a.induced).write.parquet(f"{a.out}-failing-sets")


def _estimated(spark, a, query: str):
    graph, pattern = formats.read_graph(spark, a.target, a.target_format).cached(), formats.read_pattern(spark, query, a.query_format)
    pairs, order = _planned(a, graph, pattern)
    return est.estimate(graph, pattern, pairs, order, a.tau, a.walks, a.z, a.seed, a.induced)


def estimate(spark, a):
    _estimated(spark, a, a.query).withColumns({"query": F.lit(a.query), "target": F.lit(a.target)}).write.json(a.out)


def test_estimations(spark, a):
    """Estimates for the queries of match reports against the counts that these give."""
    rows = formats.read_reports(spark, a.reports).select("query", "n_matches").collect()  # one for each report
    out = [(r["query"], r["n_matches"], _estimated(spark, a, r["query"]).first()["estimate"]) for r in rows]
    est.relative_error(spark.createDataFrame(out, "query string, actual long, estimate long")).write.json(a.out)


def frequent_datasets(spark, a):
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    found = cand.materialised(mining.frequent_profiles(graph, a.support, a.longest))
    found = cand.materialised(found.join(mining.supporter_ids(graph, found), "items"))
    formats.write_itemsets(found, a.out)
    formats.itemset_lines(found).write.text(f"{a.out}-text")


def fdm_query(spark, a):
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    made = mining.combine_stars(graph, formats.read_itemsets(spark, a.itemsets), mining.minimum_support(a.support, graph.vertices.count()), a.size, a.connection, a.threshold)
    spark.createDataFrame([(made.status, len(made.stars))], "status string, n_stars int").write.json(f"{a.out}-status")
    pattern = made.pattern
    if pattern is None:
        return
    made = LabeledGraph.from_pattern(spark, pattern)
    formats.write_proteins(made, f"{a.out}-pattern")
    plan = matcher.plan(graph, pattern, _config(a))
    found = cand.materialised(matcher.report(plan.matches(a.induced), pattern))
    formats.write_report(formats.report_lines("pattern", a.target, found, None, found.count(), a.induced), a.out)


def _samples(spark, a, size, degree, diameter):
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    if a.method == "walk":
        samples, _ = generate.random_walks(graph, a.lanes, size, a.seed, a.most_steps)
    else:
        samples = generate.random_neighbours(graph, a.lanes, size, a.seed)
    return graph, generate.with_properties(graph, samples, generate.completed(graph, samples), degree, diameter, a.density, a.labels, a.seed)


def random_walk(spark, a):
    """Samples of a size, with the number of their matches."""
    graph, rows = _samples(spark, a, a.size, None, None)
    found = generate.patterns(rows)
    counts = generate.matches_of_samples(graph, found, a.induced, _config(a))
    for lane, p in found.items():
        formats.write_proteins(LabeledGraph.from_pattern(spark, p), f"{a.out}/size_{a.size}_graph{lane}")
    spark.createDataFrame(sorted(counts.items()), "lane long, n_matches long").write.json(f"{a.out}/matches")


def random_graph_with_prop(spark, a):
    """Samples of each size from --size to before --to whose properties are in the ranges."""
    for size in range(a.size, a.to):
        _, rows = _samples(spark, a, size, a.degree, a.diameter)
        for lane, p in generate.patterns(rows).items():
            formats.write_proteins(LabeledGraph.from_pattern(spark, p), f"{a.out}/size_{size}_graph{lane}")


def _write_hard(spark, a, size, de, di, found):
    """Rows and files of one cell; patterns are numbered on from those that the folder has."""
    stats = f"{a.out}/stats"
    try:
        first = formats.next_index(spark.read.parquet(stats), size, de, di)
    except AnalysisException:  # no earlier run
        first = 0
    formats.hard_graph_rows(spark, found, size, de, di, first).write.mode("append").parquet(stats)
    for i, (p, *_) in enumerate(found, first):
        formats.write_proteins(LabeledGraph.from_pattern(spark, p), f"{a.out}/size_{size}_de_{de}_di_{di}_graph_{i}")


def construct_hard_to_find(spark, a):
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    for size in a.sizes:
        grid = itertools.product(range(1, a.most_degree + 1), range(1, a.most_diameter + 1))
        cells = {(de, di): dict(degree=(de, de + 1), diameter=(di, di), density=a.density, labels=a.labels) for de, di in grid}
        for (de, di), found in generate.hard_grid(graph, size, a.lanes, cells, a.factor, a.walks, a.seed, a.induced, a.method).items():
            _write_hard(spark, a, size, de, di, found)


def prop_random_walk_estimation(spark, a):
    """One cell of the grid of hard patterns: samples of --size with a degree from --degree and a diameter from --diameter."""
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    found = generate.hard_to_find(graph, a.size, a.lanes, a.degree, a.diameter, a.density, a.labels, a.factor, a.walks, a.seed, a.induced, a.method)
    low = lambda pair: round(pair[0]) if pair else 0
    _write_hard(spark, a, a.size, low(a.degree), low(a.diameter), found)


def heat_map(spark, a):
    """The grid over the statistics files of a folder, and its ends."""
    hard = cand.materialised(formats.read_hard_stats(spark, a.stats))
    sizes = spark.createDataFrame([(n,) for n in a.sizes], "size int")
    grid = cand.materialised(evaluate.heat_map(hard, sizes, a.most_degree, a.most_diameter))
    grid.write.parquet(a.out)
    evaluate.heat_map_ends(grid).write.json(f"{a.out}-ends")


def prob_graph_with_props(spark, a):
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    out = None
    for size, de in itertools.product(a.sizes, range(1, a.most_degree + 1)):
        row = generate.share_found(graph, size, a.lanes, de, de + 1, a.seed).withColumn("degree", F.lit(de))
        out = row if out is None else out.unionByName(row)
    out.write.parquet(a.out)


def test_isomorphism(spark, a):
    """Matches against the mappings of match reports."""
    expected = formats.read_reports(spark, a.reports)
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    actual = None
    for r in expected.select("query", "induced").collect():
        pattern = formats.read_pattern(spark, r["query"], a.query_format)
        rows = matcher.report(matcher.match(graph, pattern, bool(r["induced"]), _config(a)), pattern).select(F.lit(r["query"]).alias("query"), "mapping")
        actual = rows if actual is None else actual.unionByName(rows)
    evaluate.differences(actual, expected.select("query", F.explode("mappings").alias("mapping"))).write.json(a.out)


def average(spark, a):
    evaluate.average_of_reports(formats.read_reports(spark, a.reports)).write.json(a.out)


def rewrite_names(spark, a):
    formats.short_names(formats.read_reports(spark, a.reports)).write.parquet(a.out)


def comparison(spark, a):
    graph = formats.read_graph(spark, a.target, a.target_format).cached()
    patterns = [formats.read_pattern(spark, q, a.query_format) for q in a.queries]
    evaluate.compare_algorithms(evaluate.run_comparison(graph, patterns, a.induced)).write.parquet(a.out)


#: Verb: (function, what it takes before --out).
VERBS = {
    "KnownGraphs": (known_graphs, ["query", "target"]),
    "Estimate": (estimate, ["query", "target"]),
    "TestEstimations": (test_estimations, ["reports", "target"]),
    "FrequentDatasets": (frequent_datasets, ["target"]),
    "FDMQuery": (fdm_query, ["itemsets", "target"]),
    "RandomWalk": (random_walk, ["target"]),
    "RandomGraphWithProp": (random_graph_with_prop, ["target"]),
    "ConstructHardToFindGraphs": (construct_hard_to_find, ["target"]),
    "PropRandomWalkEstimation": (prop_random_walk_estimation, ["target"]),
    "HeatMap": (heat_map, ["stats"]),
    "ProbGraphWithProps": (prob_graph_with_props, ["target"]),
    "TestIsomorphism": (test_isomorphism, ["reports", "target"]),
    "Average": (average, ["reports"]),
    "RewriteNames": (rewrite_names, ["reports"]),
    "Comparison": (comparison, ["target"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weftgraph")
    verbs = top.add_subparsers(dest="verb", required=True)
    pair = dict(nargs=2, type=float, metavar=("LOW", "HIGH"))
    for name, (_, takes) in VERBS.items():
        p = verbs.add_parser(name)
        for t in takes:
            p.add_argument(t)
        p.add_argument("out")
        p.add_argument("--target-format", default="proteins")
        p.add_argument("--query-format", default="proteins")
        p.add_argument("--candidates", default="graphQL", choices=cand.METHODS)
        p.add_argument("--order", default="graphQL", choices=(*ORDERS, DYNAMIC))
        p.add_argument("--enumeration", default="quickSI", choices=matcher.ENUMERATIONS)
        p.add_argument("--mode", default=SUBSETS, choices=(COMPLETE, SUBSETS))
        p.add_argument("--induced", default=True, action=argparse.BooleanOptionalAction)
        p.add_argument("--gamma", type=float, default=0.5)
        p.add_argument("--tau", type=float, default=100)
        p.add_argument("--walks", type=int, default=100)
        p.add_argument("--z", type=float, default=1.96)
        p.add_argument("--seed", type=int, default=7)
        p.add_argument("--lanes", type=int, default=100)
        p.add_argument("--most-steps", type=int, default=100_000)
        p.add_argument("--size", type=int, default=5)
        p.add_argument("--to", type=int, default=25)
        p.add_argument("--sizes", type=int, nargs="+", default=[5, 15, 25])
        p.add_argument("--most-degree", type=int, default=6)
        p.add_argument("--most-diameter", type=int, default=10)
        p.add_argument("--degree", **pair)
        p.add_argument("--diameter", **pair)
        p.add_argument("--density", **pair)
        p.add_argument("--labels", **pair)
        p.add_argument("--factor", type=float, default=3)
        p.add_argument("--method", default="neighbour", choices=generate.METHODS)
        p.add_argument("--support", type=float, default=0.1)
        p.add_argument("--longest", type=int)
        p.add_argument("--connection", default="edge", choices=("merge", "edge", "none"))
        p.add_argument("--threshold", type=float, default=100)
        p.add_argument("--queries", nargs="+", default=[])
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"weftgraph {a.verb}").getOrCreate()
    VERBS[a.verb][0](spark, a)


if __name__ == "__main__":
    main()
