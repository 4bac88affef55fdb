import random
from collections import Counter
from decimal import Decimal
from itertools import combinations_with_replacement

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import columns
from weftgraph.functions.columns import quantiles
from weftgraph.operators import candidates as cand
from weftgraph.operators import estimate as est
from weftgraph.operators import evaluate, generate, mining
from weftgraph.operators import graph as graphs
from weftgraph.operators.graph import LabeledGraph
from weftgraph.plans.pattern import Pattern
from weftgraph.plans.planner import graphql_order
from weftgraph.sources import formats

P = Pattern.of(["A", "B", "A", "C", "A"], [(0, 1), (1, 2), (0, 2), (2, 3)])


def graph(spark, vertices, edges):
    return LabeledGraph.of(spark.createDataFrame(vertices, "id long, label string"), spark.createDataFrame(edges, "src long, dst long"))


def test_edges_are_normalised(spark):
    g = graph(spark, [(1, "A"), (2, "B")], [(2, 1), (1, 2), (1, 1), (1, 2)])
    assert [tuple(r) for r in g.edges.collect()] == [(1, 2)]


def test_degrees_profiles_components(spark):
    g = LabeledGraph.from_pattern(spark, P)
    assert {r["id"]: r["deg"] for r in g.degrees().collect()} == {0: 2, 1: 2, 2: 3, 3: 1, 4: 0}
    assert {r["id"]: Counter(r["items"]) for r in g.profile_arrays().collect()} == {u: P.profile(u) for u in P.vertices}
    assert {r["id"]: r["n_subsets"] for r in g.profile_subsets().collect()}[2] == 3 * 2 * 2
    assert {r["id"]: r["component"] for r in g.components().collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert not g.connected() and g.diameter() is None
    line = graph(spark, [(i, "A") for i in range(6)], [(i, i + 1) for i in range(5)])
    assert line.diameter() == 5 and [r["id"] for r in line.leaves().orderBy("id").collect()] == [0, 5]


@pytest.mark.parametrize("n, kind", [(62, "bigint"), (63, "bigint"), (64, "decimal(38,0)"), (126, "decimal(38,0)"), (127, "string"), (15000, "string")])
def test_numbers_of_subsets_of_any_length(spark, n, kind):
    """A hub of n vertices with n - 1 labels, one of them twice; two such hubs."""
    g = graph(spark, [(i, f"L{max(i, 1)}") for i in range(n)], [(0, i) for i in range(1, n)])
    subsets = g.profile_subsets()
    expected = {0: 3 << n - 2, 1: 3} | {i: 4 for i in range(2, n)}
    assert {r["id"]: int(Decimal(r["n_subsets"])) for r in subsets.collect()} == expected and dict(subsets.dtypes)["n_subsets"] == kind
    row = g.union(g, n).stats().first()
    assert [int(Decimal(row[c])) for c in ("max_subsets", "sum_subsets")] == [max(expected.values()), 2 * sum(expected.values())]


@pytest.mark.parametrize("pairs", [4_000_000, 12])
def test_diameter_searches_from_few_vertices(spark, monkeypatch, pairs):
    monkeypatch.setattr(graphs, "PAIRS", pairs)
    roots, plain = [], LabeledGraph.distances
    monkeypatch.setattr(LabeledGraph, "distances", lambda self, ids, *near: roots.append(ids.count()) or plain(self, ids, *near))
    shapes = {"hub": ([(0, i) for i in range(1, 40)] + [(1, 2), (2, 3)], 2), "path": ([(i, i + 1) for i in range(7)], 7), "ring": ([(i, (i + 1) % 9) for i in range(9)], 4), "whole": ([(a, b) for b in range(6) for a in range(b)], 1), "tailed": ([(0, 1), (0, 2), (0, 3), (3, 4), (4, 5), (2, 5), (5, 6)], 4), "two": ([(0, 1)], 1)}
    for name, (edges, expected) in shapes.items():
        if pairs > 12 or name in ("hub", "ring", "tailed"):
            roots.clear()
            g = graph(spark, [(i, "A") for i in sorted({x for e in edges for x in e})], edges)
            assert g.diameter() == expected, name
            assert name != "hub" or sum(roots) == 1
    assert graph(spark, [(4, "A")], [(4, 4)]).diameter() == 0 and graph(spark, [], [(4, 4)]).diameter() is None


def test_frequent_profiles_against_enumeration(spark):
    g = LabeledGraph.from_pattern(spark, P)
    profiles = [P.profile(u) for u in P.vertices]
    expected = {}
    for k in (1, 2, 3):
        for items in combinations_with_replacement("ABC", k):
            n = sum(all(p[x] >= c for x, c in Counter(items).items()) for p in profiles)
            if n > 1:
                expected[items] = n
    assert {tuple(r["items"]): r["support"] for r in mining.frequent_profiles(g, 1.5, 3).collect()} == expected


def test_itemsets_by_hand(spark):
    g = graph(spark, [(1, "A"), (2, "A"), (3, "B"), (4, "A"), (5, "B"), (6, "A"), (7, "A")], [(1, 2), (1, 3), (4, 5), (6, 7)])
    found = {tuple(r["items"]): r["support"] for r in mining.frequent_profiles(g, 2).collect()}
    assert found[("A",)] == 7 and found[("A", "A")] == 4 and found[("A", "B")] == 4


def test_unions_of_stars():
    first, second = mining.star("A", ["A", "B", "C"]), mining.star("D", ["B", "B"])
    merged = mining.union_by_merge(first, second, {"B": 5}, 4)
    assert len(merged.labels) == 5 and len(merged.edges) == 4 and merged.connected()
    assert mining.union_by_merge(first, second, {"B": 5}, 5) is None
    linked = mining.union_by_edge(first, second, {("C", "B"): 3, ("B", "B"): 9}, 3)
    assert len(linked.labels) == 6 and len(linked.edges) == 6
    assert mining.union_by_edge(first, second, {("C", "B"): 2}, 3) is None


def test_samples_have_the_asked_properties(spark):
    g = graph(spark, [(i, "AB"[i % 2]) for i in range(30)], [(i, (i + d) % 30) for i in range(30) for d in (1, 2, 5)]).cached()
    samples = generate.random_neighbours(g, 6, 5)
    assert {r["n"] for r in samples.groupBy("lane").agg(F.count("*").alias("n")).collect()} == {5}
    rows = generate.with_properties(g, samples, generate.completed(g, samples), degree=(1.6, 2.0), diameter=(2, 4))
    for p in generate.patterns(rows).values():
        assert p.connected() and 1.6 <= p.average_degree() <= 2.0 and 2 <= p.diameter() <= 4
    walked, edges = generate.random_walks(g, 6, 4)
    assert {r["n"] for r in walked.groupBy("lane").agg(F.count("*").alias("n")).collect()} == {4}
    assert edges.join(g.edges, ["src", "dst"], "left_anti").isEmpty()
    assert sorted(map(tuple, samples.collect())) == sorted(map(tuple, generate.random_neighbours(g, 6, 5).collect()))


def test_hard_to_find(spark):
    g = graph(spark, [(i, "A") for i in range(12)], [(i, j) for i in range(12) for j in range(i) if (i + j) % 3]).cached()
    found = generate.hard_to_find(g, 3, 4, walks=50)
    assert found and all(len(p.labels) == 3 and value > 0 for p, value, *_ in found)
    same = generate.distinct_patterns({0: (P, 2.0), 1: (P.shifted(3), 4.0), 2: (P.without_edge((2, 3)), 5.0)})
    assert [(v, n) for _, v, n in same] == [(3.0, 1), (5.0, 0)]


def test_quantiles_and_fence(spark):
    v = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0, 10.0, None)] + [(2, 5.0), (3, 1.0), (3, 1.0), (3, 2.0)], "k int, v double")
    found = {r["k"]: (r["a"], r["b"]) for r in quantiles(v, ["k"], "v", {"a": 0.25, "b": 0.75}).collect()}
    assert found == {1: (1.5, 7.0), 2: (5.0, 5.0), 3: (1.0, 2.0)}
    rows = generate.outliers(spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 10])], "lane long, estimate double")).collect()
    assert {r["fence"] for r in rows} == {23.5} and [r["status"] for r in rows if r["estimate"] == 10] == ["possibly hard"]


def test_counts_of_roots_against_pairs(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(110)}
    g = graph(spark, [(i, "ABC"[i % 3]) for i in range(30)], list(edges)).cached()
    near = {v: {a for e in edges for a in e if v in e and a != v} for v in range(30)}
    ones, twos = [0, 1, 2, 3, 9], [2, 3, 4, 5, 6, 9]
    merged, linked = Counter(), Counter()
    for a in ones:
        for b in twos:
            if a != b:
                merged.update("ABC"[x % 3] for x in near[a] & near[b])
            linked.update(("ABC"[x % 3], "ABC"[y % 3]) for x in near[a] if x % 3 < 2 for y in near[b] if y % 3 > 0 and x != b and y != a and y in near[x])
    first, second = (spark.createDataFrame([(x,) for x in r], "id long") for r in (ones, twos))
    assert {r["label"]: r["n"] for r in mining.merge_counts(g, first, second).collect()} == merged
    assert {(r["label_1"], r["label_2"]): r["n"] for r in mining.edge_counts(g, first, second, ["A", "B"], ["B", "C"]).collect()} == linked


@pytest.mark.parametrize("few", [0, 20_000])
def test_levels_grown_by_joins_are_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(mining, "FEW", few)
    g = graph(spark, [(i, "ABCD"[i * i % 4]) for i in range(24)], [(i, (i + d) % 24) for i in range(24) for d in (1, 3, 7)]).cached()
    found = {tuple(r["items"]): r["support"] for r in mining.frequent_profiles(g, 5).collect()}
    profiles = [Counter(r["items"]) for r in g.profile_arrays().collect()]
    expected = {}
    for k in range(1, 8):
        for items in combinations_with_replacement("ABCD", k):
            n = sum(all(p[x] >= c for x, c in Counter(items).items()) for p in profiles)
            if n > 5:
                expected[items] = n
    assert found == expected


def test_combined_stars(spark):
    """Hubs H with leaves A and B, hubs K with leaves B and C, whose leaves are shared or linked."""
    vertices, edges = [], []
    for k in range(6):
        at = 10 * k
        vertices += [(at, "H"), (at + 1, "A"), (at + 2, "B"), (at + 3, "K"), (at + 4, "C")]
        edges += [(at, at + 1), (at, at + 2), (at + 3, at + 2), (at + 3, at + 4), (at + 1, at + 4)]
    g = graph(spark, vertices, edges).cached()
    itemsets = spark.createDataFrame([(["A", "B"], 6), (["B", "C"], 5)], "items array<string>, support long")
    merged = mining.combine_stars(g, itemsets, 2, 2, "merge", 5)
    assert merged.status == mining.COMBINED and sorted(merged.pattern.labels.values()) == ["A", "B", "C", "H", "K"] and len(merged.pattern.edges) == 4
    linked = mining.combine_stars(g, itemsets, 2, 2, "edge", 6)
    assert linked.status == mining.COMBINED and len(linked.pattern.labels) == 6 and len(linked.pattern.edges) == 5
    assert mining.combine_stars(g, itemsets, 2, 2, "edge", 7).status == mining.NOT_CONNECTED
    assert mining.combine_stars(g, itemsets.limit(1), 2, 2, "edge", 1).status == mining.ONE_STAR
    assert mining.combine_stars(g, itemsets, 2, 3, "edge", 1).status == mining.NO_STAR
    assert mining.combine_stars(g, itemsets.limit(1), 2, 2, "none").pattern == mining.star("H", ["A", "B"])


def test_walks_of_many_patterns_are_those_of_each(spark):
    g = graph(spark, [(i, "AB"[i % 3 > 0]) for i in range(30)], [(i, (i + d) % 30) for i in range(30) for d in (1, 2, 5)]).cached()
    found = {3: Pattern.of(["A", "B", "B"], [(0, 1), (1, 2)]), 8: Pattern.of(["A", "B", "B"], [(0, 1), (1, 2), (0, 2)]), 9: Pattern.of(["B", "A"], [(0, 1)]), 11: Pattern.of(["A", "A", "A", "A"], [(0, 1), (1, 2), (2, 3)]), 12: Pattern.of(["B"], []), 13: Pattern.of(["Z"], [])}
    means = {r["lane"]: r["mean"] for r in generate.estimates(g, found, walks=40).collect()}
    for lane, p in found.items():
        pairs = cand.materialised(cand.label_degree_profile(g, p))
        order = graphql_order(p, cand.sizes(pairs, p))[0]
        assert means[lane] == pytest.approx(est.summary(est.walks(g, p, pairs, order, 0, 40)).first()["mean"])


def test_walks_go_on_until_they_are_full(spark):
    """On a path, ten different vertices take more than a hundred steps now and then; a component of three never has them."""
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    g = graph(spark, [(i, "A") for i in [*range(41), 100, 101, 102]], path).cached()
    starts = {r["lane"]: r["id"] for r in generate.first_vertices(g, 12).collect()}
    walked, edges = generate.random_walks(g, 12, 10)
    counts = Counter(r["lane"] for r in walked.collect())
    assert counts == {lane: 10 for lane, v in starts.items() if v <= 40}
    assert edges.join(g.edges, ["src", "dst"], "left_anti").isEmpty()
    assert generate.random_walks(g, 12, 10, most_steps=9)[0].groupBy("lane").count().count() <= len(counts)


def test_hard_patterns_by_cell(spark):
    g = graph(spark, [(i, "A") for i in range(12)], [(i, j) for i in range(12) for j in range(i) if (i + j) % 3]).cached()
    cells = {"path": dict(degree=(1.3, 1.4), diameter=(2, 2)), "triangle": dict(degree=(2, 2), diameter=(1, 1)), "none": dict(degree=(2, 2), diameter=(2, 2))}
    found = generate.hard_grid(g, 3, 4, cells, walks=50)
    assert found["none"] == [] and all(len(p.edges) == 3 for p, *_ in found["triangle"])
    for name in ("path", "triangle"):
        single = generate.hard_to_find(g, 3, 4, walks=50, **cells[name])
        assert [(p, pytest.approx(v), n, status) for p, v, n, status in single] == found[name]
    rows = formats.hard_graph_rows(spark, found["none"], 3, 2, 2).unionByName(formats.hard_graph_rows(spark, found["path"], 3, 1, 2, first=4))
    assert rows.filter("status = 'none'").first()["idx"] is None and formats.next_index(rows, 3, 1, 2) == 4 + len(found["path"]) and formats.next_index(rows, 3, 2, 2) == 0
    grid = {(r["de"], r["di"]): (r["n_graphs"], r["mean_matchings"]) for r in evaluate.heat_map(rows, rows.select("size"), 2, 2).collect()}
    assert grid[(2, 2)] == (None, None) and grid[(1, 1)] == (-1, -1.0)


def test_statistics_files(spark, tmp_path):
    (tmp_path / "size_5_de_2_di_3_stats_7.txt").write_text(formats.hard_stats_text("hard", 12.5, None))
    (tmp_path / "size_5_de_2_di_3_stats_8.txt").write_text(formats.hard_stats_text("possibly hard", 1e3, 2, induced=False))
    (tmp_path / "size_5_de_4_di_1_stats.txt").write_text(formats.hard_stats_text("none"))
    (tmp_path / "size_5_graph1.txt").write_text("1\n0 A\n0\n")
    folder = tmp_path / "15" / "de3_di2" / "GenerationInfo"
    folder.mkdir(parents=True)
    both = formats.hard_stats_text("hard", 4.0, 1) + "\nEstimated Number Induce Matchings: 6.0\nNumber of Isomorphic Graphs Found: null\n"
    (folder / "graph1.txt").write_text(both)
    found = sorted(map(repr, map(tuple, formats.read_hard_stats(spark, str(tmp_path)).collect())))
    assert found == sorted(map(repr, [(5, 2, 3, 7, "hard", 12.5, 0), (5, 2, 3, 8, "possibly hard", 1000.0, 2), (5, 4, 1, None, "none", None, None), (15, 3, 2, None, "hard", 4.0, 1), (15, 3, 2, None, "hard", 6.0, 0)]))


def test_large_files_are_read_in_splits(spark, tmp_path):
    rng = random.Random(1)
    p = Pattern.of({i: rng.choice(["A", "B,C", "7"]) for i in range(300)}, [rng.sample(range(300), 2) for _ in range(900)])
    g = LabeledGraph.from_pattern(spark, p)
    formats.write_proteins(g, str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        back = formats.read_graph(spark, str(tmp_path / "p"), "proteins")
        assert {r["id"]: r["label"] for r in back.vertices.collect()} == p.labels and {tuple(r) for r in back.edges.collect()} == p.edges
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reports(spark):
    a = spark.createDataFrame([("q", "x"), ("q", "y"), ("q", "y")], "query string, mapping string")
    b = spark.createDataFrame([("q", "y"), ("q", "z")], "query string, mapping string")
    assert sorted(map(tuple, evaluate.differences(a, b).collect())) == [("q", "x", "unexpected"), ("q", "y", "unexpected"), ("q", "z", "missing")]
    runs = spark.createDataFrame([("a_b", 5, 10, 100), ("a_b", 5, None, None), ("c", 6, 4, 7)], "algorithm string, size int, n_matches long, n_backtracking long")
    table = evaluate.compare_algorithms(runs)
    assert [tuple(r) for r in evaluate.size_table(table).collect()] == [(5, 100.0, None), (6, None, 7.0)]
    assert r"a\_b" in evaluate.size_table_text(table)


def test_formats_round_trip(spark, tmp_path):
    g = LabeledGraph.from_pattern(spark, P)
    formats.write_proteins(g, str(tmp_path / "p"))
    formats.write_graph(g, str(tmp_path / "q"))
    (tmp_path / "g.igraph").write_text("t 1\nv 0 A B\nv 1 C\ne 1 0 x\ne 0 1 x\n")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for back in (formats.read_graph(spark, str(tmp_path / "p"), "proteins"), formats.read_graph(spark, str(tmp_path / "q"), "parquet")):
        assert rows(back.vertices) == rows(g.vertices) and rows(back.edges) == rows(g.edges)
    ig = formats.read_graph(spark, str(tmp_path / "g.igraph"), "igraph")
    assert rows(ig.vertices) == [(0, "A,B"), (1, "C")] and rows(ig.edges) == [(0, 1)]
    with pytest.raises(ValueError):
        formats.read_graph(spark, "x", "other")
    assert formats.parse_proteins("2\n# c\n0 A\n\n1 B\n1\n1 0\n") == ([(0, "A"), (1, "B")], [(1, 0)])


def test_report_files(spark, tmp_path):
    found = spark.createDataFrame([(1, "0->3;"), (2, "0->4;")], "idx long, mapping string")
    formats.write_report(formats.report_lines("a/q", "t", found, 12, 2, True), str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    row = formats.short_names(formats.parse_reports(spark.createDataFrame([(text,)], "value string"))).first()
    assert (row["query"], row["target"], row["induced"], row["n_backtracking"], row["n_matches"], row["mappings"]) == ("q", "t", True, 12, 2, ["0->3;", "0->4;"])


def test_command_line(spark, tmp_path):
    from weftgraph import cli

    formats.write_proteins(LabeledGraph.from_pattern(spark, P), str(tmp_path / "t"))
    formats.write_proteins(LabeledGraph.from_pattern(spark, Pattern.of(["A", "B"], [(0, 1)])), str(tmp_path / "q"))
    cli.main(["KnownGraphs", str(tmp_path / "q"), str(tmp_path / "t"), str(tmp_path / "out")])
    row = formats.read_reports(spark, str(tmp_path / "out")).agg(F.max("n_matches").alias("n")).first()
    assert row["n"] == 2
    cli.main(["Estimate", str(tmp_path / "q"), str(tmp_path / "t"), str(tmp_path / "e")])
    assert spark.read.json(str(tmp_path / "e")).first()["n"] == 100


def test_clusters_need_a_shared_folder():
    class Session:
        conf = {}

        class sparkContext:  # noqa: N801
            master, folder = "spark://head:7077", None
            getCheckpointDir = classmethod(lambda cls: cls.folder)  # noqa: N815
            setCheckpointDir = classmethod(lambda cls, folder: setattr(cls, "folder", folder))  # noqa: N815

    with pytest.raises(RuntimeError):
        columns.shared_folder(Session)
    Session.conf = {"spark.checkpoint.dir": "/shared/x"}
    assert columns.shared_folder(Session) == "/shared/x"
